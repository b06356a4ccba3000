"""Literal cases of scalar functions and merges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.functions import arrays as A
from larkspur.functions import dates as D
from larkspur.functions import text as X
from larkspur.operators import merge as M
from larkspur.sources import tables as S
from larkspur.streaming import runs as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(text):
    return F.lit(text).cast("timestamp")


L = F.lit


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: X.normalized_title(L("Ａ b　Ｃ①")), "abc1"),
        (lambda: X.without_date_suffix(L("お知らせ　（2024/1/5 更新）")), "お知らせ"),
        (lambda: X.without_date_suffix(L("(1/5)")), "(1/5)"),
        (lambda: X.storage_key(L("https://Img.Example.com/a/b.png?x=1#f"), {"img.example.com": "img"}), "img/a/b.png"),
        (lambda: X.storage_key(L("https://other.com/a.png"), {"img.example.com": "img"}), None),
        (lambda: X.upstream_url(L("img/a/b.png"), {"img": "img.example.com"}), "https://img.example.com/a/b.png"),
        (lambda: X.rewritten_src(L("/img/img/a.png"), {"img.example.com": "img"}), "/img/img/a.png"),
        (lambda: X.rewritten_href(L("https://site.test/news/ABC?x#top"), "site.test", {"news": "news"}, "en"), "/en/news/abc#top"),
        (lambda: X.key_with_extension(L("a.b/c.gif"), L("image/png")), "a.b/c.png"),
        (lambda: X.string_hash(L("Hello世界")), -1823953368),
        (lambda: X.hash_id("r", L("")), "r00000000"),
        (lambda: X.collapsed_space(L("a \n b　 c")), "a b　 c"),
        (lambda: X.edge_trimmed(L("　 a　b 　")), "a　b"),
        (lambda: X.hex_colour(L("rgba(1, 2, 300, 0.5)")), "#0102FF"),
        (lambda: X.hex_colour(L("#abc")), "#AABBCC"),
        (lambda: X.without_fence(L("```json\n[1]\n```")), "[1]"),
        (lambda: X.without_scaffold(L("<article> <p>\ntext<p>"), ["article", "p"]), "text<p>"),
        (lambda: X.sniffed_mime(F.unhex(L("89504E470D0A"))), "image/png"),
        (lambda: X.sniffed_mime(F.unhex(L("5249464600000000574542505650"))), "image/webp"),
        (lambda: X.progress_text(L(5), L(10), L("units")), "5/10"),
        (lambda: X.composite_parts(L("a#b#c")), ["a", "b#c"]),
        (lambda: D.parsed_local(L("2024/01/05 09:30"), ts("2000-01-01")), dt.datetime(2024, 1, 5, 0, 30)),
        (lambda: D.parsed_local(L("nothing"), ts("2000-01-01")), dt.datetime(2000, 1, 1)),
        (lambda: D.date_in_title(L("x"), L(2024), L(3), ts("2000-01-01")), dt.datetime(2024, 2, 29, 15)),
        (lambda: D.inferred_date(L(12), L(30), L("2024-01-05").cast("date")), dt.date(2023, 12, 30)),
        (lambda: D.inferred_date(L(2), L(29), L("2023-03-01").cast("date")), None),
        (lambda: D.game_date(L("2024-01-05").cast("date"), L(5)), dt.date(2024, 1, 6)),
        (lambda: D.recheck_hours(L(1.0)), 1.0),
        (lambda: D.recheck_hours(L(72.0)), 3.0),
        (lambda: D.recheck_hours(L(1440.0)), 60.0),
        (lambda: D.recheck_hours(L(1464.0)), None),
        (lambda: D.retention_cutoff(ts("2024-05-31 00:00:00"), 3), dt.datetime(2024, 2, 29, 0, 0)),
        (lambda: D.event_attribute(L("span"), ts("2024-01-01 15:00:00")), "2024-01-02T00:00:00+09:00"),
        (lambda: D.event_attribute(L("allDay"), ts("2024-01-01 15:00:00")), "2024-01-02"),
        (lambda: D.seconds_to_hour(ts("2024-01-01 10:59:50")), 10),
        (lambda: D.parsed_iso(L("2024-01-02T00:00:00+09:00")), dt.datetime(2024, 1, 1, 15)),
        (lambda: D.parsed_iso(L("2024-01-02T00:00:00")), dt.datetime(2024, 1, 1, 15)),
        (lambda: D.parsed_iso(L("soon")), None),
        (lambda: D.plausible(ts("2024-01-01"), ts("2023-01-01"), ts("2024-01-01")), False),
        (lambda: D.until(ts("2024-01-01 03:00:00"), ts("2024-01-01")), "in 3h"),
        (lambda: A.cleaned_spans(L('[" a ", "", "b"]')), ["a", "b"]),
        (lambda: A.cleaned_spans(L("{bad")), []),
        (lambda: A.upper_median(F.array(L(4), L(1), L(3), L(2))), 3),
        (lambda: A.two_up_pad(L(1000)), 128),
        (lambda: R.from_engine(L("errored")), "failed"),
        (lambda: R.item_key(L("news"), L("x")), "news:x"),
    ],
)
def test_scalar(spark, column, want):
    assert one(spark, column()) == want


def test_title_batch_drops_single_entries(spark):
    df = spark.createDataFrame([('[{"id":"a","title":"x"},{"id":"a","title":"y"},{"id":"b","title":" "},{"id":"c","title":["z"]},{"title":"q"},5]',), ("broken",)], "t string")
    assert {(r["id"], r["title"]) for r in A.parsed_titles(df, "t").collect() if r["id"] != "c"} == {("a", "y")}


def test_checks(spark):
    rows = [("news", "1", "en", "title", "done", None, None, None, None, None), ("news", "2", "en", "title", "pending", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "item_type string, item_id string, language string, field string, state string, error string, value string, translated_at timestamp, model string, updated_at timestamp")
    bad = S.rejected(df, S.CHECKS["translations"]).collect()
    assert [(r["item_id"], r["failed_checks"]) for r in bad] == [("1", ["done_is_complete"])]
    with pytest.raises(Exception, match="done_is_complete"):
        S.asserted(df, S.CHECKS["translations"]).collect()


def test_glossary_files(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("ja,en\n\nあ,a, b\nい,c\n,x\n")
    assert [tuple(r) for r in S.glossary_csv(spark, str(path), "ja").collect()] == [("あ", "a, b"), ("い", "c")]
    assert ("あ", "a") in [tuple(r) for r in S.glossary_csv_all_commas(spark, str(path)).collect()]


def test_guard_of_the_last_language(spark):
    langs = spark.createDataFrame([("en", True), ("fr", False)], "code string, enabled boolean")
    assert M.guarded_languages(langs, langs).count() == 2
    with pytest.raises(Exception, match="last enabled"):
        M.guarded_languages(langs, langs.withColumn("enabled", F.lit(False))).collect()


def test_merges_are_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    s = spark.createDataFrame([(2, "B", 20), (3, "C", 30)], "k int, x string, y int")
    once = M.key_merge(t, s, ["k"], ["y"])
    twice = M.key_merge(once, s, ["k"], ["y"])
    want = {(1, "a", 1), (2, "b", 20), (3, "C", 30)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
    state, new = M.insert_new(t, s, ["k"])
    assert {r["k"] for r in new.collect()} == {3} and state.count() == 3
    empty = M.sync_active(t.withColumn("active", F.lit(True)), s.limit(0), "k", ["x"])
    assert not any(r["active"] for r in empty.collect())


def test_schemas_load(spark):
    assert len(S.SCHEMAS) == 15 and all(S.empty(spark, n).count() == 0 for n in ("news_items", "reset_milestones"))
