"""Queries that agreed with their SQL on the smallest tables only; each test has what larger tables bring."""

import duckdb
from pyspark.sql import functions as F

from larkspur.functions import arrays as A
from larkspur.plans import catalog
from larkspur.streaming import runs


def against_duckdb(spark, folder, name, table):
    """Rows of the query and of its SQL on one table, as sorted lists of dictionaries."""
    con = duckdb.connect()
    con.execute(f"create view {table} as from '{folder}/{table}.parquet/*.parquet'")
    result = con.execute(catalog.SQL[name])
    names = [x[0] for x in result.description]
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    got = [r.asDict() for r in catalog.QUERIES[name](spark, str(folder)).collect()]
    rows = lambda some: sorted((sorted(r.items()) for r in some), key=repr)
    return rows(got), rows(want)


def test_the_last_of_several_title_texts_wins(spark):
    texts = [(2, '[{"id":"a","title":"new"}]'), (1, '[{"id":"b","title":"x"},{"id":"a","title":"old"}]'), (3, "broken")]
    df = spark.createDataFrame(texts, "n int, t string")
    assert {tuple(r) for r in A.parsed_titles(df, "t", "n").collect()} == {("a", "new"), ("b", "x")}


def test_title_texts_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    k = F.col("id")
    spark.range(3500).select(k.alias("o_orderkey"), (k % 900).alias("o_custkey"), F.concat(F.lit("x"), k).alias("o_orderpriority")).write.parquet(str(tmp_path / "orders.parquet"))
    parsed, texts = A.parsed_titles, []
    monkeypatch.setattr(A, "parsed_titles", lambda df, text, *order: texts.extend(r[text] for r in df.collect()) or parsed(df, text, *order))
    got, want = against_duckdb(spark, tmp_path, "parsed_title_batches", "orders")
    assert got == want
    assert sorted(t.count('"id"') for t in texts) == [500, 1000, 1000, 1000]


def test_frames_whose_ids_do_not_follow_time(spark, tmp_path):
    i = F.col("id")
    at = F.timestamp_micros(1704067200000000 + (i * 7919 % 400) * 60_000_000 * 50).cast("timestamp_ntz")
    kind = F.when(i % 13 == 0, "error").otherwise("view")
    spark.range(400).select(i.alias("event_id"), at.alias("ts"), (i % 3).alias("user_id"), kind.alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_duckdb(spark, tmp_path, "coalesced_frames", "events")
    assert len(got) == 400 and got == want


def test_guarded_frames_drop_what_is_not_newer(spark):
    frames = spark.createDataFrame([(1, 0, 5, False), (1, 600, 4, False), (1, 1200, 6, False)], "who int, at_ms long, seq long, terminal boolean")
    sent = lambda **how: [(r["seq"], r["sent_ms"]) for r in runs.coalesced_frames(frames, ["who"], **how).orderBy("at_ms").collect()]
    assert sent() == [(5, 0), (6, 1200)]
    assert sent(guarded=False) == [(5, 0), (4, 600), (6, 1200)]


def test_rechecks_by_rounded_hours(spark, tmp_path):
    cents = F.element_at(F.array(*[F.lit(x) for x in (0.49, 0.5, 0.51, 0.99)]), (F.col("id") % 4 + 1).cast("int"))
    at = F.timestamp_micros(788832000000000 + (F.col("id") % 3) * 86_400_000_000).cast("timestamp_ntz")
    rows = spark.range(60).select(F.col("id").alias("o_orderkey"), at.alias("o_orderdate"), (F.col("id") * 7 % 60 + 970 + cents).alias("o_totalprice"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    got, want = against_duckdb(spark, tmp_path, "recheck_queue", "orders")
    assert {dict(r)["bucket"] for r in got} == {"due", "upcoming"} and got == want


def test_titles_with_cut_references(spark, tmp_path):
    titles = ["a &amp;&amp; b&amp", "&quot;a&quot", "a&am", "R&D & x", "&amp;amp; &amp;quot; &ampx; &lt; &#39;", "plain"]
    pages = [(i, f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{t}</p></article></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame([*pages, (9, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = against_duckdb(spark, tmp_path, "page_title", "pages")
    assert len(got) == 7 and got == want
