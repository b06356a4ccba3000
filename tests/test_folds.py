"""Folds and streams against plain Python twins."""

import random
import time

from pyspark.sql import functions as F

from larkspur.operators import listing, merge, resolve, temporal
from larkspur.plans import streams as plans
from larkspur.streaming import runs


def test_lanes_first_fit(spark):
    rng = random.Random(1)
    rows = [(c, i, s := rng.randint(0, 50), s + rng.randint(1, 9)) for c in range(4) for i in range(25)]
    got = {(r["c"], r["id"]): (r["lane"], r["lanes"]) for r in temporal.lanes(spark.createDataFrame(rows, "c int, id int, s int, e int"), ["c"], "s", "e", "id").collect()}
    for c in range(4):
        ends: list[int] = []
        own = {}
        for s, i, e in sorted((s, i, e) for k, i, s, e in rows if k == c):
            lane = next((k for k, end in enumerate(ends) if end <= s), len(ends))
            ends[lane : lane + 1] = [e]
            own[i] = lane
        assert all(got[c, i] == (lane, len(ends)) for i, lane in own.items())


def test_attached_and_cooled_starts(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(0, 500), rng.randint(1, 40), rng.random() < 0.1) for i, k in enumerate(rng.choices(range(5), k=200))]
    df = spark.createDataFrame([(k, i, t, t + n, f) for k, i, t, n, f in rows], "k int, id int, at int, until int, force boolean")
    got = {r["id"]: r["run"] for r in runs.attached_starts(df, ["k"]).collect()}
    cool = {r["id"]: r["accepted"] for r in runs.cooled_starts(df.withColumn("at_us", F.col("at").cast("long")), ["k"], 30).collect()}
    for k in range(5):
        run, until, last = None, None, None
        for t, i, n, f in sorted((t, i, n, f) for kk, i, t, n, f in rows if kk == k):
            if until is None or t >= until:
                run, until = i, t + n
            assert got[i] == run
            ok = last is None or f or t - last >= 30
            last = t if ok else last
            assert cool[i] == ok


def test_cluster_chains(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randint(0, 4000)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, title string, s long").select("id", "title", F.timestamp_micros("s").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.timestamp_micros("s").alias("created"))
    got = {r["id"]: r["survivor"] for r in resolve.clusters(df, tolerance=25).collect()}
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t, s in rows:
        for j, u, v in rows:
            if i < j and t == u and abs(s - v) <= 25:
                parent[find(j)] = find(i)
    at = {i: s for i, _, s in rows}
    for i in at:
        group = [j for j in at if find(j) == find(i)]
        assert got[i] == min(group, key=lambda j: (at[j], j))


def test_resolve_article(spark):
    ts = lambda d: f"2024-01-{d:02d} 06:00:00"
    cast = lambda df: df.withColumn("start", F.col("start").cast("timestamp")).withColumn("end", F.col("end").cast("timestamp"))
    extracted = cast(spark.createDataFrame([(0, "span", "x", ts(1), ts(9)), (1, "span", "x", ts(2), None), (2, "span", "y", ts(3), None), (3, "span", "z", ts(4), None)], "pos int, type string, title string, start string, end string"))
    pool = cast(spark.createDataFrame([("e1", "span", "x", ts(1), None), ("e2", "span", "other", ts(4), None), ("e3", "span", "gone", ts(20), None)], "id string, type string, title string, start string, end string"))
    links = spark.createDataFrame([("e1", "news", "n9"), ("e3", "news", "n1")], "event_id string, source_type string, source_id string")

    def judge(pairs):
        return spark.createDataFrame([(3, "e2"), (2, "e3")], "pos int, event_id string")

    out = resolve.resolve_article(extracted, pool, links, ("news", "n1"), lambda pos: F.concat(F.lit("new"), pos.cast("string")), judge)
    assert {(r["pos"], r["id"]) for r in out["chosen"].collect()} == {(0, "e1"), (2, "new2"), (3, "e2")}
    assert {r["event_id"] for r in out["stale"].collect()} == {"e3"}
    assert {r["id"] for r in out["orphans"].collect()} == {"e3"}


def test_day_overlap_is_half_open(spark):
    rows = [("a", "2024-01-01 10:00", "2024-01-02 00:00"), ("b", "2024-01-02 00:00", "2024-01-02 01:00"), ("c", "2024-01-01 23:00", "2024-01-02 01:00"), ("d", "2024-01-02 00:00", None)]
    df = spark.createDataFrame(rows, "id string, start string, end string").select("id", F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end"))
    got = {(r["id"], str(r["day"])) for r in temporal.overlapping_days(df, "start", "end").collect()}
    assert got == {("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-01"), ("c", "2024-01-02"), ("d", "2024-01-02")}


def test_stream_equals_batch(spark, tmp_path):
    definition = [("fetch", "step"), ("scan", "phase"), ("translate", "units")]
    all_reports = plans.reports(spark, "/root/testdata/sf0.001")
    source, check = f"{tmp_path}/in", f"{tmp_path}/check"
    for k in range(3):
        all_reports.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(source)
    all_reports.where("seq % 5 = 0").coalesce(1).write.mode("append").parquet(source)  # repeats
    stream = spark.readStream.schema(all_reports.schema).option("maxFilesPerTrigger", 4).parquet(source)
    q = runs.snapshot_stream(stream, definition).writeStream.outputMode("update").format("memory").queryName("snaps").option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = {}
    for r in spark.sql("select * from snaps").collect():
        last[r["run_id"]] = r
    twins: dict[str, runs.RunState] = {}
    for r in all_reports.orderBy("seq").collect():
        twins.setdefault(r["run_id"], runs.RunState(definition)).apply(r.asDict())
    assert last.keys() == twins.keys()
    for run, t in twins.items():
        want = "|".join(f"{s}:{k}:{state}:{n}:{'' if total is None else total}" for s, k, state, n, total in t.rows())
        assert (last[run]["steps"], last[run]["status"]) == (want, t.status)


def test_stream_forgets_settled_runs(spark, tmp_path):
    """After the retention a settled run begins anew; one that is still active keeps its units."""
    source, check = f"{tmp_path}/in", f"{tmp_path}/check"
    rows = lambda k: [("a", k, "unit", "translate", f"u{k}", None, None, None), ("b", k, "unit", "translate", f"u{k}", None, None, None), ("a", k + 10, "status", None, None, None, None, "complete")]
    for k in range(3):
        spark.createDataFrame(rows(k), runs.REPORT).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(runs.REPORT).option("maxFilesPerTrigger", 1).parquet(source)
    q = runs.snapshot_stream(stream, [("translate", "units")], retention_ms=0).writeStream.outputMode("update").format("memory").queryName("forgetful").option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(180)
    units = {}
    for r in spark.sql("select * from forgetful order by seq").collect():
        units.setdefault(r["run_id"], []).append(int(r["steps"].split(":")[3]))
    assert units == {"a": [1, 1, 1], "b": [1, 2, 3]}


def test_with_new_ids_is_stable(spark):
    target = spark.createDataFrame([("b", 7)], "key string, id long")
    keys = spark.createDataFrame([("c",), ("a",), ("b",), ("é",), ("ab",)], "key string")
    assert {r["key"]: r["id"] for r in merge.with_new_ids(target, keys, "key").collect()} == {"b": 7, "a": 8, "ab": 9, "c": 10, "é": 11}


def test_contained_terms_in_slices(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, "bcd")], "id int, t string")
    terms = spark.createDataFrame([("a",), ("bc",), ("d",), ("x",)], "w string")
    got = {(r["id"], r["w"]) for r in listing.contained_terms(texts, terms, "t", "w", most_terms=1).collect()}
    assert got == {(1, "a"), (1, "bc"), (2, "bc"), (2, "d")}
