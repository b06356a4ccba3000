"""Runs, steps and units: idempotent reports to snapshots, as a batch and as a stream.

A report names a run and one fact: a unit of a step is done, a step's total or
state, or the run's status.  Facts may repeat and arrive twice; a unit counts once.
`running` after a terminal status is dropped, a terminal status always applies.
Reports of unknown runs are dropped; units of undeclared steps are kept but not shown.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import sorted_fold

REPORT = "run_id string, seq long, kind string, step string, unit string, state string, total int, status string"
SNAPSHOT = "run_id string, seq long, status string, steps string"
TERMINAL = ("complete", "failed", "unknown")


def snapshots(reports: DataFrame, runs: DataFrame, definition: DataFrame) -> DataFrame:
    """The last snapshot of each run, one row for each declared step, by partial aggregations.

    runs: (run_id, flow); definition: (flow, step, ord, kind).
    """
    known = reports.join(runs.select("run_id"), "run_id", "left_semi")
    seeded = runs.join(F.broadcast(definition), "flow")  # the flows of the program text
    facts = known.groupBy("run_id", "step").agg(
        F.count_distinct(F.when(F.col("kind") == "unit", F.col("unit"))).alias("current"),
        F.max_by("total", F.when((F.col("kind") == "total"), F.col("seq"))).alias("total"),
        F.max_by("state", F.when((F.col("kind") == "step"), F.col("seq"))).alias("state"),
    )
    status = known.groupBy("run_id").agg(settled_status(F.col("kind"), F.col("status"), F.col("seq")).alias("status"), F.max("seq").alias("seq"))
    return (
        seeded.join(facts, ["run_id", "step"], "left")
        .join(status, "run_id", "left")
        .select("run_id", F.coalesce("status", F.lit("queued")).alias("status"), F.coalesce("seq", F.lit(0)).alias("seq"), "step", "ord", "kind", F.coalesce("state", F.lit("pending")).alias("state"), F.coalesce("current", F.lit(0)).alias("current"), "total")
    )


def settled_status(kind: Column, status: Column, seq: Column) -> Column:
    """The last terminal status, or the last status if none is terminal."""
    own = kind == "status"
    return F.coalesce(F.max_by(status, F.when(own & status.isin(*TERMINAL), seq)), F.max_by(status, F.when(own, seq)))


def shown_status(status: Column) -> Column:
    return F.when(status == "unknown", "failed").otherwise(status)


def segment_view(steps: DataFrame) -> DataFrame:
    """Pending steps after a failed one of their run are not reached."""
    failed = F.min(F.when(F.col("state") == "failed", F.col("ord"))).over(Window.partitionBy("run_id"))
    return steps.withColumn("view", F.when((F.col("state") == "pending") & (F.col("ord") > failed), "not-reached").otherwise(F.col("state")))


def unfinished(steps: DataFrame) -> DataFrame:
    """Complete runs with the steps that never finished."""
    open_steps = steps.where((F.col("status") == "complete") & ~F.col("state").isin("done", "skipped"))
    return open_steps.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "step"))), lambda x: x["step"]).alias("unfinished"))


def monotone_frames(frames: DataFrame, run: str = "run_id", seq: str = "seq", arrival: str = "arrival") -> DataFrame:
    """Frames whose seq exceeds all that arrived before in their run."""
    before = F.max(seq).over(Window.partitionBy(run).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(seq) > F.col("_before"))).drop("_before")


def attached_starts(starts: DataFrame, key: list[str]) -> DataFrame:
    """(key..., id, run): a start attaches to the run of its key that is active then, or begins one.

    starts: (key..., id, at, until); until is when a run begun by this start ends.
    """

    def step(state, at, id, until):
        run, ends = state
        if ends is None or at >= ends:
            run, ends = id, until
        return (run, ends), (run,)

    out = [StructField("run", starts.schema["id"].dataType)]
    return sorted_fold(starts, key, ["at", "id"], ["until"], out, lambda: (None, None), step).select(*key, "id", "run")


def cooled_starts(starts: DataFrame, key: list[str], cooldown_us: int) -> DataFrame:
    """(key..., id, accepted): a start is refused within the cooldown after the last accepted one, unless forced.

    starts: (key..., id, at_us, force).
    """

    def step(last, at, _, force):
        ok = last is None or bool(force) or at - last >= cooldown_us
        return at if ok else last, (ok,)

    out = [StructField("accepted", BooleanType())]
    return sorted_fold(starts, key, ["at_us", "id"], ["force"], out, lambda: None, step).select(*key, "id", "accepted")


def drained(pages: DataFrame, page: str, sentinel: str) -> DataFrame:
    """Pages before the first sentinel page; later results count as overrun and go."""
    stop = pages.where(F.col(sentinel)).agg(F.min(page).alias("_stop"))
    return pages.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop")  # one row


def joined_children(children: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Settled outcome of every child; one without an outcome failed."""
    return children.join(outcomes, key, "left").withColumn("status", F.coalesce("status", F.lit("failed")))


def woken_waiters(waiters: DataFrame, settled: DataFrame, bound: str = "30 minutes") -> DataFrame:
    """Waiters (waiter, run_id, since) with the run that settled (run_id, status, at) within the bound; works on streams with watermarks."""
    s = settled.select(F.col("run_id").alias("_run"), "status", "at")
    return waiters.join(s, F.expr(f"run_id = _run and at >= since and at <= since + interval {bound}")).drop("_run")


def from_engine(status: Column) -> Column:
    """Engine statuses in the run's terms."""
    table = {"queued": "queued", "running": "running", "waiting": "running", "paused": "running", "waitingForPause": "running", "complete": "complete", "errored": "failed", "terminated": "failed"}
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), status), F.lit("unknown"))


def visible(runs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Runs that are active, or changed within the last hours."""
    return runs.where(F.col("status").isin("queued", "running") | (F.col("updated_at") >= now - F.make_dt_interval(hours=F.lit(hours))))


def pruned(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Settled runs older than the retention go."""
    return runs.where(~(F.col("status").isin(*TERMINAL) & (F.unix_micros("updated_at") < F.unix_micros(now) - days * 86_400_000_000)))


def pruned_hub(runs: DataFrame, steps: DataFrame, units: DataFrame, waiters: DataFrame, throttle: DataFrame, now: Column, days: int = 7) -> dict[str, DataFrame]:
    """All tables of a hub without what the retention ends: settled runs with all that belongs to them, and old start marks."""
    kept = pruned(runs, now, days)
    gone = runs.join(kept.select("run_id"), "run_id", "left_anti").select("run_id")
    belongs = lambda df, key="run_id": df.join(gone.withColumnRenamed("run_id", key), key, "left_anti")
    recent = F.unix_micros("last_attempt") >= F.unix_micros(now) - days * 86_400_000_000
    return {"runs": kept, "steps": belongs(steps), "units": belongs(units), "waiters": belongs(waiters, "child_run_id"), "throttle": throttle.where(recent)}


LOST = "the engine does not know this run any more"


def reconciled_runs(runs: DataFrame, probes: DataFrame, now: Column, silence_us: int = 300_000_000, most_failures: int = 3) -> DataFrame:
    """Runs after their engine was asked: compare-and-set by the status that the probe saw.

    runs: (run_id, status, error, output, updated_at, seq, failures); probes: (run_id,
    seen, engine, error, output, failed, not_found), one for each run.  Only active
    runs that were silent for so long are asked.  A failed probe only touches the run,
    until the engine disowns it or it is the third in a row: then it is unknown.  A
    run whose status moved after the probe saw it keeps what it has.
    """
    p = probes.select("run_id", *[F.col(c).alias(f"_{c}") for c in ("seen", "engine", "error", "output", "failed", "not_found")])
    rows = runs.join(p, "run_id", "left")
    active = F.col("status").isin("queued", "running")
    asked = F.coalesce(F.col("_seen").isNotNull() & active & (F.unix_micros(now) - F.unix_micros("updated_at") >= silence_us), F.lit(False))
    failures = F.col("failures") + 1
    kept = asked & F.col("_failed") & ~F.col("_not_found") & (failures < most_failures)
    lost = asked & F.col("_failed") & ~kept
    settled = asked & ~kept & (F.col("status") == F.col("_seen"))
    status = F.when(lost, "unknown").otherwise(from_engine(F.col("_engine")))
    values = {
        "status": F.when(settled, status).otherwise(F.col("status")),
        "error": F.when(settled, F.when(lost, F.lit(LOST)).otherwise(F.coalesce("_error", "error"))).otherwise(F.col("error")),
        "output": F.when(settled, F.when(status == "complete", F.col("_output"))).otherwise(F.col("output")),
        "updated_at": F.when(settled | kept, now).otherwise(F.col("updated_at")),
        "seq": F.col("seq") + settled.cast("int"),
        "failures": F.when(kept, failures).when(asked, 0).otherwise(F.col("failures")),
    }
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in runs.columns])


def coalesced_frames(frames: DataFrame, listener: list[str], gap_ms: int = 500, guarded: bool = True) -> DataFrame:
    """(listener..., at_ms, seq, sent_ms): when each frame is pushed, or null where a newer one takes its place.

    frames: (listener..., at_ms, seq, terminal).  Frames that are not newer are
    dropped (guarded=False: all are kept, seq only orders those of one moment); the
    first goes at once, later ones at the end of the gap, where only the latest
    counts; terminal frames never wait.
    """
    rows = monotone_partition(frames, listener) if guarded else frames
    following = F.lead("at_ms").over(Window.partitionBy(*listener).orderBy("at_ms", "seq"))

    def step(sent, at, _, terminal, after):
        if terminal or sent is None or at - sent >= gap_ms:
            return at, (at,)
        flush = sent + gap_ms
        return (flush, (flush,)) if after is None or after > flush else (sent, (None,))

    out = sorted_fold(rows.withColumn("_after", following), listener, ["at_ms", "seq"], ["terminal", "_after"], [StructField("sent_ms", LongType())], lambda: None, step)
    return out.select(*listener, "at_ms", "seq", "sent_ms")


def monotone_partition(frames: DataFrame, key: list[str]) -> DataFrame:
    """Frames whose seq exceeds all that arrived before for their key."""
    before = F.max("seq").over(Window.partitionBy(*key).orderBy("at_ms", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("seq") > F.col("_before"))).drop("_before")


def followed(frames: DataFrame, listener: str, arrival: str, silence_s: int = 30) -> DataFrame:
    """Frames that a client takes, with `reopened`: did it reopen the stream after a silence before this frame?

    frames: (listener, arrival, run_id, seq, at).  Frames that are not newer are
    dropped; when the run changes the guard begins anew.
    """
    w = Window.partitionBy(listener).orderBy(arrival)
    changed = (~F.col("run_id").eqNullSafe(F.lag("run_id").over(w))).cast("int")
    rows = frames.withColumn("_new", changed).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("reopened", F.coalesce(F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > silence_s * 1_000_000, F.lit(False)))
    before = F.max("seq").over(Window.partitionBy(listener, "_part").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("seq") > F.col("_before"))).drop("_new", "_part", "_before")


def unique_units(units: DataFrame, key: list[str]) -> DataFrame:
    """units, failing at run time where an id repeats within its step."""
    n = F.count("*").over(Window.partitionBy(*key))
    return units.withColumn("_n", n).where((F.col("_n") == 1) | F.raise_error(F.concat(F.lit("repeated unit: "), F.concat_ws("/", *key))).cast("boolean")).drop("_n")


def polled(attempts: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, settled, polls): a poll ends with its first settled attempt, or unsettled when the budget is spent.

    attempts: (key, n from 1, settled).
    """
    first = F.min(F.when(F.col("settled") & (F.col("n") <= budget), F.col("n")))
    rows = attempts.groupBy(key).agg(first.alias("_first"), F.least(F.max("n"), F.lit(budget)).alias("_tried"))
    return rows.select(key, F.col("_first").isNotNull().alias("settled"), F.coalesce("_first", "_tried").alias("polls"))


def recent_starts(items: DataFrame, kind: Column, id: str, published: str, n: int | None, most: int = 100) -> DataFrame:
    """(flow_key, id): start requests for the n newest items, n between 1 and `most`."""
    page = items.orderBy(F.col(published).desc(), F.col(id).desc()).limit(max(1, min(n if n is not None else 10, most)))
    return page.select(item_key(kind, F.col(id)).alias("flow_key"), id)


def item_key(kind: Column, id: Column) -> Column:
    """Flow key of an item: the slug of a guide, else type:id."""
    return F.when(kind == "playguide", id.cast("string")).otherwise(F.concat_ws(":", kind, id))


def health(status: Column, fetched: Column, translated: Column, degraded: Column) -> Column:
    """One word for a run: active, failed, fetch-failed, translate-failed, degraded or complete."""
    return (
        F.when(status.isin("queued", "running"), "active")
        .when(status.isin("failed", "unknown"), "failed")
        .when(~fetched, "fetch-failed")
        .when(~translated, "translate-failed")
        .when(degraded, "degraded")
        .otherwise("complete")
    )


class RunState:
    """The plain fold of one run's reports; the stream keeps the same facts in state."""

    def __init__(self, definition: list[tuple[str, str]]):
        self.steps = {s: {"kind": k, "state": "pending", "total": None} for s, k in definition}
        self.units: dict[str, set] = {}
        self.status, self.seq = "queued", 0

    def apply(self, r: dict) -> None:
        if r["kind"] == "status":
            if not (self.status in TERMINAL and r["status"] not in TERMINAL):
                self.status = r["status"]
        elif r["kind"] == "unit":
            self.units.setdefault(r["step"], set()).add(r["unit"])
        elif r["step"] in self.steps:
            name = "total" if r["kind"] == "total" else "state"
            self.steps[r["step"]][name] = r[name]
        self.seq = max(self.seq, int(r["seq"]))

    def rows(self) -> list[tuple]:
        return [(s, v["kind"], v["state"], len(self.units.get(s, ())), v["total"]) for s, v in self.steps.items()]


class ReportProcessor(StatefulProcessor):
    """Keyed by run: a map of units, one of step facts, and one of run facts, so state grows by single entries.

    Rows of one micro-batch apply in the order of seq.  Emits the run's absolute
    snapshot after each batch that touches it.  With a retention the state of a
    settled run goes when so much processing time has passed.
    """

    def __init__(self, definition: list[tuple[str, str]], retention_ms: int | None = None):
        self.definition, self.retention_ms = definition, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.units = handle.getMapState("units", "step string, unit string", "seen boolean")
        self.counts = handle.getMapState("counts", "step string", "n long")
        self.facts = handle.getMapState("facts", "step string, name string", "value string")
        self.run = handle.getValueState("run", "status string, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, seq = self.run.get() if self.run.exists() else ("queued", 0)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in batch.itertuples():
            if r.kind == "status":
                if not (status in TERMINAL and r.status not in TERMINAL):
                    status = r.status
            elif r.kind == "unit":
                if not self.units.containsKey((r.step, r.unit)):
                    self.units.updateValue((r.step, r.unit), (True,))
                    n = self.counts.getValue((r.step,))[0] if self.counts.containsKey((r.step,)) else 0
                    self.counts.updateValue((r.step,), (n + 1,))
            elif r.kind == "total":
                self.facts.updateValue((r.step, "total"), (str(int(r.total)),))
            else:
                self.facts.updateValue((r.step, "state"), (r.state,))
            seq = max(seq, int(r.seq))
        self.run.update((status, seq))
        if self.retention_ms is not None and status in TERMINAL:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retention_ms)
        parts = []
        for step, kind in self.definition:
            state = self.facts.getValue((step, "state"))[0] if self.facts.containsKey((step, "state")) else "pending"
            total = self.facts.getValue((step, "total"))[0] if self.facts.containsKey((step, "total")) else ""
            n = self.counts.getValue((step,))[0] if self.counts.containsKey((step,)) else 0
            parts.append(f"{step}:{kind}:{state}:{n}:{total}")
        yield pd.DataFrame({"run_id": [key[0]], "seq": [seq], "status": [status], "steps": ["|".join(parts)]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.run.exists() and self.run.get()[0] in TERMINAL:
            for state in (self.units, self.counts, self.facts, self.run):
                state.clear()
        return iter(())

    def close(self) -> None:
        pass


def snapshot_stream(reports: DataFrame, definition: list[tuple[str, str]], retention_ms: int | None = None) -> DataFrame:
    """Snapshots of a stream of reports; needs the RocksDB state store.  Without a retention the state of settled runs stays."""
    mode = "None" if retention_ms is None else "ProcessingTime"
    return reports.groupBy("run_id").transformWithStateInPandas(ReportProcessor(definition, retention_ms), SNAPSHOT, "Update", mode)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
