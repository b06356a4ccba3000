"""Reports, snapshots and run control on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load
from ..streaming import runs as S
from .catalog import query

DEFINITION = [("fetch", 0, "step"), ("scan", 1, "phase"), ("translate", 2, "units")]


def reports(spark, d):
    """Events as reports: a user's day is a run; types give kinds."""
    e = load(spark, d, "events")
    step = F.when(F.col("event_type") == "view", "translate").when(F.col("event_type") == "click", "scan").otherwise("fetch")
    kind = F.when(F.col("event_type").isin("view", "click"), "unit").when(F.col("event_type") == "purchase", "total").when(F.col("event_type") == "error", "status").otherwise("step")
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        step.alias("step"),
        (F.floor("value") % 20).cast("string").alias("unit"),
        F.when(kind == "step", "done").alias("state"),
        F.when(kind == "total", F.floor("value").cast("int")).alias("total"),
        F.when(kind == "status", F.when(F.col("value") > 10, "complete").otherwise("running")).alias("status"),
    )


_REPORTS = """
with r as (select user_id || '-' || strftime(ts, '%Y%m%d') as run_id, event_id as seq,
  case when event_type in ('view', 'click') then 'unit' when event_type = 'purchase' then 'total' when event_type = 'error' then 'status' else 'step' end as kind,
  case event_type when 'view' then 'translate' when 'click' then 'scan' else 'fetch' end as step,
  floor(value)::bigint % 20 as unit, floor(value)::int as total, case when value > 10 then 'complete' else 'running' end as status from events),
runs as (select distinct run_id from r),
d as (select * from (values ('fetch', 0, 'step'), ('scan', 1, 'phase'), ('translate', 2, 'units')) v(step, ord, kind)),
f as (select run_id, step, count(distinct unit) filter (where kind = 'unit') as current, arg_max(total, seq) filter (where kind = 'total') as total, max(case when kind = 'step' then 'done' end) as state from r group by all),
s as (select run_id, coalesce(arg_max(status, seq) filter (where kind = 'status' and status = 'complete'), arg_max(status, seq) filter (where kind = 'status'), 'queued') as status, max(seq) as seq from r group by all),
snap as (select runs.run_id, s.status, s.seq, d.step, d.ord, d.kind, coalesce(f.state, 'pending') as state, coalesce(f.current, 0) as current, f.total
  from runs cross join d left join f on f.run_id = runs.run_id and f.step = d.step left join s on s.run_id = runs.run_id)"""


def _snapshots(spark, d):
    r = reports(spark, d)
    runs = r.select("run_id").distinct().withColumn("flow", F.lit("article"))
    definition = spark.createDataFrame([("article", *x) for x in DEFINITION], "flow string, step string, ord int, kind string")
    return S.snapshots(r, runs, definition)


@query(_REPORTS + "select * from snap")
def snapshot_batch(spark, d):
    """The last snapshot of each run from all reports."""
    return _snapshots(spark, d)


@query(_REPORTS + """
select run_id, list(step order by ord) as unfinished from snap where status = 'complete' and state not in ('done', 'skipped') group by run_id""")
def unfinished_steps(spark, d):
    return S.unfinished(_snapshots(spark, d))


@query(_REPORTS + """
, x as (select run_id, ord, case when ord = 0 and hash(run_id) is not null and seq % 3 = 0 then 'failed' else state end as state from snap)
select run_id, ord, case when state = 'pending' and ord > min(case when state = 'failed' then ord end) over (partition by run_id) then 'not-reached' else state end as view from x""")
def segment_view(spark, d):
    steps = _snapshots(spark, d).withColumn("state", F.when((F.col("ord") == 0) & (F.col("seq") % 3 == 0), "failed").otherwise(F.col("state")))
    return S.segment_view(steps).select("run_id", "ord", "view")


@query("""
select event_id, user_id from (select *, max(seq) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as b from
  (select event_id, user_id, floor(value)::bigint as seq from events)) where b is null or seq > b""")
def seq_guard(spark, d):
    """A client's guard against frames that are not newer."""
    frames = load(spark, d, "events").select("event_id", "user_id", F.floor("value").alias("seq"))
    return S.monotone_frames(frames, "user_id", "seq", "event_id").select("event_id", "user_id")


@query("""
with recursive e as (select user_id, event_id as id, ts as at, ts + to_minutes(floor(value)::bigint) as until, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select user_id, id, n, id as run, until from e where n = 1
 union all select e.user_id, e.id, e.n, case when e.at >= f.until then e.id else f.run end, case when e.at >= f.until then e.until else f.until end from f join e on e.user_id = f.user_id and e.n = f.n + 1)
select user_id, id, run from f""")
def dedup_attach(spark, d):
    """Starts that attach to the active run of their key."""
    e = load(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("until"))
    return S.attached_starts(e, ["user_id"])


@query("""
with recursive e as (select user_id, event_id as id, epoch_us(ts) as t, event_type = 'error' as force, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select user_id, id, n, t as last, true as accepted from e where n = 1
 union all select user_id, id, n, case when ok then t else last end, ok from (select e.*, f.last, e.force or e.t - f.last >= 3600000000 as ok from f join e on e.user_id = f.user_id and e.n = f.n + 1))
select user_id, id, accepted from f""")
def cooldown(spark, d):
    """Starts refused within an hour of the last accepted one."""
    e = load(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), (F.col("event_type") == "error").alias("force"))
    return S.cooled_starts(e, ["user_id"], 3_600_000_000)


@query("""
select a.event_id as waiter, b.event_id as settled from events a join events b on a.user_id = b.user_id and b.event_type = 'purchase' and a.event_type = 'click' and b.ts >= a.ts and b.ts <= a.ts + interval 30 minute""")
def run_join(spark, d):
    """Waiters and what settles within half an hour of them."""
    e = load(spark, d, "events")
    waiters = e.where("event_type = 'click'").select(F.col("event_id").alias("waiter"), F.col("user_id").alias("run_id"), F.col("ts").alias("since"))
    settled = e.where("event_type = 'purchase'").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("status"), F.col("ts").alias("at"))
    return S.woken_waiters(waiters, settled).select("waiter", F.col("status").alias("settled"))


@query("""
select doc_id, coalesce(case quality when 1 then 'complete' when 0 then 'errored' end, 'failed') as status from documents left join labels using (doc_id)""")
def joined_children(spark, d):
    """Outcomes of all children; a missing one failed."""
    outcomes = load(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "complete").when(F.col("quality") == 0, "errored").alias("status"))
    return S.joined_children(load(spark, d, "documents").select("doc_id"), outcomes, "doc_id")


@query("""
select event_id, case when event_type in ('view', 'click') then 'active' when event_type = 'error' then 'failed' when value < 5 then 'fetch-failed' when value < 10 then 'translate-failed' when value < 20 then 'degraded' else 'complete' end as health from events""")
def health_gate(spark, d):
    t, v = F.col("event_type"), F.col("value")
    status = F.when(t.isin("view", "click"), "running").when(t == "error", "failed").otherwise("complete")
    return load(spark, d, "events").select("event_id", S.health(status, v >= 5, v >= 10, v < 20).alias("health"))
