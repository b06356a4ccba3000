"""Intervals, runs, clusters, agendas, recurrences and entity resolution on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import resolve as R
from ..operators import temporal as T
from ..operators.listing import top_per_group
from ..sources.tables import load
from .catalog import query

_MINUTE = 60_000_000


def _intervals(spark, d):
    """Events widened to value minutes (at least one)."""
    e = load(spark, d, "events")
    minutes = F.greatest(F.floor("value"), F.lit(1)).cast("int")
    return e.select("event_id", "user_id", "event_type", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("end"))


_INTERVALS = "with i as (select event_id, user_id, event_type, ts as start, ts + to_minutes(greatest(floor(value), 1)::bigint) as \"end\" from events)"


@query("""
select event_id, coalesce(lead(ts) over (partition by user_id, event_type order by ts, event_id), ts + interval 2 day) as "end" from events""")
def next_row_interval(spark, d):
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return T.next_or_period(rows, ["user_id", "event_type"], "ts", "2 days", "end", "event_id").select("event_id", "end")


@query("""
with b as (select *, case when event_type is not distinct from lag(event_type) over w then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(new) over (partition by user_id order by ts, event_id) as run from b)
select user_id, event_type, min(ts) as "start", max(ts) as "end", count(*) as "rows" from r group by user_id, event_type, run""")
def merge_runs(spark, d):
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return T.merged_runs(rows, ["user_id"], ["ts", "event_id"], ["event_type"], "ts").drop("run")


_CLUSTERS = _INTERVALS + """, m as (
  select *, max("end") over (partition by user_id order by start, event_id rows between unbounded preceding and 1 preceding) as reach from i),
c as (select *, sum(case when reach is null or start >= reach then 1 else 0 end) over (partition by user_id order by start, event_id) as cluster from m)"""


@query(_CLUSTERS + "select user_id, cluster::bigint as cluster, min(start) as \"from\", max(\"end\") as \"to\", count(*) as n from c group by user_id, cluster")
def overlap_clusters(spark, d):
    rows = T.overlap_clusters(_intervals(spark, d), ["user_id"], "start", "end", "event_id")
    return rows.groupBy("user_id", "cluster").agg(F.min("start").alias("from"), F.max("end").alias("to"), F.count("*").alias("n"))


@query(_CLUSTERS.replace("with ", "with recursive ", 1) + """,
o as (select user_id, cluster::bigint as cluster, event_id, start, "end" as e, row_number() over (partition by user_id, cluster order by start, event_id) as n from c),
f as (select user_id, cluster, event_id, n, 0 as lane, [e] as ends from o where n = 1
 union all select o.user_id, o.cluster, o.event_id, o.n, k - 1, case when k > len(ends) then list_append(ends, e) else list_transform(ends, lambda x, i: case when i = k then e else x end) end
 from (select o.*, ends, coalesce(list_position(list_transform(ends, lambda x: x <= o.start), true), len(ends) + 1)::int as k from f join o on o.user_id = f.user_id and o.cluster = f.cluster and o.n = f.n + 1) o)
select user_id, cluster, event_id, lane, max(lane) over (partition by user_id, cluster) + 1 as lanes from f""")
def lane_packing(spark, d):
    """First-fit lanes inside clusters."""
    rows = T.overlap_clusters(_intervals(spark, d), ["user_id"], "start", "end", "event_id")
    return T.lanes(rows, ["user_id", "cluster"], "start", "end", "event_id")


@query(_INTERVALS + """
, s as (select unnest(generate_series(date '2024-01-01', date '2024-03-01', interval 1 day))::date as day)
select event_id, day from i join s on start < day + interval 1 day and (start >= day or "end" > day)""")
def day_overlap_join(spark, d):
    """Each event with the days that it overlaps; days are made from the event, not joined."""
    return T.overlapping_days(_intervals(spark, d), "start", "end").select("event_id", "day")


@query(_INTERVALS + """
select a.event_id as a, b.event_id as b from i a join i b on a.user_id = b.user_id and a.event_id < b.event_id
where abs(epoch_us(a.start) - epoch_us(b.start)) <= 1800000000 or abs(epoch_us(a."end") - epoch_us(b."end")) <= 1800000000""")
def tolerance_pairs(spark, d):
    """Pairs of a user's events with close starts or close ends, by two bucketed joins."""
    rows = _intervals(spark, d)
    left = rows.select("user_id", F.col("event_id").alias("a"), T.micros("start").alias("ls"), T.micros("end").alias("le"))
    right = rows.select("user_id", F.col("event_id").alias("b"), T.micros("start").alias("rs"), T.micros("end").alias("re"))
    return T.close_pairs(left, right, ["user_id"], 30 * _MINUTE, ("a", "b")).where("a < b")


def _titled(spark, d):
    rows = _intervals(spark, d)
    return rows.select(F.col("event_id").alias("id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("title"), "start", "end", F.col("start").alias("created"))


@query(_INTERVALS + """
, g as (select *, case when start - lag(start) over w <= interval 2 hour then 0 else 1 end as new from i window w as (partition by user_id, event_type order by start, event_id)),
c as (select *, sum(new) over (partition by user_id, event_type order by start, event_id) as cluster from g)
select event_id as id, first_value(event_id) over (partition by user_id, event_type, cluster order by start, event_id) as survivor from c""")
def cluster_events(spark, d):
    """Components of equal titles with starts within two hours; along one axis they are runs, which SQL can state."""
    rows = _titled(spark, d).withColumn("end", F.lit(None).cast("timestamp_ntz"))
    return R.clusters(rows, tolerance=120 * _MINUTE)


@query("""
select distinct coalesce(p.survivor, l_partkey) as event_id, case l_returnflag when 'R' then 'topic' else 'news' end as source_type, l_suppkey as source_id
from lineitem left join (select p_partkey, min(p_partkey) over (partition by p_name, p_brand) as survivor from part where p_size > 10) p on p_partkey = l_partkey""")
def merged_links(spark, d):
    """Links of losers move to the survivors of their groups, and repeats vanish."""
    links = load(spark, d, "lineitem").select(F.col("l_partkey").alias("event_id"), F.when(F.col("l_returnflag") == "R", "topic").otherwise("news").alias("source_type"), F.col("l_suppkey").alias("source_id"))
    parts = load(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    survivors = parts.join(parts.groupBy("p_name", "p_brand").agg(F.min("id").alias("survivor")), ["p_name", "p_brand"]).select("id", "survivor")
    return R.merged_links(links, survivors)


@query("""
select o_orderkey, o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45) as orphan from orders""")
def orphan_flags(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    links = load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("event_id"))
    gone = R.orphans(orders, links).withColumn("orphan", F.lit(True))
    return orders.join(gone, "id", "left").select(F.col("id").alias("o_orderkey"), F.coalesce("orphan", F.lit(False)).alias("orphan"))


_NOW = "1997-06-01 12:00:00"


@query(f"""
with e as (select o_orderkey as key, o_orderdate as changed, o_orderdate + to_hours((o_custkey % 500)::bigint) as checked from orders),
h as (select *, (epoch_ms(timestamp '{_NOW}') - epoch_ms(changed)) / 3600000.0 as quiet from e)
select key, case when quiet <= 1440 then least(greatest(quiet / 24, 1), 168) end as hours,
       case when quiet <= 1440 then epoch_ms(checked) + round(least(greatest(quiet / 24, 1), 168) * 3600000)::bigint end as next_ms from h where changed <= timestamp '{_NOW}'""")
def recheck_schedule(spark, d):
    """Fading poll intervals; null beyond sixty quiet days."""
    now = F.lit(_NOW).cast("timestamp")
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("changed"), "o_custkey")
    rows = rows.where(F.col("changed") <= now).withColumn("checked", F.timestamp_millis(F.unix_millis("changed") + (F.col("o_custkey") % 500) * 3_600_000))
    hours = D.recheck_hours(D.quiet_hours(F.col("changed"), now))
    return rows.select("key", hours.alias("hours"), F.unix_millis(D.next_check(F.col("checked"), F.col("changed"), now)).alias("next_ms"))


@query("""
with t as (select o_orderkey as key, o_orderdate as next_check, o_orderstatus = 'F' as changed from orders order by next_check, key limit 20)
select key, case when not changed then 'unchanged' when count(*) filter (where changed) over (order by next_check, key) <= 5 then 'rerun' else 'deferred' end as outcome from t""")
def recheck_budget(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("next_check"), (F.col("o_orderstatus") == "F").alias("changed"))
    return R.within_budgets(rows, 20, 5).select("key", "outcome")


_RULES = [("daily", "FREQ=DAILY;BYHOUR=6", 1), ("weekly", "FREQ=WEEKLY;BYDAY=SU,WE;BYHOUR=6", 2), ("month", "FREQ=MONTHLY;BYMONTHDAY=1,10,25;BYHOUR=6", 3), ("end", "FREQ=MONTHLY;BYMONTHDAY=-1;BYHOUR=0", 4), ("bad", "FREQ=SOMETIMES", 5)]


@query("""
with d as (select unnest(generate_series(timestamp '2026-01-20', timestamp '2026-05-20', interval 1 day)) as day),
e as (select day + interval 6 hour as "at", 1 as o, 'daily' as id from d
 union all select day + interval 6 hour, 2, 'weekly' from d where dayofweek(day) in (0, 3)
 union all select day + interval 6 hour, 3, 'month' from d where day(day) in (1, 10, 25)
 union all select day, 4, 'end' from d where day = last_day(day))
select "at", list(id order by o) as members, string_agg(upper(id), ' / ' order by o) as title_ja, string_agg(case when id = 'daily' then 'jour' when id = 'weekly' then 'week' else upper(id) end, ' / ' order by o) as title_fr from e group by 1""" )
def recurrence_expand(spark, d):
    """Rules expanded over a window and merged by instant, with names in a language, its fallback and the base."""
    rules = spark.createDataFrame([(i, i.upper(), {"daily": {"fr": "jour", "en": "day"}, "weekly": {"en": "week"}}.get(i, {}), r, o) for i, r, o in _RULES], "id string, title_ja string, titles map<string,string>, rrule string, sort_order int")
    rows = T.recurrences(rules, F.lit("2026-01-20").cast("date"), F.lit("2026-05-20").cast("date"))
    return T.merged_recurrences(rows, ["fr"]).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(_INTERVALS + """
, x as (select * from i where start < timestamp '2024-01-11' and (start >= timestamp '2024-01-10' or "end" > timestamp '2024-01-10'))
select event_id as id, case when start = "end" then 'milestone' else 'bar' end as section,
  round(least(greatest((epoch_us(start) - epoch_us(timestamp '2024-01-10')) / 86400000000.0, 0), 1), 9) as "from",
  round(least(greatest((epoch_us("end") - epoch_us(timestamp '2024-01-10')) / 86400000000.0, 0), 1), 9) as "to",
  start < timestamp '2024-01-10' as open_start, "end" > timestamp '2024-01-11' as open_end from x""")
def day_agenda(spark, d):
    """One day's bars with fractions and open ends (lanes are tested against a plain fold)."""
    rows = _intervals(spark, d).select(F.col("event_id").alias("id"), F.lit("span").alias("type"), F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end"), F.col("user_id").alias("swimlane"))
    out = T.day_agenda(rows, F.lit("2024-01-10").cast("date"), "swimlane")
    return out.select("id", "section", F.round("from", 9).alias("from"), F.round("to", 9).alias("to"), "open_start", "open_end")


@query("""
with s as (select user_id % 5 as content, event_type as icon, date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as "end" from events group by all),
b as (select *, case when icon is not distinct from lag(icon) over w and start is not distinct from lag("end") over w then 0 else 1 end as new from s window w as (partition by content, icon order by start)),
r as (select *, sum(new) over (partition by content, icon order by start) as run from b)
select content, icon, min(start) as "start", max("end") as "end" from r group by content, icon, run""")
def icon_grid_runs(spark, d):
    """A calendar grid of icons, merged where days touch."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    grid = load(spark, d, "events").select((F.col("user_id") % 5).alias("content"), F.col("event_type").alias("icon"), day.alias("start")).distinct()
    grid = grid.withColumn("end", F.expr("start + interval 1 day"))
    return T.merged_runs(grid.withColumn("same", F.lit(1)), ["content", "icon"], ["start"], ["same"], "start", "end").select("content", "icon", "start", "end")


@query("""
select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from events) where n = 1""")
def first_event(spark, d):
    rows = load(spark, d, "events").select("user_id", "event_id", "ts")
    return top_per_group(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")
