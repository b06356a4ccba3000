"""Upserts, replacements, prunes and backfills: new table states from old ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..sources.tables import load
from .catalog import query

_SPLIT = "1996-01-01"
_OLD_NEW = f"""
with old as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderdate < timestamp '{_SPLIT}'),
     new as (select o_orderkey, 'N' as o_orderstatus, o_totalprice + 1 as o_totalprice from orders where o_orderdate >= timestamp '1995-06-01')"""


def _old_new(spark, d):
    orders = load(spark, d, "orders")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    old = orders.where(F.col("o_orderdate") < at(_SPLIT)).select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where(F.col("o_orderdate") >= at("1995-06-01")).select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return old, new


@query(_OLD_NEW + "select o_orderkey, o_orderstatus, o_totalprice from new where o_orderkey not in (select o_orderkey from old)")
def upsert_new_only(spark, d):
    """Only rows that were inserted come back."""
    return M.insert_new(*_old_new(spark, d), ["o_orderkey"])[1]


@query(_OLD_NEW + """
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, coalesce(o.o_orderstatus, n.o_orderstatus) as o_orderstatus,
       coalesce(n.o_totalprice, o.o_totalprice) as o_totalprice from old o full join new n on o.o_orderkey = n.o_orderkey""")
def upsert_merge(spark, d):
    """Existing rows take the new price and keep their status."""
    return M.key_merge(*_old_new(spark, d), ["o_orderkey"], ["o_totalprice"])


@query(_OLD_NEW + """
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey,
       case when n.o_orderkey is not null and n.o_orderkey % 2 = 0 then n.o_orderstatus else o.o_orderstatus end as o_orderstatus,
       case when n.o_orderkey is not null then case when n.o_orderkey % 3 = 0 then null else n.o_totalprice end else o.o_totalprice end as o_totalprice
from old o full join new n on o.o_orderkey = n.o_orderkey""")
def upsert_provided(spark, d):
    """Only provided columns are set, and a provided null is a value."""
    old, new = _old_new(spark, d)
    k = F.col("o_orderkey")
    new = new.withColumn("o_totalprice", F.when(k % 3 == 0, None).otherwise(F.col("o_totalprice"))).withColumn("provided", F.when(k % 2 == 0, F.array(F.lit("o_orderstatus"), F.lit("o_totalprice"))).otherwise(F.array(F.lit("o_totalprice"))))
    return M.merge_provided(old, new, ["o_orderkey"])


@query("""
select o_orderkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders""")
def update_by_key(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changes = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return M.update_matching(orders, changes, ["o_orderkey"])[0]


@query("""
select l_orderkey, l_partkey from (select distinct l_orderkey, l_partkey from lineitem where l_orderkey % 5 <> 0)
union all select distinct l_orderkey, l_suppkey from lineitem where l_orderkey % 5 = 0 and l_linenumber = 1""")
def replace_children(spark, d):
    """Children of changed parents are replaced as a whole."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    old = rows.select("l_orderkey", "l_partkey").distinct()
    changed = rows.where("l_orderkey % 5 = 0")
    fresh = changed.where("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("l_partkey"))
    return M.replace_children(old, changed.select("l_orderkey").distinct(), fresh, ["l_orderkey"])


@query("""
select doc_id, case when doc_id % 4 = 0 then 'failed' when doc_id % 4 = 1 then 'running' else 'done' end as state,
       case when doc_id % 4 = 0 then 'x' end as error, quality as value from labels""")
def state_upsert(spark, d):
    """State changes keep values; errors stay only with failures."""
    t = F.lit("2024-01-01").cast("timestamp")
    base = load(spark, d, "labels").select("doc_id", F.lit("done").alias("state"), F.lit(None).cast("string").alias("error"), F.col("quality").alias("value"), t.alias("updated_at"))
    changes = base.where("doc_id % 4 in (0, 1)").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("running").alias("state"), F.lit("x").alias("error"), t.alias("updated_at"))
    return M.set_states(base, changes, ["doc_id"]).drop("updated_at")


@query("""
select o_orderkey, case when o_orderstatus = 'P' then 'pending' else o_orderstatus end as state from orders""")
def reset_running(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    return M.reset_states(orders, F.col("state") == "P", "pending")


@query("""
with known as (select p_name as name, min(p_partkey) as id from part where p_partkey % 2 = 0 group by 1)
select name, id from known where name in (select p_name from part)
union all select name, (select max(id) from known) + row_number() over (order by name) from (select distinct p_name as name from part where p_name not in (select name from known))""")
def get_or_create(spark, d):
    """Stored ids, and the next numbers for new keys in key order."""
    part = load(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return M.with_new_ids(part.where("id % 2 = 0").groupBy("name").agg(F.min("id").alias("id")), part, "name")


@query("""
select event_id, event_type from events where not (event_type = 'view' and ts >= timestamp '2024-01-20')
union all select event_id + 1000000000, 'view' from events where event_type = 'click' and ts >= timestamp '2024-01-20'""")
def replace_window(spark, d):
    events = load(spark, d, "events").select("event_id", "event_type", "ts")
    t = F.lit("2024-01-20").cast("timestamp_ntz")
    fresh = events.where((F.col("event_type") == "click") & (F.col("ts") >= t)).select((F.col("event_id") + 1000000000).alias("event_id"), F.lit("view").alias("event_type"), "ts")
    return M.replace_window(events, fresh, (F.col("event_type") == "view") & (F.col("ts") >= t)).select("event_id", "event_type")


@query("""
with new as (select event_type, ts, event_id + 1000000000 as event_id from events where user_id % 50 = 3 and event_type <> 'view' and ts > timestamp '2024-01-15'),
w as (select event_type, min(ts) as f from new group by 1)
select e.event_type, e.event_id from events e left join w using (event_type) where f is null or ts < f union all select event_type, event_id from new""")
def replace_window_per_key(spark, d):
    """Each key's window begins at its own earliest new row."""
    events = load(spark, d, "events").select("event_type", "ts", "event_id", "user_id")
    new = events.where((F.col("user_id") % 50 == 3) & (F.col("event_type") != "view") & (F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")))
    new = new.select("event_type", "ts", (F.col("event_id") + 1000000000).alias("event_id"))
    return M.replace_window_per_key(events.drop("user_id"), new, "event_type", "ts").select("event_type", "event_id")


@query("""
select l_orderkey, l_linenumber from lineitem where l_orderkey in (
  select o_orderkey from orders where coalesce(case when o_orderstatus = 'O' then o_orderdate + interval 30 day end, o_orderdate) >= timestamp '1996-01-01')""")
def prune_retention(spark, d):
    """Old parents go by their end, or start without one; their children follow."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate", F.expr("case when o_orderstatus = 'O' then o_orderdate + interval 30 day end").alias("o_end"))
    kept, _ = M.prune(orders, F.lit("1996-01-01").cast("timestamp_ntz"), "o_orderdate", "o_end")
    return M.cascade(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), kept, "l_orderkey", "o_orderkey")


@query("select p_name, p_brand from (select p_name, p_brand, row_number() over (partition by p_name order by p_partkey desc) as n from part) where n = 1")
def reload_last_wins(spark, d):
    part = load(spark, d, "part").select("p_name", "p_brand", "p_partkey")
    return M.reload(part, ["p_name"], F.col("p_partkey")).select("p_name", "p_brand")


@query("""
select coalesce(a.p_partkey, b.p_partkey) as p_partkey, coalesce(b.p_name, a.p_name) as p_name, b.p_partkey is not null as active
from (select p_partkey, p_name from part where p_partkey % 2 = 0) a
full join (select p_partkey, p_name || '!' as p_name from part where p_partkey % 3 = 0) b on a.p_partkey = b.p_partkey""")
def sync_active(spark, d):
    """The source becomes the active set; everything else is deactivated."""
    part = load(spark, d, "part").select("p_partkey", "p_name")
    target = part.where("p_partkey % 2 = 0").withColumn("active", F.lit(True))
    source = part.where("p_partkey % 3 = 0").withColumn("p_name", F.concat("p_name", F.lit("!")))
    return M.sync_active(target, source, "p_partkey", ["p_name"])


@query("select doc_id, 'quality' as field, quality as value from labels where quality is not null union all select doc_id, 'toxic', toxic from labels where toxic is not null")
def wide_to_tall(spark, d):
    return M.wide_to_tall(load(spark, d, "labels").select("doc_id", "quality", "toxic"), ["doc_id"], ["quality", "toxic"])


@query("""
select conv_id, [coalesce(roles[2], ''), '', coalesce(roles[1], ''), coalesce(roles[10], '')] as texts
from (select conv_id, list(role order by turn) as roles from conversations group by 1)""")
def index_remap(spark, d):
    """A new arrangement of spans takes its texts from old places."""
    old = load(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    spans = F.array(*[F.struct(F.lit(i).cast("int").alias("from")) for i in (1, None, 0, 9)])
    return old.select("conv_id", M.remap_spans(F.col("roles"), spans).alias("texts"))


@query("select n_nationkey, n_name, n_regionkey <> 2 as enabled from nation")
def guarded_whitelist(spark, d):
    """A change of the whitelist that must leave an enabled row."""
    nation = load(spark, d, "nation").select("n_nationkey", "n_name", F.lit(True).alias("enabled"))
    changed = nation.join(load(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey").withColumn("enabled", F.col("n_regionkey") != 2).drop("n_regionkey")
    return M.guarded_languages(nation, changed)
