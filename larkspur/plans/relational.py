"""Listings, joins, counts and rankings on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing as L
from ..sources.tables import load
from .catalog import query


@query("""
select o_orderkey, o_orderdate, o_totalprice, c_name as localized_title, true as has_more
from orders left join customer on c_custkey = o_custkey
order by o_orderdate desc, o_orderkey desc limit 20""")
def list_page_newest(spark, d):
    """The newest page with a left join of a title; the page is cut before the join."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    page = L.newest_page(orders, 20, "o_orderdate", "o_orderkey")
    titles = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("localized_title"))
    return page.join(titles, "o_custkey", "left").select("o_orderkey", "o_orderdate", "o_totalprice", "localized_title", "has_more")


@query("""
select o_orderkey, o_orderdate from orders
where o_orderdate < timestamp '1996-06-01' and o_orderstatus = 'O'
order by o_orderkey desc limit 50""")
def list_page_keyset(spark, d):
    """A page by descending key; filters come before the limit."""
    orders = load(spark, d, "orders")
    where = L.conjunction(F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp_ntz"), F.col("o_orderstatus") == "O")
    return L.keyset_page(orders, L.clamped(50, 30, 100), "o_orderkey", descending=True, where=where).select("o_orderkey", "o_orderdate")


@query("""
with p as (select * from orders where o_orderdate < timestamp '1995-03-15' order by o_orderdate desc, o_orderkey desc limit 26)
select o_orderkey, o_orderdate, (select count(*) from p) > 25 as has_more from p order by o_orderdate desc, o_orderkey desc limit 25""")
def list_page_before(spark, d):
    """The page before a strict date cursor."""
    cursor = F.lit("1995-03-15").cast("timestamp_ntz")
    return L.newest_page(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), 25, "o_orderdate", "o_orderkey", before=cursor)


@query("""
select d.doc_id, d.lang, d.n_chars, l.quality as localized_quality, d.text is not null as has_body
from documents d left join labels l on l.doc_id = d.doc_id""")
def localized_left_join(spark, d):
    labels = load(spark, d, "labels").select("doc_id", F.col("quality").alias("localized_quality"))
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars", F.col("text").isNotNull().alias("has_body"))
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", "n_chars", "localized_quality", "has_body")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where quality is not null)")
def unlabeled_scan(spark, d):
    return L.without_value(load(spark, d, "documents").select("doc_id", "source"), load(spark, d, "labels"), "doc_id", "quality")


_LAYERS = """
with o as (select p_partkey, p_name || ' (own)' as p_name from part where p_partkey % 7 = 0
           union all select p_partkey + 100000000, p_name from part where p_partkey % 50 = 1)"""


@query(_LAYERS + """
select p_partkey, p_name, true as is_override from o
union all select p_partkey, p_name, false from part where p_partkey not in (select p_partkey from o)""")
def layered_view(spark, d):
    """Overrides shadow base rows of their key."""
    part = load(spark, d, "part").select("p_partkey", "p_name")
    own = part.where("p_partkey % 7 = 0").withColumn("p_name", F.concat("p_name", F.lit(" (own)")))
    own = own.unionByName(part.where("p_partkey % 50 = 1").withColumn("p_partkey", F.col("p_partkey") + 100000000))
    return L.layered(own, part, ["p_partkey"])


@query("select doc_id, lang, doc_id in (select doc_id from labels where quality = 1) as translated from documents")
def translated_flag(spark, d):
    return L.flagged(load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels").where("quality = 1"), "doc_id", "translated")


@query("select d.doc_id, b.item_id from documents d join benchmark b on instr(d.text, b.text) > 0")
def dictionary_contains(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("text").alias("hay"))
    terms = load(spark, d, "benchmark").select("item_id", F.col("text").alias("term"))
    return L.contained_terms(docs, terms, "hay", "term").select("doc_id", "item_id")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def exists_filter(spark, d):
    big = load(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def not_exists_filter(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name").join(load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""
select c.conv_id, c.turn, (select count(*) from conversations x where x.conv_id = c.conv_id and x.role = c.role) as current
from conversations c""")
def correlated_unit_count(spark, d):
    """A correlated count, decorrelated into one grouped count."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role")
    return rows.join(rows.groupBy("conv_id", "role").agg(F.count("*").alias("current")), ["conv_id", "role"]).select("conv_id", "turn", "current")


@query("""
select (select count(*) from documents) as items, (select count(*) from documents where text is not null) as fetched,
       (select count(distinct doc_id) from labels where quality = 1) as translated,
       (select count(*) from documents where lang = 'en') as n_en, (select count(*) from documents where lang = 'fr') as n_fr,
       (select count(*) from documents where lang = 'de') as n_de, (select count(*) from documents where lang = 'es') as n_es""")
def dashboard_stats(spark, d):
    """All counts of documents in one pass, and those of labels in another."""
    docs = load(spark, d, "documents").agg(F.count("*").alias("items"), F.count("text").alias("fetched"), *[F.count_if(F.col("lang") == x).alias(f"n_{x}") for x in ("en", "fr", "de", "es")])
    done = load(spark, d, "labels").where("quality = 1").agg(F.countDistinct("doc_id").alias("translated"))
    return docs.crossJoin(done).select("items", "fetched", "translated", "n_en", "n_fr", "n_de", "n_es")  # one row each


@query("select lang, count(*) as n from documents group by lang")
def category_counts(spark, d):
    return load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("""
select event_type, count(*) filter (where ts < timestamp '2024-01-10') as due,
       count(*) filter (where ts >= timestamp '2024-01-10' and value >= 10) as upcoming, count(*) filter (where value < 10) as small
from events where event_type <> 'error' group by event_type""")
def group_bucket_counts(spark, d):
    t = F.lit("2024-01-10").cast("timestamp_ntz")
    return load(spark, d, "events").where("event_type <> 'error'").groupBy("event_type").agg(F.count_if(F.col("ts") < t).alias("due"), F.count_if((F.col("ts") >= t) & (F.col("value") >= 10)).alias("upcoming"), F.count_if(F.col("value") < 10).alias("small"))


@query("""
select l_partkey, l_returnflag = 'R' as original, l_orderkey, l_linenumber from (
  select *, row_number() over (partition by l_partkey, l_returnflag = 'R' order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as n from lineitem) where n = 1""")
def top1_per_bucket(spark, d):
    """The newest row of each part, returned and other ones apart; one partial aggregation, no sort."""
    rows = load(spark, d, "lineitem").select("l_partkey", (F.col("l_returnflag") == "R").alias("original"), "l_shipdate", "l_orderkey", "l_linenumber")
    best = rows.groupBy("l_partkey", "original").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("m"))
    return best.select("l_partkey", "original", "m.l_orderkey", "m.l_linenumber")


@query("select o_custkey, arg_max(o_orderpriority, o_orderkey) as latest_model from orders group by o_custkey")
def latest_per_group(spark, d):
    return L.newest_per_group(load(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", name="latest_model")


@query("""
select lang, doc_id, n_chars from (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as n from documents) where n <= 5""")
def top5_per_category(spark, d):
    docs = load(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return L.top_per_group(docs, ["lang"], [F.col("n_chars").desc(), F.col("doc_id")], 5)


@query("""
select l_partkey, l_suppkey from (
  select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by (s_acctbal > 0) desc, first asc nulls last, l_suppkey) as n
  from (select l_partkey, l_suppkey, min(l_shipdate) as first from lineitem group by all) join supplier on s_suppkey = l_suppkey) where n = 1""")
def primary_source_rank(spark, d):
    """A preferred source, then the oldest, then the least id; links are reduced before they are ranked."""
    links = load(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("first"))
    named = links.join(load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 0).alias("names")), "l_suppkey")
    return L.top_per_group(named, ["l_partkey"], [F.col("names").desc(), F.col("first").asc_nulls_last(), F.col("l_suppkey")]).select("l_partkey", "l_suppkey")


@query("""
select c.conv_id, c.turn, n.n_name as title from conversations c left join nation n on n.n_nationkey = c.conv_id % 40""")
def run_titles(spark, d):
    """Runs with the title of their item, where there is one."""
    runs = load(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 40).cast("int").alias("n_nationkey"))
    return runs.join(load(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("title")), "n_nationkey", "left").select("conv_id", "turn", "title")


@query("""
select n_nationkey, n_name, r_name, coalesce(s_name, n_name) as served from nation
left join region on r_regionkey = n_regionkey
left join (select s_nationkey, max(s_name) as s_name from supplier where s_acctbal > 5000 group by 1) on s_nationkey = n_nationkey""")
def banner_chain(spark, d):
    """A chain of left joins with a fallback."""
    served = load(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_name").alias("s_name"))
    regions = load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return load(spark, d, "nation").join(regions, "n_regionkey", "left").join(served, "n_nationkey", "left").select("n_nationkey", "n_name", "r_name", F.coalesce("s_name", "n_name").alias("served"))


@query("select n_name, r_name from nation, region")
def cross_units(spark, d):
    """Few candidates with every language; both sides are fixed lists."""
    return load(spark, d, "nation").select("n_name").crossJoin(F.broadcast(load(spark, d, "region").select("r_name")))


@query("""
select outcome_small, outcome_mid, outcome_large from (
select count(*) filter (where l_quantity < 10) as outcome_small, count(*) filter (where l_quantity >= 10 and l_quantity < 40) as outcome_mid,
       count(*) filter (where l_quantity >= 40) as outcome_large from lineitem)""")
def outcome_tallies(spark, d):
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").agg(F.count_if(q < 10).alias("outcome_small"), F.count_if((q >= 10) & (q < 40)).alias("outcome_mid"), F.count_if(q >= 40).alias("outcome_large"))


@query("""
select event_type, sum(n)::bigint as scraped, count(*) as pages, max(n) as most from
(select event_type, user_id, count(*) as n from events group by all) group by event_type""")
def page_sums(spark, d):
    pages = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return pages.groupBy("event_type").agg(F.sum("n").alias("scraped"), F.count("*").alias("pages"), F.max("n").alias("most"))


@query("select count(*) filter (where l.quality is null) as untitled, count(*) filter (where l.quality is null) >= 5 as backfill from documents d left join labels l using (doc_id)")
def backfill_trigger(spark, d):
    docs = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.agg(F.count_if(F.col("quality").isNull()).alias("untitled")).withColumn("backfill", F.col("untitled") >= 5)


@query("""
select lang as code, 'label' as label from documents where lang = 'xx'
union all select 'en', 'English' where not exists (select 1 from documents where lang = 'xx')""")
def default_language(spark, d):
    """The table's rows, or one built-in row if it has none."""
    rows = load(spark, d, "documents").where("lang = 'xx'").select(F.col("lang").alias("code"), F.lit("label").alias("label"))
    return L.default_if_empty(rows, spark.createDataFrame([("en", "English")], "code string, label string"))


@query("""
with e as (select o_orderkey as key, o_orderdate + to_hours((o_totalprice::bigint % 1000)) as next_check from orders)
select 'due' as bucket, key from (select * from e where next_check <= timestamp '1995-01-01' order by next_check, key limit 25)
union all select 'upcoming', key from (select * from e where next_check > timestamp '1995-01-01' order by next_check, key limit 25)""")
def recheck_queue(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderdate") + F.make_dt_interval(hours=(F.rint("o_totalprice").cast("long") % 1000).cast("int"))).alias("next_check"))
    rows = rows.where(F.col("next_check").isNotNull())
    due, upcoming, _ = L.schedule(rows, F.lit("1995-01-01").cast("timestamp_ntz"), 25, 25, 25)
    return due.select(F.lit("due").alias("bucket"), "key").unionByName(upcoming.select(F.lit("upcoming").alias("bucket"), "key"))


@query("""
select p_partkey, p_name from part where instr(p_name, 'e') > 0 and (p_brand like '%1%' or instr(p_type, 'x') > 0) and p_partkey > 50 order by p_partkey limit 40""")
def substring_keyset(spark, d):
    """Containment in one of several columns behind a key cursor."""
    where = F.expr("instr(p_name, 'e') > 0") & (F.col("p_brand").contains("1") | F.expr("instr(p_type, 'x') > 0"))
    return L.keyset_page(load(spark, d, "part"), 40, "p_partkey", after=50, where=where).select("p_partkey", "p_name")


@query("""
select p_partkey, pos from (values (7, 0), (3, 1), (19, 2), (999999999, 3)) v(k, pos) join part on p_partkey = k""")
def caller_order(spark, d):
    ids = spark.createDataFrame([(7, 0), (3, 1), (19, 2), (999999999, 3)], "p_partkey long, pos int")
    return L.in_order(load(spark, d, "part").select("p_partkey"), F.broadcast(ids), "p_partkey")


@query("""
with n as (select user_id % 20 as page, avg((event_type = 'view' or event_type = 'click')::int::double) as share from events group by 1),
s as (select min(page) as stop from n where share < 0.4)
select user_id % 20 as page, count(*) as n from events, s where stop is null or user_id % 20 <= stop group by 1""")
def early_stop(spark, d):
    pages = load(spark, d, "events").select((F.col("user_id") % 20).alias("page"), F.col("event_type").isin("view", "click").alias("new"))
    return L.pages_until_stale(pages, "page", "new", 0.4).groupBy("page").agg(F.count("*").alias("n"))
