"""String, date, JSON and array functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import dates as D
from ..functions import text as X
from ..sources.tables import load
from .catalog import query


@query("""
select p_partkey, 'sched-' || lpad(lower(to_hex(abs(case when h >= 2147483648 then h - 4294967296 else h end))), 8, '0') as id from (
  select p_partkey, list_reduce(list_prepend(0::bigint, list_transform(string_split(p_name, ''), lambda c: ascii(c)::bigint)), lambda a, c: (a * 31 + c) % 4294967296) as h from part)""")
def hash_id(spark, d):
    """Stable ids from a 32-bit string hash."""
    return load(spark, d, "part").select("p_partkey", X.hash_id("sched-", F.col("p_name")).alias("id"))


@query("""
select p_partkey, lower(regexp_replace(p_name, '\\s', '', 'g')) as norm from part""")
def normalize_title(spark, d):
    """NFKC, no white space, lower case; on ASCII text SQL can state it."""
    return load(spark, d, "part").select("p_partkey", X.normalized_title(F.col("p_name")).alias("norm"))


@query("""
select page_id, key, coalesce('/img/' || key, url) as src from (select page_id, url, case when path <> '' and split_part(host, '.', -1) = 'com' then alias || '/' || path end as key from (
  select page_id, url, host, 'c' || md5(host) as alias, regexp_extract(url, '^(?:https?:)?//[^/?#]+/*([^?#]*)', 1) as path from (select page_id, url, lower(regexp_extract(url, '^(?:https?:)?//([^/?#:]+)', 1)) as host from pages)))""")
def url_canonical_key(spark, d):
    """Storage keys of allowed hosts without query and fragment, and rewritten sources; every .com host of the table is allowed."""
    pages = load(spark, d, "pages").select("page_id", "url")
    host = F.lower(F.regexp_extract("url", r"^(?:https?:)?//([^/?#:]+)", 1))
    hosts = pages.select(host.alias("host")).distinct().where("host like '%.com'")
    table = hosts.agg(F.map_from_entries(F.collect_list(F.struct("host", F.concat(F.lit("c"), F.md5("host")).alias("alias")))).alias("hosts"))  # the allowed hosts, a setting
    known = F.col("hosts")
    return pages.crossJoin(F.broadcast(table)).select("page_id", X.storage_key(F.col("url"), known).alias("key"), X.rewritten_src(F.col("url"), known).alias("src"))


@query("""
select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped,
       regexp_replace(html, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g') as collapsed from pages""")
def html_escape(spark, d):
    html = F.col("html")
    return load(spark, d, "pages").select("page_id", X.escaped_attribute(html).alias("escaped"), X.collapsed_space(html).alias("collapsed"))


@query("""
select c, case when regexp_matches(c, '^#[0-9a-f]{6}$') then upper(c) when c = '#abc' then '#AABBCC' when c = 'red' then '#FF0000' when c like 'rgb(%' then '#0AFF00' end as hex
from (values ('#12ab9f'), ('#abc'), ('red'), ('rgb(10, 300, 0)'), ('nope')) v(c)""")
def colour_hex(spark, d):
    colours = spark.createDataFrame([("#12ab9f",), ("#abc",), ("red",), ("rgb(10, 300, 0)",), ("nope",)], "c string")
    return colours.select("c", X.hex_colour(F.col("c")).alias("hex"))


@query("""
select event_id, json_extract_string(props, '$.k') as k, json_valid(props) as valid, length(props) as n from events""")
def json_props(spark, d):
    """JSON text: validity and a field."""
    props = F.col("props")
    return load(spark, d, "events").select("event_id", F.get_json_object(props, "$.k").alias("k"), A.valid_json(props).alias("valid"), F.length(props).alias("n"))


@query("""
select conv_id, max(text) filter (where role = 'user') as title, arg_max(text, turn) filter (where role = 'assistant') as content, max(turn) filter (where role = 'assistant') as content_at
from conversations group by conv_id""")
def pivot_fields(spark, d):
    """Tall rows to one row for each item."""
    role = F.col("role")
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(role == "user", F.col("text"))).alias("title"), F.max_by(F.when(role == "assistant", F.col("text")), F.when(role == "assistant", F.col("turn"))).alias("content"), F.max(F.when(role == "assistant", F.col("turn"))).alias("content_at"))


@query("select conv_id, string_agg(role, ' / ' order by turn) as roles, list(turn order by turn) as turns from conversations group by conv_id")
def ordered_concat(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return load(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), " / ").alias("roles"), F.transform("r", lambda x: x["turn"]).alias("turns"))


@query("""
select conv_id, floor((row_number() over (order by conv_id) - 1) / 25)::bigint as chunk from (select distinct conv_id from conversations)""")
def numbered_chunks(spark, d):
    """Ids cut into numbered units of 25."""
    ids = load(spark, d, "conversations").select("conv_id").distinct()
    return A.chunked(ids, "conv_id", 25).select("conv_id", "chunk")


@query("""
select vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) as ncc from (
  select vec_id, list_transform(e[1:32], lambda x: x - list_avg(e[1:32])) as a, list_transform(e[33:64], lambda x: x - list_avg(e[33:64])) as b
  from (select vec_id, embedding::double[] as e from embeddings))""")
def array_ncc(spark, d):
    """Normalised cross-correlation of two halves of an array."""
    e = F.col("embedding").cast("array<double>")
    return load(spark, d, "embeddings").select("vec_id", F.round(A.correlation(F.slice(e, 1, 32), F.slice(e, 33, 32)), 6).alias("ncc"))


@query("""
select p_partkey, least(greatest(round(p_size * 10 * 0.3), 28), 128)::int as pad,
  case when abs((p_size * 10.0 / 100) / (4.0 / 3) - 1) <= 0.05 then 100 else least(100, round(p_size * 10 / (4.0 / 3)))::int end as fit_height from part""")
def fit_aspect(spark, d):
    """Pure arithmetic of raster geometry."""
    width, height = F.col("p_size") * 10, F.lit(100)
    return load(spark, d, "part").select("p_partkey", A.two_up_pad(width).alias("pad"), A.fitted_height(width, height, 4 / 3).alias("fit_height"))


@query("""
select event_id, 3600 - (floor(epoch(ts))::bigint % 3600) as to_hour, (case when hour(ts) < 6 then ts::date + 1 else ts::date end)::date as game_date,
  strftime(ts, '%Y-%m-%d') || ' (' || (['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])[isodow(ts)] || ')' as published from events""")
def date_parts(spark, d):
    ts = F.col("ts").cast("timestamp")
    hour = F.hour("ts")
    return load(spark, d, "events").select("event_id", D.seconds_to_hour(ts).alias("to_hour"), D.game_date(F.to_date("ts"), hour).alias("game_date"), D.dated_with_weekday(ts, ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"], "UTC").alias("published"))


@query("""
select t, case t when '2024/01/05' then timestamp '2024-01-04 15:00' when '2024/1/5 09:30' then timestamp '2024-01-05 00:30' else timestamp '2024-02-02' end as at
from (values ('2024/01/05'), ('2024/1/5 09:30'), ('later')) v(t)""")
def local_dates(spark, d):
    """Wall-clock text of a zone as instants; unreadable text is now."""
    rows = spark.createDataFrame([("2024/01/05",), ("2024/1/5 09:30",), ("later",)], "t string")
    return rows.select("t", D.parsed_local(F.col("t"), F.lit("2024-02-02").cast("timestamp")).cast("timestamp_ntz").alias("at"))


@query("""
select o_orderkey, case when s < 60 then 'just now' when s < 3600 then floor(s / 60)::bigint || 'm ago' when s < 86400 then floor(s / 3600)::bigint || 'h ago' else floor(s / 86400)::bigint || 'd ago' end as ago
from (select o_orderkey, epoch(timestamp '2005-01-01') - epoch(o_orderdate) as s from orders)""")
def relative_times(spark, d):
    return load(spark, d, "orders").select("o_orderkey", D.relative_past(F.col("o_orderdate").cast("timestamp"), F.lit("2005-01-01").cast("timestamp")).alias("ago"))


@query("""
select doc_id, regexp_matches(text, '[ぁ-ヿ一-鿿]') as japanese, regexp_matches(source, '^[a-z0-9_]{1,64}$') as slug, coalesce(map {'en': 'English', 'fr': 'French'}[lang], lang) as label from documents""")
def text_predicates(spark, d):
    return load(spark, d, "documents").select("doc_id", X.has_japanese(F.col("text")).alias("japanese"), F.col("source").rlike(X.SLUG).alias("slug"), X.mapped(F.col("lang"), {"en": "English", "fr": "French"}, F.col("lang")).alias("label"))


@query("""
select l_orderkey, l_linenumber, case when l_linenumber = 1 then null when l_linenumber = 2 then l_quantity::int || '…' else l_quantity::int || '/50' end as progress from lineitem""")
def progress_texts(spark, d):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "step").otherwise("units")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.progress_text(F.col("l_quantity").cast("int"), F.when(n > 2, F.lit(50)), kind).alias("progress"))


@query("""
select conv_id, list_transform(range(3), lambda i: coalesce(roles[i + 1], 'none')) as paired from (select conv_id, list(role order by turn) as roles from conversations group by 1)""")
def span_pairs(spark, d):
    """Positional pairing of two arrays with a fallback."""
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return rows.select("conv_id", A.paired_or(F.array(*[F.lit("none")] * 3), F.col("roles")).alias("paired"))
