"""Scalar rules and small operators, each on a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import dates as D
from ..functions import text as X
from ..operators import resolve as R
from ..operators import temporal as P
from ..operators import tree as T
from ..sources import tables as S
from ..sources.tables import load
from ..streaming import runs
from .catalog import query

_NOW = "1997-06-15 20:30:00"
# Japan keeps nine hours before UTC all year
_LOCAL = "(o_orderdate + to_hours((o_custkey % 24)::bigint))"


def _at():
    return F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_custkey") % 24) * 3_600_000_000)


def _ntz(c):
    return c.cast("timestamp_ntz")


@query(f"""
select o_orderkey, date_trunc('day', o_orderdate) + interval 6 hour as changeover,
  strftime({_LOCAL} + interval 9 hour, '%Y-%m-%d') as day_attribute, strftime({_LOCAL} + interval 9 hour, '%Y-%m-%dT%H:%M:%S') || '+09:00' as time_attribute,
  strftime({_LOCAL} + interval 9 hour, '%Y-%m-%d') || ' (' || ['月', '火', '水', '木', '金', '土', '日'][isodow({_LOCAL} + interval 9 hour)] || ')' as named from orders""")
def local_attributes(spark, d):
    """Changeovers, event attributes and weekdays in the zone of the content."""
    at = _at()
    attribute = lambda kind: D.event_attribute(F.lit(kind), at)
    named = D.dated_with_weekday(at, list("月火水木金土日"))
    return load(spark, d, "orders").select("o_orderkey", _ntz(D.changeover(F.to_date("o_orderdate"))).alias("changeover"), attribute("allDay").alias("day_attribute"), attribute("mark").alias("time_attribute"), named.alias("named"))


@query(f"""
select o_orderkey, {_LOCAL} >= timestamp '1997-06-15 15:00:00' and {_LOCAL} < timestamp '1997-06-15 15:00:00' + interval 120 day as ahead,
  {_LOCAL} < timestamp '{_NOW}' + interval 9 hour - interval 3 month - interval 9 hour as old from orders""")
def horizon_and_retention(spark, d):
    """The next 120 days from the zone's midnight, and rows beyond three months of retention."""
    now = F.lit(_NOW).cast("timestamp")
    first, last = D.horizon(now)
    return load(spark, d, "orders").select("o_orderkey", ((_at() >= first) & (_at() < last)).alias("ahead"), (_at() < D.retention_cutoff(now, 3)).alias("old"))


@query(f"""
select o_orderkey, case o_orderkey % 4 when 0 then {_LOCAL} when 1 then {_LOCAL} - interval 9 hour when 2 then {_LOCAL} - interval 9 hour end as at from orders""")
def parsed_instants(spark, d):
    """Instants with an offset, and bare local ones of the zone."""
    k = F.col("o_orderkey")
    plain = F.date_format(_at(), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 4 == 0, F.concat(plain, F.lit("Z"))).when(k % 4 == 1, F.concat(plain, F.lit("+09:00"))).when(k % 4 == 2, plain).otherwise("soon")
    return load(spark, d, "orders").select("o_orderkey", _ntz(D.parsed_iso(text)).alias("at"))


@query("""
select o_orderkey, date_diff('day', timestamp '1997-06-15', o_orderdate) between -180 and 540 and o_custkey % 400 <= 180 as plausible from orders""")
def plausible_events(spark, d):
    """Bounds of start, order and duration."""
    start = F.col("o_orderdate").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + (F.col("o_custkey") % 400) * 86_400_000_000)
    return load(spark, d, "orders").select("o_orderkey", D.plausible(start, end, F.lit("1997-06-15").cast("timestamp")).alias("plausible"))


@query("""
select o_orderkey, case o_orderkey % 3 when 0 then o_orderdate - interval 9 hour when 1 then make_timestamp(1999, (o_custkey % 12 + 1)::bigint, 1, 0, 0, 0.0) - interval 9 hour else timestamp '2000-01-01' end as published from orders""")
def title_dates(spark, d):
    """The date in a title, else the first of the listing's month, else now."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    written = F.when(k % 6 == 0, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "yyyy年M月d日"))
    title = F.when(k % 3 == 0, F.concat(F.lit("x ("), written, F.lit(")"))).otherwise("x 12/3")
    year, month = F.when(k % 3 == 1, 1999), F.when(k % 3 == 1, (c % 12 + 1).cast("int"))
    return load(spark, d, "orders").select("o_orderkey", _ntz(D.date_in_title(title, year, month, F.lit("2000-01-01").cast("timestamp"))).alias("published"))


@query("""
select o_orderkey, case when o_orderkey % 2 = 0 then 'x' || o_custkey else '(1/2)' end as title from orders""")
def date_suffixes(spark, d):
    """A date in parentheses at the end goes, unless nothing would be left."""
    k = F.col("o_orderkey")
    suffix = F.when(k % 4 == 0, "（2024/1/5）").otherwise(" (1月5日 更新)")
    title = F.when(k % 2 == 0, F.concat(F.lit("x"), "o_custkey", suffix)).otherwise("(1/2)")
    return load(spark, d, "orders").select("o_orderkey", X.without_date_suffix(title).alias("title"))


@query("""
select p_partkey, case p_size % 3 when 0 then [p_name, 'b'] when 1 then null else null end as spans, case p_size % 3 when 0 then [p_name, 'b'] else [] end as cleaned,
  p_size % 3 = 0 as right_size, '日' || p_name as named, case when p_size % 2 = 0 then [p_brand, 'y'] else ['x', 'y'] end as paired from part""")
def span_rules(spark, d):
    """Spans from JSON: parsed, cleaned, counted, named by language and paired."""
    s = F.col("p_size")
    text = F.when(s % 3 == 0, F.concat(F.lit('["'), "p_name", F.lit('", "b"]'))).when(s % 3 == 1, '{"a": 1}').otherwise("no json")
    dirty = F.when(s % 3 == 0, F.concat(F.lit('[" '), "p_name", F.lit('", "  ", "b "]'))).otherwise("nope")
    two = F.array(F.lit("x"), F.lit("y"))
    titles = F.create_map(F.lit("en"), F.concat(F.lit("日"), "p_name"))
    other = F.when(s % 2 == 0, F.array("p_brand"))
    return load(spark, d, "part").select(
        "p_partkey",
        A.parsed_spans(text).alias("spans"),
        A.cleaned_spans(dirty).alias("cleaned"),
        F.coalesce(A.same_length(A.parsed_spans(text), two), F.lit(False)).alias("right_size"),
        A.fallback_name(titles, "fr", F.lit("base")).alias("named"),
        A.paired_or(two, F.coalesce(other, F.array().cast("array<string>"))).alias("paired"),
    )


@query("""
select o_custkey::varchar as id, arg_max(o_orderpriority, o_orderkey) as title from orders where o_orderkey % 5 not in (1, 2) group by o_custkey""")
def parsed_title_batches(spark, d):
    """Titles of batch replies, each of up to 1,000 keys: blank and mistyped entries drop alone, the last of an id wins."""
    k = F.col("o_orderkey")
    entry = lambda title: F.concat(F.lit('{"id": "'), "o_custkey", F.lit('", "title": '), title, F.lit("}"))
    title = F.when(k % 5 == 1, '" "').when(k % 5 == 2, "null").otherwise(F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))
    batch = F.expr("o_orderkey div 1000").alias("batch")
    replies = load(spark, d, "orders").groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", entry(title).alias("e")))).alias("all"))
    return A.parsed_titles(replies.select("batch", F.concat(F.lit("[3, "), F.array_join(F.transform("all", lambda x: x["e"]), ", "), F.lit("]")).alias("reply")), "reply", "batch")


@query("select doc_id, quality, toxic, 2 as languages from labels")
def language_maps(spark, d):
    """One row for each item with its values by language."""
    labels = load(spark, d, "labels")
    tall = labels.select("doc_id", F.lit("quality").alias("language"), F.col("quality").alias("value")).unionByName(labels.select("doc_id", F.lit("toxic").alias("language"), F.col("toxic").alias("value")))
    own = lambda c: F.col("by_language")[c]["value"].alias(c)
    return A.language_map(tall, ["doc_id"], "language", "value").select("doc_id", own("quality"), own("toxic"), F.size("by_language").alias("languages"))


@query("""
select o_custkey, string_agg('- ' || o_orderpriority || ' → ' || o_orderstatus, chr(10) order by o_orderkey) as section from orders group by o_custkey""")
def glossary_sections(spark, d):
    """Lines of a glossary section."""
    pairs = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("target"))))
    return load(spark, d, "orders").groupBy("o_custkey").agg(pairs.alias("p")).select("o_custkey", X.glossary_lines(F.col("p")).alias("section"))


@query("""
select page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) as lang, try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') as bigint) as number from pages
where regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) <> ''""")
def extracted_ids(spark, d):
    """Parts of addresses by pattern; null, not empty, without one."""
    rows = load(spark, d, "pages").select("page_id", X.extracted(F.col("url"), "^[a-z]+://[^/]+/([a-z]{2})/").alias("lang"), X.extracted(F.col("url"), "/([0-9]+)(?:[?#]|$)").try_cast("long").alias("number"))
    return rows.where("lang is not null")


@query("""
select p_partkey, 'https://cdn.test/' || p_partkey || '/a.png' as url, '/fr/news/' || 'ab' || p_partkey || case when p_size % 2 = 0 then '#x' else '' end as href,
  'a/' || p_partkey || case p_size % 3 when 0 then '.png' when 1 then '.jpg' else '.webp' end as key, p_type || '#' || p_name || '#z' as composite, p_type as content, p_name || '#z' as icon from part""")
def key_rules(spark, d):
    """Keys to addresses, article links to local ones, extensions by type, and composite keys both ways."""
    s, k = F.col("p_size"), F.col("p_partkey")
    mime = F.when(s % 3 == 0, "image/png").when(s % 3 == 1, "image/jpeg").otherwise("image/webp")
    href = F.concat(F.lit("https://site.test/news/AB"), k, F.lit("/?a=b"), F.when(s % 2 == 0, "#x").otherwise(""))
    composite = X.composite_key(F.col("p_type"), F.col("p_name"), F.lit("z"))
    return load(spark, d, "part").select(
        "p_partkey",
        X.upstream_url(F.concat(F.lit("c/"), k, F.lit("/a.png")), {"c": "cdn.test"}).alias("url"),
        X.rewritten_href(href, "site.test", {"news": "news"}, "fr").alias("href"),
        X.key_with_extension(F.concat(F.lit("a/"), k, F.lit(".gif")), mime).alias("key"),
        composite.alias("composite"),
        X.composite_parts(composite)[0].alias("content"),
        X.composite_parts(composite)[1].alias("icon"),
    )


@query("""
select p_partkey, p_name as plain, case p_size % 3 when 0 then 'image/png' when 1 then 'image/webp' end as mime from part""")
def reply_and_bytes(spark, d):
    """Replies without their code fence, and image types by first bytes."""
    s = F.col("p_size")
    fenced = F.when(s % 2 == 0, F.concat(F.lit("```json\n"), "p_name", F.lit("\n```"))).otherwise(F.col("p_name"))
    data = F.when(s % 3 == 0, F.unhex(F.lit("89504E470D0A1A0A00000000"))).when(s % 3 == 1, F.unhex(F.lit("52494646AABBCCDD574542505650"))).otherwise(F.unhex(F.lit("00112233")))
    return load(spark, d, "part").select("p_partkey", X.without_fence(fenced).alias("plain"), X.sniffed_mime(data).alias("mime"))


@query("select doc_id, length(text) > 2000 as batch from documents")
def batch_gate(spark, d):
    """Which bodies are long enough for the batch path."""
    return load(spark, d, "documents").select("doc_id", T.batch_size_gate(F.col("text"), 2000).alias("batch"))


@query("""
select event_id, case event_type when 'view' then 'running' when 'click' then 'failed' when 'purchase' then 'complete' else 'unknown' end as status from events""")
def engine_statuses(spark, d):
    t = F.col("event_type")
    engine = F.when(t == "view", "waitingForPause").when(t == "click", "errored").when(t == "purchase", "complete").otherwise("odd")
    return load(spark, d, "events").select("event_id", runs.from_engine(engine).alias("status"))


@query("select event_id from events where event_id // 50 < (select min(event_id // 50) from events where event_id % 731 = 730)")
def drained_pages(spark, d):
    """Results of pages before the first sentinel; what came after it counts as overrun."""
    e = load(spark, d, "events").withColumn("page", F.floor(F.col("event_id") / 50))
    return runs.drained(e.withColumn("stop", F.col("event_id") % 731 == 730), "page", "stop").select("event_id")


@query("""
select o_orderkey from orders, (select min(epoch_us(l_shipdate)) - 86400000000 as low, max(epoch_us(l_shipdate)) + 86400000000 as high from lineitem where l_partkey = 7) h where epoch_us(o_orderdate) between low and high""")
def hull_prune(spark, d):
    """The pool cut to the range of the batch."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    pool = load(spark, d, "orders").select("o_orderkey", micros("o_orderdate").alias("at"))
    batch = load(spark, d, "lineitem").where("l_partkey = 7").select(micros("l_shipdate").alias("b"))
    return P.hull_prune(pool, batch, "at", "b", 86_400_000_000).select("o_orderkey")


@query("""
select 'news' as item_type, o_orderkey::varchar as id, o_orderpriority as title, o_orderdate as published, null::int as sort_order from orders
union all select 'topic', p_partkey::varchar, p_name, null, null from part union all select 'playguide', s_suppkey::varchar, s_name, null, s_nationkey from supplier""")
def all_articles(spark, d):
    """The three article tables as one."""
    text = lambda c: F.col(c).cast("string").alias("id")
    news = load(spark, d, "orders").select(text("o_orderkey"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("published"))
    topics = load(spark, d, "part").select(text("p_partkey"), F.col("p_name").alias("title"))
    guides = load(spark, d, "supplier").select(text("s_suppkey"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("sort_order"))
    return S.articles(news, topics, guides).select("item_type", "id", "title", "published", "sort_order")


@query("""
select p_partkey, least(60, (select max(p_partkey) + 1 from part)) as next_cursor, 60 >= (select max(p_partkey) + 1 from part) as done from part where p_partkey between 40 and 59""")
def source_batch(spark, d):
    """A batch of a listing by cursor, with the next cursor."""
    return S.batch_of_sources(load(spark, d, "part").select("p_partkey"), 40, 20, "p_partkey").select("p_partkey", "next_cursor", "done")


@query("""
select l_orderkey, l_linenumber, l_partkey from lineitem where not coalesce(l_quantity > 5 and l_discount <= 0.08, false)""")
def rejected_rows(spark, d):
    """Rows that fail a check."""
    checks = {"quantity": "l_quantity > 5", "discount": "l_discount <= 0.08"}
    return S.rejected(load(spark, d, "lineitem"), checks).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
select o_orderkey, case when o_custkey % 2 = 0 and o_orderstatus = 'F' then 9 else 1 end as start, case when o_custkey % 2 = 0 and o_orderstatus = 'F' then 10 else 2 end as "end", o_orderpriority as title from orders""")
def refreshed_dates(spark, d):
    """Dates follow the extraction only where the article is the event's primary source; titles stay."""
    o = load(spark, d, "orders")
    k = F.col("o_orderkey").alias("id")
    events = o.select(k, F.col("o_orderpriority").alias("title"), F.lit(1).alias("start"), F.lit(2).alias("end"))
    extracted = o.where("o_custkey % 2 = 0").select(k, F.lit("other").alias("title"), F.lit(9).alias("start"), F.lit(10).alias("end"))
    primaries = o.select(F.col("o_orderkey").alias("event_id"), F.lit("news").alias("source_type"), F.col("o_orderstatus").alias("source_id"))
    return R.refreshed(events, extracted, primaries, ("news", "F")).select(F.col("id").alias("o_orderkey"), "start", "end", "title")


@query("""
with recursive e as (select event_id as pos, event_type as title, epoch_us(ts) as s from events),
l as (select b.pos, min(a.pos) as rep from e a join e b on a.title = b.title and a.pos < b.pos and abs(a.s - b.s) <= 600000000 group by b.pos),
w as (select pos, pos as rep from e union all select w.pos, l.rep from w join l on l.pos = w.rep)
select pos, min(rep) as rep from w group by pos""")
def first_occurrences(spark, d):
    """The first earlier row of an article that is the same and close."""
    e = load(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"))
    return R.first_occurrence(e, 600_000_000)


@query("""
with boss as (select user_id % 5 as content, 'b' || event_type as icon, ts as start, event_id from events where value > 30),
b as (select content::varchar as content, icon, start, coalesce(lead(start) over (partition by content order by start), start + interval 3 day) as "end" from boss)
select content, icon, start, "end" from b union all select 'day', event_type, date_trunc('day', ts), date_trunc('day', ts) + interval 1 day from events where value < 1""")
def schedule_rows(spark, d):
    """Rotations up to their successor and rows of whole days in one shape (icon grids have a query of their own)."""
    e = load(spark, d, "events")
    at = F.col("ts").cast("timestamp_ntz")
    slots = e.where("value > 30").select((F.col("user_id") % 5).cast("string").alias("content"), F.concat(F.lit("b"), "event_type").alias("icon"), at.alias("start"))
    day = F.date_trunc("day", at).cast("timestamp_ntz")
    days = e.where("value < 1").select(F.lit("day").alias("content"), F.col("event_type").alias("icon"), day.alias("start"), (day + F.expr("interval 1 day")).alias("end"))
    return P.schedule_rows(slots, days.limit(0), days, "3 days")


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 42")
def point_lookup(spark, d):
    """One row by its key."""
    return load(spark, d, "orders").where(F.col("o_orderkey") == 42).limit(1).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""
select o_orderkey, c_name, o_orderdate from (select * from orders where o_orderdate <= timestamp '1996-01-01' order by o_orderdate, o_orderkey limit 50) join customer on c_custkey = o_custkey""")
def due_with_payload(spark, d):
    """The most overdue rows, cut before the join that gives their payload."""
    due = load(spark, d, "orders").where(F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp_ntz")).orderBy("o_orderdate", "o_orderkey").limit(50)
    names = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return due.join(names, "o_custkey").select("o_orderkey", "c_name", "o_orderdate")
