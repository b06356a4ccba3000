"""Served images, labels, pages to refresh, gap fills and table changes on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing as L
from ..operators import merge as M
from ..operators import serving as V
from ..sources.tables import load
from ..streaming import runs as S
from .catalog import query

PATHS = {"F": "news", "O": "topic"}
BASE = "https://site.test/"

# an order is a render of its customer's image: originals, English and French ones; every render has two files
_RENDERS = """
with renders as (select o_orderkey as id, o_custkey as source_id, case o_orderkey % 3 when 0 then null when 1 then 'en' else 'fr' end as language, o_orderpriority as model, o_orderdate as created_at from orders),
files as (select 'f' || o_orderkey as key, o_orderkey as image_id, true as is_primary, case when o_orderkey % 11 = 0 then null else 'image/png' end as mime, o_orderkey % 640 as width, o_orderkey % 480 as height from orders
  union all select 's' || o_orderkey, o_orderkey, false, 'image/gif', 1, 1 from orders),
served as (select source_id, arg_max(f, o) filter (where language is not null) as localized, arg_max(f, o) filter (where language is null) as original from
  (select source_id, language, {'key': key, 'mime': mime, 'width': width, 'height': height} as f, row_number() over (order by created_at, id) as o from renders join files on image_id = id and is_primary
   where language = 'en' or language is null) group by source_id)"""


def _renders(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    renders = o.select(k.alias("id"), F.col("o_custkey").alias("source_id"), F.when(k % 3 == 1, "en").when(k % 3 == 2, "fr").alias("language"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("created_at"))
    main = o.select(F.concat(F.lit("f"), k).alias("key"), k.alias("image_id"), F.lit(True).alias("is_primary"), F.when(k % 11 != 0, "image/png").alias("mime"), (k % 640).alias("width"), (k % 480).alias("height"))
    other = o.select(F.concat(F.lit("s"), k).alias("key"), k.alias("image_id"), F.lit(False).alias("is_primary"), F.lit("image/gif").alias("mime"), F.lit(1).cast("long").alias("width"), F.lit(1).cast("long").alias("height"))
    return renders, main.unionByName(other)


@query(_RENDERS + "select source_id, localized.key as localized, original.key as original, localized.width as width, original.mime as mime from served")
def served_images(spark, d):
    """The newest localized and original file of each source."""
    served = V.served_files(*_renders(spark, d), "en")
    return served.select("source_id", F.col("localized.key").alias("localized"), F.col("original.key").alias("original"), F.col("localized.width").alias("width"), F.col("original.mime").alias("mime"))


@query(_RENDERS + "select id, source_id, key, width from renders join files on image_id = id and is_primary")
def primary_files(spark, d):
    return V.primary_files(*_renders(spark, d)).select("id", "source_id", "key", "width")


_SOURCES = """,
sources as (select 'k' || c_custkey as key, c_custkey as source_id, case c_custkey % 4 when 0 then null when 1 then []::varchar[] when 2 then ['日本', c_name] else [c_mktsegment] end as texts_ja from customer where c_custkey % 10 <> 9),
texts as (select c_custkey as source_id, [upper(c_name), c_mktsegment] as spans from customer where c_custkey % 5 = 0),
images as (select l_orderkey as item, l_linenumber as pos, l_suppkey as s, case when l_partkey % 7 = 0 then null else 'k' || (l_partkey % 2000) end as key, 'http://x/' || l_partkey as src from lineitem)"""


def _sources(spark, d):
    c = load(spark, d, "customer")
    k = F.col("c_custkey")
    texts_ja = F.when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("日本"), "c_name")).when(k % 4 == 3, F.array("c_mktsegment"))
    sources = c.where(k % 10 != 9).select(F.concat(F.lit("k"), k).alias("key"), k.alias("source_id"), texts_ja.alias("texts_ja"))
    texts = c.where(k % 5 == 0).select(k.alias("source_id"), F.array(F.upper("c_name"), F.col("c_mktsegment")).alias("spans"))
    i = load(spark, d, "lineitem")
    p = F.col("l_partkey")
    images = i.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("s"), F.when(p % 7 != 0, F.concat(F.lit("k"), p % 2000)).alias("key"), F.concat(F.lit("http://x/"), p).alias("src"))
    return sources, texts, images


@query(_RENDERS + _SOURCES + """
select item, pos, s, images.key, src, coalesce('/img/' || coalesce(localized, original).key, src) as served_src, coalesce(localized, original).width as width, coalesce(localized, original).height as height,
  case when len(coalesce(spans, texts_ja)) > 0 then coalesce(spans, texts_ja) end as text
from images left join sources using (key) left join served using (source_id) left join texts using (source_id)""")
def article_images(spark, d):
    """Images of translated articles as readers get them."""
    sources, texts, images = _sources(spark, d)
    return V.article_images(images, sources, V.served_files(*_renders(spark, d), "en"), texts, True)


@query(_RENDERS + _SOURCES + """
select item, pos, s, images.key, src, coalesce('/img/' || original.key, src) as served_src, original.width as width, original.height as height, case when len(texts_ja) > 0 then texts_ja end as text
from images left join sources using (key) left join served using (source_id)""")
def article_images_original(spark, d):
    """Images of untranslated articles: originals and transcriptions only."""
    sources, texts, images = _sources(spark, d)
    return V.article_images(images, sources, V.served_files(*_renders(spark, d), "en"), texts, False)


@query(_RENDERS + _SOURCES + """
select id, case when trim(array_to_string(coalesce(spans, texts_ja, []), ' ')) <> '' then coalesce(localized_title, title_ja) || '：' || trim(array_to_string(coalesce(spans, texts_ja, []), ' ')) else localized_title end as localized_title
from (select o_orderkey as id, 'k' || (o_custkey + 5) as key, o_orderstatus as title_ja, case when o_orderkey % 2 = 0 then o_orderpriority end as localized_title from orders) e left join sources using (key) left join texts using (source_id)""")
def schedule_labels(spark, d):
    """Titles of scheduled events with the names of their icons."""
    sources, texts, _ = _sources(spark, d)
    k = F.col("o_orderkey")
    events = load(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("k"), F.col("o_custkey") + 5).alias("key"), F.col("o_orderstatus").alias("title_ja"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("localized_title"))
    return V.labelled_icons(events, sources, texts).select("id", "localized_title")


_PAGES = """
with changed as (select 'k' || p_partkey as key, case when p_partkey % 2 = 0 then 'en' else 'fr' end as language from part where p_partkey % 7 = 0),
urls as (select distinct key, url from (
  select key, 'https://site.test/' || language || '/' || case l_linestatus when 'F' then 'news' else 'topic' end || '/' || l_orderkey as url from changed join lineitem on key = 'k' || l_partkey
  union all select key, 'https://site.test/' || language || slash from changed join part on key = 'k' || p_partkey and p_size <= 5, (values (''), ('/')) v(slash)))"""


def _changed_pages(spark, d):
    p = load(spark, d, "part")
    k = F.col("p_partkey")
    changed = p.where(k % 7 == 0).select(F.concat(F.lit("k"), k).alias("key"), F.when(k % 2 == 0, "en").otherwise("fr").alias("language"))
    index = load(spark, d, "lineitem").select(F.col("l_linestatus").alias("item_type"), F.col("l_orderkey").cast("string").alias("item_id"), F.concat(F.lit("k"), F.col("l_partkey")).alias("image_key"))
    banners = p.where("p_size <= 5").select(F.concat(F.lit("k"), k).alias("image_key"))
    return V.pages_with_image(changed, index, banners, PATHS, BASE)


@query(_PAGES + "select key, url from urls")
def image_pages(spark, d):
    """Pages to refresh after an image changed: articles that show it, and home pages if a banner does."""
    return _changed_pages(spark, d)


@query(_PAGES + "select key, chunk, list(url order by url) as urls from (select key, url, ((row_number() over (partition by key order by url) - 1) // 30)::int as chunk from urls) group by key, chunk")
def url_chunks(spark, d):
    return V.url_chunks(_changed_pages(spark, d), "key")


@query("""
select l_linestatus as item_type, l_orderkey::varchar as item_id, 'https://site.test/' || code || '/' || case l_linestatus when 'F' then 'news' else 'topic' end || '/' || l_orderkey as url
from (select distinct l_linestatus, l_orderkey from lineitem) a cross join (select distinct lang as code from documents) l""")
def article_urls(spark, d):
    """Every article's page in every language."""
    articles = load(spark, d, "lineitem").select(F.col("l_linestatus").alias("item_type"), F.col("l_orderkey").cast("string").alias("item_id")).distinct()
    return V.article_urls(articles, load(spark, d, "documents").select(F.col("lang").alias("code")).distinct(), PATHS, BASE)


@query("select l_orderkey as item_id, 'k' || l_partkey as key, bool_or(l_returnflag = 'R') as transcribe from lineitem where l_suppkey % 9 <> 0 group by all")
def ingest_units(spark, d):
    """Image keys of each article, with whether a place of theirs may be transcribed."""
    key = F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("k"), F.col("l_partkey")))
    return V.ingest_units(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), key.alias("key"), (F.col("l_returnflag") == "R").alias("transcribable")))


@query(_RENDERS + _SOURCES + """
select item, pos, s, images.key, src, case when source_id % 4 = 2 and source_id not in (select source_id from texts) then texts_ja end as text from images left join sources using (key)""")
def body_context(spark, d):
    """Transcriptions to send along with a body: Japanese ones of images not translated yet."""
    sources, texts, images = _sources(spark, d)
    return V.body_context(images, sources, texts)


@query(_RENDERS + "select c_custkey as source_id from customer where c_custkey not in (select source_id from renders where language is null)")
def without_original(spark, d):
    return V.without_original(load(spark, d, "customer").select(F.col("c_custkey").alias("source_id")), _renders(spark, d)[0])


@query(_RENDERS + """
select c_custkey as source_id, case when model in ('1-URGENT', 'manual') then 'skipped' else 'render' end as outcome
from customer left join (select source_id, arg_max(model, o) as model from (select *, row_number() over (order by created_at, id) as o from renders where language = 'fr') group by source_id) m on m.source_id = c_custkey""")
def render_outcomes(spark, d):
    """Renders to make: skipped where the newest one is by the same model."""
    latest = V.latest_models(_renders(spark, d)[0], "fr")
    return V.render_outcomes(load(spark, d, "customer").select(F.col("c_custkey").alias("source_id")), latest, "1-URGENT")


@query("select doc_id, false as force from documents where doc_id not in (select doc_id from labels where quality = 1) union all select doc_id, true from documents")
def gap_fill(spark, d):
    """What a gap fill and a forced run translate."""
    docs, done = load(spark, d, "documents").select("doc_id"), load(spark, d, "labels").where("quality = 1")
    return V.untranslated(docs, done, "doc_id").withColumn("force", F.lit(False)).unionByName(V.untranslated(docs, done, "doc_id", True).withColumn("force", F.lit(True)))


@query("select p_partkey, p_name from part where p_type = 'ECONOMY' and p_name ilike '%RED%' order by p_partkey desc limit 100")
def search_events(spark, d):
    """A search without regard to ASCII case and a type filter, both applied, newest first."""
    rows = load(spark, d, "part").where(L.conjunction(F.col("p_type") == "ECONOMY", L.like_text("p_name", "RED")))
    return rows.orderBy(F.col("p_partkey").desc()).limit(L.clamped(None, 100, 100)).select("p_partkey", "p_name")


@query("select event_id, user_id from events where event_type in ('view', 'click') or ts >= timestamp '2024-01-05'")
def visible_runs(spark, d):
    """Active runs, and settled ones that changed within the last day."""
    runs = load(spark, d, "events").withColumn("status", F.when(F.col("event_type").isin("view", "click"), "running").otherwise("complete"))
    return S.visible(runs.withColumnRenamed("ts", "updated_at"), F.lit("2024-01-06").cast("timestamp_ntz"), 24).select("event_id", "user_id")


@query("select event_id from events where event_type like 'er%' or event_type = 'view'")
def composite_prefix(spark, d):
    """Rows of a composite key: the key itself, or anything after its separator."""
    rows = load(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "view#1").otherwise(F.col("event_type")).alias("source_id"))
    return rows.where(L.within_key("source_id", "view")).select("event_id")


@query("""
with p as (select o_orderkey as id, o_orderstatus as name from orders where o_orderkey % 3 = 0), n as (select o_orderkey as id, o_orderstatus as name from orders where o_orderkey % 2 = 0 and o_orderkey not in (select id from p))
select 'parent' as kind, id, name as value from p union all select 'parent', id, name from n
union all select 'child', id, 'a' || id from n union all select 'child', id, 'b' || id from n""")
def insert_with_children(spark, d):
    """Parents and children written together; parents that exist add nothing."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    own = F.array(*[F.struct(F.concat(F.lit(c), F.col("id")).alias("value")) for c in "ab"])
    none = o.select(F.col("id").alias("parent"), F.col("name").alias("value")).limit(0)
    parents, children = M.insert_with_children(o.where("id % 3 = 0"), none, o.where("id % 2 = 0").withColumn("files", own), "files", "id", "parent")
    return parents.select(F.lit("parent").alias("kind"), "id", F.col("name").alias("value")).unionByName(children.select(F.lit("child").alias("kind"), F.col("parent").alias("id"), "value"))


@query("select doc_id, quality, false as made from labels union all select doc_id, null, true from documents where doc_id not in (select doc_id from labels)")
def ensured_rows(spark, d):
    labels = load(spark, d, "labels").select("doc_id", "quality").withColumn("made", F.lit(False))
    return M.ensured(labels, load(spark, d, "documents"), "doc_id", made=F.lit(True))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def delete_by_item(spark, d):
    """All rows of some items go, whatever the rest of their key."""
    gone = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.without_keys(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, ["l_orderkey"])


@query("""
select o_orderkey, case when o_orderstatus in ('O', 'P') and o_orderkey <> max(case when o_orderstatus in ('O', 'P') and r = 1 then o_orderkey end) over (partition by o_custkey) then 'terminated' else o_orderstatus end as status
from (select *, row_number() over (partition by o_custkey, o_orderstatus in ('O', 'P') order by o_orderdate desc, o_orderkey desc) as r from orders)""")
def one_active_run(spark, d):
    """Only the last started of several active runs of an item stays active."""
    runs = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderstatus").alias("status"))
    return M.one_active(runs, ["o_custkey"], ("O", "P"), "o_orderdate", "o_orderkey").select("o_orderkey", "status")


@query("""
select 'render' as kind, c_custkey || ':original' as id, null as key from customer where c_acctbal > 0
union all select 'render', o_custkey || ':' || o_orderkey, null from orders where o_orderstatus = 'F'
union all select 'file', c_custkey || ':original', 'k' || c_custkey from customer where c_acctbal > 0
union all select 'file', o_custkey || ':' || o_orderkey, 'v' || o_orderkey from orders where o_orderstatus = 'F'""")
def seeded_renders(spark, d):
    """First renders and files from mirrored sources and finished urls."""
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    sources = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("k"), F.col("c_custkey")).alias("key"), F.when(F.col("c_acctbal") > 0, "done").otherwise("pending").alias("mirror_state"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    done = o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").cast("string").alias("language"), F.lit("url").alias("field"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("state"), F.concat(F.lit("v"), F.col("o_orderkey")).alias("value"), F.lit("m").alias("model"), F.col("o_orderdate").alias("translated_at"))
    renders, files = M.seeded_renders(sources, done)
    return renders.select(F.lit("render").alias("kind"), "id", F.lit(None).cast("string").alias("key")).unionByName(files.select(F.lit("file").alias("kind"), F.col("image_id").alias("id"), "key"))
