"""Entity resolution of dated events: matching, clustering, primary sources, merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .listing import top_per_group
from .temporal import close_pairs, micros

#: Two days, in microseconds.
TOLERANCE = 2 * 86_400_000_000


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): least reachable id for links (a, b), by label spreading with shortcuts.

    Every step is a join and a sum; its result is written to the shared folder, which cuts lineage.  The number of
    steps grows with the logarithm of the longest chain; labels only fall, so it ends.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = label.join(near, "id").select("id", F.least("label", "near").alias("label"))
        jump = low.join(label.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = written(jump)
        changed = new.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        label = new
        if not changed:
            return label.select("id", F.col("label").alias("component"))


def same_and_close(events: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Links (a, b), a < b, between events (id, title, start, end) of equal title and close times."""
    left = events.select("title", F.col("id").alias("a"), micros("start").alias("ls"), micros("end").alias("le"))
    right = events.select("title", F.col("id").alias("b"), micros("start").alias("rs"), micros("end").alias("re"))
    return close_pairs(left, right, ["title"], tolerance, ("a", "b")).where("a < b")


def first_occurrence(rows: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(pos, rep): for rows (pos, title, start, end), the first earlier row that is the same and close, or what that one stands for.

    Each row points to its first match; the ends of the chains come by doubling, one
    join a step.
    """
    links = same_and_close(rows.withColumn("id", F.col("pos")), tolerance)
    earliest = links.groupBy(F.col("b").alias("pos")).agg(F.min("a").alias("rep"))
    rep = written(rows.select("pos").join(earliest, "pos", "left").withColumn("rep", F.coalesce("rep", "pos")))
    while True:
        onward = rep.select(F.col("pos").alias("rep"), F.col("rep").alias("rep2"))
        step = written(rep.join(onward, "rep").select("pos", "rep", "rep2"))
        moved = not step.where("rep <> rep2").isEmpty()
        rep = step.select("pos", F.col("rep2").alias("rep"))
        if not moved:
            return rep


def matched(extracted: DataFrame, pool: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(pos, event_id): the pool's event of equal title and close times; of several the earliest start, then id."""
    left = extracted.select("title", F.col("pos").alias("a"), micros("start").alias("ls"), micros("end").alias("le"))
    right = pool.select("title", F.col("id").alias("b"), micros("start").alias("rs"), micros("end").alias("re"))
    pairs = close_pairs(left, right, ["title"], tolerance, ("a", "b")).join(pool.select(F.col("id").alias("b"), "start"), "b")
    return top_per_group(pairs, ["a"], [F.col("start"), F.col("b")]).select(F.col("a").alias("pos"), F.col("b").alias("event_id"))


def candidates(extracted: DataFrame, pool: DataFrame, kind: str = "type", tolerance: int = TOLERANCE) -> DataFrame:
    """(pos, event_id) of close events whatever their title, inside an equal `kind` (the blocking key)."""
    left = extracted.select(kind, F.col("pos").alias("a"), micros("start").alias("ls"), micros("end").alias("le"))
    right = pool.select(kind, F.col("id").alias("b"), micros("start").alias("rs"), micros("end").alias("re"))
    return close_pairs(left, right, [kind], tolerance, ("a", "b")).select(F.col("a").alias("pos"), F.col("b").alias("event_id"))


def adjudicated(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verdicts (pos, event_id) of a judge, kept only where they name one of the row's own candidates."""
    return judge(pairs).select("pos", "event_id").join(pairs.select("pos", "event_id").distinct(), ["pos", "event_id"], "left_semi")


def resolve_article(extracted: DataFrame, pool: DataFrame, links: DataFrame, source: tuple[str, str], mint: Callable[[Column], Column], judge: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """One article's extracted events (pos, type, title, start, end) against the pool.

    Repeats inside the article follow their first occurrence; exact matches and then
    the judge's verdicts name existing events; the rest are minted.  Returns the new
    events, the article's links, links of others and the orphans left behind.
    """
    reps = first_occurrence(extracted)
    heads = extracted.join(reps.where("pos = rep").select("pos"), "pos", "left_semi")
    exact = matched(heads, pool)
    rest = heads.join(exact, "pos", "left_anti")
    named = exact
    if judge is not None:
        named = named.unionByName(adjudicated(candidates(rest, pool), judge))
    minted = heads.join(named, "pos", "left_anti").withColumn("id", mint(F.col("pos")))
    chosen = named.select("pos", F.col("event_id").alias("id")).unionByName(minted.select("pos", "id"))
    fresh = chosen.select(F.col("id").alias("event_id")).distinct().withColumn("source_type", F.lit(source[0])).withColumn("source_id", F.lit(source[1]))
    own = (F.col("source_type") == source[0]) & (F.col("source_id") == source[1])
    others = links.where(~own)
    all_links = others.select("event_id", "source_type", "source_id").unionByName(fresh)
    stale = links.where(own).join(fresh, "event_id", "left_anti")
    return {"minted": minted, "chosen": chosen, "links": all_links, "stale": stale, "orphans": orphans(pool, all_links)}


def orphans(events: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    return events.join(links.select(F.col("event_id").alias(key)).distinct(), key, "left_anti")


def primary_sources(events: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """(event_id, source_type, source_id): a source whose headline names the event, then the oldest, then by id.

    articles: (source_type, source_id, headline, published); a source without a date comes last.
    """
    named = links.join(events.select(F.col("id").alias("event_id"), "title"), "event_id").join(articles, ["source_type", "source_id"], "left")
    names = F.coalesce((F.length("title") > 0) & (F.length("headline") > 0) & (F.contains("headline", "title") | F.contains("title", "headline")), F.lit(False))
    return top_per_group(named.withColumn("names", names), ["event_id"], [F.col("names").desc(), F.col("published").asc_nulls_last(), F.col("source_id")]).select("event_id", "source_type", "source_id")


def clusters(events: DataFrame, judged: DataFrame | None = None, tolerance: int = TOLERANCE) -> DataFrame:
    """(id, survivor): events joined by equal title and close times, and by judged pairs; the oldest survives.

    events: (id, title, start, end, created).  Chains count: closeness is not
    transitive, components are.
    """
    edges = same_and_close(events, tolerance)
    if judged is not None:
        edges = edges.unionByName(judged.select("a", "b"))
    label = connected(edges)
    rows = events.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    oldest = rows.groupBy("component").agg(F.min_by("id", F.struct("created", "id")).alias("survivor"))
    return rows.join(oldest, "component").select("id", "survivor")


def merged_links(links: DataFrame, survivors: DataFrame) -> DataFrame:
    """Links of losers move to survivors; repeats vanish."""
    return links.join(survivors.withColumnRenamed("id", "event_id"), "event_id", "left").select(F.coalesce("survivor", "event_id").alias("event_id"), "source_type", "source_id").distinct()


def refreshed(events: DataFrame, extracted: DataFrame, primaries: DataFrame, source: tuple[str, str]) -> DataFrame:
    """Dates follow the extraction only where its article is the primary source; titles never change."""
    own = primaries.where((F.col("source_type") == source[0]) & (F.col("source_id") == source[1])).select(F.col("event_id").alias("id"))
    new = extracted.join(own, "id", "left_semi").select("id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.lit(True).alias("_hit"))
    return events.join(new, "id", "left").withColumn("start", F.when(F.col("_hit"), F.col("_s")).otherwise(F.col("start"))).withColumn("end", F.when(F.col("_hit"), F.col("_e")).otherwise(F.col("end"))).drop("_s", "_e", "_hit")


def within_budgets(due: DataFrame, polls: int, changes: int) -> DataFrame:
    """The `polls` most overdue rows; of the changed ones the first `changes` run, the others stay due."""
    from pyspark.sql import Window

    taken = due.orderBy("next_check", "key").limit(polls)
    n = F.count_if("changed").over(Window.orderBy("next_check", "key").rowsBetween(Window.unboundedPreceding, 0))  # `polls` rows at most
    return taken.withColumn("outcome", F.when(~F.col("changed"), "unchanged").when(n <= changes, "rerun").otherwise("deferred"))


def resolvable(extracted: DataFrame) -> DataFrame:
    """The four forms of an extracted event in one shape (..., type, title, start, end).

    extracted: (..., type, title, date, start, end, timestamp); marks have a timestamp,
    all-day events a date, and neither has an end.
    """
    ranged = F.col("type").isin("multiDay", "span")
    begin = F.when(ranged, F.col("start")).when(F.col("type") == "allDay", F.col("date")).otherwise(F.col("timestamp"))
    rest = [c for c in extracted.columns if c not in ("date", "start", "end", "timestamp")]
    return extracted.select(*rest, begin.alias("start"), F.when(ranged, F.col("end")).alias("end"))


def judge_input(pairs: DataFrame, order: list[str]) -> DataFrame:
    """(article, payload): each article's open cases as JSON, numbered from 0 in order.

    pairs: (article, order..., new, candidates) with structs for both.
    """
    cases = F.array_sort(F.collect_list(F.struct(*order, "new", "candidates")))
    numbered = F.transform(cases, lambda x, i: F.struct(i.alias("id"), x["new"].alias("new"), x["candidates"].alias("candidates")))
    return pairs.groupBy("article").agg(F.to_json(numbered).alias("payload"))


def correlated(responses: DataFrame, languages: DataFrame) -> DataFrame:
    """Batch responses (batch, pos, lang, ...) with the language of their metadata, else that of their place in the request (batch, langs)."""
    return responses.join(languages, "batch").withColumn("lang", F.coalesce("lang", F.get("langs", F.col("pos")))).drop("langs")


def article_results(bodies: DataFrame, event_titles: DataFrame) -> DataFrame:
    """(item, success, fields): an article succeeds if every language's body does; titles of its events count as fields too.

    bodies: (item, ok, fields); event_titles: (item, fields).
    """
    both = bodies.select("item", "ok", "fields").unionByName(event_titles.select("item", F.lit(True).alias("ok"), "fields"))
    return both.groupBy("item").agg(F.bool_and("ok").alias("success"), F.sum("fields").alias("fields"))


def fetched_fields(items: DataFrame) -> DataFrame:
    """What a body fetch sets: (..., fetch, published, title).

    items: (..., kind, has_tree, stored_published, found_published, found_title,
    stored_title, fallback_title).  News with a tree are not fetched again; a topic keeps
    its date; a guide's title is the found, the stored or the fallback one, others keep theirs.
    """
    guide = F.col("kind") == "playguide"
    return items.select(
        *[c for c in items.columns if c not in ("has_tree", "stored_published", "found_published", "found_title", "stored_title", "fallback_title")],
        (~((F.col("kind") == "news") & F.col("has_tree"))).alias("fetch"),
        F.when(F.col("kind") == "topic", F.coalesce("stored_published", "found_published")).otherwise(F.col("found_published")).alias("published"),
        F.when(guide, F.coalesce("found_title", "stored_title", "fallback_title")).otherwise(F.col("stored_title")).alias("title"),
    )
