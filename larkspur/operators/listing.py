"""Listings: filters, keyset pages, top rows, counts and fallbacks."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def conjunction(*conditions: Column | None) -> Column:
    """All given conditions; None stands for one that was not asked for."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def like_text(column: str, term: str) -> Column:
    """The column holds the term, without regard to ASCII case; % and _ in the term keep their meaning as wildcards."""
    return F.col(column).ilike(f"%{term}%")


def within_key(column: str, key: str, separator: str = "#") -> Column:
    """A composite key is this key, or one of its parts after the separator."""
    return (F.col(column) == key) | F.col(column).startswith(key + separator)


def clamped(limit: int | None, default: int, most: int) -> int:
    return max(1, min(limit if limit is not None else default, most))


def newest_page(df: DataFrame, size: int, published: str, key: str | None = None, before=None, before_key=None) -> DataFrame:
    """The newest `size` rows before a cursor, with has_more.

    With `key` the cursor is (published, key) and no row is skipped at ties; without
    it the cursor is strict on published alone, which skips ties of the boundary.
    One top-n of size + 1 rows; the page itself is bounded by `size`.
    """
    after = None
    if before is not None:
        after = F.col(published) < before
        if key is not None and before_key is not None:
            after = after | ((F.col(published) == before) & (F.col(key) < before_key))
    order = [F.col(published).desc()] + ([F.col(key).desc()] if key else [])
    page = df.where(conjunction(after)).orderBy(*order).limit(size + 1)
    ranked = page.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # size + 1 rows at most
    return ranked.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def keyset_page(df: DataFrame, size: int, key: str, after=None, descending: bool = False, where: Column | None = None) -> DataFrame:
    """The next `size` rows by a unique key; filters apply before the limit, so cursors walk matches."""
    bound = None if after is None else (F.col(key) < after if descending else F.col(key) > after)
    return df.where(conjunction(bound, where)).orderBy(F.col(key).desc() if descending else F.col(key)).limit(size)


def top_per_group(df: DataFrame, group: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group.  Spark keeps n rows of a group in each task before it shuffles."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_n")


def newest_per_group(df: DataFrame, group: list[str], value: str, *order: str, name: str | None = None) -> DataFrame:
    """`value` of the row with the greatest order in each group, by one partial aggregation."""
    return df.groupBy(*group).agg(F.max_by(value, F.struct(*order)).alias(name or value))


def localized(items: DataFrame, translations: DataFrame, key: str, language: str, field: str = "title", name: str = "localized_title", item_type: str | None = None) -> DataFrame:
    """items with the translated field, or null.  A stale translation still serves; its state does not matter."""
    own = translations.where(conjunction(F.col("language") == language, F.col("field") == field, F.col("item_type") == item_type if item_type else None))
    return items.join(own.select(F.col("item_id").alias(key), F.col("value").alias(name)), key, "left")


def without_value(items: DataFrame, translations: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Items with no translation row, or none that holds a value."""
    return items.join(translations.where(F.col(value).isNotNull()).select(key), key, "left_anti")


def layered(overrides: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Overrides and the base rows that none of them shadows, with is_override."""
    rest = base.join(overrides.select(*key), key, "left_anti")
    return overrides.withColumn("is_override", F.lit(True)).unionByName(rest.withColumn("is_override", F.lit(False)))


def flagged(items: DataFrame, present: DataFrame, key: str, name: str) -> DataFrame:
    """items with a boolean: does `present` hold the key?"""
    return items.join(present.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def contained_terms(texts: DataFrame, terms: DataFrame, text: str, term: str, most_terms: int = 100_000) -> DataFrame:
    """Pairs of a text and a dictionary term that it contains, with the columns of both.

    Each text is read once, by one automaton of all terms, whatever their number.  The
    dictionary is sent out only behind a check of its size; a larger one is searched
    in slices by hash, each of bounded size.  Empty terms are in every text.
    """
    spark, kind = texts.sparkSession, texts.schema
    words = terms.where(F.col(term).isNotNull()).select(F.col(term).alias("_term")).distinct()
    slices = -(-max(words.count(), 1) // most_terms)
    schema = StructType([*kind.fields, StructField("_term", StringType())])
    at = texts.columns.index(text)
    parts = []
    for k in range(slices):
        own = words if slices == 1 else words.where(F.pmod(F.xxhash64("_term"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast([r[0] for r in own.collect()])  # most_terms or about so many

        def run(batches, shared=shared):
            search = _term_search(shared.value)
            for batch in batches:
                rows, found = [], []
                for i, value in enumerate(batch.column(at).to_pylist()):
                    here = search(value) if value is not None else ()
                    rows += [i] * len(here)
                    found += here
                some = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.string())], schema.names)

        parts.append(texts.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts).join(terms, F.col("_term") == F.col(term)).drop("_term")


def _term_search(terms: list[str]):
    """A function that gives the different terms in a text, in any order."""
    empty = [""] if "" in terms else []
    terms = [t for t in terms if t]
    try:
        import ahocorasick
    except ImportError:
        known, lengths = set(terms), sorted({len(t) for t in terms})
        return lambda text: empty + list({text[i : i + n] for i in range(len(text)) for n in lengths} & known)
    automaton = ahocorasick.Automaton()
    for t in terms:
        automaton.add_word(t, t)
    if not terms:
        return lambda text: empty
    automaton.make_automaton()
    return lambda text: empty + list({t for _, t in automaton.iter(text)})


def default_if_empty(df: DataFrame, default: DataFrame) -> DataFrame:
    """df, or the default rows if it has none."""
    return df.unionByName(default.join(df.limit(1).select(F.lit(1).alias("_some")), F.lit(True), "left_anti"))


def in_order(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df for ids (key, pos), in the order of pos; missing ones are left out."""
    return df.join(ids, key).orderBy("pos")


def schedule(entries: DataFrame, now: Column, due_limit: int, upcoming_limit: int, retired_limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Due, upcoming and retired entries (key, next_check), each sorted and cut."""
    due = entries.where(F.col("next_check") <= now).orderBy("next_check", "key").limit(due_limit)
    upcoming = entries.where(F.col("next_check") > now).orderBy("next_check", "key").limit(upcoming_limit)
    retired = entries.where(F.col("next_check").isNull()).orderBy("key").limit(retired_limit)
    return due, upcoming, retired


def pages_until_stale(pages: DataFrame, page: str, is_new: str, share: float = 0.5) -> DataFrame:
    """Rows of the pages up to and with the first on which less than `share` of the rows is new."""
    stale = pages.groupBy(page).agg(F.avg(F.col(is_new).cast("double")).alias("new")).where(F.col("new") < share).agg(F.min(page).alias("_stop"))
    return pages.crossJoin(F.broadcast(stale)).where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop")  # one row
