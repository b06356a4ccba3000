"""Loading tables, and the catalog of the content pipeline as Spark schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _LONG, _INT, _BOOL, _TIME = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns chosen later reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _schema(key: str, /, **columns) -> T.StructType:
    """Columns named in `key` are not null; others may be."""
    keys = key.split()
    return T.StructType([T.StructField(n, t, n not in keys) for n, t in columns.items()])


_BODY = {"blocks_ja": _TEXT, "body_fetched_at": _TIME, "body_checked_at": _TIME, "body_changed_at": _TIME}

#: Names of the fifteen stored tables and their columns.  Trees and spans are JSON text; instants are UTC timestamps.
SCHEMAS: dict[str, T.StructType] = {
    "news_items": _schema("id title_ja category published_at", id=_TEXT, title_ja=_TEXT, category=_TEXT, published_at=_TIME, **_BODY),
    "topics": _schema("id published_at title_ja", id=_TEXT, published_at=_TIME, title_ja=_TEXT, category=_TEXT, **_BODY),
    "playguides": _schema("id sort_order title_ja", id=_TEXT, sort_order=_INT, published_at=_TIME, title_ja=_TEXT, **_BODY),
    "translations": _schema("item_type item_id language field state updated_at", item_type=_TEXT, item_id=_TEXT, language=_TEXT, field=_TEXT, state=_TEXT, error=_TEXT, value=_TEXT, translated_at=_TIME, model=_TEXT, updated_at=_TIME),
    "events": _schema("id type title_ja start_time created_at", id=_TEXT, type=_TEXT, title_ja=_TEXT, start_time=_TIME, end_time=_TIME, zone=_TEXT, source_type=_TEXT, source_id=_TEXT, created_at=_TIME),
    "event_sources": _schema("event_id source_type source_id created_at", event_id=_TEXT, source_type=_TEXT, source_id=_TEXT, created_at=_TIME),
    "glossary": _schema("source_text target_language translated_text", source_text=_TEXT, target_language=_TEXT, translated_text=_TEXT, updated_at=_TIME),
    "glossary_overrides": _schema("source_text target_language translated_text", source_text=_TEXT, target_language=_TEXT, translated_text=_TEXT, updated_at=_TIME),
    "languages": _schema("code label enabled", code=_TEXT, label=_TEXT, native_label=_TEXT, enabled=_BOOL, updated_at=_TIME),
    "reset_milestones": _schema("id title_ja rrule enabled sort_order", id=_TEXT, title_ja=_TEXT, titles=T.MapType(_TEXT, _TEXT), rrule=_TEXT, enabled=_BOOL, sort_order=_INT, note=_TEXT, created_at=_TIME, updated_at=_TIME),
    "image_sources": _schema("id key mirror_state transcribe_state", id=_LONG, key=_TEXT, texts_ja=T.ArrayType(_TEXT), transcribe_model=_TEXT, mirror_state=_TEXT, transcribe_state=_TEXT, updated_at=_TIME),
    "images": _schema("id source_id created_at", id=_TEXT, source_id=_LONG, language=_TEXT, model=_TEXT, created_at=_TIME),
    "image_files": _schema("key image_id is_primary", key=_TEXT, image_id=_TEXT, is_primary=_BOOL, mime=_TEXT, width=_INT, height=_INT, bytes=_LONG, created_at=_TIME),
    "article_images": _schema("item_type item_id image_key", item_type=_TEXT, item_id=_TEXT, image_key=_TEXT),
    "banners": _schema("id image_key active", id=_LONG, image_key=_TEXT, link_url=_TEXT, link_topic_id=_TEXT, alt_ja=_TEXT, sort_order=_INT, published_at=_TIME, active=_BOOL, updated_at=_TIME),
}

#: States and event types as stored.
STATES = ("pending", "running", "done", "failed")
EVENT_TYPES = ("multiDay", "allDay", "span", "mark")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


#: Row checks that the stored tables must pass.
CHECKS: dict[str, dict[str, Column | str]] = {
    "translations": {
        "state": "state in ('pending', 'running', 'done', 'failed')",
        "done_is_complete": "state <> 'done' or (value is not null and translated_at is not null and model is not null)",
    },
    "events": {
        "type": "type in ('multiDay', 'allDay', 'span', 'mark')",
        "end_by_type": "(type in ('mark', 'allDay') and end_time is null) or (type in ('multiDay', 'span') and end_time is not null)",
    },
    "image_sources": {"states": "mirror_state in ('pending', 'running', 'done', 'failed') and transcribe_state in ('pending', 'running', 'done', 'failed')"},
    "news_items": {"id_length": "length(id) = 32"},
    "playguides": {"slug": "id rlike '^[a-z0-9_]{1,64}$'"},
}


def rejected(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows that fail a check, with the names of the checks; null counts as failed."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("failed_checks", failed).where(F.size("failed_checks") > 0)


def asserted(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """df, failing at run time on the first row that breaks a check."""
    for name, test in checks.items():
        df = df.where(F.coalesce(F.expr(test), F.lit(False)) | F.raise_error(F.lit(f"check failed: {name}")).cast("boolean"))
    return df


def glossary_csv(spark: SparkSession, path: str, header: str = "") -> DataFrame:
    """(ord, source_text, translated_text) from lines split at the first comma; blank lines and the header are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    return _pairs(lines, 2).where(F.col("source_text") != header) if header else _pairs(lines, 2)


def glossary_csv_all_commas(spark: SparkSession, path: str) -> DataFrame:
    """The other reading of the same file: split at every comma, first two parts kept."""
    return _pairs(spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''"), -1)


def _pairs(lines: DataFrame, limit: int) -> DataFrame:
    parts = F.split("line", ",", limit)
    return lines.select(F.trim(F.get(parts, 0)).alias("source_text"), F.trim(F.get(parts, 1)).alias("translated_text")).where("source_text <> '' and translated_text <> ''")


def articles(news: DataFrame, topics: DataFrame, guides: DataFrame) -> DataFrame:
    """The three article tables as one, with the type of each row and nulls for what a table lacks."""
    tagged = [df.withColumn("item_type", F.lit(t)) for t, df in (("news", news), ("topic", topics), ("playguide", guides))]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)


def batch_of_sources(sources: DataFrame, cursor: int, size: int, order: str = "ord") -> DataFrame:
    """Rows cursor..cursor+size-1 of a listing, with the next cursor and whether it is the last batch."""
    total = sources.agg((F.max(order) + 1).alias("total"))
    return sources.where(F.col(order).between(cursor, cursor + size - 1)).crossJoin(F.broadcast(total)).withColumn("next_cursor", F.least(F.lit(cursor + size), F.col("total"))).withColumn("done", F.col("next_cursor") >= F.col("total")).drop("total")
