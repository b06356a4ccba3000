"""Changes to tables as functions from old state and input to new state.

Plain Parquet has no row updates, so each change is a join by key that gives the
whole new table.  Inputs with repeated keys are first reduced to one row for each
key by an explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def one_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def insert_new(target: DataFrame, source: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Insert rows whose key is new; returns (new state, inserted rows).  source has one row for each key."""
    inserted = source.join(target.select(*key), key, "left_anti")
    return target.unionByName(inserted, allowMissingColumns=True), inserted


def key_merge(target: DataFrame, source: DataFrame, key: list[str], columns: list[str], when: Column | None = None) -> DataFrame:
    """Insert new keys; on existing keys set `columns` from the source (where `when` holds on s.* and t.*)."""
    t, s = target.alias("t"), source.alias("s")
    joined = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key], "full_outer")
    matched = F.col(f"s.{key[0]}").isNotNull() & F.col(f"t.{key[0]}").isNotNull()
    fresh = F.col(f"t.{key[0]}").isNull()
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.coalesce(f"t.{c}", f"s.{c}").alias(c))
        elif c in source.columns:
            take = fresh if c not in columns else fresh | (matched if when is None else matched & when)
            out.append(F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return joined.select(*out)


def merge_provided(target: DataFrame, source: DataFrame, key: list[str], provided: str = "provided") -> DataFrame:
    """As key_merge, but a source row sets only the columns named in its array `provided`: null is a value, absence is not."""
    t, s = target.alias("t"), source.alias("s")
    joined = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key], "full_outer")
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.coalesce(f"t.{c}", f"s.{c}").alias(c))
        elif c in source.columns:
            out.append(F.when(F.array_contains(f"s.{provided}", c), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return joined.select(*out)


def update_matching(target: DataFrame, changes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Set the other columns of `changes` on rows with their keys; returns (new state, matched keys)."""
    columns = [c for c in changes.columns if c not in key]
    marked = changes.withColumn("_hit", F.lit(True)).withColumnsRenamed({c: f"_new_{c}" for c in columns})
    joined = target.join(marked, key, "left")
    state = joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])
    return state, target.select(*key).join(changes.select(*key), key, "left_semi")


def replace_children(target: DataFrame, parents: DataFrame, children: DataFrame, parent_key: list[str]) -> DataFrame:
    """All children of the given parents are replaced; a parent without new children keeps none."""
    return target.join(parents.select(*parent_key), parent_key, "left_anti").unionByName(children.dropDuplicates())


def set_states(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Upsert (state, error, updated_at) only: the value stays, the error stays only for failures."""
    kept = changes.withColumn("error", F.when(F.col("state") == "failed", F.col("error")))
    return key_merge(target, kept, key, ["state", "error", "updated_at"])


def finish_translations(target: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Upsert finished translations; their error is cleared."""
    full = done.withColumn("state", F.lit("done")).withColumn("error", F.lit(None).cast("string"))
    return key_merge(target, full, key, ["state", "error", "value", "translated_at", "model", "updated_at"])


def reset_states(target: DataFrame, condition: Column, to: str = "pending", updated_at: Column | None = None) -> DataFrame:
    out = target.withColumn("_hit", F.coalesce(condition, F.lit(False))).withColumn("state", F.when(F.col("_hit"), F.lit(to)).otherwise(F.col("state")))
    if updated_at is not None:
        out = out.withColumn("updated_at", F.when(F.col("_hit"), updated_at).otherwise(F.col("updated_at")))
    return out.drop("_hit")


def with_new_ids(target: DataFrame, keys: DataFrame, key: str, id: str = "id") -> DataFrame:
    """(key, id) for every key: the stored id, or the next ones in the order of the keys.

    New ids continue from the greatest stored one.  Ranks of new keys come from one
    sort of the new keys only; a retry gives the same ids.
    """
    known = keys.select(key).distinct().join(target.select(key, id), key, "left")
    base = target.agg(F.coalesce(F.max(id), F.lit(0)).alias("_base"))
    new = known.where(F.col(id).isNull()).select(key)
    ranked = _global_rank(new, key)
    made = ranked.crossJoin(F.broadcast(base)).select(key, (F.col("_base") + F.col("_rank")).alias(id))  # one row
    return known.where(F.col(id).isNotNull()).unionByName(made)


def _global_rank(df: DataFrame, key: str) -> DataFrame:
    """1-based ranks by key without one task for all rows: ranks inside ranges plus the sizes of earlier ranges.

    Ranges follow the keys themselves, whatever prefix they share; rows are written
    with their range once, so that both passes agree.
    """
    ranged = df.withColumn("_key", F.encode(F.col(key).cast("string"), "UTF-8")).repartitionByRange("_key")
    marked = written(ranged.withColumn("_bucket", F.spark_partition_id()))
    sizes = marked.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    return marked.withColumn("_place", place).join(before, "_bucket").select(*df.columns, (F.col("_before") + F.col("_place")).alias("_rank"))


def replace_window(target: DataFrame, fresh: DataFrame, condition: Column) -> DataFrame:
    """Rows of the window go, fresh ones come."""
    return target.where(~F.coalesce(condition, F.lit(False))).unionByName(fresh, allowMissingColumns=True)


def replace_window_per_key(target: DataFrame, fresh: DataFrame, key: str, start: str) -> DataFrame:
    """For each key in fresh, target rows from its earliest new start on are replaced."""
    window = fresh.groupBy(key).agg(F.min(start).alias("_from"))
    kept = target.join(window, key, "left").where(F.col("_from").isNull() | (F.col(start) < F.col("_from"))).drop("_from")
    return kept.unionByName(fresh, allowMissingColumns=True)


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def prune(target: DataFrame, cutoff: Column, start: str, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows whose end (or start, without one) lies before the cutoff are removed."""
    at = F.coalesce(end, start) if end else F.col(start)
    return target.where(at >= cutoff), target.where(at < cutoff)


def reload(source: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The whole table from a file in which the last row of a key wins."""
    return one_per_key(source, key, [order.desc()])


def sync_active(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Upsert the source as active; all other rows become inactive.  An empty source deactivates everything."""
    active = source.withColumn("active", F.lit(True))
    merged = key_merge(target, active, [key], [*columns, "active"])
    present = source.select(key).distinct().withColumn("_present", F.lit(True))
    return merged.join(present, key, "left").withColumn("active", F.coalesce("_present", F.lit(False))).drop("_present").select(*target.columns)


def guarded_languages(languages: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed table, failing if no enabled language is left."""
    left = changed.agg(F.count_if("enabled").alias("_enabled"))
    checked = F.when(F.col("_enabled") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("the last enabled language must stay")).cast("boolean"))
    return changed.crossJoin(F.broadcast(left)).where(checked).drop("_enabled")  # one row


def remap_spans(previous: Column, spans: Column) -> Column:
    """Texts of a new arrangement of spans (from: index in the old one, or null); blanks where the old one has none."""
    return F.transform(spans, lambda s: F.coalesce(F.get(previous, s["from"]), F.lit("")))


def wide_to_tall(df: DataFrame, key: list[str], columns: list[str], field: str = "field", value: str = "value") -> DataFrame:
    """One row for each non-null column of a row."""
    return df.unpivot(key, columns, field, value).where(F.col(value).isNotNull())


def insert_with_children(parents: DataFrame, children: DataFrame, new: DataFrame, own: str, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """New parents and the rows of their array of structs `own`, together: (parents, children).

    A batch that comes twice changes nothing: parents that are there already add no children either.
    """
    fresh = new.join(parents.select(key), key, "left_anti")
    rows = fresh.select(F.col(key).alias(parent_key), F.explode(own).alias("_c")).select(parent_key, "_c.*")
    return parents.unionByName(fresh.select(*parents.columns)), children.unionByName(rows.select(*children.columns))


def ensured(target: DataFrame, keys: DataFrame, key: str, **defaults: Column) -> DataFrame:
    """target with a row of defaults for each key that it lacks."""
    missing = keys.select(key).distinct().join(target.select(key), key, "left_anti")
    return target.unionByName(missing.select(key, *[v.alias(c) for c, v in defaults.items()]), allowMissingColumns=True)


def without_keys(target: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """target without the rows of the given keys (or parts of keys)."""
    return target.join(gone.select(*key).distinct(), key, "left_anti")


def one_active(runs: DataFrame, item: list[str], active: tuple[str, ...], started: str, id: str, to: str = "terminated") -> DataFrame:
    """Of several active runs of an item only the last started stays active (of equal ones the greatest id); the others are settled."""
    is_active = F.col("status").isin(*active)
    newest = runs.where(is_active).groupBy(*item).agg(F.max_by(id, F.struct(started, id)).alias("_newest"))
    out = runs.join(newest, item, "left")
    return out.withColumn("status", F.when(is_active & (F.col(id) != F.col("_newest")), to).otherwise(F.col("status"))).select(*runs.columns)


def seeded_renders(sources: DataFrame, translations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First renders and files of an image model: an original for each mirrored source, a localized one for each finished url.

    sources: (id, key, mirror_state, updated_at); translations: (source_id, language,
    field, state, value, model, translated_at).  Render ids are source and language.
    """
    name = lambda source, language: F.concat_ws(":", source, F.coalesce(language, F.lit("original")))
    null = F.lit(None).cast("string")
    original = sources.where("mirror_state = 'done'").select(name(F.col("id"), null).alias("id"), F.col("id").alias("source_id"), null.alias("language"), null.alias("model"), F.col("updated_at").alias("created_at"), "key")
    done = translations.where("field = 'url' and state = 'done'")
    localized = done.select(name(F.col("source_id"), F.col("language")).alias("id"), "source_id", "language", "model", F.col("translated_at").alias("created_at"), F.col("value").alias("key"))
    rows = original.unionByName(localized)
    return rows.drop("key"), rows.select("key", F.col("id").alias("image_id"), F.lit(True).alias("is_primary"), "created_at")
