"""JSON, array and small geometry functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def parsed_spans(text: Column) -> Column:
    """A JSON array of strings, or null for anything else."""
    return F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}))


def cleaned_spans(text: Column) -> Column:
    """Trimmed, without empty ones; an empty array for malformed JSON."""
    spans = F.coalesce(parsed_spans(text), F.array().cast("array<string>"))
    return F.filter(F.transform(spans, lambda s: F.trim(s)), lambda s: s != "")


def same_length(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)


def parsed_titles(df: DataFrame, text: str, order: str | None = None) -> DataFrame:
    """(id, title) from JSON arrays of {id, title}: blank or mistyped entries drop alone, the last of an id wins.

    With several texts, the last is that of the greatest `order`.  A text beyond the
    size of a variant (128 MiB) counts as broken; long lists belong in several texts.
    """
    entries = F.variant_get(F.try_parse_json(text), "$", "array<variant>")
    rows = df.select(*([F.col(order).alias("at")] if order else []), F.posexplode(entries).alias("pos", "entry"))
    place = F.struct("at", "pos") if order else F.col("pos")
    rows = rows.select(place.alias("pos"), F.try_variant_get("entry", "$.id", "string").alias("id"), F.try_variant_get("entry", "$.title", "string").alias("title"))
    return rows.where("trim(id) <> '' and trim(title) <> ''").groupBy("id").agg(F.max_by("title", "pos").alias("title"))


def fallback_name(titles: Column, language: str, base: Column) -> Column:
    return F.coalesce(F.element_at(titles, language), F.element_at(titles, "en"), base)


def paired_or(own: Column, other: Column) -> Column:
    """Entries of `own` with those of `other` in their places, where it has them; as long as `own`."""
    return F.transform(own, lambda x, i: F.coalesce(F.get(other, i), x))


def chunked(df: DataFrame, key: str, size: int) -> DataFrame:
    """A short list in key order, cut into numbered units.  The list is one request's: it must fit a task."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size).cast("long"))


def language_map(df: DataFrame, key: list[str], language: str, *values: str) -> DataFrame:
    """One row for each key with a map from language to a struct of values."""
    return df.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(language, F.struct(*values)))).alias("by_language"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 0 without variance."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))

    def around(m):
        def add(s, p):
            x, y = p["x"] - m["a"], p["y"] - m["b"]
            return F.struct((s["ab"] + x * y).alias("ab"), (s["aa"] + x * x).alias("aa"), (s["bb"] + y * y).alias("bb"))

        return F.aggregate(pairs, zero, add, lambda s: F.when((s["aa"] <= 0) | (s["bb"] <= 0), 0.0).otherwise(s["ab"] / F.sqrt(s["aa"] * s["bb"])))

    # the means are bound once; inside the fold they would be computed for every element
    return F.transform(F.array(F.struct(mean(a).alias("a"), mean(b).alias("b"))), around)[0]


def upper_median(values: Column) -> Column:
    """The upper of the middle values, not their mean."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def two_up_pad(height: Column) -> Column:
    """Three tenths of the height, between 28 and 128."""
    return F.least(F.greatest(F.round(height * 0.3), F.lit(28)), F.lit(128)).cast("int")


def fitted_height(width: Column, height: Column, aspect: float, tolerance: float = 0.05) -> Column:
    """Height after a centred crop to an aspect; within the tolerance nothing is cropped."""
    close = F.abs((width / height) / F.lit(aspect) - 1) <= tolerance
    return F.when(close, height).otherwise(F.least(height.cast("double"), F.round(width / F.lit(aspect)))).cast("int")


def png_size(data: Column) -> Column:
    """struct(width, height) from a PNG header, or null."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(data, 1, 4)) == "89504E47", F.struct(number(17).alias("width"), number(21).alias("height")))
