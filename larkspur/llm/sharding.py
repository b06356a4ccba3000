"""Reproducible shuffle into shards: a keyed permutation of global row numbers.

Row numbers come from counts of hash buckets (a bounded table) and positions
inside a bucket, so no task ever orders the whole table.  A Feistel network over
a grid of a x b >= n numbers permutes them; numbers that land outside 0..n-1 walk
on along their cycle.  Shard and slot are arithmetic on the permuted number, so
they can be computed for any row number, and inverted, without the table.
Everything is DataFrame functions.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets for row numbers; their counts are all that reaches the driver.
BUCKETS = 4096
ROUNDS = 3
_WALK = 64


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square grid with a * b >= n; a * b - n < a."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, -(-max(n, 1) // a)


def _keyed(x: Column, seed: int, k: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(seed * 1000 + k)), F.lit(modulus))


def _step(x: Column, n: int, seed: int) -> Column:
    a, b = grid(n)
    u, v = (x - x % b) / b, x % b
    u = u.cast("long")
    for k in range(ROUNDS):
        u = (u + _keyed(v, seed, 2 * k, a)) % a
        v = (v + _keyed(u, seed, 2 * k + 1, b)) % b
    return u * b + v


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """The place of row number `row` (0 to n-1) in the permutation of n rows."""
    a, b = grid(n)
    most = min(a * b - n, _WALK)  # a cycle meets each of the a*b-n outer numbers once at most
    x = _step(row, n, seed)
    if most:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(most)), x, lambda y, _: F.when(y < n, y).otherwise(_step(y, n, seed)))
        x = F.when(x < n, x).otherwise(walked)
        x = F.when(x < n, x).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))
    return x


def row_numbers(df: DataFrame, keys: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """df with dense global numbers from 0, and the number of rows.

    All keys together pick a hash bucket and order the rows of a bucket, so no single
    id, null or not, fills a bucket.  Rows that agree in all keys take adjacent
    numbers.  At most BUCKETS counts reach the driver.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    counts = dict(df.groupBy(bucket.alias("bucket")).count().collect())
    offsets, total = [], 0
    for k in range(BUCKETS):
        offsets.append(total)
        total += counts.get(k, 0)
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    table = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<long>")  # a constant
    base = F.element_at(table, F.col("_bucket") + 1)
    return df.withColumn("_bucket", bucket).withColumn(number, base + place - 1).drop("_bucket"), total


def shard(df: DataFrame, shards: int, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: shard counts differ by one at most and slots have no gap.
    Null text counts as empty; null ids are as good as any; repeated rows take places
    of their own; fewer rows than shards leave the last shards empty; an empty
    table gives an empty result.  Extra columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("_text"),
    )
    numbered, n = row_numbers(rows, ["doc_id", "text_crc32", "size", "_text"], "_row")
    place = permuted(F.col("_row"), n, seed)
    return numbered.withColumn("_place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        ((F.col("_place") - F.col("_place") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8, seed=20)
