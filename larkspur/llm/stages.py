"""The operators as stages of a corpus pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, pii, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies of the pipeline: shingles of five words, similarity in hundredths.
SHINGLE = 5
THRESHOLD = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain, trained on the folder's labels, rejects."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), chain, keep=False).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of the n-gram Jaccard join; rows without an id all stay."""
    docs = docs.select(*COLUMNS)
    found = jaccard.linked(docs, SHINGLE, THRESHOLD)
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*COLUMNS)
    ids = docs.where("doc_id is not null").agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] > ids["d"]:
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").withColumn("_n", place).where("_n = 1").drop("_n"))
    return kept


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain an item of the folder's benchmark."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of their kinds; n_chars follows the text."""
    found = pii.find(docs.select(*COLUMNS), "text", "_spans")
    out = found.withColumn("text", pii.masked(F.col("text"), F.col("_spans")))
    hit = F.coalesce(F.size("_spans"), F.lit(0)) > 0
    return out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives back its bytes."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.round_trips(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")
