"""A pipeline from raw documents to token ids, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import stages
from larkspur.llm.shared import written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("benchmark_decontamination", stages.drop_benchmark),
    ("pii", stages.mask_personal),
    ("byte_bpe", stages.encode_texts),
]

#: Trained models and similarity joins have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
