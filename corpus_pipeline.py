"""A corpus pipeline over documents: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import op3_shards, op4_jaccard, op7_mix, op8_decontaminate, op9_rules
from cairn.llm.common import cut, drop_cuts, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' policy v2 keeps."""
    return op9_rules.filter_docs(docs, "v2")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard coefficient of 0.8 or more."""
    return op4_jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return op8_decontaminate.clean_docs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix to target weights takes: a row per document and pass that takes any of it."""
    return op7_mix.mixed_docs(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot on the ring, and the columns of docs."""
    return op3_shards.shard(docs, shards=8, extra=tuple(docs.columns))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The Bayesian join's components and the ring's dealing have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and reread, and what the stage read goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(written())
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = cut(stage(spark, docs, sf_dir), f"stage{k}")
        drop_cuts(spark, [x for x in written()[:-1] if x not in others])
    return STAGES[-1][1](spark, docs, sf_dir)
