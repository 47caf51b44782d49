"""The corpus pipeline: classify, deduplicate, decontaminate, mix, tokenise.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bayesmill.llm import decontamination, mixing, near, quality, tokenfile
from bayesmill.llm.workspace import Workspace, parts

TOKENIZER = "byte_bpe_50k.json"

#: SQL has no covariances' Cholesky factors or tokenizer; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, Workspace(spark, "pipeline-quality"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word similarity 0.8 or more), the document with the least id stays."""
    return near.keep_one(docs, Workspace(spark, "pipeline-near"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, items, Workspace(spark, "pipeline-items"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them, in shuffled shards."""
    plan = mixing.Mix(docs, Workspace(spark, "pipeline-mix"), shards=max(16, parts(spark)))
    by = [plan.shard_column, plan.order_column]
    # the order is a hash, so dealing by it needs no sample of the rows
    return plan.rows().repartition(parts(spark), *by).sortWithinPartitions(*by).drop(*by)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; what they hold of each document."""
    import public_tokenizers

    ws = Workspace(spark, "pipeline-tokens")
    tokenfile.write_tokens(docs, ws.path("tokens"), public_tokenizers.path(TOKENIZER))
    return tokenfile.read_documents(spark, ws.path("tokens"))


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token-ID output", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
