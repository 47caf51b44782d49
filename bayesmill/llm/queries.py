"""One query for each operator, over the whole of its intended table.

A query binds its operator to the driver's tables with production parameters
and derives the contract's digest columns from the operator's real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontamination import ORACLE as _contained_oracle
from .sharding import ORACLE as _sharding_oracle
from .workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney and unigram scores of every document."""
    from . import lm_scoring

    return lm_scoring.perplexity_scores(_table(spark, sf_dir, "documents"), Workspace(spark, "op1"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from pyspark.sql import functions as F

    from . import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), Workspace(spark, "op2"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and one more whose texts hold control strings; read back."""
    from pyspark.sql import functions as F

    from . import chat

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = chat.STOP + chat.START + "assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    from . import decontamination

    return decontamination.find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Workspace(spark, "op4"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    from . import quality

    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Workspace(spark, "op5"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as PNG, read back from the table, and hashed."""
    from . import media

    ws = Workspace(spark, "op6")
    stored = ws.save(media.encode_column(_table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    return ws.finish(media.features(stored).drop("error"), "features")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to bit-packed files and read from them."""
    import public_tokenizers

    from . import tokenfile

    ws = Workspace(spark, "op7")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), ws.path("tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_documents(spark, ws.path("tokens"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that a mix of all sources takes."""
    from . import mixing

    ws = Workspace(spark, "op8")
    return ws.finish(mixing.Mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ws).taken(), "taken")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    from . import pii

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.spans_digest(pii.find(docs, pii.train(docs)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40, its slot, and its shard of 41."""
    from pyspark.sql import functions as F

    from . import sharding

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sharding.assign(docs, [1.0] * sharding.SHARDS, grown=1.0, drop_text=True)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_simhash": op2_simhash,
    "op3_chat": op3_chat,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_media": op6_media,
    "op7_tokens": op7_tokens,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": _contained_oracle,
    "op10_sharding": _sharding_oracle,
}
