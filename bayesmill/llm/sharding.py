"""Rendezvous hashing of stable record keys over weighted shards.

Every shard bids for every key: with u the bid's hash in (0, 1) and w the
shard's weight, the least -ln(u)/w wins, so shards get keys in proportion to
their weights.  The winner depends on the key and the shards alone.  A new
shard can only win keys from others, never move keys between them, and its
share of the keys is its share of the weight.

Slots number a shard's rows without gaps.  Rows are dealt into buckets of a
shard by a hash of key and content; bucket sizes, of which there are a bounded
number, are summed before each bucket is numbered on its own, so a shard may be
of any size.

All of it is built-in expressions: bids are md5, which other engines have too.

Defined cases: a null key is the empty string; a null text has no bytes; rows
that repeat are all kept and get slots of their own (equal rows in no
particular order among themselves); columns of any other name are carried.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD = 16
HEX = 13  # hex digits of a bid: 52 bits, exact in a double


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def bids(key: Column, weights: Sequence[float]) -> Column:
    """An array of (cost, shard); the least is the winner."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def bid(s):
        digits = F.substring(F.md5(F.concat(key, F.lit(":"), s["i"].cast("string")).cast("binary")), 1, HEX)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**HEX))
        return F.struct((-F.log(u) / s["w"]).alias("cost"), s["i"].alias("shard"))

    return F.transform(shards, bid)


def assign(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown: float | None = None, drop_text: bool = False) -> DataFrame:
    """Add size, text_crc32, shard, slot and, with the weight of one more shard, grown_shard.

    With ``drop_text`` the text leaves before rows are exchanged for numbering.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = len(weights)
    all_bids = bids(key_text(key), [*weights, *([grown] if grown is not None else [])])
    out = df.withColumns({"size": (F.octet_length(raw) + OVERHEAD).cast("long"), "text_crc32": F.crc32(raw), "_bids": all_bids})
    out = out.withColumns({
        "shard": F.array_min(F.slice("_bids", 1, n))["shard"],
        "grown_shard": F.array_min("_bids")["shard"] if grown is not None else F.lit(None).cast("int"),
        "_bucket": F.substring(F.md5(F.concat(key_text(key), F.lit("#"), F.col("text_crc32").cast("string")).cast("binary")), 1, 2),
    }).drop("_bids", *([text] if drop_text else []))
    return number(out, key)


def number(df: DataFrame, key: str) -> DataFrame:
    """Add slot: rows of a shard counted from 0 by (_bucket, key, text_crc32)."""
    sizes = df.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most 256 rows for each shard
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.col(key).asc_nulls_first(), "text_crc32")
    rows = df.withColumn("_row", F.row_number().over(inside) - 1)
    return rows.join(F.broadcast(starts), ["shard", "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_row", "_start")


SHARDS = 40

ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS t FROM documents),
bid AS (
  SELECT doc_id, k, t, s.i AS i,
         -ln((CAST(('0x' || substr(md5(k || ':' || CAST(s.i AS VARCHAR)), 1, {HEX})) AS BIGINT) + 0.5) / {float(16**HEX)!r}) AS cost
  FROM docs CROSS JOIN range({SHARDS + 1}) AS s(i)),
won AS (
  SELECT doc_id, k, t, CAST(arg_min(i, cost) FILTER (WHERE i < {SHARDS}) AS INTEGER) AS shard, CAST(arg_min(i, cost) AS INTEGER) AS grown_shard
  FROM bid GROUP BY doc_id, k, t),
tab AS (
  SELECT list(CAST(list_reduce(list_prepend(r, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT) ORDER BY r) AS tbl
  FROM range(256) AS b(r)),
crc AS (
  SELECT won.*, CAST(xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
      lambda c, b: xor(c // 256, list_extract(tbl, 1 + (xor(c, b) & 255)))), 4294967295) AS BIGINT) AS text_crc32
  FROM won, tab)
SELECT doc_id, CAST(strlen(t) + {OVERHEAD} AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || '#' || CAST(text_crc32 AS VARCHAR)), 1, 2), doc_id NULLS FIRST, text_crc32) - 1 AS slot,
       grown_shard
FROM crc
"""
