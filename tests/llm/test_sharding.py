"""Rendezvous shards against a plain version."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

from bayesmill.llm import sharding as S


def plain(key, weights):
    cost = lambda i: -math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[: S.HEX], 16) + 0.5) / 16**S.HEX) / weights[i]
    return min(range(len(weights)), key=lambda i: (cost(i), i))


def test_assign(spark):
    rows = [(i, f"text {i} é") for i in range(400)] + [(7, "text 7 é"), (7, "other"), (None, None), (401, None), (402, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as cost", "1 as _extra")
    weights = [1.0, 2.0, 0.5, 1.0]
    got = S.assign(df, weights, grown=1.5).collect()
    assert len(got) == len(rows) and {"cost", "_extra", "text"} <= set(got[0].asDict())
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert r["shard"] == plain(key, weights)
        assert r["grown_shard"] == plain(key, [*weights, 1.5])
        assert r["grown_shard"] in (r["shard"], 4)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    n = Counter(r["shard"] for r in got)
    assert n[1] > n[0] > n[2]
    assert S.assign(df.limit(0), weights).count() == 0


@pytest.mark.parametrize("weights", [[], [0.0], [1.0, -1.0], [math.inf]])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        S.bids(None, weights)
