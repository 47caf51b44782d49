"""PNG round trips, damage, and hashes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesmill.llm import media as M
from bayesmill.llm.workspace import Workspace


@pytest.mark.parametrize("kind", [*range(5), None])
@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_round_trip(kind, n):
    p = random.Random(n).randbytes(n)
    x, length = M.decode(M.encode(p, kind=kind))
    assert (length, x.tobytes()) == (n, p.ljust(max(1, -(-n // 192)) * 192))


def plain_unfilter(kinds, rows):
    """The format's rules sample by sample."""
    out, above = [], [0] * len(rows[0])
    for k, r in zip(kinds, rows, strict=True):
        line = []
        for x, v in enumerate(r):
            a, b, c = line[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            line.append((v + (0, a, b, (a + b) // 2, paeth)[k]) % 256)
        out.append(line)
        above = line
    return out


def test_filters_are_undone_by_the_formats_rules():
    rng = np.random.default_rng(3)
    images = [(rng.integers(0, k, n).astype(np.uint8), rng.integers(0, 256, (n, w)).astype(np.uint8)) for n, w, k in [(1, 7, 5), (9, 7, 5), (30, 7, 3), (4, 20, 5), (40, 3, 5), (5, 1, 5), (6, 7, 1)]]
    for (kinds, rows), got in zip(images, M.unfilter_all(images), strict=True):
        assert got.tolist() == plain_unfilter(kinds.tolist(), rows.tolist())


def test_rows_choose_their_filters():
    """Rows that repeat the one above, slopes and texts; all come back, and several filters are used."""
    rng = random.Random(2)
    line = rng.randbytes(192)
    slope = bytes((3 * i) % 256 for i in range(192))
    p = line * 5 + slope * 2 + b"some words and so on " * 60 + bytes((x + 7 * y) % 256 for y in range(9) for x in range(192))
    kinds, _, n = M.read_chunks(M.encode(p))
    assert n == len(p) and len(set(kinds.tolist())) >= 3 and M.decode(M.encode(p))[0].tobytes()[:n] == p


@pytest.mark.parametrize("kind", range(5))
def test_long_images_take_linear_time(kind):
    import time

    rows = np.random.default_rng(0).integers(0, 256, (10_000, 192)).astype(np.uint8)
    t = time.process_time()
    M.unfilter(np.full(len(rows), kind, np.uint8), rows)
    assert time.process_time() - t < 5


def test_many_chunks():
    p = random.Random(1).randbytes(300_000)
    png = M.encode(p)
    assert png.count(b"IDAT") > 3 and M.decode(png)[0].tobytes()[: len(p)] == p


def test_any_damage_is_found():
    png = M.encode(b"hello world" * 40)
    for i in range(len(png)):
        bad = bytearray(png)
        bad[i] ^= 1 << i % 8
        with pytest.raises(M.MediaError):
            M.decode(bytes(bad))
    for i in range(len(png)):
        with pytest.raises(M.MediaError):
            M.decode(png[:i])
    with pytest.raises(M.MediaError):
        M.decode(png + b"x" * 12)


def test_hash_is_near_for_near_images():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.integers(-3, 4, (96, 192)), axis=0).astype(np.int64) + 128
    x = x.clip(0, 255).astype(np.uint8)
    near = (x.astype(int) + rng.integers(-2, 3, x.shape)).clip(0, 255).astype(np.uint8)
    far = rng.permutation(x.ravel()).reshape(x.shape)
    d = lambda a, b: (M.cosine_hash(a) ^ M.cosine_hash(b)).bit_count()
    assert d(x, near) < 10 < d(x, far)


def test_columns(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 10_000), (1, "abc"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("feature", F.lit("clash")).withColumn("media", F.lit(1))
    stored = Workspace(spark, "t").save(M.encode_column(df.select("doc_id", "text", "media")), "media")
    got = M.features(stored).collect()
    assert len(got) == len(rows)
    for r in got:
        p = next((t or "").encode() for i, t in rows if i == r["doc_id"])
        padded = p.ljust(max(1, -(-len(p) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(p), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), None)
    bad = stored.select("doc_id", F.concat(F.lit(b"x"), "media").alias("media")).unionByName(spark.range(1).select(F.lit(9).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("media")))
    assert {r["error"] for r in M.features(bad).collect()} == {"not a PNG"}
    assert M.features(stored.limit(0)).count() == 0
