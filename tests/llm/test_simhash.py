"""SimHash fingerprints and components against plain versions."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bayesmill.llm import simhash as S
from bayesmill.llm.components import components
from bayesmill.llm.workspace import Workspace


def plain_fingerprint(text, width=3):
    words = (text or "").encode().translate(S._LOWER).split()
    if not words:
        return 0
    runs = [words[i : i + width] for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    texts = ["a b c d e", "", None, "One", "one TWO", "x\ty\n z  w", "é è ê ë " * 50, "  "]
    import pyarrow as pa

    data, off = S.tx.utf8(pa.array(texts))
    assert S.fingerprints(data, off).tolist() == [plain_fingerprint(t) for t in texts]


def test_gray_rank_neighbours_differ_in_one_bit():
    x = np.arange(4096, dtype=np.uint64)
    by_rank = x[np.argsort(S.gray_rank(x))]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


@pytest.mark.parametrize("seed", range(4))
def test_forest_has_the_components_of_all_links(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(18), rng.randrange(6))) for b in base for _ in range(60)})
    group = np.array([rng.randrange(3) for _ in fps], np.uint64)
    a, b = S.forest(group, np.array(fps, np.uint64), 2)
    real = [(i, j) for i in range(len(fps)) for j in range(i) if group[i] == group[j] and (fps[i] ^ fps[j]).bit_count() <= 2]
    assert len(a) < len(fps)
    assert plain_components(zip(a.tolist(), b.tolist(), strict=True), range(len(fps))) == plain_components(real, range(len(fps)))


@pytest.mark.parametrize("split_at", [5, 1000])
def test_links_over_all_routes(spark, split_at):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(25)} | {0, 1, 3, (1 << 64) - 1})
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    ws = Workspace(spark, "test")
    got = {r["node"]: r["component"] for r in components(S.links(nodes, ws, 2, split_at), ws).collect()}
    real = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = plain_components(real, range(len(fps)))
    assert {i: got.get(i, i) for i in range(len(fps))} == want
    assert len(set(want.values())) < len(fps)


def test_query_columns_and_edge_cases(spark):
    rows = [(5, "a b c d"), (3, "A  b c d"), (9, None), (8, ""), (7, " \n"), (3, "A  b c d"), (None, "q w e r t y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", S.F.lit("clash"))
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in S.near_duplicates(docs, Workspace(spark, "t")).collect()), key=str)
    assert got == [(-1, None), (3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 7)]
    kept = S.keep_one(docs, Workspace(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 7]
    assert S.near_duplicates(docs.limit(0), Workspace(spark, "t")).count() == 0


def test_null_and_repeated_ids_join_nothing(spark):
    """Every row's component against all pairs of rows, with ids that are null or repeat over other texts."""
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([40, 400]))) for _ in range(12)]
    texts = [t + rng.choice(["", "", " x", " x y"]) for t in base for _ in range(4)]
    rows = [(rng.choice([None, i // 3, i]), t) for i, t in enumerate(texts)]
    fps = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    part = plain_components(pairs, range(len(fps)))
    ids = {p: [rows[i][0] for i in part if part[i] == p and rows[i][0] is not None] for p in part.values()}
    want = [(rows[i][0], fps[i], min(ids[part[i]], default=None)) for i in range(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in S.near_duplicates(docs, Workspace(spark, "t")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(set(part.values())) > 12 and len(pairs) > 20


def test_components_of_two_pairs(spark):
    bits = lambda fp, *k: fp ^ sum(1 << i for i in k)
    a, b = random.Random(1).getrandbits(63), random.Random(2).getrandbits(63)
    fps = {1: a, 2: bits(a, 3), 3: b, 4: bits(b, 5)}
    nodes = spark.createDataFrame([(f, f) for f in fps.values()], "node long, fp long")
    ws = Workspace(spark, "t")
    got = {r["node"]: r["component"] for r in components(S.links(nodes, ws), ws).collect()}
    for x, y in ((fps[1], fps[2]), (fps[3], fps[4])):
        assert got.get(x, x) == got.get(y, y) == min(x, y)


def test_the_index_does_the_search():
    """Of 2000 fingerprints most nodes are left by their shared bits, and all links are found."""
    rng = random.Random(4)
    fps = np.array([rng.getrandbits(64) for _ in range(1000)], np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(1 << 9), fps ^ np.uint64(3 << 40)]))
    index = S.GrayIndex(np.zeros(len(fps), np.uint64), fps)
    assert len(index.children) >= 4
    found = {(int(index.fp[a]), int(index.fp[b])) for q, m in index.neighbours(index.companied(), np.full(65, 2)) for a, b in zip(q, m, strict=True)}
    real = {(x, y) for i, x in enumerate(index.fp.tolist()) for y in index.fp[i + 1 :].tolist() if (x ^ y).bit_count() <= 2}
    assert found == real and len(real) >= 2000
    assert index.visited < len(fps) * len(fps) / 4


def test_keep_one_reads_back_by_file(spark, tmp_path):
    rows = [(i, f"word{i % 30} some other text {i % 30} goes on {i % 30}", i) for i in range(90)] + [(None, "quite something else", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _b long")
    df = df.withColumn("_file", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("kept_id", F.lit(3))
    df.repartition(5).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    plain = S.keep_one(df, Workspace(spark, "t")).collect()
    got = S.keep_one(docs, Workspace(spark, "t"))
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain)) and 1 < len(plain) < 91


def test_keep_one_with_null_and_repeated_ids(spark, tmp_path):
    texts = ["one two three four five", "quite something else goes here", "and a third text of its own", "the fourth has other words still"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/d")
    for docs in (df, spark.read.parquet(f"{tmp_path}/d")):
        got = [(r["doc_id"], r["text"]) for r in S.keep_one(docs, Workspace(spark, "t")).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])]))
