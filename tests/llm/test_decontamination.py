"""Containment search against plain sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from bayesmill.llm import decontamination as D
from bayesmill.llm.workspace import Workspace


def test_shingle_sets_match_words():
    texts = ["a b c d e f", "One, TWO", "", None, "É à-b c D e", "x " * 9, "...", "a b c d e f"]
    h, at = D.shingles(*D.tx.utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert len(set(h[at[i] : at[i + 1]].tolist())) == len(D.word_shingles(t or ""))
    assert h[at[0] : at[1]].tolist() == h[at[7] : at[8]].tolist()
    assert D.word_shingles("É, à\nb C d") == {("é".encode(), "à".encode(), b"b", b"c", b"d")}


def test_bins_shrink_with_item_size():
    assert D.bins(1000, 2) is None
    b = [D.bins(1 << 14, q) for q in (8, 16, 32, 64, 256, 1024)]
    assert b == sorted(b, reverse=True) and b[-1] < 10 and len(set(b)) > 4


@pytest.mark.parametrize(("size", "n", "part"), [(10, 300, 0.95), (20, 3000, 0.9), (40, 3000, 0.7), (55, 20_000, 0.7), (300, 20_000, 0.25)])
def test_qualifying_pairs_share_a_minimum(size, n, part):
    """Recall of signatures at the limit, over 3000 pairs whose documents hold just 0.8 of an item's hashes."""
    rng = np.random.default_rng(size)
    b, found, least = D.bins((1 << n.bit_length()) - 1, 1 << (size.bit_length() - 1)), 0, 0
    docs = 3000 if n < 5000 else 300
    for _ in range(docs):
        item = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        shared = item[: -(-4 * size // 5)]
        h = np.concatenate([rng.integers(0, 1 << 64, n - len(shared), dtype=np.uint64), shared])
        s = D.Run(h, np.array([0, n])).signature(n.bit_length(), b)
        found += bool(np.isin(s, item).any())
        least += int((s != ~np.uint64(0)).sum())
    assert found == docs
    assert least < part * docs * n  # the share of hashes that are looked up


def test_coarser_signatures_come_from_finer_ones():
    h = np.random.default_rng(0).integers(0, 1 << 64, 700, dtype=np.uint64)
    at = np.array([0, 0, 300, 700])
    one, two = D.Run(h, at), D.Run(h, at)
    c = one.n[2].item().bit_length()
    one.signature(c, 9)
    assert (one.signature(c, 5) == two.signature(c, 5)).all()


def test_the_benchmark_is_searched_by_signatures(spark):
    """On the given tables every kind of item has a number of bins, so all documents are searched by MinHash."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    for folder, kinds in D.build_index(items, Workspace(spark, "t")):
        assert kinds and all(D.bins((1 << c) - 1, 1 << (k - 1)) is not None for k in kinds for c in range(1, 18))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi".split()) + str(rng.randrange(40))
    items = [[word() for _ in range(n)] for n in (0, 1, 3, 5, 6, 12, 30, 40, 100, 400, 1500)]
    docs = []
    for _ in range(160):
        w = [word() for _ in range(rng.choice([0, 2, 20, 300, 5000]))]
        for _ in range(rng.randrange(3)):
            it = list(rng.choice(items))
            for k in range(len(it)):
                if rng.random() < rng.choice([0, 0, 0.01, 0.05]):
                    it[k] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = it
        docs.append(rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w))
    return docs, [" ".join(i) for i in items]


def test_shared_shingles_are_counted_in_parts(spark, monkeypatch):
    same = "one two three four five six seven eight"
    docs = spark.createDataFrame([(i, f"{same} tail{i}") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{same} {'other' * (i % 2)}") for i in range(40)], "item_id long, text string")
    whole = sorted(map(tuple, D.find_contained(docs, items, Workspace(spark, "t")).collect()))
    block = D.Block(*D.build_index(items, Workspace(spark, "t"))[0], 0.8)
    run = D.Run(*D.shingles(*D.tx.utf8(pa.array([r["text"] for r in docs.collect()]))))
    at_once = sorted(block.pairs(run))
    monkeypatch.setattr(D, "POSTINGS", 7)
    assert sorted(block.pairs(run)) == at_once and len(whole) == len(at_once) == 50 * 40


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs_are_found(spark, seed):
    docs, items = corpus(seed)
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)] + [(7, docs[7], "x"), (None, None, "x")], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(i, d) for i, d in enumerate(items)] + [(50, None), (None, items[6])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["item_shingles"]) for r in D.find_contained(df, it, Workspace(spark, "t")).collect()}
    want = {}
    for d, t in enumerate(docs):
        have = D.word_shingles(t)
        for i, x in [*enumerate(items), (None, items[6])]:
            own = D.word_shingles(x)
            if own and len(own & have) >= 0.8 * len(own):
                want[d, i] = (len(own & have), len(own))
    assert want and got == want
    kept = D.drop_contaminated(df, it, Workspace(spark, "t"))
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(len(docs)), None} - {d for d, _ in want}
    assert D.find_contained(df.limit(0), it, Workspace(spark, "t")).count() == 0
    assert D.find_contained(df, it.limit(0), Workspace(spark, "t")).count() == 0
