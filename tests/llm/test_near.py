"""Near copies against a comparison of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline as P
from bayesmill.llm import near as N
from bayesmill.llm.simhash import _LOWER
from bayesmill.llm.workspace import Workspace


def shingles(text):
    words = (text or "").encode().translate(_LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Least ids of the groups that pairs of five-word similarity 0.8 or more connect, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return {min(rows[i][0] for i in range(len(rows)) if find(i) == g) for g in {find(i) for i in range(len(rows))}}


def test_stage_finds_near_copies_and_keeps_what_is_less_similar(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e"]
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 300]))]
        for edits in (0, 0, 1, 2, 4, 6, 9):
            more = list(words)
            for _ in range(edits):
                more[rng.randrange(len(more))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(more))
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    df.repartition(4).write.parquet(f"{tmp_path}/d")
    want = plain_kept(list(enumerate(texts)))
    for docs in (df, spark.read.parquet(f"{tmp_path}/d")):
        kept = P.deduplicate(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == want
    assert len(set(texts)) > len(want) > 12


def test_null_and_repeated_ids_drop_nothing(spark):
    rows = [(None, "one two three four five six"), (None, "quite something else goes here"), (7, "and a third text of its own"), (7, "the fourth has other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, N.keep_one(docs, Workspace(spark, "t")).collect())) == sorted(map(repr, docs.collect()))
    assert N.keep_one(docs.limit(0), Workspace(spark, "t")).count() == 0


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


@pytest.mark.parametrize("seed", range(3))
def test_forest_connects_similar_pairs_and_nothing_else(seed):
    rng = np.random.default_rng(seed)
    whole = [np.unique(rng.integers(0, 1 << 40, 200).astype(np.uint64)) for _ in range(3)]
    sets = [np.sort(rng.choice(whole[i % 3], rng.integers(150, 196), replace=False)) for i in range(90)]
    fp = N.set_fingerprints(sets)
    root = list(range(90))
    for table in range(N.tables_for(90)[1]):
        word = N.table_words(fp, table)
        for a, b in N.forest(np.zeros(90, np.uint64), word, fp, np.arange(90), np.array([len(s) for s in sets]), lambda place, size: sets[place], N.limits(0)):
            assert N.similar(sets[a], sets[b])
            root[find(root, a)] = find(root, b)
    for i in range(90):
        for j in range(i):
            if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                assert find(root, i) == find(root, j)


def test_tables_reach_pairs_at_the_limit_as_reckoned():
    """Pairs of similarity 0.8 exactly: the share that a table has in reach, and what all of them miss."""
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(1500):
        w = np.unique(rng.integers(0, 1 << 40, 100).astype(np.uint64))
        cut = len(w) // 10
        pairs += [w[cut:], w[:-cut]]
    fp = N.set_fingerprints(pairs)
    for n in (100, 50_000, 10_000_000):
        route, tables = N.tables_for(n)
        allowed, found = N.limits(route), []
        for t in range(tables):
            w = N.table_words(fp, t)
            x = w[::2] ^ w[1::2]
            ok = np.ones(len(x), bool)
            for k in range(1, 65):
                ok &= np.bitwise_count(x >> np.uint64(64 - k)) <= allowed[k]
            found.append(ok)
        assert np.mean(found) >= 0.9 * N.reach(route)
        assert np.mean(np.any(found, axis=0)) > 0.99
    assert np.bitwise_count(fp[::2] ^ fp[1::2]).sum(axis=1).max() <= N.FAR


def test_the_index_leaves_most_of_a_group():
    rng = np.random.default_rng(2)
    word = rng.integers(0, 1 << 63, 4096, dtype=np.uint64)
    index = N.GrayIndex(np.zeros(4096, np.uint64), word)
    for _ in index.neighbours(np.arange(4096), N.limits(0)):
        pass
    assert index.visited < 4096 * 4096 / 4


def test_large_groups_are_cut_without_losing_links(spark, tmp_path):
    rng = random.Random(5)
    texts, base = [], [f"w{rng.randrange(9000)}" for _ in range(200)]
    for i in range(150):  # one large group, and pairs that share a route with it
        words = list(base)
        words[rng.randrange(200)] = f"new{i}"
        texts.append(" ".join(words))
    for i in range(25):
        words = [f"x{rng.randrange(9000)}" for _ in range(60)]
        texts += [" ".join(words), " ".join([*words, f"more{i}"])]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert len(want) == 26
    for split_at in (40, 1000):
        assert {r["doc_id"] for r in N.keep_one(df, Workspace(spark, "t"), split_at=split_at).collect()} == want


def test_tables_that_are_joins_keep_their_rows(spark, tmp_path):
    """Spark cannot say which file a joined row is from; filters then join by row."""
    from bayesmill.llm import quality, simhash

    rows = [(i, f"some words of text number {i % 7} that go on and on {i % 7}") for i in range(30)]
    for name in "ab":
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    both = a.join(b.select("doc_id"), "doc_id")
    for keep in (N.keep_one, simhash.keep_one):
        assert sorted(r["doc_id"] for r in keep(both, Workspace(spark, "t")).collect()) == sorted(r["doc_id"] for r in keep(a, Workspace(spark, "t")).collect()) == list(range(7))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality long")
    good = quality.keep_good(both, labels, Workspace(spark, "t"))
    assert good.columns == both.columns and sorted(map(str, good.collect())) == sorted(map(str, quality.keep_good(a, labels, Workspace(spark, "t")).collect()))
    assert keep(both.limit(0), Workspace(spark, "t")).count() == 0
