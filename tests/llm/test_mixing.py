"""Targets, tree and words taken against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesmill.llm import mixing as M
from bayesmill.llm.workspace import Workspace


def test_targets_reshare_the_excess():
    t = M.targets([100, 1000, 1000, 0], [5, 2, 1, 5], 1.5)
    assert t[0] == 200 and t[3] == 0 and sum(t) == pytest.approx(1.5 * 2100)
    assert t[1:3] == pytest.approx([2950 * 2 / 3, 2950 / 3])
    assert M.targets([], [], 1.5) == []


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_tree_keeps_quotas(shards):
    q = np.array([1000, 10, 0, 333])
    got = M.split_tree(q, shards, np.random.default_rng(1))
    assert (got.sum(axis=0) == q).all() and got.min() >= 0
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= shards.bit_length()


def test_tree_is_hypergeometric():
    left = [M.split_tree(np.array([30, 70]), 2, np.random.default_rng(i))[0, 0] for i in range(4000)]
    assert np.mean(left) == pytest.approx(15, abs=0.2)
    assert np.var(left) == pytest.approx(50 * 0.3 * 0.7 * 50 / 99, rel=0.1)


def test_first_words():
    assert M.first_words("  é  b\tc ".encode(), 2).decode() == "  é  b"
    assert [M.first_words(b"a b", n) for n in (0, 2, 5)] == [b"", b"a b", b"a b"]


def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["a", "b", "c", None][int(rng.integers(0, 4)) if i % 3 else 0], 0) for i in range(600)]
    rows += [(600, None, "a", 0), (601, "", "empty", 0), (602, "one", "one", 0), (5, "again", "b", 0), (5, "again", "b", 0), (None, "x y", "c", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("size", F.lit("clash")).withColumn("_s", F.lit(1)).withColumn("_shard", F.lit("own"))


def test_mix(spark):
    rows, df = table(spark)
    mix = M.Mix(df, Workspace(spark, "t"), shards=4)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, M.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5), strict=True))
    by = defaultdict(list)
    for _, t, s, _ in rows:
        by[s].append(len((t or "").split()))
    assert sorted(r["size"] for r in got) == sorted(x for v in by.values() for x in v)
    total = sum(r["taken"] for r in got)
    assert total == pytest.approx(1.5 * sum(sizes.values()), abs=len(names))
    groups = defaultdict(int)
    for r in got:
        groups[(r["source_size"], round(r["target"], 6))] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in names:
        assert groups[(sizes[s], round(want[s], 6))] == pytest.approx(want[s], abs=1) or sum(sizes[x] == sizes[s] for x in names) > 1
    again = M.Mix(df.repartition(3), Workspace(spark, "t"), shards=4).taken().collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    out = mix.rows()
    kept = out.collect()
    assert out.columns == [*df.columns, "__shard", "_order"] and {r["_shard"] for r in kept} == {"own"}
    assert sum(len((r["text"] or "").split()) for r in kept) == total
    assert {r["__shard"] for r in kept} == {0, 1, 2, 3}
    assert all(r["n_chars"] in (0, len(r["text"])) for r in kept if r["text"])


def test_taken_is_the_plan_replayed(spark):
    """Every document's words from a plain replay: blocks by hash, a permutation of them for each source, words until the target."""
    _, df = table(spark)
    mix = M.Mix(df, Workspace(spark, "t"), shards=4, seed=5)
    slim = [r.asDict() for r in mix.slim.collect()]
    names = sorted({r["source"] for r in slim}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r["size"] for r in slim if r["source"] == s) for s in names}
    goal = dict(zip(names, M.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5), strict=True))
    want = []
    for i, s in enumerate(names):
        blocks = defaultdict(list)
        for r in slim:
            if r["source"] == s:
                blocks[int(((r["h"] % (1 << 64)) >> 12) / 2**52 * (1 + M.BLOCKS * size[s] // sum(size.values())))].append(r)
        rng, left, taken = np.random.default_rng([5, i]), round(goal[s]), Counter()
        for _ in range(3):
            order = rng.permutation(sorted(blocks)).tolist()
            for b in order:
                for r in sorted(blocks[b], key=lambda r: (r["h"], r["id"] is not None, r["id"] or 0)):
                    n = min(r["size"], left)
                    taken[id(r)] += n
                    left -= n
        want += [(r["id"], r["size"], size[s], taken[id(r)]) for r in slim if r["source"] == s]
    got = [(r["doc_id"], r[1], r["source_size"], r["taken"]) for r in mix.taken().toDF("doc_id", "n", "source_size", "target", "taken").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(0 < t % n < n for _, n, _, t in want if n)


def test_rows_hold_the_words_that_are_taken(spark):
    """With few blocks, so that those taken in part hold many documents, repeats among them."""
    rows = [(i % 40, " ".join(["w"] * (1 + i % 40 % 7)), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    blocks, M.BLOCKS = M.BLOCKS, 4
    try:
        mix = M.Mix(df, Workspace(spark, "t"), shards=2)
        want, got = Counter(), Counter()
        for r in mix.taken().collect():
            want[r["doc_id"]] += r["taken"]
        for r in mix.rows().collect():
            got[r["doc_id"]] += len(r["text"].split())
        assert got == +want
    finally:
        M.BLOCKS = blocks


def test_written_shards(spark, tmp_path):
    _, df = table(spark)
    mix = M.Mix(df.drop("_shard"), Workspace(spark, "t"), shards=3)
    M.write_shards(mix, f"{tmp_path}/mix")
    got = spark.read.parquet(f"{tmp_path}/mix")
    assert got.count() == mix.rows().count() and {r[0] for r in got.select("_shard").distinct().collect()} == {0, 1, 2}


def test_empty_table(spark):
    _, df = table(spark)
    mix = M.Mix(df.limit(0), Workspace(spark, "t"))
    assert mix.taken().count() == 0 and mix.rows().count() == 0
