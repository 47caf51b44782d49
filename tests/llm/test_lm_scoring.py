"""Language-model scores against a plain model in dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesmill.llm import lm_scoring as L
from bayesmill.llm.workspace import Workspace


def words(t):
    return bytes(L.tx.LOWER[np.frombuffer((t or "").encode(), np.uint8)]).split() + [None]


class Plain:
    """Interpolated modified Kneser-Ney of order 2 or 3, in dictionaries."""

    def __init__(self, texts, order):
        self.c = Counter(w for t in texts for w in t)
        self.n, self.v, self.order = sum(self.c.values()), len(self.c), order
        grams = lambda n: [p for t in texts for p in zip(*(["<s>"] * k + t[: len(t)] for k in range(n - 1, -1, -1)), strict=False)]
        pairs = Counter(grams(2))
        self.levels = []
        if order == 3:
            triples = Counter(grams(3))
            self.levels.append(self.level(triples))
            pairs = Counter((b, c) for _, b, c in triples)
        self.levels.append(self.level(pairs))
        self.before, self.types = Counter(b for _, b in pairs), len(pairs)
        self.e = self.count(self.before.values())
        self.left = sum(self.e[min(x, 3) - 1] for x in self.before.values()) / max(self.types, 1)

    @staticmethod
    def count(xs):
        return L.discounts([sum(x == k for x in xs) for k in (1, 2, 3, 4)])

    def level(self, counts):
        total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, k in counts.items():
            total[g[:-1]] += k
            kinds[g[:-1]][min(k, 3) - 1] += 1
        return counts, total, kinds, self.count(counts.values())

    def prob(self, w, *context):
        """The probability of w after the given words, the last nearest."""
        if not context:
            if not self.types:
                return 1 / (self.v + 1)
            x = self.before.get(w, 0)
            return (x - self.e[min(x, 3) - 1] if x else 0) / self.types + self.left / (self.v + 1)
        counts, total, kinds, d = self.levels[-len(context)]
        below = self.prob(w, *context[1:])
        if context not in total:
            return below
        k = counts.get((*context, w), 0)
        return ((k - d[min(k, 3) - 1] if k else 0) + sum(a * n for a, n in zip(d, kinds[context], strict=True)) * below) / total[context]

    def score(self, t):
        padded = ["<s>"] * (self.order - 1) + t
        return sum(math.log10(self.prob(w, *padded[i : i + self.order - 1])) for i, w in enumerate(t))


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocab = ["The", "of", "a", "é", "X1"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(vocab[min(int(rng.expovariate(0.15)), 64)] for _ in range(rng.randrange(40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, "the of a"), (3, rows[3][1]), (3, rows[3][1]), (n + 3, "long " * 30_000 + "unseen")]


@pytest.mark.parametrize(("flush", "order"), [(50, 3), (3_000_000, 3), (3_000_000, 2)])
def test_scores(spark, monkeypatch, flush, order):
    monkeypatch.setattr(L, "FLUSH", flush)
    rows = corpus(150)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(5)
    got = L.perplexity_scores(df, Workspace(spark, "t"), shards=8, order=order).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    m = Plain([words(t) for i, t in rows if not held(i)], order)
    assert len(got) == len(rows) and any(r["held_out"] for r in got)
    texts = dict(rows)
    for r in got:
        t = words(texts[r["doc_id"]])
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == m.n
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(w in m.c for w in t))
        assert r["base_score"] == pytest.approx(sum(math.log10((m.c[w] + 1) / (m.n + m.v + 1)) for w in t), rel=1e-9)
        assert r["score"] == pytest.approx(m.score(t), rel=1e-9)
    for v in [("<s>", "<s>"), ("<s>", b"the"), (b"the", b"w1"), (b"w1", b"the"), (b"never", b"the"), (b"the", b"never")]:
        assert sum(m.prob(w, *v[3 - order :]) for w in [*m.c, "unknown"]) == pytest.approx(1)


def test_followers_are_summed_in_parts(spark, monkeypatch):
    rows = corpus(60, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, L.perplexity_scores(df, Workspace(spark, "t"), shards=3).collect()))
    model = L.train(df.where(~L.held_out()), Workspace(spark, "t"), 3)
    monkeypatch.setattr(L, "GATHER", 16)
    s = L.Scorer(model)
    for _, data, off in L._texts([__import__("pyarrow").RecordBatch.from_pydict({"text": [t for _, t in rows]})]):
        toks, at = L.tokens(data, off)
        small = s.score(toks, at)[1]
        monkeypatch.setattr(L, "GATHER", 4_000_000)
        assert np.allclose(small, L.Scorer(model).score(toks, at)[1], rtol=1e-12)
    assert s.long and len(whole) == len(rows)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    ws = Workspace(spark, "t")
    model = L.train(df.limit(0), ws, 4)
    r = L.score(df, model).first()
    assert (r["n_tokens"], r["n_known"], r["score"], r["base_score"]) == (3, 0, 0.0, 0.0)
    assert L.perplexity_scores(df.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 21, 32, 40])
def test_pairs_are_mixed_one_to_one(bits):
    v, w = np.random.default_rng(0).integers(0, 1 << bits, (2, 1000), dtype=np.uint64)
    hi, lo = L.mix_pair(v, w, bits)
    assert int(max(hi.max(), lo.max())) < 1 << bits
    a, b = L.unmix_pair(hi, lo, bits)
    assert (a == v).all() and (b == w).all()


@pytest.mark.parametrize("top", [1 << 20, 1 << 34, 1 << 40, 1 << 63])
def test_sorted_keys_pack_and_are_found(top):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        k = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (L.unpack_sorted(L.pack_sorted(k)) == k).all()
        m = L.sorted_arrays(k)
        assert (L._all_keys(m) == k).all()
        q = np.unique(np.concatenate([k[::2], rng.integers(0, top, 500, dtype=np.uint64), [np.uint64(0), np.uint64((1 << 64) - 1)]]))
        assert (L.places(m, q) == np.searchsorted(k, q)).all()
        want = np.where(np.isin(q, k), np.searchsorted(k, q), -1)
        assert (L.ranks(m, q) == want).all()


def test_many_words_use_two_part_keys():
    hi, lo = np.random.default_rng(2).integers(0, 4, (2, 300), dtype=np.uint64)
    for a, b in zip(L._counted(hi, lo, 40, 80), L._counted(hi, lo, 2, 4), strict=True):
        assert (a == b).all()
    a, b = L._distinct(hi, lo, 40), L._distinct(hi, lo, 2)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
    m = L.Model("", 3, L.Shards.even(8, 1 << 64, 0), np.full(8, 1 << 30), 1)
    assert m.bits == 34 and m.n == 16
    top = (1 << 34) - 1
    s = int(np.searchsorted(m.pairs.begin, np.uint64(top), "right")) - 1
    assert int(m.pairs.keys(s, np.array([top], np.uint64), np.array([top], np.uint64))[0]) == (top - int(m.pairs.begin[s])) << 34 | top
