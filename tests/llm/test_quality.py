"""Statistics, the discriminant against closed forms, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bayesmill.llm import quality as Q
from bayesmill.llm.workspace import Workspace

SF = "/root/testdata/sf0.01"


def test_moments_add_up():
    x = np.random.default_rng(0).normal(size=(50, 3)) + 1e6
    m = Q.Moments.of(x[:20]).plus(Q.Moments.of(x[20:20])).plus(Q.Moments.of(x[20:]))
    assert m.n == 50 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.scatter / 49, np.cov(x.T), atol=1e-6)


def test_log_density_difference():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(400, 4)), rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 2
    m = Q.Discriminant.fit(Q.Moments.of(a), Q.Moments.of(b), to_pooled=0, to_diagonal=1e-9)
    x = np.vstack([a, b])

    def density(x, c):
        z = x - m.mean[c]
        s = np.linalg.inv(m.inverse[c]) @ np.linalg.inv(m.inverse[c]).T
        return -0.5 * (np.log(np.linalg.det(s)) + (z @ np.linalg.inv(s) * z).sum(axis=1)) + np.log((1 - m.share, m.share)[c])

    d = density(x, 1) - density(x, 0)
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-np.sign(d) * 8 * np.log1p(abs(d) / 8))))


def test_one_class_only():
    one = Q.Moments.of(np.ones((3, 2)))
    assert Q.Discriminant.fit(Q.Moments.of(np.ones((0, 2))), one).score(np.zeros((2, 2))).tolist() == [1, 1]


def test_statistics_of_odd_texts():
    texts = ["", None, " \n", "a", "A!! A!! A!!", "x\nx\nx\n", "é" * 9, "| a | b", "a" * 50_000 + " b" * 50_000]
    data, off = Q.tx.utf8(pa.array(texts))
    x = Q.statistics(data, off)
    assert x.shape == (len(texts), len(Q.FEATURES)) and np.isfinite(x).all()
    for i in range(len(texts)):  # a text's numbers do not depend on its neighbours
        d, o = Q.tx.utf8(pa.array([texts[i]], pa.string()))
        assert np.allclose(Q.statistics(d, o)[0], x[i])
    f = dict(zip(Q.FEATURES, x[4], strict=True))
    assert f["repeats"] == pytest.approx((2 / 4) ** 0.5) and f["upper"] == pytest.approx((3 / 4) ** 0.5)
    assert dict(zip(Q.FEATURES, x[5], strict=True))["line_repeats"] == pytest.approx((2 / 4) ** 0.5)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in Q.classify(docs, labels, Workspace(spark, "t")).collect()}
    assert len(got) == docs.count()
    rows = [(got[r["doc_id"]], r["quality"]) for r in labels.collect()]
    held = [(r, q) for r, q in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.values())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.97


def test_edges(spark):
    rows = [(i, "The quick brown fox, number " + str(i), "x") for i in range(40)] + [(100 + i, "BUY!! " * (5 + i), "x") for i in range(40)] + [(None, None, "x"), (5, "", "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("stats", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    got = Q.classify(docs, labels, Workspace(spark, "t"))
    assert got.count() == len(rows)
    kept = Q.keep_good(docs, labels, Workspace(spark, "t"))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(40)) <= set(ids) and not any(i and i >= 100 for i in ids)
    assert Q.classify(docs.limit(0), labels, Workspace(spark, "t")).count() == 0
    assert {r["score"] for r in Q.classify(docs, labels.limit(0), Workspace(spark, "t")).collect()} == {0.5}
