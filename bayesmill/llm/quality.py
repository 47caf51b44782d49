"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics, counted on its bytes with
numpy.  For each class, Spark sums what mean and covariance need (count, sum,
cross-products) over all learning rows; only these sums reach the driver.  A
class covariance is shrunk towards the pooled one and that towards its diagonal,
and its Cholesky factor is kept, so that a log-density is one triangular
product.  A score is the logistic of a flattened difference of the classes'
log-densities, learned priors included.

Defined cases: a null text is empty, and an empty text has a vector and so a
score; a null or foreign label is not learned from; if a class has no rows the
score is the share of label 1 (1/2 without any rows); repeated rows count as
often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .rows import KEPT, file_hash, keep_rows, row_hash
from .workspace import Workspace, frugal, small_batches

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "bangs", "symbols", "bars", "stops", "high_bytes", "line_words",
    "repeats", "types", "top_word", "marked_words", "short_words", "upper_words", "line_repeats",
)

_UPPER, _ALPHA, _DIGIT, _BANG, _SYMBOL, _BAR, _STOP, _HIGH = range(8)
_KIND = np.zeros((256, 8), bool)
_KIND[65:91, _UPPER] = _KIND[65:91, _ALPHA] = _KIND[97:123, _ALPHA] = True
_KIND[48:58, _DIGIT] = True
_KIND[list(b"!?"), _BANG] = True
_KIND[list(b"#$%&*<>=^~{}[]@_\\/+`"), _SYMBOL] = True
_KIND[list(b"|"), _BAR] = True
_KIND[list(b".,;:"), _STOP] = True
_KIND[128:, _HIGH] = True


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x between offsets."""
    c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return np.diff(c[at])


def _top_and_types(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the largest count of one value, and the number of different ones."""
    top, types = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(h):
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        np.maximum.at(top, doc[at], np.diff(np.append(at, len(h))))
        types += np.bincount(doc[at], minlength=n)
    return top, types


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = len(off) - 1
    low, starts, ends, first = tx.words(data, off)
    h = tx.word_hashes(low, starts, ends)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    size = np.diff(off)
    count = [_sums(_KIND[:, k][data], off) for k in range(8)]
    w1, b1 = words + 1.0, size + 1.0
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][words > 0]] = False
    top, types = _top_and_types(h, doc, n)
    last = data[ends - 1] if len(ends) else data[:0]
    marked = ~(_KIND[:, _ALPHA] | _KIND[:, _HIGH] | _KIND[:, _STOP] | _KIND[:, _DIGIT])[last]
    upper_word = _KIND[:, _UPPER][data[starts]] & _KIND[:, _UPPER][data[np.minimum(starts + 1, ends - 1)]] & (ends - starts > 1) if len(starts) else same
    # lines, by the hash of their bytes
    breaks = data == 10
    edge = np.unique(np.concatenate([off, np.flatnonzero(breaks) + 1]))
    a, z = edge[:-1], edge[1:]
    z = z - breaks[np.maximum(z - 1, 0)] if len(z) else z
    line_doc = np.searchsorted(off, a, "right") - 1
    full = z > a
    lines = np.bincount(line_doc[full], minlength=n)
    _, line_types = _top_and_types(tx.word_hashes(data, a[full], z[full]), line_doc[full], n)
    root = lambda x, y: np.sqrt(x / y)
    return np.column_stack([
        np.log(w1), np.log((size - words + 1.0) / w1), root(count[_UPPER], count[_ALPHA] + 1.0), root(count[_DIGIT], b1), root(count[_BANG], b1),
        root(count[_SYMBOL], b1), root(count[_BAR], b1), root(count[_STOP], w1), root(count[_HIGH], b1), np.log(w1 / (lines + 1.0)),
        root(_sums(same, first), w1), np.log(types + 1.0) / np.log(w1 + 1.0), root(top, w1), root(_sums(marked, first), w1),
        root(_sums(ends - starts <= 3, first), w1), root(_sums(upper_word, first), w1), root(lines - line_types, lines + 1.0),
    ])


# -- discriminant -----------------------------------------------------------

@dataclass
class Moments:
    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        m = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        return cls(float(len(x)), m, (x - m).T @ (x - m))

    def plus(self, o: Moments) -> Moments:
        n = self.n + o.n
        if not n:
            return self
        d = o.mean - self.mean
        return Moments(n, self.mean + d * (o.n / n), self.scatter + o.scatter + np.outer(d, d) * (self.n * o.n / n))


@dataclass
class Discriminant:
    """A score of 1 is label 1."""

    mean: np.ndarray  # (class, feature)
    inverse: np.ndarray  # (class, feature, feature): inverse Cholesky factors
    offset: np.ndarray  # (class,): log prior less half the log determinant
    share: float
    flat: float = 8.0

    @classmethod
    def fit(cls, zero: Moments, one: Moments, to_pooled: float = 0.05, to_diagonal: float = 0.02, ridge: float = 1e-4) -> Discriminant:
        k, n = len(one.mean), zero.n + one.n
        share = one.n / n if n else 0.5
        if not zero.n or not one.n:
            return cls(np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2), share)
        pooled = (zero.scatter + one.scatter) / n
        diagonal = np.diag(np.diag(pooled) + ridge)
        inverse, offset = [], []
        for m, p in ((zero, 1 - share), (one, share)):
            # few rows: nearer to what both classes share
            w = (m.n * (1 - to_pooled)) / (m.n + k)
            c = w * m.scatter / m.n + (1 - w) * pooled
            chol = np.linalg.cholesky((1 - to_diagonal) * c + to_diagonal * diagonal)
            inverse.append(np.linalg.inv(chol))
            offset.append(np.log(p) - np.log(np.diag(chol)).sum())
        return cls(np.array([zero.mean, one.mean]), np.array(inverse), np.array(offset), share)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.inverse.any():
            return np.full(len(x), self.share)
        log = [o - 0.5 * (((x - m) @ i.T) ** 2).sum(axis=1) for m, i, o in zip(self.mean, self.inverse, self.offset, strict=True)]
        d = log[1] - log[0]
        # far from both classes densities say too much: grow as a logarithm there, order kept
        d = np.sign(d) * self.flat * np.log1p(abs(d) / self.flat)
        return 1 / (1 + np.exp(-d))


# -- columns ----------------------------------------------------------------

def statistics_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``file`` and ``row`` (hashes of the row's file, and of id and text), and ``stats``, an array in the order of FEATURES."""
    small_batches(docs.sparkSession)
    rows = docs.select(id, file_hash(docs).alias("file"), row_hash(id, text).alias("row"), text)
    schema = rows.select(id, "file", "row").withColumn("stats", F.array(F.lit(0.0))).schema

    def run(batches):
        for b in batches:
            data, off = tx.utf8(b.column(3))
            for i, j in tx.runs(off):
                x = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), _lists(x)], schema.names)

    return rows.mapInArrow(frugal(run), schema)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.empty((0, len(FEATURES)))


def learn(rows: DataFrame, **shrinkage: float) -> Discriminant:
    """``rows(label, stats)``: label 0 or 1.  Every task adds up its rows' moments; the driver adds up the tasks'."""
    k = len(FEATURES)

    def run(batches):
        sums = [Moments(0.0, np.zeros(k), np.zeros((k, k))) for _ in range(2)]
        for b in batches:
            label, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
            sums = [s.plus(Moments.of(x[label == c])) for c, s in enumerate(sums)]
        if sums[0].n or sums[1].n:
            yield pa.RecordBatch.from_pydict({"label": [0, 1], "n": [s.n for s in sums], "mean": [s.mean.tolist() for s in sums], "scatter": [s.scatter.ravel().tolist() for s in sums]})

    total = [Moments(0.0, np.zeros(k), np.zeros((k, k))) for _ in range(2)]
    few = rows.where(F.col("label").isin(0, 1)).select(F.col("label").cast("int"), "stats")
    sums = few.mapInArrow(frugal(run), "label long, n double, mean array<double>, scatter array<double>")
    for r in sorted(sums.collect(), key=lambda r: (r["label"], r["n"], r["mean"])):
        total[r["label"]] = total[r["label"]].plus(Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(k, k)))
    return Discriminant.fit(*total, **shrinkage)


def score_table(stats: DataFrame, model: Discriminant, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``score``, after the columns to keep."""
    schema = stats.select(*keep).schema.add("score", "double")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(_matrix(b.column(len(keep)))))], schema.names)

    return stats.select(*keep, "stats").mapInArrow(frugal(run), schema)


def held_out(id: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace) -> tuple[Discriminant, DataFrame]:
    """Learn ``labels.quality`` from the documents that are not held out; also gives all documents' statistics.

    A document that has several labels is learned from with each of them.
    """
    stats = ws.save(statistics_table(docs), "stats")
    known = labels.select("doc_id", F.col("quality").alias("label"))
    return learn(stats.where(~held_out()).join(known, "doc_id").select("label", "stats")), stats


def classify(docs: DataFrame, labels: DataFrame, ws: Workspace, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    model, stats = fit(docs, labels, ws)
    return ws.finish(score_table(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")), "scores")


def keep_good(docs: DataFrame, labels: DataFrame, ws: Workspace, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts.

    Rows are told apart by their id and text, so repeated or null ids keep their
    rows.
    """
    model, stats = fit(docs, labels, ws)
    good = score_table(stats, model, ("file", "row")).where(F.col("score") >= threshold)
    return keep_rows(docs, ws, good.select(F.col("row").alias(KEPT), "file").distinct(), "doc_id", "text")
