"""Cross-products: from observations to centred, scaled sufficient statistics.

Two forms.  ``SuffStats`` holds arrays on the driver and suits the sampler; it
comes from one scan in which every task reduces its rows to a count, means and
centred cross-products, which are merged row by row of the matrix (no difference
of large sums).  The
other form is a table of triplets ``(block, i, j, v)`` with ``i <= j`` beside a
table of predictors, worked on by Catalyst alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.quality import DataError

EPS = float(np.finfo(float).eps)
ROOT_EPS = EPS**0.5


# -- one scan ---------------------------------------------------------------

@dataclass
class SuffStats:
    """Centred statistics: gram = Xc'Xc, xty = Xc'yc, yty = yc'yc, with what was centred out."""

    n: int
    names: list[str]
    gram: np.ndarray
    xty: np.ndarray
    yty: float | None
    x_means: np.ndarray
    y_mean: float | None
    intercept: bool = True

    def response_var(self) -> float | None:
        return None if self.yty is None else self.yty / (self.n - 1)


def _merge(a: tuple, b: tuple) -> tuple:
    (n, m, s), (k, o, t) = a, b
    if not n or not k:
        return b if not n else a
    d = o - m
    return n + k, m + d * (k / (n + k)), s + t + np.outer(d, d) * (n * k / (n + k))


def _partial(x: np.ndarray) -> tuple:
    m = x.mean(axis=0)
    c = x - m
    return len(x), m, c.T @ c


DRIVER_BYTES = 1 << 31  # of the one matrix that the driver gets
PARTIAL_BYTES = 1 << 36  # of partial matrices in all, which bounds the number of tasks that make one


def moments(df: DataFrame, columns: Sequence[str], array: str | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred cross-products of ``columns`` and then the entries of ``array``.

    Every task sends its matrix by rows, and each row of the result is merged
    from all tasks' by itself, in the tasks' order; so no task holds more than
    one matrix, and the outcome does not depend on which task ends first.
    """
    select = [F.col(c).cast("double") for c in columns] + ([F.col(array).cast("array<double>")] if array else [])
    rows = df.select(*select)
    first = df.select(F.size(array).alias("k")).first() if array else None
    p = len(columns) + (first["k"] if first else 0)
    if 8 * p * p > DRIVER_BYTES:
        raise DataError(f"{p} predictors make a Gram matrix of over {DRIVER_BYTES >> 20} MB: give diagonal blocks or triplets")
    most = max(4 * df.sparkSession.sparkContext.defaultParallelism, PARTIAL_BYTES // max(16 * p * p, 1))
    if rows.rdd.getNumPartitions() > most:
        rows = rows.coalesce(most)

    def scan(batches):
        total = None
        for b in batches:
            if b.num_rows:
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[: len(columns)]]
                x = np.column_stack(cols) if cols else np.empty((b.num_rows, 0))
                if array:
                    x = np.column_stack([x, b.columns[-1].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)])
                total = _partial(x) if total is None else _merge(total, _partial(x))
        if total is not None:
            n, mean, m2 = total
            part = TaskContext.get().partitionId()
            for i in range(0, len(mean), 64):
                k = min(64, len(mean) - i)
                yield pa.RecordBatch.from_pydict({"i": list(range(i, i + k)), "part": [part] * k, "n": [n] * k, "mean": [mean.tolist()] * k, "m2": m2[i : i + k].tolist()})

    def fold(key, rows):
        i, total = key[0].as_py(), None
        for r in rows.sort_by("part").to_batches(max_chunksize=256):
            for n, mean, m2 in zip(r["n"].to_pylist(), r["mean"], r["m2"], strict=True):
                m, s = (x.values.to_numpy(zero_copy_only=False) for x in (mean, m2))
                if total is None:
                    total = (n, m.copy(), s.copy())
                else:
                    have, o, t = total
                    d = m - o
                    total = (have + n, o + d * (n / (have + n)), t + s + d * (d[i] * have * n / (have + n)))
        return pa.table({"i": [i], "n": [total[0]], "mean": [total[1].tolist()], "m2": [total[2].tolist()]})

    got = rows.mapInArrow(scan, "i long, part long, n long, mean array<double>, m2 array<double>").groupBy("i").applyInArrow(fold, "i long, n long, mean array<double>, m2 array<double>").collect()
    if not got:
        raise DataError("no observations")
    got.sort(key=lambda r: r["i"])
    s = np.array([r["m2"] for r in got])
    return got[0]["n"], np.array(got[0]["mean"]), (s + s.T) / 2


def from_observations(df: DataFrame, y: str, x: Sequence[str] | str) -> SuffStats:
    """Statistics of a response and predictors; ``x`` is column names or one array column."""
    columns, array, names = ([y], x, None) if isinstance(x, str) else ([y, *x], None, list(x))
    n, m, s = moments(df, columns, array)
    names = names or [f"x{i + 1}" for i in range(len(m) - 1)]
    return SuffStats(n, names, s[1:, 1:], s[1:, 0].copy(), float(s[0, 0]), m[1:], float(m[0]))


def working_columns(df: DataFrame, columns: Sequence[str], standardize: bool = True) -> DataFrame:
    """Columns less their means and, if asked, over their standard deviations (n - 1); for use outside of fits, which fold this into the Gram matrix."""
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    if any(one[f"s_{i}"] in (None, 0.0) for i in range(len(columns))):
        raise DataError("a column is constant")
    return df.withColumns({c: (F.col(c).cast("double") - one[f"m_{i}"]) / (one[f"s_{i}"] if standardize else 1.0) for i, c in enumerate(columns)})


def same_names(a: DataFrame, b: DataFrame) -> bool:
    """Whether two one-column tables hold the same values equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# -- triplets ---------------------------------------------------------------

def raw_triplets(df: DataFrame, columns: Sequence[str], block: str = "all") -> DataFrame:
    """Uncentred cross-products of few columns as (block, i, j, v), i <= j, in one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(*[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")).alias(f"v{k}") for k, (i, j) in enumerate(pairs)])
    rows = [F.struct(F.lit(block).alias("block"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{k}").alias("v")) for k, (i, j) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def centred_triplets(df: DataFrame, columns: Sequence[str], block: str = "all") -> DataFrame:
    """Centred cross-products of few columns, each from its own stable covariance."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    c = [F.col(x).cast("double") for x in columns]
    one = df.agg(F.count("*").alias("n"), *[F.covar_samp(c[i], c[j]).alias(f"v{k}") for k, (i, j) in enumerate(pairs)])
    rows = [F.struct(F.lit(block).alias("block"), F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"v{k}") * (F.col("n") - 1)).alias("v")) for k, (i, j) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def wide_triplets(df: DataFrame, array: str) -> DataFrame:
    """Centred cross-products of an array column as (i, j, v), i <= j."""
    _, _, s = moments(df, [], array)
    i, j = np.triu_indices(len(s))
    schema = "i int, j int, v double"
    return df.sparkSession.createDataFrame(list(zip(i.tolist(), j.tolist(), s[i, j].tolist(), strict=True)), schema)


def centre(triplets: DataFrame, predictors: DataFrame, n: int) -> DataFrame:
    """G - n m m' for triplets; ``predictors(idx, x_mean, ...)``."""
    side = lambda k: predictors.select(F.col("idx").alias(k), F.col("x_mean").alias(f"_{k}"))
    return triplets.join(side("i"), "i").join(side("j"), "j").withColumn("v", F.col("v") - F.lit(n) * F.col("_i") * F.col("_j")).drop("_i", "_j")


def centre_xty(predictors: DataFrame, n: int, y_mean: float) -> DataFrame:
    return predictors.withColumn("xty", F.col("xty") - F.lit(n) * F.col("x_mean") * F.lit(y_mean))


def scale_triplets(triplets: DataFrame, predictors: DataFrame) -> DataFrame:
    """D^-1 G D^-1 without making what is sparse dense; ``predictors(idx, scale, ...)``."""
    side = lambda k: predictors.select(F.col("idx").alias(k), F.col("scale").alias(f"_{k}"))
    return triplets.join(side("i"), "i").join(side("j"), "j").withColumn("v", F.col("v") / (F.col("_i") * F.col("_j"))).drop("_i", "_j")


def predictor_scale(diagonal: Column, n: int | Column) -> Column:
    return F.sqrt(diagonal / (n - 1))


def constant_predictors(triplets: DataFrame, predictors: DataFrame, n: int) -> DataFrame:
    """Predictors whose centred diagonal is rounding; triplets are not centred."""
    d = triplets.where("i = j").select(F.col("i").alias("idx"), F.col("v").alias("raw")).join(predictors, "idx")
    off = F.lit(n) * F.col("x_mean") * F.col("x_mean")
    return d.where(F.col("raw") - off <= 100 * EPS * F.greatest(F.lit(1.0), F.abs("raw"), F.abs(off))).select("idx")


def asymmetry(full: DataFrame) -> DataFrame:
    """Per block, the largest difference of mirrored entries and what is allowed; both triangles are given."""
    mirror = full.select("block", F.col("i").alias("j"), F.col("j").alias("i"), F.col("v").alias("w"))
    both = full.join(mirror, ["block", "i", "j"], "full_outer").select("block", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("w", F.lit(0.0)).alias("w"))
    return both.groupBy("block").agg(F.max(F.abs(F.col("v") - F.col("w"))).alias("difference"), (F.lit(ROOT_EPS) * F.greatest(F.lit(1.0), F.max(F.abs("v")))).alias("allowed"))


# -- driver-side checks of arrays -------------------------------------------

def check_gram(gram: np.ndarray, names: Sequence[str] | None = None) -> np.ndarray:
    """Square, finite, symmetric within rounding; returns the mean with its transpose."""
    g = np.asarray(gram, float)
    if g.ndim != 2 or g.shape[0] != g.shape[1] or names is not None and len(names) != len(g):
        raise DataError("a Gram matrix must be square, with a name for each column")
    if not np.isfinite(g).all():
        raise DataError("a Gram matrix must be finite")
    if np.abs(g - g.T).max(initial=0) > ROOT_EPS * max(1.0, np.abs(g).max(initial=0)):
        raise DataError("a Gram matrix must be symmetric")
    return (g + g.T) / 2


def check_sufficient(n: int, gram, xty, yty=None, x_means=None, y_mean=None, names: Sequence[str] | None = None) -> SuffStats:
    """Sufficient statistics given as arrays, centred if means come with them."""
    if isinstance(n, bool) or n != int(n) or n < 2:
        raise DataError("n must be a whole number from 2")
    g = check_gram(gram, names)
    p = len(g)
    xty = np.asarray(xty, float).reshape(-1)
    if xty.shape != (p,) or not np.isfinite(xty).all():
        raise DataError("xty must be finite, one for each predictor")
    if yty is not None and not (np.isfinite(yty) and yty >= 0):
        raise DataError("yty must be finite and not negative")
    if (x_means is None) != (y_mean is None):
        raise DataError("x_means and y_mean come together")
    names = list(names) if names is not None else [f"x{i + 1}" for i in range(p)]
    if len(set(names)) != p or any(not n for n in names):
        raise DataError("names must be given and differ")
    if x_means is None:
        if bad := [names[j] for j in np.flatnonzero(np.diag(g) <= 100 * EPS * np.maximum(1, abs(np.diag(g))))]:
            raise DataError(f"predictors {bad} are constant")
        return SuffStats(int(n), names, g, xty, None if yty is None else float(yty), np.zeros(p), None, intercept=False)
    m = np.asarray(x_means, float).reshape(-1)
    if m.shape != (p,) or not np.isfinite(m).all() or not np.isfinite(y_mean):
        raise DataError("means must be finite, one for each predictor")
    y2 = None
    if yty is not None:
        y2 = yty - n * y_mean**2
        if y2 < -ROOT_EPS * max(1.0, yty):
            raise DataError("yty is less than its mean allows")
        y2 = max(y2, 0.0)
    out = SuffStats(int(n), names, g - n * np.outer(m, m), xty - n * m * y_mean, y2, m, float(y_mean))
    raw = np.diag(g)
    if bad := [names[j] for j in np.flatnonzero(np.diag(out.gram) <= 100 * EPS * np.maximum(1, np.maximum(abs(raw), abs(n * m**2))))]:
        raise DataError(f"predictors {bad} are constant")
    return out


def check_fixed_rank(gram: np.ndarray) -> None:
    """Flat-prior predictors must be linearly independent."""
    if len(gram):
        values = np.linalg.eigvalsh(gram)
        if values.min() <= ROOT_EPS * max(1.0, abs(values).max()):
            raise DataError("fixed predictors are linearly dependent")


def check_psd(gram: np.ndarray, xty: np.ndarray, yty: float | None) -> None:
    """No negative eigenvalue, xty within the range, and the joint matrix positive semidefinite."""
    values, vectors = np.linalg.eigh(gram)
    tolerance = ROOT_EPS * max(1.0, abs(values).max(initial=0))
    if values.min(initial=0) < -tolerance:
        raise DataError("the Gram matrix has negative eigenvalues")
    zero = values <= tolerance
    inside = vectors.T @ xty
    if (abs(inside[zero]) > ROOT_EPS * max(1.0, abs(xty).max(initial=0))).any():
        raise DataError("xty lies outside the Gram matrix's range")
    if yty is not None and yty - (inside[~zero] ** 2 / values[~zero]).sum() < -ROOT_EPS * max(1.0, yty):
        raise DataError("yty is too small for the other statistics")


