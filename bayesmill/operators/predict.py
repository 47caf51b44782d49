"""Prediction: points in Catalyst, intervals by batches of rows against the draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import mixture_quantile
from ..plans.lineage import store
from ..plans.spec import SpecError, number
from ..sources.quality import DataError, check_columns

DRAW_LIMIT = 256 << 20  # bytes of draws that are shipped to tasks; more are read from the shared folder
RUN = 64 << 20  # bytes of draws, or of rows' signals, that a task holds then


def linear(intercept: float, coefficients: Mapping[str, float]) -> Column:
    """The point prediction as one expression."""
    out = F.lit(float(intercept))
    for name, b in coefficients.items():
        out = out + F.lit(float(b)) * F.col(name).cast("double")
    return out


def point(newdata: DataFrame, intercept: float, means: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Add ``fit``, the prediction at the coefficients' means."""
    check_columns(newdata, list(names))
    if "fit" in newdata.columns:
        raise DataError("column ['fit'] is taken")
    return newdata.withColumn("fit", linear(intercept, dict(zip(names, means, strict=True))))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercepts, coefficients (a row for each draw), residual standard deviations."""
    m, var, theta = (batch.column(c) for c in ("intercept", "residual_var", "theta"))
    return m.to_numpy(zero_copy_only=False), theta.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), np.sqrt(var.to_numpy(zero_copy_only=False))


def _stored(uri: str, files: Sequence[str], rows: int):
    fs, _ = pafs.FileSystem.from_uri(uri)
    for path in files:
        with fs.open_input_file(path) as f:
            yield from map(_arrays, pq.ParquetFile(f).iter_batches(rows))


def predict(newdata: DataFrame, draws: DataFrame, names: Sequence[str], interval: str = "none", level: float = 0.95) -> DataFrame:
    """Add ``fit`` and, for an interval, ``lower`` and ``upper``; columns are found by name, in any order.

    ``credible``: quantiles of the draws' means.  ``prediction``: quantiles of
    the mixture of the draws' normal distributions.  Draws of over
    ``DRAW_LIMIT`` bytes are stored in the shared folder, where they stay, and
    tasks read a run of them at a time for each run of rows.
    """
    if interval not in ("none", "credible", "prediction"):
        raise SpecError("interval must be none, credible or prediction")
    number(level, "level", above=0, below=1)
    check_columns(newdata, list(names))
    if clash := {"fit", "lower", "upper"} & set(newdata.columns):
        raise DataError(f"columns {sorted(clash)} are taken")
    r = draws.agg(F.coalesce(F.avg("intercept"), F.lit(0.0)).alias("m"), F.count("*").alias("n")).first()
    means = dict(draws.select(F.posexplode("theta").alias("idx", "v")).groupBy("idx").agg(F.avg("v").alias("v")).collect())  # a number for each predictor
    out = point(newdata, r["m"], [means[k] for k in range(len(names))], names)
    if interval == "none":
        return out
    count, t = r["n"], draws.select(F.coalesce("intercept", F.lit(0.0)).alias("intercept"), "residual_var", "theta")
    if count * (len(names) + 2) * 8 <= DRAW_LIMIT:
        held = t.toArrow()
        shipped = newdata.sparkSession.sparkContext.broadcast(_arrays(held.combine_chunks().to_batches()[0]))
        parts = lambda: [shipped.value]
    else:
        uri, files = store(t)
        parts = lambda: _stored(uri, files, max(1, RUN // (8 * len(names) + 16)))
    step = max(1, min(1000, RUN // (8 * count)))
    cols = [F.col(f"`{c}`") for c in out.columns]
    x = F.array(*[F.col(c).cast("double") for c in names]).alias("_x")
    schema = out.schema.add("lower", "double").add("upper", "double")
    tail = (1 - level) / 2

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            rows = batch.columns[-1].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            if not np.isfinite(rows).all():
                raise DataError("new data must be finite")
            low, high = np.empty(n), np.empty(n)
            for i in range(0, n, step):
                x, at = rows[i : i + step], 0
                eta, sd = np.empty((len(x), count)), np.empty(count)
                for m, b, s in parts():
                    eta[:, at : at + len(m)], sd[at : at + len(m)] = x @ b.T + m, s
                    at += len(m)
                if interval == "credible":
                    low[i : i + step], high[i : i + step] = np.quantile(eta, [tail, 1 - tail], axis=1)
                else:
                    low[i : i + step], high[i : i + step] = mixture_quantile(eta, sd, tail), mixture_quantile(eta, sd, 1 - tail)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(low), pa.array(high)], schema.names)

    rows = out.select(*cols, x)
    # the work is in the rows, not in reading them: a table of few partitions is dealt out
    cores = newdata.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows.mapInArrow(run, schema)
