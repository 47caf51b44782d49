"""Cross-products of a stream: an extension, as counts, means and centred products merge exactly.

Each micro-batch leaves one row, named by its number, so a batch that is run
again replaces its row; the rows are merged when the statistics are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gram as G
from ..sources.quality import DataError

TASKS = 16  # that merge the batches' statistics


def collector(path: str, y: str, x: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch`` that adds each batch's statistics to ``path``."""
    names = [y, *x]

    def add(batch: DataFrame, number: int) -> None:
        good = batch.select(*[F.col(c).cast("double") for c in names])
        if good.isEmpty():
            return
        bad = good.where(" or ".join(f"`{c}` is null or isnan(`{c}`)" for c in names))
        if not bad.isEmpty():
            raise DataError("a batch holds values that are missing or not finite")
        n, m, s = G.moments(good, names)
        row = [(number, int(n), m.tolist(), s.ravel().tolist())]
        batch.sparkSession.createDataFrame(row, "batch long, n long, mean array<double>, m2 array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def statistics(spark: SparkSession, path: str, x: Sequence[str]) -> G.SuffStats:
    """The statistics of all batches so far."""
    p = len(x) + 1
    schema = "batch long, n long, mean array<double>, m2 array<double>"

    def fold(batches):
        first, total = None, None
        for b in batches:
            for r in b.to_pylist():
                part = (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(p, p))
                first, total = (r["batch"], part) if total is None else (first, G._merge(total, part))
        if total is not None:
            n, m, s = total
            yield pa.RecordBatch.from_pylist([{"batch": first, "n": int(n), "mean": m.tolist(), "m2": s.ravel().tolist()}], pa.schema([("batch", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))]))

    # batches are merged in tasks, always in the same order; the driver gets a row from each of a fixed number of them
    dealt = spark.read.schema(schema).parquet(f"{path}/*").repartition(TASKS, "batch").sortWithinPartitions("batch")
    rows = sorted(dealt.mapInArrow(fold, schema).collect(), key=lambda r: r["batch"])
    n, m, s = reduce(G._merge, [(r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(p, p)) for r in rows])
    return G.SuffStats(n, list(x), s[1:, 1:], s[1:, 0].copy(), float(s[0, 0]), m[1:], float(m[0]))
