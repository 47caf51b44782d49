"""Rows of a table told apart by what they hold and the file they come from, and kept without an exchange of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, frugal, map_arrays, put_arrays

PARTS = 16
KEPT = "__kept_row"  # a name that no table is likely to have


def _one_source(docs: DataFrame) -> bool:
    """Whether Spark can say which file a row of ``docs`` is read from; of joins and the like it cannot."""
    try:
        return docs.select(F.input_file_name()).schema is not None
    except AnalysisException as e:
        if e.getCondition() != "MULTI_SOURCES_UNSUPPORTED_FOR_EXPRESSION":
            raise
        return False


def file_hash(docs: DataFrame):
    """A hash of the file that a row of ``docs`` is read from, or of an empty name."""
    return F.xxhash64(F.input_file_name() if _one_source(docs) else F.lit(""))


def row_hash(id: str, text: str):
    """A hash of id and text, null or not; rows that share it are alike in both."""
    return F.xxhash64(F.col(id).isNull(), F.col(id), F.col(text).isNull(), F.col(text))


def keep_rows(docs: DataFrame, ws: Workspace, kept: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose hash is in ``kept(KEPT, file)``, without an exchange of texts.

    Rows to keep are dealt by the file that they are read from and stored, so
    a task that reads a file looks only at that file's.  Rows that come from no
    file are joined instead.
    """
    files = min(1 << 16, len(docs.inputFiles())) if _one_source(docs) else 0
    if not files or not kept.where(F.col("file") == F.xxhash64(F.lit(""))).isEmpty():
        return docs.withColumn(KEPT, row_hash(id, text)).join(kept.select(KEPT), KEPT, "left_semi").drop(KEPT)
    # several parts for each file, as one file may hold most rows
    bucket = lambda file, row: (F.pmod(file, F.lit(files)) * PARTS + F.pmod(row, F.lit(PARTS))).cast("int")
    uri = ws.path("files")

    def store(key, rows):
        put_arrays(f"{uri}/{key[0].as_py()}", row=np.sort(rows["row"].to_numpy()))
        return pa.table({"n": [len(rows)]})

    ids = kept.select(bucket(F.col("file"), F.col(KEPT)).alias("b"), F.col(KEPT).alias("row"))
    stored = {r["b"] for r in ids.select("b").distinct().collect()}
    ids.groupBy("b").applyInArrow(store, "n long").agg(F.sum("n")).collect()

    def run(batches):
        have: dict[int, np.ndarray] = {}
        for b in batches:
            file, own = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            keep = np.zeros(b.num_rows, bool)
            for k in np.unique(file).tolist():
                if k in stored:
                    if k not in have:
                        have[k] = map_arrays(f"{uri}/{k}")["row"]
                    mine = file == k
                    at = np.minimum(np.searchsorted(have[k], own[mine]), len(have[k]) - 1)
                    keep[mine] = have[k][at] == own[mine]
            yield pa.RecordBatch.from_arrays(b.columns[:-2], names=b.schema.names[:-2]).filter(pa.array(keep))

    return docs.select("*", bucket(file_hash(docs), row_hash(id, text)).alias("__file"), row_hash(id, text).alias("__row")).mapInArrow(frugal(run), docs.schema)
