"""Shared scratch space that driver and executors both see.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
local session (tests) may leave it unset; then a temporary folder is made,
because driver and executors are one process there.  Files are written under a
temporary name and renamed, so a task that is retried or run twice leaves one
whole file.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import mmap
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, from the session; a new local one in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("bayesmill.local.dir", None)
    if found:
        return found.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="bayesmill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("bayesmill.local.dir", f"file://{made}")
    return f"file://{made}"


class Workspace:
    """A folder of tables and raw files for one run of one operator."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.uri = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a table and read it again: lineage ends here."""
        df.write.parquet(self.path(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write ``df`` as a table, read it again, and delete all else in this workspace."""
        out = self.save(df, name)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.uri)
        for f in p.getFileSystem(conf).listStatus(p):
            if f.getPath().getName() != name:
                f.getPath().getFileSystem(conf).delete(f.getPath(), True)
        return out

    def drop(self, *names: str) -> None:
        """Delete what is no longer needed (through Hadoop, so any store works)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def put_arrays(uri: str, **arrays: np.ndarray) -> None:
    """Write each array as raw little-endian values to ``uri/<name>.<dtype>``."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    for name, a in arrays.items():
        to, part = f"{path}/{name}.{a.dtype.name}", f"{path}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(np.ascontiguousarray(a).data if a.size else b"")
        fs.move(part, to)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """Memory-map the arrays that :func:`put_arrays` wrote.

    A folder on a mounted file system is mapped in place.  From any other store
    the file is first copied to an unnamed local file, which goes with the
    mapping; nothing stays behind.
    """
    fs, path = pafs.FileSystem.from_uri(uri)
    out = {}
    for f in fs.get_file_info(pafs.FileSelector(path)):
        name, _, kind = f.base_name.rpartition(".")
        if not name or f.base_name.startswith("."):
            continue
        if f.size == 0:
            out[name] = np.empty(0, kind)
        elif isinstance(fs, pafs.LocalFileSystem):
            with open(f.path, "rb") as local:
                out[name] = _mapped(local, kind)
        else:
            with tempfile.TemporaryFile() as local, fs.open_input_stream(f.path) as src:
                shutil.copyfileobj(src, local, 1 << 22)
                local.flush()
                out[name] = _mapped(local, kind)
    return out


#: From Python 3.13 on a mapping need not keep its file open, so many mappings do not use up file descriptors.
_CLOSED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def _mapped(file, kind: str) -> np.ndarray:
    return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **_CLOSED), kind)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound Arrow batches: whole texts go to Python, so rows must be few."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def frugal(task):
    """A task's function that hands free memory back at its end, as workers live on for other tasks."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
