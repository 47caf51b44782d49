"""Ends a table's lineage in the shared folder that the session names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which Spark then uses for checkpoints.

    Only a local session may leave the setting out; it gets a temporary folder.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not found:
            found = tempfile.mkdtemp(prefix="bayesmill-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that plans made from it start anew."""
    shared(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> tuple[str, list[str]]:
    """``df`` as Parquet in the shared folder: the folder's URI and the files' paths, for tasks that read it with Arrow."""
    uri = f"{shared(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    uri = re.sub("^file:/(?!/)", "file:///", uri if ":" in uri else f"file://{uri}")
    fs, path = pafs.FileSystem.from_uri(uri)
    return uri, sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))
