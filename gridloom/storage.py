"""Intermediate tables in the folder all executors share.

Lineage is cut only by written tables or `checkpoint()`: both survive the loss of any executor.
The folder is `spark.checkpoint.dir`; only where a session has none (tests, a laptop) a local one is set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The tables written by this process and not dropped yet.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; also hands it to the SparkContext, so that `checkpoint()` works."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, own, True)
        d = "file://" + own
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once, its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """`df` written as Parquet into the shared folder and read again, with its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, path: str) -> None:
    """Remove a table made by `written` (through Hadoop's file system, so any scheme works)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_written(spark: SparkSession) -> int:
    """Remove all tables made by `written` in this process, once nothing that reads them is still to run; their number."""
    n = len(_written)
    while _written:
        drop_written(spark, _written.pop())
    return n
