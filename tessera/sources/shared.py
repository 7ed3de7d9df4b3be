"""The folder that driver and executors share, and tables stored there."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine, but only if all workers are on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def stored(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The folder of what write(folder) makes of the files at `source`, made once a session.

    The name holds the place, length and time of the source, so a changed source is read
    anew; a folder counts once its mark is there, which is written last.
    """
    files, where = _file_system(spark, source)
    size = files.getContentSummary(where).getLength()
    stamp = f"{source}:{size}:{files.getFileStatus(where).getModificationTime()}:{spark.sparkContext.applicationId}"
    folder = f"{shared_dir(spark)}/tessera-{name}-{hashlib.sha1(stamp.encode()).hexdigest()[:20]}"
    if not exists(spark, f"{folder}/DONE/_SUCCESS"):
        write(folder)
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/DONE")
    return folder


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores at least, for work that a small file would leave to one of them.

    Input of many files or row groups passes as it is; only where a whole table is fewer
    parts than cores is it dealt anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, n_rows: int, *keys: str, rows: int = 500_000) -> DataFrame:
    """df by keys in parts of about so many of its n_rows, and as many parts as there are cores at least.

    The number of parts grows with the rows, so that what a task sorts or gathers does not.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // rows))
    return df.repartition(parts, *keys)
