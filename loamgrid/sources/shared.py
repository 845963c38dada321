"""Tables that several steps of a job read, written once to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without one gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = f"/tmp/loamgrid-checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from the shared folder; lineage ends there."""
    folder(df.sparkSession)
    return df.checkpoint()


def local_folder(spark: SparkSession) -> str:
    """The shared folder as a path of the file system, for sources that open files themselves."""
    where = folder(spark)
    if not where.startswith(("/", "file:")):
        raise ValueError("the log is kept in a folder that is mounted on all executors")
    return "/" + where.removeprefix("file:").lstrip("/")
