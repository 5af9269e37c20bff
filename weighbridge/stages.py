"""Written intermediate tables in the folder all executors share.

The tables belong to whoever owns that folder: they outlive a lazy result that reads
them. The temporary folder of a local session is removed when its process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables: the session's checkpoint
    folder. Only a local session without one gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="weighbridge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the stage folder and read back: one evaluation for
    several readers, which also survives the loss of executors."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
