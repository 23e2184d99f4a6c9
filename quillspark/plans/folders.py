"""A folder that driver and executors share, for what queries write and read back."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, as a path; where that is unset, one of this machine, in local mode only. Deleted when Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    base = os.path.join(shared.removeprefix("file://").removeprefix("file:"), f"{name}-{uuid.uuid4().hex}") if shared else tempfile.mkdtemp(prefix=f"quillspark-{name}-")
    os.makedirs(base, exist_ok=True)
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


class Kept:
    """Frames stored as Parquet in a shared folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def store(self, frame: DataFrame, name: str) -> DataFrame:
        path = os.path.join(self.folder, name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)
