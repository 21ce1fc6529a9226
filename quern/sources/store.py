"""Tables written between steps of an iterative job, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; where that is unset, a temporary folder for a local master, as in tests, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.gettempdir()
    return os.path.join(found.rstrip("/"), f"quern-{spark.sparkContext.applicationId}")


def saved(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table and reads it back, which cuts its lineage."""

    def save(df: DataFrame) -> DataFrame:
        path = f"{work_dir(spark)}/step-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save
