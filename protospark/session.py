"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder on a local master (as in tests), an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="protospark-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def own_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, to be deleted when the application has ended."""
    return f"{shared_dir(spark).rstrip('/')}/protospark/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
