"""Cutting the lineage of iterative jobs with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (or the context's); a temporary one only where everything runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """One side of a join of two tables that both grow with the history: it is sorted and merged, never broadcast.

    Spark reckons a table by the size of its files. Written ones are compressed, ids that follow each other by a factor of a hundred, so a gigabyte of rows would look
    small enough to pass through the driver.
    """
    return df.hint("merge")
