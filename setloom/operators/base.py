"""Helpers of the operators: lineage cuts and running sums in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder: branches read it instead of computing it again.

    A ``local`` master without ``spark.checkpoint.dir`` gets a folder of its own; elsewhere that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="setloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder, which all executors share."""
    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as compressed columns: as ``cut``, for wide rows, of which a checkpoint takes several times the room."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def running_sum(df: DataFrame, keys: list[str], weight: Column, name: str) -> DataFrame:
    """df with the weight of all rows before each, in the order of keys, as ``name``.

    Key ranges go to tasks, which add up their own rows; the tasks' sums, one row each, are joined on. No task
    sees all rows, unlike a window without partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranged = cut(df.withColumn("_w", weight.cast("long")).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = ranged.withColumn("_inner", F.coalesce(F.sum("_w").over(own), F.lit(0)))
    return inner.join(F.broadcast(sums), "_part").withColumn(name, F.col("_inner") + F.col("_before")).drop("_part", "_w", "_inner", "_before")
