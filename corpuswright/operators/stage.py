"""Intermediate results that several branches of a plan read: computed once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKEW = 3  # times a task's share of the rows, from which a table is dealt anew


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, also set for checkpoints; a private one only where neither is
    set and driver and executors are one process. Elsewhere that is an error: not all could reach it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` as it is, or, where reading it keeps too few tasks at work, dealt by a hash of the columns named.

    A file with one row group is one task, however many cores wait and however many splits the file has: a split without the middle
    of a row group has no rows. So where there are enough splits, the rows of each are counted, which reads no column, and a table
    moves if fewer tasks than there are cores have any, or one has over SKEW times its share. Others never do.

    What is built on a table that moved runs where its rows went: Spark carries a filter below a repartition, into the few tasks
    that read, but not below one on the partition, which all rows pass.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= cores:
        rows = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
        told = rows.agg(F.count(F.lit(1)).alias("busy"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
        if told["all"] < splits or (told["busy"] >= cores and told["most"] * splits <= SKEW * told["all"]):
            return df
    return df.repartition(max(2 * cores, splits), *by).where(F.spark_partition_id() >= 0)


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table of that name in the shared folder: computed where it is not there as a whole, else read. The name must say
    what the table depends on. Two who write it at once write the same rows, and one table stays."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    done = hadoop(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        mine = f"{path}-{uuid.uuid4().hex}"
        df.write.parquet(mine)
        fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(hadoop(path)) or not fs.rename(hadoop(mine), hadoop(path)):
            path = mine
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame) -> DataFrame:
    """`df` materialised, so that what is built on it does not compute it again, and without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
