"""Shared plumbing: table access, the shared folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach.

    On a cluster it is what ``spark.checkpoint.dir`` names. Only in local mode, where nothing is set, as
    in tests, a temporary folder is made and set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidefold-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result has no lineage before the files, so a lost executor costs a reread only.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it has more than this share of the rows; so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 1024


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The keys with more than ``HOT_SHARE`` of ``total`` rows, 1,023 at most."""
    return rows.groupBy(key).count().where(F.col("count") > HOT_SHARE * total).select(key)


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join with ``right``, which has a key once: rows of hot keys meet a broadcast of theirs, all others are shuffled.

    ``hot`` comes from ``hot_keys``, which bounds what is broadcast, so that no task gets all rows of a hot key.
    """
    if hot.isEmpty():
        return left.join(right, key)
    few = F.broadcast(hot)
    near = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key)
    return near.unionByName(left.join(few, key, "left_anti").join(right, key))


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_empty(column: str):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
