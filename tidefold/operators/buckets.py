"""Series stored in buckets by their keys, so that joins of them move no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes are not known before writing; rows are. So many go to a bucket.
BUCKET_ROWS = 2_000_000


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """The power of two that keeps buckets within ``bucket_rows`` if keys are even: tables of different sizes then fit together."""
    return 1 << (max(1, -(-rows // bucket_rows)) - 1).bit_length()


def store(df: DataFrame, name: str, keys: list[str], buckets: int) -> str:
    """Write ``df`` as a table of the session's warehouse, bucketed and sorted by ``keys``; the table's name, which no other call gets.

    Rows are dealt to their buckets first, so that a bucket is one file. Keys may be null; a null
    key meets none in a join.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return table


def joined(spark: SparkSession, left: str, right: str, keys: list[str], how: str = "inner") -> DataFrame:
    """The join of two stored tables by their bucket keys: buckets of one number meet where they lie, already sorted by hash.

    A hot key is one bucket; salt it into a key column before storing where that matters.
    """
    return spark.table(left).hint("merge").join(spark.table(right), keys, how)
