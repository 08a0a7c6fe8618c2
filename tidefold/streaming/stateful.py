"""Totals over streams: state by key is kept between micro-batches and moved by every batch's partial sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_dir

#: Rows of a file of the stream, at most, and batches that its files are dealt to.
FILE_ROWS, BATCHES = 250_000, 4


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count and total of ``value`` by ``key``, null a key too and null values not counted. Rows are summed in every task before the shuffle, so a hot key is a few rows there."""
    return stream.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def as_stream(rows: DataFrame, name: str, batches: int = BATCHES, file_rows: int = FILE_ROWS, last: DataFrame | None = None) -> DataFrame:
    """``rows`` written to the shared folder and read as a stream of about ``batches`` batches.

    Every task that makes rows writes files of its own, as many as they need, and a batch takes its share of all
    files: both grow with the rows. Files come in the order of writing, those of ``last`` after all others.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", file_rows).parquet(path)
    if last is not None:
        last.write.mode("append").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


def run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the events by type, read as a stream; the last state is returned.

    The stream's log and output are in the shared folder; each batch replaces the output whole, so one that
    is repeated after a failure changes nothing.
    """
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = as_stream(spark.read.parquet(f"{sf_dir}/events.parquet").repartition(spark.sparkContext.defaultParallelism), "events")
    totals = running_totals(source, "event_type", "value")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out")

    run = totals.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(totals.schema).parquet(f"{home}/out")
