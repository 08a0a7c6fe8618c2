"""The last source not later than a target, over streams: sources and targets wait in keyed state until the watermark has passed them."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.timegrid import TimeGrid

#: The state store that ``transformWithState`` needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "k string, share int, number bigint, at bigint, v double"


class LastSource(StatefulProcessor):
    """State of a key: its sources since the last one before the watermark, and the targets that wait.

    A target is answered when the watermark has passed its time, as no source before it can come any
    more; then sources before the last one that the watermark has passed are dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sources = handle.getListState("sources", "at bigint, v double")
        self.waiting = handle.getListState("waiting", "at bigint, number bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        # Rows of a batch go to the state in one piece each; they are looked at when a timer comes.
        for frame in rows:
            asked = frame["asked"].to_numpy(dtype=bool)
            if not asked.all():
                own = frame[~asked]
                self.sources.appendList(list(zip(own["at"].tolist(), own["v"].tolist(), strict=True)))
            if asked.any():
                own = frame[asked]
                self.waiting.appendList(list(zip(own["at"].tolist(), own["number"].tolist(), strict=True)))
                first = int(own["at"].min())
                earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            # Timers have milliseconds: the next whole one is past the target.
            self.handle.registerTimer(earliest // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due, later = [w for w in waiting if w[0] < mark], [w for w in waiting if w[0] >= mark]
        if due:
            # Of values at one time the largest is the last.
            known: dict[int, float] = {}
            for at, v in self.sources.get() if self.sources.exists() else ():
                known[at] = max(v, known.get(at, v))
            starts = sorted(known)
            out = []
            for at, number in due:
                i = bisect.bisect_right(starts, at) - 1
                out.append((key[0], key[1], number, at, known[starts[i]] if i >= 0 else None))
            if starts:
                self.sources.put([(t, known[t]) for t in starts[max(0, bisect.bisect_right(starts, mark) - 1) :]])
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            frame = pd.DataFrame(out, columns=["k", "share", "number", "at", "v"])
            yield frame.astype({"share": "int32", "number": "int64", "at": "int64", "v": "float64"})
        if later:
            self.handle.registerTimer(min(w[0] for w in later) // 1000 + 1)

    def close(self) -> None:
        pass


def _last_of_steps(rows: DataFrame, delay: str, grid: TimeGrid) -> DataFrame:
    """``rows`` (k, T, number, v, at, asked) with the last source before each step of ``grid`` alone, as no other can answer a target on a step.

    They leave when the watermark has passed their step. Every task keeps the last of its own rows before the shuffle,
    so a hot key is a few rows there.
    """
    step, zero = round(grid.dt_seconds * 1e6), (grid.start - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    if step % 1000 or zero % 1000 or abs(step - grid.dt_seconds * 1e6) > 1e-3:
        # Watermarks have no less.
        raise ValueError("steps of a stream's grid must be whole milliseconds")
    # Windows are closed on the left, and a source at a step must go with that step.
    rows = rows.withColumn("before", F.timestamp_micros(F.col("at") - 1)).withWatermark("before", delay)
    window = F.window("before", f"{step} microseconds", startTime=f"{zero % step} microseconds")
    wrong = F.raise_error(F.concat(F.lit("no step of the grid: "), F.col("T").cast("string"))).cast("bigint")
    number = F.when(F.col("asked"), F.when(F.pmod(F.col("at") - zero, F.lit(step)) == 0, F.col("number")).otherwise(wrong)).otherwise(0)
    met = rows.groupBy("k", window.alias("w"), "asked", number.alias("number")).agg(F.max(F.struct("at", "v")).alias("last"), F.count("*").alias("n"))
    # A target that was asked for twice is answered twice.
    many = F.explode(F.array_repeat("k", F.when(F.col("asked"), F.col("n")).otherwise(1).cast("int"))).alias("k")
    return met.select(many, F.window_time("w").alias("T"), "number", "last.v", "last.at", "asked")


def stream_as_of(stream: DataFrame, delay: str, shares: int = 1, grid: TimeGrid | None = None) -> DataFrame:
    """``stream`` (k string, T timestamp, number bigint, v double; targets have no v) -> for every target k, T, number, value.

    ``value`` is that of the last source of its key not later than T, null without one; of values at one
    time the largest. Rows that come later than ``delay`` after the latest time seen may be dropped, and are
    counted in the progress as such; targets are answered once the watermark has passed them, so those within
    ``delay`` of the last time wait for more rows. Rows without T are dropped; a null key is a key. A
    row with v is a source, and a null v a target, so a source without value does not occur. A hot key's targets are
    spread over ``shares`` tasks, each of which has all of the key's sources.

    With ``grid``, all targets stand on its steps, which go on beyond both ends, and one that does not is an error. Of the
    sources between two steps only the last then goes to the state of its key, whose rows grow with the steps and not with
    the sources. Without, the state holds every source until the watermark has passed it.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    every: Column = F.sequence(F.lit(0), F.lit(shares - 1))
    own = F.array(F.pmod(F.xxhash64("at", "number"), F.lit(shares)).cast("int"))
    rows = stream.where("T is not null").select("k", "T", "number", "v", F.unix_micros("T").alias("at"), F.col("v").isNull().alias("asked"))
    rows = _last_of_steps(rows, delay, grid) if grid else rows.withWatermark("T", delay)
    rows = rows.withColumn("share", F.explode(F.when(F.col("asked"), own).otherwise(every)))
    found = rows.groupBy("k", "share").transformWithStateInPandas(LastSource(), OUT, "Append", "EventTime")
    return found.select("k", F.timestamp_micros("at").alias("T"), "number", F.col("v").alias("value"))


def run_to_folder(answers: DataFrame, home: str, trigger: dict | None = None):
    """Start the query: every batch replaces a folder of its own under ``home``/out, so one that is repeated after a failure changes nothing.

    The same ``home`` resumes where the last run ended or was killed.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    return answers.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/log").trigger(**(trigger or {"availableNow": True})).start()


def results(spark: SparkSession, home: str, schema: str = "k string, T timestamp, number bigint, value double") -> DataFrame:
    """What the batches of ``home`` have answered."""
    return spark.read.schema(schema).parquet(f"{home}/out").drop("batch")
