"""Recurrences along time, one series a row: explicit steps as one fold in the row, or by numpy over batches of rows.

Rows never meet, so a table of any number of cells is one pass without a shuffle. A row holds its whole
trajectory, which bounds the steps, not the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

State = dict[str, Column]


def held(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """``x`` held between bounds; null stays null. The expression is made once, however long."""
    if low is None and high is None:
        return x

    def between(v: Column) -> Column:
        inside = v if low is None else F.greatest(F.lit(low), v)
        return F.when(v.isNotNull(), inside if high is None else F.least(F.lit(high), inside))

    return F.get(F.transform(F.array(x), between), F.lit(0))


def euler(state: State, rates: State, dt: float, low: float | None = None, high: float | None = None) -> State:
    """One explicit step: state + dt * rate, held between the bounds."""
    return {n: held(x + F.lit(dt) * rates[n], low, high) for n, x in state.items()}


def _packed(state: State) -> Column:
    return F.struct(*[c.alias(n) for n, c in state.items()])


def _each(steps: int | None, given: str | None) -> Column:
    return F.col(given) if given else F.sequence(F.lit(0), F.lit(steps - 1)) if steps else F.array().cast("array<int>")


def _kind(rows: DataFrame, start: State) -> str:
    """The type of the start: in a fold of it, fields that start without null must be able to become null."""
    return rows.select(_packed(start).alias("s")).schema["s"].dataType.simpleString()


def trajectory(rows: DataFrame, keys: list[str], start: State, step: Callable[[State, Column], State], steps: int | None = None, given: str | None = None) -> DataFrame:
    """(keys, t_idx, state columns) after each step, t_idx from 0.

    ``step`` makes the next state from the last one and what is given: the number of the step, or the
    element of the array column ``given``, whose length is then the number of steps. A state must keep its types. Null
    arrays give no rows, null values stay null.
    """
    names = list(start)

    def onward(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        return F.array_append(done, _packed(step({n: last[n] for n in names}, x)))

    whole = F.aggregate(_each(steps, given), F.array(_packed(start)).cast(f"array<{_kind(rows, start)}>"), onward)
    after = rows.select(*keys, F.posexplode(F.slice(whole, F.lit(2), F.size(whole) - 1)).alias("t_idx", "s"))
    return after.select(*keys, F.col("t_idx").cast("long").alias("t_idx"), *[F.col("s")[n].alias(n) for n in names])


def last_state(rows: DataFrame, keys: list[str], start: State, step: Callable[[State, Column], State], steps: int | None = None, given: str | None = None) -> DataFrame:
    """(keys, state columns) after the last step: the last row of each ``trajectory``, of which nothing else is kept.

    Series without a step, or with a null array, give no row.
    """
    names, each = list(start), _each(steps, given)
    state = F.aggregate(each, _packed(start).cast(_kind(rows, start)), lambda s, x: _packed(step({n: s[n] for n in names}, x)))
    after = rows.where(F.size(each) > 0).select(*keys, state.alias("s"))
    return after.select(*keys, *[F.col("s")[n].alias(n) for n in names])


#: Series of a task, about: some seconds of work, however few bytes they have.
SERIES = 50_000


def dealt(rows: DataFrame, key: str, times: int = 1) -> DataFrame:
    """``rows``, of which ``times`` series each are made, dealt by ``key`` to tasks of about ``SERIES`` series.

    Spark cuts a table by its bytes, so one of few bytes that much work follows would stay in one task.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() * times // SERIES)), key)


def trajectory_by_chunks(rows: DataFrame, keys: list[str], start: State, step: Callable[[State, Column], State], steps: int, chunk: int) -> DataFrame:
    """The same in stretches of ``chunk`` steps, each from the last state of the one before: a row never holds more than a stretch."""
    from ..plans.storage import written

    names = list(start)
    state = rows.select(*keys, *[c.alias(n) for n, c in start.items()])
    out = None
    for first in range(0, steps, chunk):
        n = min(chunk, steps - first)
        part = written(trajectory(state, keys, {m: F.col(m) for m in names}, lambda s, i, at=first: step(s, i + at), n), "stretch")
        state = part.where(F.col("t_idx") == n - 1).drop("t_idx")
        part = part.withColumn("t_idx", F.col("t_idx") + first)
        out = part if out is None else out.unionByName(part)
    return out


def trajectory_by_kernel(rows: DataFrame, keys: list[str], start: State, step: Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]], steps: int) -> DataFrame:
    """The same with a numpy ``step`` over the states of a batch of rows, all doubles."""
    names = list(start)
    given = rows.select(*keys, *[c.cast("double").alias(n) for n, c in start.items()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            state = {n: frame[n].to_numpy(dtype=float) for n in names}
            for i in range(steps):
                state = step(state, i)
                yield frame[keys].assign(t_idx=i, **state)

    kinds = dict(given.dtypes)
    return given.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "t_idx bigint", *[f"{n} double" for n in names]]))
