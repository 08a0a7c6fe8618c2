"""The distinct ones among ranked points: taken best first, each at least a distance from all taken before it.

The choice of the sequential rule, made in rounds: a point that ranks before all undecided points of its
cell and the cells next to it is taken, and what lies too close to it goes. Cells are as wide as the distance, so
nothing outside the neighbouring cells can be too close. With ranks that do not follow the places, rounds
grow with the logarithm of the points; the last ``FINISH`` undecided ones are decided in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written

#: Undecided points that one task decides; shares that a crowded cell is dealt to.
FINISH, SHARES = 20_000, 16
#: Cells lie on so many of the axes.
AXES = 2


def _distance(a: Column, b: Column, d: int) -> Column:
    total = F.lit(0.0)
    for i in range(d):
        gap = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
        total = total + gap * gap
    return F.sqrt(total)


def _around(rows: DataFrame, cell: str, axes: int) -> DataFrame:
    """Each row once for its cell and every cell next to it."""
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in product((-1, 0, 1), repeat=axes)])
    near = F.transform(steps, lambda s: F.zip_with(F.col(cell), s, lambda c, x: c + x))
    return rows.withColumn(cell, F.explode(near))


def _decided(frames: Iterator[pd.DataFrame], distance: float) -> Iterator[pd.DataFrame]:
    """The sequential rule on the points of one task, which are sorted by rank."""
    taken: np.ndarray | None = None
    for frame in frames:
        keep = []
        for i, x in enumerate(np.array(frame["x"].tolist(), dtype=np.float64).reshape(len(frame), -1)):
            if taken is None or not (np.sqrt(((taken - x) ** 2).sum(axis=1)) < distance).any():
                taken = x[None] if taken is None else np.concatenate([taken, x[None]])
                keep.append(i)
        yield frame.iloc[keep]


def distinct_ranked(
    rows: DataFrame, order: list[str], bounds: dict[str, tuple[float, float]], distance: float, most: int | None = None, finish: int = FINISH
) -> DataFrame:
    """The rows chosen from ``rows``, with ``place`` (from 1 in the order of choice): the first ``most`` of them, or all.

    Rows are taken in ascending ``order`` (losses, or numbers of runs; then the bounded columns decide) if their
    Euclidean distance to all taken so far, with every column of ``bounds`` scaled to 0 at its lower bound and
    1 at its upper one, is at least ``distance``. Rows with a null or non-finite value in ``bounds``, or with a
    null, NaN or infinite value in a numeric ``order`` column, are never taken. Of rows equal in all of these one is
    taken. A distance of zero or less takes every row.
    """
    spark = rows.sparkSession
    names = sorted(bounds)
    kinds = dict(rows.dtypes)
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf") if kinds[c] not in ("string", "date", "boolean") and not kinds[c].startswith("timestamp") else F.col(c).isNotNull()
    usable = F.lit(True)
    for c in [*names, *order]:
        usable &= finite(c)
    place = [(F.col(n).cast("double") - low) / (high - low) for n, (low, high) in ((n, bounds[n]) for n in names)]
    axes = min(AXES, len(names))
    cell = F.array(*[F.floor(p / (distance if distance > 0 else 1.0)) for p in place[:axes]])
    points = rows.where(usable).select(F.struct(*order, *names).alias("rank"), F.array(*place).alias("x"), cell.alias("cell"), F.struct(*rows.columns).alias("row"))
    if distance > 0:
        points = points.groupBy("rank", "x", "cell").agg(F.min("row").alias("row")) if not _has_map(rows) else points.dropDuplicates(["rank"])
    undecided = written(points, "ranked")
    taken = []
    left = undecided.count() if distance > 0 else 0
    if distance <= 0:
        taken.append(undecided)
    while left:
        if left <= finish:
            one = undecided.repartition(1).sortWithinPartitions("rank")
            taken.append(written(one.mapInPandas(lambda f: _decided(f, distance), undecided.schema), "distinct"))
            break
        # The best of each cell, one row for each task and cell before the shuffle, then the best around each cell.
        first = undecided.groupBy("cell").agg(F.min("rank").alias("rank"))
        around = _around(first, "cell", axes).groupBy("cell").agg(F.min("rank").alias("best"))
        leaders = first.join(around, "cell").where("rank = best").select("cell", "rank")
        share = F.pmod(F.xxhash64("rank"), F.lit(SHARES))
        spread = leaders.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        dealt = undecided.withColumn("share", share)
        now = written(dealt.join(spread, ["cell", "share", "rank"]).drop("share").select(*undecided.columns), "distinct")
        taken.append(now)
        # A cell has few leaders around it, as no two of them are neighbours.
        near = _around(now.select("cell", "x"), "cell", axes).groupBy("cell").agg(F.collect_list("x").alias("leaders"))
        near = near.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        close = F.exists("leaders", lambda y: _distance(F.col("x"), y, len(names)) < distance)
        rest = dealt.join(near, ["cell", "share"], "left").where(~F.coalesce(close, F.lit(False))).select(*undecided.columns)
        undecided = written(rest, "ranked")
        left = undecided.count()
        if most is not None and left:
            # What ranks before all undecided points is final.
            bound = undecided.agg(F.min("rank").alias("bound"))
            final = _together(taken).join(bound, F.col("rank") < F.col("bound"), "left_semi")
            if final.limit(most).count() >= most:
                break
    chosen = _together(taken) if taken else undecided
    return _placed(chosen, most).select("row.*", "place") if taken else spark.createDataFrame([], rows.schema).withColumn("place", F.lit(1).cast("long"))


def _has_map(rows: DataFrame) -> bool:
    return any("map<" in kind for _, kind in rows.dtypes)


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _placed(chosen: DataFrame, most: int | None) -> DataFrame:
    """With ``place`` by rank: of a stated number of rows directly, of all by ranges."""
    from .coordinates import numbered

    if most is not None:
        chosen = chosen.orderBy("rank").limit(most)
    return numbered(chosen, "rank", "place", 1)
