"""Alignment of series in time, and of points with coordinates."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import VALUE
from ..functions.random_streams import uniform
from . import sweep

METHODS = ("constant", "nearest", "linear", "ffill")


def _with_keys(source: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``targets`` with all of ``keys``: those that it lacks take every combination that ``source`` has with its others."""
    if all(k in targets.columns for k in keys):
        return targets
    there = source.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    lacking = [k for k in keys if k not in targets.columns]
    same = [targets[k].eqNullSafe(there[f"_{k}"]) for k in keys if k not in lacking]
    rows = targets.join(there, same) if same else targets.crossJoin(there)
    return rows.select(*targets.columns, *[F.col(f"_{k}").alias(k) for k in lacking])


def as_of(source: DataFrame, targets: DataFrame, method: str, keys: list[str] | None = None, time: str = "T", value: str = VALUE, range_rows: int = sweep.RANGE_ROWS) -> DataFrame:
    """Values of ``source`` (keys, time, value) at the times of ``targets`` (time, and perhaps keys and others).

    ffill takes the last value not later (null before the first), nearest the closest (ties: the later;
    beyond the ends: the end), linear interpolates, and extrapolates from the two values at an end; a
    series of one value is constant. Of values at one time the largest counts as the last, the smallest as the
    first. Source rows without time or value are none. Every target row comes back: with null where its
    time is null or its key has no source. Null keys are a key of their own. The other columns of
    ``targets`` are kept; those of ``source`` are not. ``range_rows`` sets how many rows are swept together,
    not what comes out.
    """
    if method not in ("nearest", "linear", "ffill"):
        raise ValueError(f"unknown method {method!r}")
    keys = list(keys or [])
    targets = _with_keys(source, targets, keys)
    carried = [c for c in targets.columns if c not in keys and c != time]
    kinds = dict(source.dtypes)
    place = F.unix_micros(F.col(time).cast("timestamp")).alias("at")
    key = sweep.key_of([F.col(k).cast(kinds[k]).alias(f"k{i}") for i, k in enumerate(keys)]).alias("k")
    s = source.select(key, place, F.col(value).cast("double").alias("v"))
    t = targets.select(F.struct(*targets.columns).alias("row"), key, place)
    found = sweep.bracketed(s, t.select("k", "at"), range_rows)
    lo, hi = F.col("lo"), F.col("hi")
    if method == "ffill":
        got: Column = lo["a"]["v"]
    elif method == "nearest":
        left, right = F.col("at") - lo["a"]["at"], hi["a"]["at"] - F.col("at")
        got = F.when(lo.isNull(), hi["a"]["v"]).when(hi.isNull() | (left < right), lo["a"]["v"]).otherwise(hi["a"]["v"])
    else:
        a = F.when(lo.isNull(), hi["a"]).when(hi.isNull(), lo["b"]).otherwise(lo["a"])
        b = F.when(lo.isNull(), hi["b"]).when(hi.isNull(), lo["a"]).otherwise(hi["a"])
        found = found.withColumns({"p": a, "q": b})
        p, q = F.col("p"), F.col("q")
        share = (F.col("at") - p["at"]).cast("double") / F.nullif((q["at"] - p["at"]).cast("double"), F.lit(0.0))
        got = F.when(p.isNull() | q.isNull(), F.coalesce(p["v"], q["v"])).when(p["at"] == q["at"], p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * share)
    rows = t.join(found.select("k", "at", got.alias("got")), ["k", "at"], "left")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in (*keys, time, *carried)], F.col("got").alias(value))


#: Coordinates that are searched in every task; more are swept together with the points.
SEARCHED = 8192


def _number(column: Column, kind: str) -> Column:
    """A place on the axis: times as microseconds, numbers as doubles; NaN counts as missing, negative zero as zero."""
    x = F.unix_micros(column.cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else column.cast("double")
    return F.when(~F.isnan(x), x + F.lit(0.0))


def _searched(rows: DataFrame, coords: list[tuple[float, int]]) -> DataFrame:
    """``rows`` (x) with lo and hi by binary search: (x, idx) of the coordinates at or next to x."""
    if not coords:
        nothing = F.lit(None).cast("struct<x: double, idx: int>")
        return rows.withColumns({"lo": nothing, "hi": nothing})
    ends = [(None, None), *coords, (None, None)]
    cells = [(float(i), *ends[i], *ends[i + 1]) for i in range(len(ends) - 1)]
    table = rows.sparkSession.createDataFrame(cells, "cell double, lx double, li int, hx double, hi int")
    table = table.select("cell", *[F.when(F.col(i).isNotNull(), F.struct(F.col(x).alias("x"), F.col(i).alias("idx"))).alias(n) for n, x, i in (("lo", "lx", "li"), ("hi", "hx", "hi"))])
    split = Bucketizer(splits=[float("-inf"), *[x for x, _ in coords], float("inf")], inputCol="place", outputCol="cell")
    dealt = split.transform(rows.withColumn("place", F.coalesce("x", F.lit(0.0))))
    # At most SEARCHED + 1 cells.
    return dealt.join(F.broadcast(table), "cell", "left").drop("cell", "place")


def _swept(rows: DataFrame, coords: DataFrame, range_rows: int) -> DataFrame:
    """The same by sorting points and coordinates together."""
    k = sweep.key_of([]).alias("k")
    found = sweep.bracketed(coords.select(k, F.col("x").alias("at"), F.col("idx").alias("v")), rows.select(k, F.col("x").alias("at")), range_rows)
    pair = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["a"]["at"].alias("x"), F.col(c)["a"]["v"].cast("int").alias("idx"))).alias(c)
    return rows.join(found.select(F.col("at").alias("x"), pair("lo"), pair("hi")), "x", "left")


def nearest_index(
    points: DataFrame, coords: DataFrame, column: str, tolerance: float | None = None, method: str = "nearest", searched: int = SEARCHED, range_rows: int = sweep.RANGE_ROWS
) -> DataFrame:
    """``points`` with <column>_idx: the index of the coordinate that belongs to ``column``.

    ``coords`` is (idx, value), value a number or a time, compared as doubles; a value that repeats counts once, with its
    smallest idx, and one that is null or not finite is none. ``nearest`` takes the closest coordinate
    (ties: the larger), ``ffill`` the last not larger, ``bfill`` the first not smaller, ``exact`` an equal
    one. A point further than ``tolerance`` (microseconds for times), without such a coordinate, null or NaN gets null;
    ``require_found`` turns nulls into an error. Every row comes back with its columns. Up to ``searched``
    coordinates are searched in every task, more are swept together with the points, with the same result.
    """
    if method not in ("nearest", "ffill", "bfill", "exact"):
        raise ValueError(f"unknown method {method!r}")
    kinds = dict(points.dtypes)
    rows = points.select(F.struct(*points.columns).alias("point"), _number(F.col(column), kinds[column]).alias("x"))
    places = coords.select(_number(F.col("value"), dict(coords.dtypes)["value"]).alias("x"), F.col("idx").cast("int").alias("idx"))
    places = places.where((F.abs("x") < float("inf")) & F.col("idx").isNotNull()).groupBy("x").agg(F.min("idx").alias("idx"))
    few = places.limit(searched + 1).collect()
    both = _searched(rows, sorted((r.x, r.idx) for r in few)) if len(few) <= searched else _swept(rows, places, range_rows)
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    left, right = x - lo["x"], hi["x"] - x
    chosen = {
        # Both gaps are endless for an infinite point: the end it has is its coordinate.
        "nearest": F.when(hi.isNull() | (lo.isNotNull() & (left < right)), lo).otherwise(hi),
        "ffill": lo,
        "bfill": F.when(left == 0, lo).otherwise(hi),
        "exact": F.when(left == 0, lo),
    }[method]
    got = chosen["idx"]
    if tolerance is not None:
        got = F.when(F.abs(x - chosen["x"]) <= tolerance, got)
    return both.select("point.*", F.when(x.isNotNull(), got).alias(f"{column}_idx"))


def require_found(points: DataFrame, column: str) -> DataFrame:
    """Raise KeyError if a point found no coordinate."""
    if not points.where(F.col(f"{column}_idx").isNull()).isEmpty():
        raise KeyError(f"some values of {column} are not among the coordinates")
    return points


def coords_to_indices(points: DataFrame, coords: dict[str, DataFrame], dims: list[str], tolerance: float | None = None, method: str = "nearest") -> DataFrame:
    """Resolve several coordinate columns; an unknown dimension is an error that lists those there are."""
    for d in dims:
        if d not in coords:
            raise ValueError(f"no coordinate {d!r}; there are {', '.join(sorted(coords))}")
        points = nearest_index(points, coords[d], d, tolerance, method)
        if tolerance is not None or method == "exact":
            points = require_found(points, d)
    return points


def extract_observations(outputs: DataFrame, observations: DataFrame, coords: dict[str, DataFrame], target: str, variable: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Each observation row with ``pred``, the output variable at its nearest coordinates, joined by name.

    Every column of ``observations`` but ``target`` and those ``carried`` along is a coordinate; gridded
    observations are rows too. A dimension with ``coords`` is found by the nearest coordinate and joined with the index
    column of ``outputs`` (t_idx for T, else its own name); one without is a label, joined by equality. A
    row whose coordinates are null or not among the outputs has a null pred. ``outputs`` has one row for
    each of its keys; of several the largest value counts.
    """
    if target not in observations.columns:
        raise ValueError(f"observations have no column {target!r}")
    dims = [c for c in observations.columns if c != target and c not in carried]
    keys = {d: "t_idx" if d == "T" and d in coords else d for d in dims}
    if unknown := [d for d in dims if keys[d] not in outputs.columns]:
        raise ValueError(f"no coordinate {', '.join(unknown)}; there are {', '.join(sorted(coords))}")
    found = coords_to_indices(observations, coords, [d for d in dims if d in coords])
    hits = outputs.groupBy(*[F.col(keys[d]).alias(f"_{d}") for d in dims]).agg(F.max(variable).alias("pred"))
    same = [F.col(f"{d}_idx" if d in coords else d) == F.col(f"_{d}") for d in dims]
    return found.join(hits, same, "left").select(*dims, *carried, target, "pred")


def completeness(source: DataFrame, targets: DataFrame, keys: list[str], time: str = "T") -> DataFrame:
    """How complete a series is: for each of ``keys``, the times of ``targets`` without a row (n_missing) and rows beyond the first at a time (n_repeated).

    Keys are those that occur in ``source``, null too; times that are no target are not counted as missing, but count as
    repeated. Rows without a time have the time null, which no target is. Repeated targets are one; without targets nothing
    is missing. An empty source gives no rows; other columns are ignored.
    """
    steps = targets.select(time).where(F.col(time).isNotNull()).distinct()
    at = source.groupBy(*keys, time).agg(F.count("*").alias("n"))
    there = at.join(steps, time, "left_semi").groupBy(*keys).agg(F.count("*").alias("there"))
    repeated = at.groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("n_repeated"))
    missing = (F.lit(steps.count()) - F.coalesce("there", F.lit(0))).cast("long")
    return repeated.join(there.select(*[F.col(k).alias(f"_{k}") for k in keys], "there"), [repeated[k].eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(*keys, missing.alias("n_missing"), "n_repeated")


def sample_observations(rows: DataFrame, key: str, value: str, share: float, noise: float, seed: int = 0) -> DataFrame:
    """A sparse, noisy sample of ``rows``: about ``share`` of them, each value moved by up to ``noise`` of itself, evenly.

    Which rows and how far are two independent draws of the random stream (``functions.random_streams``)
    that belong to the row's ``key``, so a repeated run gives the same sample on any cluster. Rows with
    equal keys are chosen and moved alike; a null key is a key like others, a null value stays null. Other
    columns are kept.
    """
    picked = rows.where(uniform(seed, "observed", F.col(key)) < share)
    return picked.withColumn(value, F.col(value) * (1 + noise * (2 * uniform(seed, "noise", F.col(key)) - 1)))
