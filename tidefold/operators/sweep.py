"""The sources before and after each point of sorted series, in time linear in the rows, however long one series is.

Points are sorted by key and place into ranges of about equally many rows; running windows look inside a
range, and the first and last sources of the ranges are carried on over groups of ``FAN`` ranges, then
over groups of those groups, so no window sees more than one range or ``FAN`` rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written

#: Rows of a range; ranges that are carried on together.
RANGE_ROWS, FAN = 250_000, 1024


def key_of(columns: list[Column]) -> Column:
    """Key columns as one column that is never null; null keys equal null keys."""
    return F.struct(*columns, F.lit(0).alias("any"))


def points(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(k, at, low, high, source, target), one row per k and at, of sources (k, at, v) and targets (k, at) that have a place.

    Rows are brought together in every task before the shuffle, so a place that many share is few rows there.
    """
    s = sources.where("at is not null and v is not null").select("k", "at", F.col("v").cast("double").alias("v"), F.lit(False).alias("asked"))
    t = targets.where("at is not null").select("k", "at", F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked"))
    both = s.unionByName(t).groupBy("k", "at")
    return both.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"), F.max("asked").alias("target")).withColumn("source", F.col("n") > 0).drop("n")


def _pair(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def _completed(own: Column, outer: Column) -> Column:
    """A pair of neighbours found inside, completed by the pair that lies outside."""
    return F.when(own.isNull(), outer).otherwise(_pair(own["a"], F.coalesce(own["b"], outer["a"])))


def _carried(ends: DataFrame, many: int) -> DataFrame:
    """(part, k, down, up) with below and above: the last two sources in earlier parts, the first two in later ones.

    ``down`` is the pair of the last source of a part and the one before it, ``up`` that of the first and the
    one after it; null without sources.
    """
    ends = ends.withColumn("group", F.floor(F.col("part") / FAN))
    for pair, order in (("down", F.col("part")), ("up", F.col("part").desc())):
        past = Window.partitionBy("k", "group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        outer = F.last(F.col(pair)["a"], ignorenulls=True).over(past)
        ends = ends.withColumn(pair, _pair(F.col(pair)["a"], F.coalesce(F.col(pair)["b"], outer)))
        ends = ends.withColumn("below" if pair == "down" else "above", F.last(pair, ignorenulls=True).over(past))
    if many > FAN:
        groups = ends.groupBy(F.col("group").alias("part"), "k").agg(F.max("down").alias("down"), F.min("up").alias("up"))
        far = _carried(groups, -(-many // FAN)).select(F.col("part").alias("group"), "k", F.col("below").alias("far_below"), F.col("above").alias("far_above"))
        ends = ends.join(far, ["group", "k"])
        ends = ends.withColumns({"below": _completed(F.col("below"), F.col("far_below")), "above": _completed(F.col("above"), F.col("far_above"))})
    return ends.select("part", "k", "below", "above")


def bracketed(sources: DataFrame, targets: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(k, at, lo, hi) for each distinct k and at of ``targets`` (k, at): the sources (k, at, v) at or next to it.

    lo is the pair (a, b) of the last source not later and the one before that, hi of the first not earlier
    and the one after that; a source is (at, v). Of values at one place lo has the largest, hi the
    smallest. Sources without place or value are none; targets without place are not returned.
    """
    rows = written(points(sources, targets), "points")
    parts = max(1, -(-rows.count() // range_rows))
    if parts > 1:
        # Ranges are numbered in a written table: a range keeps its number however often it is read.
        rows = written(rows.repartitionByRange(parts, "k", "at").withColumn("part", F.spark_partition_id()), "ranges")
    else:
        rows = rows.withColumn("part", F.lit(0))
    part = Window.partitionBy("part", "k")
    for pair, one, value, order in (("lo", "last", "high", F.col("at")), ("hi", "first", "low", F.col("at").desc())):
        way = part.orderBy(order)
        rows = rows.withColumn(one, F.when(F.col("source"), F.struct("at", F.col(value).alias("v"))))
        rows = rows.withColumn(f"{pair}_next", F.last(one, ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn(pair, F.last(_pair(F.col(one), F.col(f"{pair}_next")), ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select("part", "k", "at", "source", "target", "lo", "hi")
    if parts > 1:
        # Swept once and written; the ends of a range are its outermost sources, with their neighbours inside.
        rows = written(rows, "swept")
        own = lambda c: F.when(F.col("source"), F.col(c))
        ends = rows.groupBy("part", "k").agg(F.max(own("lo")).alias("down"), F.min(own("hi")).alias("up"))
        rows = rows.where("target").join(_carried(ends, parts), ["part", "k"])
        rows = rows.withColumns({"lo": _completed(F.col("lo"), F.col("below")), "hi": _completed(F.col("hi"), F.col("above"))})
    return rows.where("target").select("k", "at", "lo", "hi")
