"""Coordinates of all inputs: one dense index over the values of several sources, and where sources disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .sweep import FAN, RANGE_ROWS


def offsets(counts: DataFrame, many: int) -> DataFrame:
    """(part, before): the sum of ``n`` over smaller parts, by groups of ``FAN`` parts and then groups of groups."""
    counts = counts.withColumn("group", F.floor(F.col("part") / FAN))
    past = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0)))
    if many > FAN:
        groups = offsets(counts.groupBy(F.col("group").alias("part")).agg(F.sum("n").alias("n")), -(-many // FAN))
        counts = counts.join(groups.select(F.col("part").alias("group"), F.col("before").alias("far")), "group").withColumn("before", F.col("before") + F.col("far"))
    return counts.select("part", "before")


def numbered(rows: DataFrame, order: str, name: str, first: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``name``: their number in ascending ``order`` (equal values in any order), from ``first`` without gaps.

    Rows are sorted into ranges and numbered inside them; the ranges' counts are added up, so no task sees
    more than a range.
    """
    columns = rows.columns
    stored = written(rows.select(F.struct(*columns).alias("row"), F.col(order).alias("order")), "unnumbered")
    many = max(1, -(-stored.count() // range_rows))
    ranges = written(stored.repartitionByRange(many, "order").withColumn("part", F.spark_partition_id()), "numbered")
    own = F.row_number().over(Window.partitionBy("part").orderBy("order"))
    before = offsets(ranges.groupBy("part").agg(F.count("*").alias("n")), many)
    got = ranges.withColumn("own", own).join(before, "part")
    return got.select(*[F.col("row").getField(c).alias(c) for c in columns], (F.col("before") + F.col("own") + (first - 1)).cast("long").alias(name))


def coordinates(sources: dict[str, tuple[DataFrame, str]], range_rows: int = RANGE_ROWS) -> DataFrame:
    """(value, idx, sources): every value that a column of some source has, with its place in ascending order and the sources that have it.

    ``sources`` names (table, column) pairs; their columns take a common type. Null and NaN are no coordinates.
    A source without some value disagrees with the others, see ``disagreements``.
    """
    both = None
    for name, (table, column) in sources.items():
        one = table.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
        one = one.groupBy("value").agg(F.lit(name).alias("source"))
        both = one if both is None else both.unionByName(one)
    if dict(both.dtypes)["value"] in ("double", "float"):
        both = both.where(~F.isnan("value"))
    values = both.groupBy("value").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    return numbered(values, "value", "idx", 0, range_rows).select("value", "idx", "sources")


def disagreements(found: DataFrame, names: list[str]) -> DataFrame:
    """For each source (source, n_missing, first_missing, last_missing): how many of all coordinates it lacks, and which first and last; null if none."""
    lacks = found.select("value", F.explode(F.array_except(F.array(*[F.lit(n) for n in names]), "sources")).alias("source"))
    lacks = lacks.groupBy("source").agg(F.count("*").alias("n_missing"), F.min("value").alias("first_missing"), F.max("value").alias("last_missing"))
    every = found.sparkSession.createDataFrame([(n,) for n in names], "source string")
    return every.join(lacks, "source", "left").na.fill(0, ["n_missing"])
