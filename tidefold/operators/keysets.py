"""Whether sources have the same keys: digests of key sets in one pass, and the keys in question only where digests differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (dimension, source, table, column)
Source = tuple[str, str, DataFrame, str]


def _keys(sources: list[Source]) -> DataFrame:
    """The distinct (dim, source, key) of all sources, keys as text; null is a key too."""
    out = None
    for dim, source, table, column in sources:
        one = table.select(F.lit(dim).alias("dim"), F.lit(source).alias("source"), F.col(column).cast("string").alias("key")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def key_digests(sources: list[Source]) -> DataFrame:
    """(dim, source, n, total, mix): number of distinct keys, the sum of one hash of theirs and the exclusive or of another.

    Digests do not depend on order and can be added up over parts of a table without common keys. Equal
    sets have equal digests; different ones agree by chance once in 2^128 cases.
    """
    return _keys(sources).groupBy("dim", "source").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit("mix"), "key")).alias("mix")
    )


def alignment(sources: list[Source]) -> DataFrame:
    """(dim, aligned, size): whether all sources of a dimension have the same keys, and the most that one has. A source without rows has none."""
    want = sources[0][2].sparkSession.createDataFrame([(d, s) for d, s, _, _ in sources], "dim string, source string")
    all_rows = want.join(key_digests(sources), ["dim", "source"], "left").na.fill(0, ["n"])
    same = F.count_distinct(F.struct("n", F.coalesce("total", F.lit(0).cast("decimal(38,0)")).alias("total"), F.coalesce("mix", F.lit(0)).alias("mix"))) == 1
    return all_rows.groupBy("dim").agg(same.alias("aligned"), F.max("n").alias("size"))


def conflicts(sources: list[Source]) -> DataFrame:
    """(dim, source, key): the keys that a source lacks and another of its dimension has, for the dimensions whose digests differ."""
    # One row for each dimension.
    apart = {r.dim for r in alignment(sources).where("not aligned").collect()}
    named: dict[str, list[str]] = {}
    for dim, source, _, _ in sources:
        named.setdefault(dim, []).append(source)
    asked = [s for s in sources if s[0] in apart]
    if not asked:
        return sources[0][2].sparkSession.createDataFrame([], "dim string, source string, key string")
    held = _keys(asked).groupBy("dim", "key").agg(F.collect_set("source").alias("held"))
    wanted = F.create_map(*[x for d in sorted(apart) for x in (F.lit(d), F.array(*[F.lit(s) for s in named[d]]))])
    return held.select("dim", F.explode(F.array_except(wanted[F.col("dim")], "held")).alias("source"), "key")
