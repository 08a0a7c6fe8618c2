"""Vectors dealt to coarse cells, cells to shards of bounded size, queries to blocks of their cell.

Rows of a shard and queries of a block lie close together, so the centre and radius of a cell bound the
scores of all its rows before any rows meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise, width
from .vectors import LEAST, is_query

#: Rows that the cells are fitted on, and their number, at most. Every row is dealt by it, whatever their number.
SAMPLE, CELLS = 8192, 256
#: Cells that a block searches before it looks at the bounds again.
NEAR = 4
#: Tasks of a search, at most, and the shards of one up to there.
TASKS, TASK_SHARDS = 2048, 4


@dataclass
class Cells:
    """Centres of a k-means fit; a row belongs to the nearest one, the first of equally near."""

    centres: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, most: int, rounds: int = 8, seed: int = 0) -> Cells:
        """At most ``most`` centres, spread by the distances of the rows from those before; as many as there are different rows suffice."""
        x, rng = rows.astype(np.float64), np.random.default_rng(seed)
        centres = [x[int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]]
        gap = ((x - centres[0]) ** 2).sum(axis=1)
        while len(centres) < most and gap.sum() > 0:
            centres.append(x[int(rng.choice(len(x), p=gap / gap.sum()))])
            gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(axis=1))
        out = cls(np.array(centres))
        for _ in range(rounds):
            own = out.of(x)
            for c in np.unique(own):
                out.centres[c] = x[own == c].mean(axis=0)
        return out

    def of(self, rows: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * rows.astype(np.float64) @ self.centres.T).argmin(axis=1)


def unpacked(row, names: tuple[str, str], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, of whole numbers of a ``kind``, of a packed row."""
    ids = np.asarray(getattr(row, names[0]))
    return ids, np.frombuffer(getattr(row, names[1]), kind).reshape(len(ids), -1)


@dataclass
class Dealt:
    """Shards (cell, chunk, ids, columns, c) and blocks (block, cell, anchors, a_columns, a), vectors as the bytes of numbers of a kind; radii about the cells' centres, minus infinity for an empty cell."""

    stored: DataFrame
    blocks: DataFrame
    numbers: Column
    centres: np.ndarray
    radius: np.ndarray
    kind: str
    tasks: int

    def meet(self, work: DataFrame) -> DataFrame:
        """``work`` (cell) with every chunk of the cell: a row for each pair of a block and a shard."""
        return work.withColumn("chunk", F.explode(F.sequence(F.lit(0), self.numbers[F.col("cell")] - 1)))

    def _seed(self) -> Column:
        return F.pmod(F.xxhash64("block"), self.numbers[F.col("cell")]).cast("int")

    def own(self, work: DataFrame) -> DataFrame:
        """``work`` (block, cell) with one chunk of the block's own cell."""
        return work.withColumn("chunk", self._seed())

    def others(self, work: DataFrame) -> DataFrame:
        """``work`` (block, home, cell, chunk) without the pairs of ``own``."""
        return work.where(~((F.col("cell") == F.col("home")) & (F.col("chunk") == self._seed())))

    def searched(self, work: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], found: str) -> DataFrame:
        """``work`` (pairs of a block and a shard) through ``run``, which gets a shard's row, then the blocks that meet it.

        A shard moves once and a block once a pair; rows that hold both are never made.
        """
        both = self.stored.withColumn("stored", F.lit(True)).unionByName(work.withColumn("stored", F.lit(False)), allowMissingColumns=True)
        both = both.repartition(max(self.tasks, width(work.sparkSession)), "cell", "chunk")
        return both.sortWithinPartitions("cell", "chunk", F.desc("stored")).mapInPandas(run, found)

    def in_rounds(self, blocks: DataFrame, ask: Callable[[DataFrame, DataFrame | None, str], DataFrame], run: Callable[[DataFrame, str], DataFrame], lows: str, highs: str | None, per: int) -> DataFrame:
        """All that ``run`` finds for pairs of a block and a shard: first one shard of a block's own cell, then the most promising
        cells, then all others. Before each, ``ask`` gives the blocks what they ask for by what is found so far; cells out of its
        reach are dropped."""
        found = run(self.own(ask(blocks, None, "seeds")), "seeds")
        blocks = blocks.withColumnRenamed("cell", "home")
        for part, cells in (("near", F.slice("cells", 1, NEAR)), ("far", F.array_except("cells", "searched"))):
            asking = self.reachable(ask(blocks, found, part), lows, highs, per)
            if part == "near":
                asking = materialise(asking.withColumn("searched", cells), "asking")
                blocks = blocks.join(asking.select("block", "searched"), "block")
            work = self.meet(asking.withColumn("cell", F.explode(cells)).drop("cells"))
            found = found.unionByName(run(self.others(work), part))
        return found

    def reachable(self, work: DataFrame, lows: str, highs: str | None, per: int) -> DataFrame:
        """``work`` (blocks with what they ask) with ``cells``: those whose centre and radius leave some anchor a score from its lows to its highs, the most promising first."""
        centres, radius, kind = self.centres, self.radius, self.kind

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                met = []
                for r in frame.itertuples(index=False):
                    ids, a = unpacked(r, ("anchors", "a"), kind)
                    a = a.astype(np.float64)
                    mid = a @ centres.T
                    slack = np.sqrt((a**2).sum(axis=1))[:, None] * radius * (1 + 1e-9) + 1e-6 * (1 + np.abs(mid))
                    lo = np.asarray(getattr(r, lows)).reshape(len(ids), per)
                    hi = np.asarray(getattr(r, highs)).reshape(len(ids), per) if highs else np.full(lo.shape, np.inf)
                    there = np.zeros(len(radius), dtype=bool)
                    for j in range(per):
                        there |= ((mid + slack >= lo[:, j, None]) & (mid - slack <= hi[:, j, None])).any(axis=0)
                    there = np.flatnonzero(there & (radius >= 0))
                    met.append(there[np.argsort(-mid[:, there].mean(axis=0), kind="stable")])
                yield frame.assign(cells=met)

        kinds = ", ".join(f"{n} {t}" for n, t in work.dtypes)
        return work.mapInPandas(run, f"{kinds}, cells array<int>")


def with_floors(blocks: DataFrame, found: DataFrame | None, key: str, k: int, name: str) -> DataFrame:
    """``blocks`` with ``floors``: the k-th score found so far for each of their anchors (``key``), ``LEAST`` without one."""
    if found is None:
        return blocks.withColumn("floors", F.transform("anchors", lambda q: F.lit(LEAST)))
    floor = best_of(found, [key], k).groupBy(key).agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    floors = members(blocks, key).join(floor, key, "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST)))
    return materialise(in_order(blocks, floors, ["at"], {"floors": "floor"}), f"floors-{name}")


def members(blocks: DataFrame, key: str) -> DataFrame:
    """(block, at, key): the anchors of ``blocks`` with their places."""
    return blocks.select("block", F.posexplode("anchors").alias("at", key))


def in_order(blocks: DataFrame, rows: DataFrame, order: list[str], columns: dict[str, str]) -> DataFrame:
    """``blocks`` with columns of the rows (block) of each (bounded) as arrays, in their order."""
    packed = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*order, *columns.values()))).alias("r"))
    return blocks.join(packed.select("block", *[F.col(f"r.{c}").alias(n) for n, c in columns.items()]), "block")


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows found for each key, with their rank from 1."""
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _packed(rows: DataFrame, groups: list[str], extra: tuple[str, ...], names: list[str], kind: str, name: str) -> DataFrame:
    """One row per group (bounded), its rows in the order of vec_id: ids, extra columns, and the vectors as bytes."""
    all_rows = rows.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("vec_id", *extra, "v"))).alias("r"))
    columns = [F.col(f"r.{c}").alias(n) for c, n in zip(("vec_id", *extra), names, strict=False)]
    flat = all_rows.select(*groups, *columns, F.flatten("r.v").alias(names[-1]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{names[-1]: [np.asarray(v).astype(kind).tobytes() for v in frame[names[-1]]]})

    kinds = ", ".join(f"{n} {'binary' if n == names[-1] else t}" for n, t in flat.dtypes)
    return materialise(flat.mapInPandas(run, kinds), name)


def _kind(clean: DataFrame) -> str:
    """The smallest kind of whole numbers that holds every component and its negative."""
    r = clean.agg(F.max(F.array_max("v")).alias("top"), F.min(F.array_min("v")).alias("low")).head()
    # The least number of a kind has no negative there.
    most = max(r["top"], -r["low"])
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"


def deal(clean: DataFrame, total: int, shard_rows: int, block_rows: int, extra: tuple[str, ...] = ()) -> Dealt:
    """Deal ``total`` rows (vec_id unique, v, extra columns), at least one, to shards, and those that are queries to blocks as well."""
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"].tolist()
    cells = Cells.fit(np.array(sample), min(CELLS, max(1, total // shard_rows)))
    centres, kind = cells.centres, _kind(clean)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(cells.of(np.stack(v.tolist()) if len(v) else np.empty((0, centres.shape[1]))).astype(np.int32))

    rows = materialise(clean.withColumn("cell", cell_of("v")), "cells")
    # At most CELLS rows.
    counts = {r.cell: (r.n, r.asked) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(is_query(), 1)).alias("asked")).collect()}

    def many(size: int, part: int) -> Column:
        return F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, max(1, -(-n[part] // size)))])

    def chunk(size: int, part: int) -> Column:
        """The chunk of a row: as many in a cell as keep them near ``size`` rows."""
        return F.pmod(F.xxhash64("vec_id"), many(size, part)[F.col("cell")]).cast("int")

    stored = _packed(rows.withColumn("chunk", chunk(shard_rows, 0)), ["cell", "chunk"], extra, ["ids", *extra, "c"], kind, "shards")
    asked = _packed(rows.where(is_query()).withColumn("part", chunk(block_rows, 1)), ["cell", "part"], extra, ["anchors", *[f"a_{c}" for c in extra], "a"], kind, "asked")
    block = (F.col("cell").cast("long") * (1 << 32) + F.col("part")).alias("block")

    def reach_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                _, c = unpacked(r, ("ids", "c"), kind)
                yield pd.DataFrame({"cell": [r.cell], "radius": [float(np.sqrt(((c - centres[r.cell]) ** 2).sum(axis=1).max()))]})

    radius = np.full(len(centres), -np.inf)
    for r in stored.select("cell", "ids", "c").mapInPandas(reach_of, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("r")).collect():
        radius[r.cell] = r.r * (1 + 1e-9) + 1e-6
    return Dealt(stored, asked.select(block, *[c for c in asked.columns if c != "part"]), many(shard_rows, 0), centres, radius, kind, min(TASKS, sum(-(-n // shard_rows) for n, _ in counts.values()) // TASK_SHARDS))
