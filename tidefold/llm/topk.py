"""Exact top-k inner products by branch and bound on a ball tree in each shard.

Vectors are dealt to coarse cells and their shards, the stated queries to blocks of their
cell. A first round searches one shard of a block's own cell; its k-th scores go into a second round over
the most promising cells, and those of both into a third over all other cells whose centre and radius
allow a better score: only pairs that may matter are shuffled, and every search starts with a bound and
tightens it as it goes. A node whose upper bound (centre times query plus radius times query norm) is below
the k-th score of every query is dropped; leaves that are left are scored in the order of their bounds, more
and more of them in one product. Ties stay open, so results are exact. A shard moves once a round, however many
blocks ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import best_of, deal, unpacked, with_floors
from .runtime import materialise
from .vectors import NONE, at_least, best_hits, by_rank, first_of_each, gathered, is_query, norms, of_one_length, product_kind, usable

K = 5
SCALE = 256
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
LEAF = 256


class BallTree:
    """Rows split at the median of the widest axis down to ``LEAF`` rows; nodes have a centre and a radius."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.norms = norms(self.rows)
        self.most = int(np.abs(self.rows.astype(np.float64)).max(initial=0))
        nodes: list[list] = []
        self._grow(np.arange(len(ids)), self.rows.astype(np.float64), nodes)
        self.centres, self.radii = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.own, self.children = [n[2] for n in nodes], np.array([n[3] for n in nodes])
        self.cast: dict[type, np.ndarray] = {}

    def _grow(self, own: np.ndarray, whole: np.ndarray, nodes: list[list]) -> int:
        rows = whole[own]
        centre = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        at = len(nodes)
        nodes.append([centre, radius, own, (-1, -1)])
        if len(own) > LEAF and radius:
            axis = int(rows.var(axis=0).argmax())
            cut = own[np.argsort(rows[:, axis], kind="stable")]
            nodes[at][3] = tuple(self._grow(np.sort(half), whole, nodes) for half in (cut[: len(own) // 2], cut[len(own) // 2 :]))
        return at

    def _fits(self, queries: np.ndarray) -> bool:
        """Whether no partial sum of a product can leave 64 bits, with a margin for rounding."""
        reach = np.abs(queries.astype(np.float64)) @ np.abs(self.rows.astype(np.float64)).T
        return bool(reach.max(initial=0) < 2**62)

    def search(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Improve each query's best scores and ids, sorted by score then id; unused places hold ``LEAST``.

        Products are exact in the numbers they are made in; scores that may leave 64 bits are refused.
        """
        k = scores.shape[1]
        asked = queries.astype(np.float64)
        if int(np.abs(asked).max(initial=0)) * self.most * queries.shape[1] >= 2**63 - 1 and not self._fits(queries):
            raise ValueError("inner products beyond 64 bits")
        lengths = norms(queries)
        kind = product_kind(lengths, self.norms)
        if kind not in self.cast:
            self.cast[kind] = self.rows.astype(kind)
        exact, rows = queries.astype(kind), self.cast[kind]

        def bounds(nodes: np.ndarray) -> np.ndarray:
            top = asked @ self.centres[nodes].T + lengths[:, None] * self.radii[nodes]
            return top + 1e-9 * np.abs(top) + 1e-6

        leaves, nodes = [], np.zeros(1, dtype=int)
        while len(nodes):
            nodes = nodes[(bounds(nodes) >= scores[:, -1:]).any(axis=0)]
            inner = self.children[nodes, 0] >= 0
            leaves.append(nodes[~inner])
            nodes = self.children[nodes[inner]].ravel()
        left = np.concatenate(leaves)
        reach = bounds(left)
        left = left[by_reach := np.argsort(-reach.max(axis=0), kind="stable")]
        reach, many = reach[:, by_reach], 1
        while len(left):
            there = reach[:, :many] >= scores[:, -1:]
            active, batch = np.flatnonzero(there.any(axis=1)), left[:many][there.any(axis=0)]
            # The best leaf alone, then twice as many at a time: the bounds of those before apply.
            left, reach, many = left[many:], reach[:, many:], 2 * many
            if not len(active):
                continue
            own = np.sort(np.concatenate([self.own[leaf] for leaf in batch]))
            found = exact[active] @ rows[own].T
            row, new, who = best_hits(found, found >= at_least(scores[active, -1], kind)[:, None], self.ids[own], k)
            if len(row):
                # Every query has k places already, so it keeps k.
                row = np.concatenate([np.repeat(np.arange(len(active)), k), row])
                new, who = np.concatenate([scores[active].ravel(), new]), np.concatenate([ids[active].ravel(), who])
                order = by_rank(row, new, who)
                order = order[first_of_each(row[order], k)]
                scores[active], ids[active] = new[order].reshape(-1, k), who[order].reshape(-1, k)
        return scores, ids


def _search(frames: Iterator[pd.DataFrame], k: int, kind: str) -> Iterator[dict[str, np.ndarray]]:
    """Search each shard for the query blocks that follow it, starting from the scores carried so far."""
    shard, tree = None, None
    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.stored:
                shard, tree = row, None
                continue
            if tree is None:
                tree = BallTree(*unpacked(shard, ("ids", "c"), kind))
            queries, asked = unpacked(row, ("anchors", "a"), kind)
            # Places are filled with the k-th score carried so far: it prunes, and rows that tie with it still enter.
            scores, ids = np.repeat(np.asarray(row.floors)[:, None], k, axis=1), np.full((len(queries), k), NONE)
            scores, ids = tree.search(asked, scores, ids)
            which, place = np.nonzero((ids != NONE) & (ids != queries[:, None]))
            yield {"query_id": queries[which], "vec_id": ids[which, place], "score": scores[which, place]}


FOUND = "query_id bigint, vec_id bigint, score bigint"


def exact_top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the k highest integer inner products.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by 50,
    candidates all rows but the query's own vec_id; fewer than k candidates give fewer rows. Vectors
    that are null, empty, or hold null or non-finite components take no part, nor do rows without
    vec_id, nor vectors of another length than most have (of equally common lengths the shorter counts).
    A repeated vec_id is one candidate and one query: the first by its components. Scores are exact 64-bit
    integers; where a sum of products may leave them, an error says so. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    clean = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
    )
    clean = of_one_length(materialise(clean.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors"))
    total = clean.count()
    if not total or not clean.where(is_query()).head(1):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dealt = deal(clean, total, shard_rows, block_rows)
    kind = dealt.kind

    def run(work: DataFrame, name: str) -> DataFrame:
        # One more than k: the query itself may be among them.
        found = dealt.searched(work.select("cell", "chunk", "anchors", "a", "floors"), lambda frames: gathered(_search(frames, k + 1, kind)), FOUND)
        return materialise(best_of(found, ["query_id"], k).drop("rank"), name)

    found = dealt.in_rounds(dealt.blocks, lambda blocks, found, part: with_floors(blocks, found, "query_id", k, part), run, "floors", None, 1)
    return best_of(found, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
