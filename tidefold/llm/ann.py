"""Approximate nearest neighbours by cosine on a hierarchical k-means tree.

The tree is fitted on a bounded sample and every row is filed under a leaf. A query visits leaves
best bin first: a priority queue holds the branches passed by, nearest first. How many leaves are
visited is widened, by a quarter at a time, until the recall on a bounded set of calibration queries, against
brute force over all rows, reaches its target. A query whose leaves hold too few rows visits more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise
from .vectors import blocks, is_query, keep_best, of_one_length, usable

K = 5
#: Rows the tree is fitted on, at most.
SAMPLE = 20_000
#: Calibration queries, at most, and the recall they must reach.
CALIBRATION = 256
TARGET = 0.97
BRANCHES = 8
#: Sampled rows in a leaf, at least, and leaves, roughly: as many as give leaves of a chunk, but not fewer than this.
LEAF_SAMPLE = 40
LEAVES = 48
CHUNK_ROWS = 4096
NONE = np.iinfo(np.int64).max


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes: 32-bit if that holds them exactly."""
    for frame in frames:
        rows = [np.asarray(v, dtype=np.float64) for v in frame["v"]]
        with np.errstate(over="ignore"):
            short = [v.astype("<f4") for v in rows]
        yield frame.assign(v=[b"s" + s.tobytes() if (s == v).all() else b"d" + v.astype("<f8").tobytes() for v, s in zip(rows, short, strict=True)])


def unpacked(cells) -> np.ndarray:
    """Packed vectors as a matrix in double precision."""
    out = [np.frombuffer(c, dtype="<f4" if c[:1] == b"s" else "<f8", offset=1).astype(np.float64) for c in cells]
    return np.stack(out) if out else np.zeros((0, 1))


class KMeansTree:
    """Spherical k-means, split again and again until a node holds few sampled rows."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        stack = [(self._node(), sample)]
        while stack:
            at, rows = stack.pop()
            own = None
            if len(rows) > leaf:
                centres = rows[rng.choice(len(rows), size=min(branches, len(rows)), replace=False)]
                for _ in range(8):
                    own = (rows @ centres.T).argmax(axis=1)
                    sums = np.zeros_like(centres)
                    np.add.at(sums, own, rows)
                    norms = np.linalg.norm(sums, axis=1, keepdims=True)
                    centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
                own = (rows @ centres.T).argmax(axis=1)
            used = np.unique(own) if own is not None else []
            if len(used) < 2:
                self.leaf_of[at] = self.leaves
                self.leaves += 1
                continue
            self.centres[at] = centres[used]
            self.children[at] = [self._node() for _ in used]
            stack += [(child, rows[own == u]) for child, u in zip(self.children[at], used, strict=True)]

    def _node(self) -> int:
        self.centres.append(np.zeros((0, 0)))
        self.children.append([])
        self.leaf_of.append(-1)
        return len(self.leaf_of) - 1

    def file(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest branch."""
        out = np.zeros(len(rows), dtype=np.int32)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            at, own = stack.pop()
            if self.leaf_of[at] >= 0:
                out[own] = self.leaf_of[at]
                continue
            near = (rows[own] @ self.centres[at].T).argmax(axis=1)
            stack += [(child, own[near == i]) for i, child in enumerate(self.children[at]) if (near == i).any()]
        return out

    def visit(self, query: np.ndarray, leaves: int, held: dict[int, int] | None = None, rows: int = 0) -> list[int]:
        """The first leaves for a query, best bin first; with ``held``, rows by leaf, further ones until they hold ``rows``."""
        out: list[int] = []
        queue = [(0.0, 0)]
        while queue and (len(out) < leaves or (held is not None and sum(held.get(i, 0) for i in out) < rows)):
            _, at = heapq.heappop(queue)
            while self.leaf_of[at] < 0:
                near = self.centres[at] @ query
                best = int(near.argmax())
                for i, child in enumerate(self.children[at]):
                    if i != best:
                        heapq.heappush(queue, (-float(near[i]), child))
                at = self.children[at][best]
            out.append(self.leaf_of[at])
        return out


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near one: exact, and no square overflows or vanishes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safely for very large and very small components."""
    rows = _scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best rows, ties to smaller ids. Equal rows are compared once and stand for their smallest ids.

    A matrix product finds a few more than k; those are measured again one by one, in the same order of
    summation for every pair.
    """
    order = np.argsort(ids, kind="stable")
    rows, ids = np.ascontiguousarray(rows[order]), ids[order]
    _, first, group = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    within = np.argsort(group, kind="stable")
    start = np.searchsorted(group[within], np.arange(len(first)))
    nth = np.arange(len(ids)) - start[group[within]]
    names = np.full((len(first), k + 1), NONE)
    names[group[within][nth <= k], nth[nth <= k]] = ids[within][nth <= k]
    distinct, queries = _scaled(rows[first]), _scaled(queries)
    norms = np.sqrt(np.einsum("ij,ij->i", distinct, distinct))
    own = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    rough = queries @ (distinct / norms[:, None]).T
    many = min(k + 8, len(first))
    near = np.argpartition(-rough, many - 1, axis=1)[:, :many]

    def ranked(q: slice, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = np.einsum("qmd,qd->qm", distinct[near], queries[q]) / (own[q, None] * norms[near])
        found, scores = names[near].reshape(len(near), -1), np.repeat(exact, k + 1, axis=1)
        scores = np.where((found == NONE) | (found == query_ids[q, None]), -np.inf, scores)
        return keep_best(scores, found, np.zeros((len(near), 0)), np.zeros((len(near), 0), dtype=np.int64), k)

    scores, found = ranked(slice(None), near)
    # Where more rows than those are as near as the last of them, all of these are measured.
    last = np.take_along_axis(rough, near, axis=1).min(axis=1) + 1e-9 * own
    reach = np.partition(rough, -min(k + 1, len(first)), axis=1)[:, -min(k + 1, len(first))] - 1e-9 * own
    for q in np.flatnonzero(reach <= last) if many < len(first) else ():
        scores[q : q + 1], found[q : q + 1] = ranked(slice(q, q + 1), np.flatnonzero(rough[q] >= reach[q])[None])
    return scores, found


#: Result rows that a task holds before it reduces them to the best of each query.
HELD = 400_000


def _scan(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k best of the leaf chunks of a task, for the queries that visit them."""

    def best(held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)

    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        for row in frame.itertuples(index=False):
            rows, asked, names = unpacked(row.rows), unpacked(row.queries), np.asarray(row.query_ids)
            for s in range(0, len(names), 512):
                scores, ids = _best(asked[s : s + 512], names[s : s + 512], rows, np.asarray(row.ids), k)
                which, place = np.nonzero(scores > -np.inf)
                held.append(pd.DataFrame({"query_id": names[s : s + 512][which], "vec_id": ids[which, place], "score": scores[which, place]}))
                size += len(which)
            if size > HELD:
                held = [best(held)]
                if len(held[0]) > HELD // 2:
                    yield held.pop()
                size = sum(map(len, held))
    if held:
        yield best(held)


def _calibrate(clean: DataFrame, tree, filed, k: int) -> int:
    """The number of leaves, widened until the calibration queries' recall reaches the target.

    ``CALIBRATION`` queries at most are compared with every row, in each task over the rows it has.
    """
    spark = clean.sparkSession
    probes = clean.where(is_query()).orderBy(F.xxhash64("vec_id")).limit(CALIBRATION).toPandas()
    asked, names = unpacked(probes["v"]), probes["vec_id"].to_numpy()
    shared = spark.sparkContext.broadcast((asked, names))

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, own = shared.value
        scores, ids, leaves = np.full((len(own), k), -np.inf), np.full((len(own), k), NONE), {}
        for frame in frames:
            for s in range(0, len(frame), 2048):
                part = frame.iloc[s : s + 2048]
                leaves.update(zip(part["vec_id"], part["leaf"], strict=True))
                new = _best(queries, own, unpacked(part["v"]), part["vec_id"].to_numpy(), k)
                scores, ids = keep_best(scores, ids, *new, k)
                leaves = {i: leaves[i] for i in np.unique(ids[ids != NONE])}
        which, place = np.nonzero(ids != NONE)
        found = ids[which, place]
        yield pd.DataFrame({"query_id": own[which], "vec_id": found, "score": scores[which, place], "leaf": [leaves[i] for i in found]})

    near = filed.mapInPandas(exact, "query_id bigint, vec_id bigint, score double, leaf int")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    truth = ranked.where(F.col("r") <= k).select("query_id", "leaf").toPandas()
    units = dict(zip(names.tolist(), _unit(asked), strict=True))
    order = {q: {leaf: i for i, leaf in enumerate(tree.visit(u, tree.leaves))} for q, u in units.items()}
    place = np.array([order[q][leaf] for q, leaf in truth.itertuples(index=False)])
    visits = 1
    while visits < tree.leaves and len(place) and (place < visits).mean() < TARGET:
        visits += max(1, visits // 4)
    return min(visits, tree.leaves)


def nearest(vectors: DataFrame, k: int = K, chunk_rows: int = CHUNK_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: each query's k nearest found, by cosine.

    Queries are the rows whose vec_id is divisible by 50, candidates all rows but the query's own
    vec_id. Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do rows without vec_id. Ties go to the smaller vec_id. A repeated vec_id counts once: its
    first vector by components. Vectors of another length than most have take no part (of equally common
    lengths the shorter counts). Components of any finite size count. Leaves that hold many rows (one
    vector may be very common) are cut into chunks by a hash of vec_id, as are the queries that visit
    them, and each pair of a chunk and a share of queries is work of its own. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = vectors.sparkSession
    clean = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    clean = of_one_length(clean.where(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v")))
    clean = materialise(clean.mapInPandas(_packed, "vec_id bigint, v binary"), "vectors")
    if clean.where(is_query()).isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total = clean.count()
    # A hash keeps the sample the same at every run; a limit bounds it.
    part = clean.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < int(min(1.0, 2 * sample / total) * (1 << 20)))
    fitted = unpacked(part.orderBy(F.xxhash64("vec_id")).limit(sample).toPandas()["v"])
    fitted = _unit(np.unique(fitted, axis=0)) if len(fitted) else np.zeros((0, 1))
    tree = KMeansTree(fitted, leaf=max(LEAF_SAMPLE, len(fitted) // max(LEAVES, total // chunk_rows)))
    shared = spark.sparkContext.broadcast(tree)

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            leaf = shared.value.file(_unit(unpacked(frame["v"]))) if len(frame) else []
            yield frame.assign(leaf=leaf)

    filed = materialise(clean.mapInPandas(file, "vec_id bigint, v binary, leaf int"), "filed")
    visits = _calibrate(clean, tree, filed, k)
    # One table row a leaf. A query's own row is in a leaf too, so k + 1 rows hold k others.
    held = {r.leaf: r["count"] for r in filed.groupBy("leaf").count().collect()}

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                leaves = [shared.value.visit(u, visits, held, k + 1) for u in _unit(unpacked(frame["v"]))]
                yield frame.assign(leaf=leaves).explode("leaf").astype({"leaf": "int32"})

    # Rows of the size table are bounded by the leaves of the tree, hence by the sample.
    sizes = filed.groupBy("leaf").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    sizes = F.broadcast(materialise(sizes, "sizes"))
    deal = F.xxhash64("vec_id")
    members = blocks(filed.join(sizes, "leaf").withColumn("chunk", F.pmod(deal, F.col("chunks")).cast("int")), ["leaf", "chunk"], "members")
    visited = clean.where(is_query()).mapInPandas(spread, "vec_id bigint, v binary, leaf int")
    visited = materialise(visited, "visits")
    crowd = F.broadcast(materialise(visited.groupBy("leaf").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("shares")), "crowds"))
    asked = blocks(visited.join(crowd, "leaf").withColumn("share", F.pmod(deal, F.col("shares")).cast("int")), ["leaf", "share"], "asked")
    asked = asked.join(sizes, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("vec_id").alias("query_ids"), F.col("v").alias("queries")
    )
    work = members.select("leaf", "chunk", F.col("vec_id").alias("ids"), F.col("v").alias("rows")).join(asked, ["leaf", "chunk"])
    near = work.select("query_ids", "queries", "ids", "rows").mapInPandas(lambda f: _scan(f, k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
