"""Hard negatives by anchor spanning-tree bounds.

Rows are dealt to coarse cells, cells to shards of bounded size, anchors to blocks of their
cell. The anchors of a block form a minimum spanning tree, which falls into branches of anchors near
their head. For a candidate c, the score of an anchor is its head's score plus or minus (distance times norm
of c), so a head's scores bound those of its branch; only candidates whose bounds overlap what is asked for
(the fifth best score of the label so far, then the windows of the positives, from the third best found in them
so far) are scored themselves. Blocks meet one shard of their own cell first, then the most promising cells,
then all others whose centre and radius leave a score asked for; a shard moves once a round. Bounds never
decide a result: all results are exact integer products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import best_of, deal, in_order, members, unpacked, with_floors
from .runtime import materialise
from .vectors import LEAST, NONE, at_least, at_most, best_hits, first_of_each, gathered, is_query, kept_hits, norms, of_one_length, product_kind, ranked_hits, usable

SCALE, LABELS, MOVED = 256, 10, 7
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of its positive's.
LOW, HIGH = 50, 95
SHARD_ROWS, BLOCK_ROWS = 4096, 512
#: Anchors of a branch are this near its head, as a share of its norm; farther ones would bound too little.
BRANCH = 1 / 4


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent (-1 for the root, the point nearest the mean), edge length and depth of every point in a minimum spanning tree."""
    x = points.astype(np.float64)
    n = len(x)
    root = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    parent, edge, depth = np.full(n, -1), np.zeros(n), np.zeros(n, dtype=int)
    source, gap = np.full(n, root), ((x - x[root]) ** 2).sum(axis=1)
    gap[root] = np.inf
    out = np.ones(n, dtype=bool)
    out[root] = False
    for _ in range(n - 1):
        new = int(np.where(out, gap, np.inf).argmin())
        out[new] = False
        parent[new], edge[new], depth[new] = source[new], np.sqrt(gap[new]), depth[source[new]] + 1
        closer = ((x - x[new]) ** 2).sum(axis=1)
        nearer = out & (closer < gap)
        source[nearer], gap[nearer] = new, closer[nearer]
    return parent, edge, depth


def branches(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Head and distance to it of every point: from the root on, a point joins its parent's branch if near its head, or heads a branch."""
    x = points.astype(np.float64)
    parent, _, depth = tree
    head, away = np.arange(len(x)), np.zeros(len(x))
    for at in np.argsort(depth, kind="stable")[1:]:
        other = head[parent[at]]
        gap = np.sqrt(((x[at] - x[other]) ** 2).sum())
        if gap <= BRANCH * np.sqrt((x[other] ** 2).sum()):
            head[at], away[at] = other, gap
    return head, away


class Rows:
    """Candidates, ready for products: ids (ascending), labels and vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray | None = None, label: np.ndarray | None = None):
        self.rows, self.ids, self.label = rows, ids, label
        self.norms, self.most = norms(rows), int(np.abs(rows.astype(np.float64)).max(initial=0))
        self.cast: dict[type, np.ndarray] = {}

    def kind(self, anchors: np.ndarray) -> type:
        """Numbers that make products with ``anchors`` exact; those that could leave 64 bits, times 100, are refused."""
        if int(np.abs(anchors.astype(np.float64)).max(initial=0)) * self.most * anchors.shape[-1] * 100 >= 2**63:
            raise ValueError("inner products beyond 64 bits")
        return product_kind(norms(anchors), self.norms)

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.cast:
            self.cast[kind] = self.rows.astype(kind)
        return self.cast[kind]


Wanted = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def by_branches(anchors: np.ndarray, heads: tuple[np.ndarray, np.ndarray], rows: Rows, wanted: Wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All heads, then by branch: (anchors there, their scores, which scores are known and wanted).

    ``wanted(anchors, low, high)`` says which candidates' bounds overlap what an anchor asks for; the bounds of a branch
    are one row for all its anchors. In a branch only those candidates are scored, other scores read as 0.
    """
    head, away = heads
    kind = rows.kind(anchors)
    a, c = anchors.astype(kind), rows.of(kind)
    here = np.flatnonzero(head == np.arange(len(head)))
    exact = a[here] @ c.T
    yield here, exact, wanted(here, exact, exact)
    for place in np.flatnonzero(np.bincount(head, minlength=len(head))[here] > 1):
        mine = np.flatnonzero((head == here[place]) & (head != np.arange(len(head))))
        middle, reach = exact[place].astype(np.float64), away[mine].max() * rows.norms * (1 + 1e-9) + 1e-6
        hit = wanted(mine, (middle - reach)[None, :], (middle + reach)[None, :])
        own = np.flatnonzero(hit.any(axis=0))
        scores = np.zeros(hit.shape, dtype=kind)
        scores[:, own] = a[mine] @ c[own].T
        yield mine, scores, hit & wanted(mine, np.where(hit, scores, middle - reach), np.where(hit, scores, middle + reach))


def bounded(anchors: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, wanted: Wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``by_branches`` of a spanning tree."""
    return by_branches(anchors, branches(anchors, tree), Rows(rows), wanted)


def _pairs(frames: Iterator[pd.DataFrame], kind: str) -> Iterator[tuple]:
    """Each block with the shard it meets: (row, anchors, vectors, heads, shard)."""
    shard, rows = None, None
    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.stored:
                shard, rows = row, None
                continue
            if rows is None:
                ids, c = unpacked(shard, ("ids", "c"), kind)
                rows = Rows(c, ids, np.asarray(shard.label))
            anchors, a = unpacked(row, ("anchors", "a"), kind)
            yield row, anchors, a, (np.asarray(row.head), np.asarray(row.away)), rows


FOUND = "anchor_id bigint, place int, score bigint, vec_id bigint"


def _positives(frames: Iterator[pd.DataFrame], k: int, kind: str) -> Iterator[dict[str, np.ndarray]]:
    """The best rows of the anchors' labels in each pair of a block and a shard, of those that reach the floors carried in."""
    for row, anchors, a, heads, rows in _pairs(frames, kind):
        label, floors = np.asarray(row.a_label), np.asarray(row.floors)
        least = at_least(floors, rows.kind(a))
        for here, scores, hit in by_branches(a, heads, rows, lambda h, lo, hi, least=least: hi >= least[h][:, None]):
            keep = lambda r, c, here=here, label=label, anchors=anchors, rows=rows: (label[here[r]] == rows.label[c]) & (anchors[here[r]] != rows.ids[c])
            r, s, i = best_hits(scores, hit, rows.ids, k, keep)
            yield {"anchor_id": anchors[here[r]], "place": np.zeros(len(r), dtype=np.int32), "score": s, "vec_id": i}


def _negatives(frames: Iterator[pd.DataFrame], k: int, kind: str) -> Iterator[dict[str, np.ndarray]]:
    """For each positive of an anchor, the best rows of other labels in its window."""
    for row, anchors, a, heads, rows in _pairs(frames, kind):
        label = np.asarray(row.a_label)
        # (anchors, positives): where there are fewer positives, a window that nothing meets.
        lows, highs = np.asarray(row.lows).reshape(len(anchors), -1), np.asarray(row.highs).reshape(len(anchors), -1)
        # All windows of an anchor are one interval at first.
        number = rows.kind(a)
        least, most = at_least(lows.min(axis=1), number), at_most(highs.max(axis=1), number)
        for here, scores, hit in by_branches(a, heads, rows, lambda h, lo, hi, least=least, most=most: (hi >= least[h][:, None]) & (lo <= most[h][:, None])):
            hits = kept_hits(hit, lambda r, c, here=here, label=label, rows=rows: label[here[r]] != rows.label[c])
            few = ranked_hits(scores, hits, rows.ids) if isinstance(hits, tuple) else None
            for j in range(lows.shape[1]):
                low, high = lows[here, j], highs[here, j]
                if few is None:
                    r, s, i = best_hits(scores, hits & (scores >= low[:, None]) & (scores <= high[:, None]), rows.ids, k)
                else:
                    r, s, i = few
                    inside = (s >= low[r]) & (s <= high[r])
                    r, s, i = r[inside], s[inside], i[inside]
                    first = first_of_each(r, k)
                    r, s, i = r[first], s[first], i[first]
                yield {"anchor_id": anchors[here[r]], "place": np.full(len(r), j, dtype=np.int32), "score": s, "vec_id": i}


def hard_negatives(
    vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Where vec_id is divisible by 7, label first becomes (label + 1) % 10; components become
    floor(scale * x). Anchors are the rows whose vec_id is divisible by 50. An anchor's positives are its
    ``positives`` best other rows of its label; for each, the ``negatives`` best rows of other labels follow
    whose score is ``low`` to ``high`` hundredths of the positive's, ties by smaller vec_id. A positive with a
    negative score has an empty window; one without rows in its window gives none. Rows without vec_id
    or label, and vectors that are null, empty, hold null or non-finite components or differ in length
    from most (of equally common lengths the shorter counts), take no part. A repeated vec_id is one row:
    the first by its components, then by label. Products that may leave 64 bits, times 100, are an
    error. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
    )
    first = clean.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v")
    clean = of_one_length(materialise(first, "negatives"))
    total = clean.count()
    if not total or not clean.where(is_query()).head(1):
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    dealt = deal(clean, total, shard_rows, block_rows, ("label",))
    kind = dealt.kind

    def trees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            grown = [branches(a, spanning_tree(a)) for a in (unpacked(r, ("anchors", "a"), kind)[1] for r in frame.itertuples(index=False))]
            yield frame.assign(head=[g[0] for g in grown], away=[g[1] for g in grown])

    shape = ", ".join(f"{n} {t}" for n, t in dealt.blocks.dtypes)
    blocks = materialise(dealt.blocks.mapInPandas(trees, f"{shape}, head array<bigint>, away array<double>"), "blocks")
    columns = ["cell", "chunk", "anchors", "a_label", "a", "head", "away"]

    def liked(work: DataFrame, name: str) -> DataFrame:
        found = dealt.searched(work.select(*columns, "floors"), lambda f: gathered(_positives(f, positives, kind)), FOUND)
        return materialise(best_of(found, ["anchor_id"], positives).drop("rank"), f"positives-{name}")

    found = dealt.in_rounds(blocks, lambda blocks, found, part: with_floors(blocks, found, "anchor_id", positives, part), liked, "floors", None, 1)
    best = best_of(found, ["anchor_id"], positives)
    best = materialise(best.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Windows of scores: low * p <= 100 * s <= high * p, as whole numbers. No positive, no window.
    p = F.col("positive_score")
    window = F.struct(F.ceil(F.expr(f"({low} * positive_score) / 100.0bd")).alias("lo"), F.floor(F.expr(f"({high} * positive_score) / 100.0bd")).alias("hi"))
    keys = ["anchor_id", "place"]
    windows = best.select(*keys, window.alias("window")).select(*keys, F.col("window.lo").cast("long").alias("lo"), F.col("window.hi").cast("long").alias("hi"))

    def ask(blocks: DataFrame, found: DataFrame | None, part: str) -> DataFrame:
        """``blocks`` with the ends of their anchors' windows; where as many rows as are asked for are found in one, it begins with the last of them."""
        left = windows
        if found is not None:
            floor = best_of(found, keys, negatives).groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == negatives)
            left = windows.join(floor, keys, "left").withColumn("lo", F.greatest("lo", "floor")).select(*keys, "lo", "hi")
        places = members(blocks, "anchor_id").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(positives - 1))))
        ends = places.join(left, keys, "left").withColumns({"lo": F.coalesce("lo", F.lit(NONE)), "hi": F.coalesce("hi", F.lit(LEAST))})
        return materialise(in_order(blocks, ends, ["at", "place"], {"lows": "lo", "highs": "hi"}), f"windows-{part}")

    def mined(work: DataFrame, name: str) -> DataFrame:
        found = dealt.searched(work.select(*columns, "lows", "highs"), lambda f: gathered(_negatives(f, negatives, kind)), FOUND)
        return materialise(best_of(found, keys, negatives).drop("rank"), f"negatives-{name}")

    chosen = best_of(dealt.in_rounds(blocks, ask, mined, "lows", "highs", positives), keys, negatives)
    return chosen.join(best, keys).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), p, F.col("score").alias("negative_score")
    )


ORACLE_SQL = f"""
with v as (
  select vec_id, case when vec_id % {MOVED} = 0 then (label + 1) % {LABELS} else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as anchor_id, c.vec_id as vec_id, q.label = c.label as same,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from s where same) where n <= {POSITIVES}),
g as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from g where rank <= {NEGATIVES}
"""
