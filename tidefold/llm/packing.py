"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous rounds.

Pieces longer than half a sequence open one each. Then, round by round, the pieces that are left and
the gaps of all open sequences are range-sorted together, longest first, gaps before pieces of their
length. A sweep through that order gives each piece its successor, the smallest gap that holds it and
is not taken by a longer piece; what is left of a gap takes further pieces as the sweep comes to its size. Every
task sweeps its own range, and pieces and gaps that find no partner there are matched across ranges
by their rank. Gaps are updated and the next round begins. When few pieces find gaps any more, those of
the larger sizes open sequences. Rounds are written to the shared folder, so a lost executor costs a part
of one round.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexers import ChunkEncoder, ranges
from .runtime import materialise

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
LENGTH = 1024
#: Documents that a task tokenises together, and the rows of a range of a sweep.
BATCH, RANGE_ROWS = 1024, 1 << 15
#: Sequences open when fewer than one in so many pieces found a gap. Ranges whose counts are added up together.
FEW, FAN = 32, 1024

GAP, PIECE, PLACED, CHANGED = 0, 1, 2, 3


def cuts(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of every piece: documents are cut into pieces of ``length``, the first may be shorter."""
    many = -(-sizes // length)
    first = sizes - (many - 1) * length
    doc = np.repeat(np.arange(len(sizes)), many)
    nth = ranges(np.zeros(len(sizes), dtype=np.int64), many).astype(np.int64)
    return doc, np.where(nth == 0, 0, first[doc] + (nth - 1) * length), np.where(nth == 0, first[doc], length)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32 for every piece; null texts are empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ChunkEncoder.of(tokenizer)
        for frame in frames:
            for k in range(0, len(frame), BATCH):
                part = frame.iloc[k : k + BATCH]
                ids, sizes = encoder.encode_all(part["text"].tolist())
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4"), sizes + 1
                doc, start, size = cuts(sizes, length)
                # Pieces follow each other without a break, over documents too.
                data, ends = memoryview(ids).cast("B"), (4 * np.cumsum(size)).tolist()
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy()[doc], "piece": (ranges(np.zeros(len(sizes), dtype=np.int64), np.bincount(doc))),
                        "start": start, "length": size, "ids_crc32": [zlib.crc32(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)],
                    }
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _sweep(state: DataFrame, parts: int, length: int, opening: int | None, number: int) -> DataFrame:
    """One sweep within ranges: (kind, id, size) -> part, kind, id, size, bin, rank.

    PLACED rows have the piece and its sequence, CHANGED rows what is left of a gap that took pieces. A
    gap goes on taking pieces where the sweep reaches the size that is left of it. PIECE and GAP rows
    found no partner in their range and are ranked in the order in which a sweep over all ranges would
    take them. Pieces of ``opening`` tokens or more that find no gap open a sequence; ``number`` keeps the
    sequences of one sweep apart from those of others.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["part", "kind", "id", "size", "bin", "rank"]
        # Gaps at least as large as the row at hand, the smallest on top, and smaller ones that took a piece.
        gaps: list[tuple[int, int, bool]] = []
        later: list[tuple[int, int]] = []
        part = alone = opened = 0
        for frame in frames:
            if not len(frame):
                continue
            out, part = [], int(frame["part"].iloc[0])
            for kind, key, size in zip(frame["kind"].tolist(), frame["id"].tolist(), frame["size"].tolist(), strict=True):
                while later and -later[0][0] >= size:
                    free, place = heapq.heappop(later)
                    gaps.append((place, -free, True))
                if kind == GAP:
                    gaps.append((key, size, False))
                    continue
                if gaps:
                    place, gap, _ = gaps.pop()
                elif opening is not None and size >= opening:
                    place, gap, opened = 2 * ((number << 54) + (part << 22) + opened) + 1, length, opened + 1
                else:
                    out.append((part, PIECE, key, size, 0, alone))
                    alone += 1
                    continue
                out.append((part, PLACED, key, size, place, 0))
                if gap - size >= size:
                    gaps.append((place, gap - size, True))
                elif gap > size:
                    heapq.heappush(later, (size - gap, place))
            yield pd.DataFrame(out, columns=names)
        changed = [(place, gap) for place, gap, used in gaps if used] + [(place, -free) for free, place in later]
        rest = [(part, CHANGED, place, gap, 0, 0) for place, gap in changed]
        rest += [(part, GAP, key, size, 0, i) for i, (key, size, _) in enumerate(g for g in reversed(gaps) if not g[2])]
        yield pd.DataFrame(rest, columns=names)

    order = [F.col("size").desc(), F.col("kind"), F.col("id")]
    # One range is at most ``range_rows`` rows; more are dealt by sampled borders.
    ranged = state.coalesce(1) if parts == 1 else state.repartitionByRange(parts, *order)
    ranged = ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return ranged.mapInPandas(run, "part int, kind int, id bigint, size bigint, bin bigint, rank bigint")


def _heights(counts: DataFrame, many: int) -> DataFrame:
    """(part, p, g) pieces and gaps without a partner -> with ``before`` and ``held``: gaps open before a range, and after its pieces.

    With t the sum of g - p so far, the lowest t - g so far is where no gap was open. Both are added up over
    groups of ``FAN`` ranges and then groups of groups.
    """
    group = F.floor(F.col("part") / FAN)
    so_far = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("group", group).withColumn("t", F.sum(F.col("g") - F.col("p")).over(so_far))
    rows = rows.withColumn("low", F.min(F.col("t") - F.col("g")).over(so_far))
    if many > FAN:
        # A group is a range that first closes, then opens gaps.
        last = F.max(F.struct("part", "t", "low"))
        groups = rows.groupBy("group").agg(last.alias("l")).select(F.col("group").alias("part"), (-F.col("l.low")).alias("p"), (F.col("l.t") - F.col("l.low")).alias("g"))
        far = _heights(groups, -(-many // FAN)).select(F.col("part").alias("group"), F.col("before").alias("start"))
        rows = rows.join(far, "group")
    else:
        rows = rows.withColumn("start", F.lit(0))
    floor = F.least(F.lit(0), F.col("start") + F.col("low"))
    held = F.col("start") + F.col("t") - F.col("g") - floor
    # What was open before the pieces of a range: the floor reached before them counts.
    earlier = F.lag("low").over(Window.partitionBy("group").orderBy("part"))
    past = F.col("start") + F.col("t") - F.col("g") + F.col("p")
    before = past - F.least(F.lit(0), F.col("start") + F.coalesce(earlier, F.lit(0)))
    return rows.select("part", "p", "g", before.alias("before"), held.alias("held"))


def across(alone: DataFrame, parts: int) -> DataFrame:
    """(piece, size, bin, gap) of the pieces and gaps (part, kind, id, size, rank) that are partners across ranges.

    The pieces of a range come before its gaps and take the nearest gaps before them, as closing
    brackets take opening ones: a gap opens a level, a piece closes one, and on every level gaps and pieces
    take turns, so the n-th piece of a level has its n-th gap.
    """
    counts = alone.groupBy("part").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(n) for k, n in ((PIECE, "p"), (GAP, "g"))])
    rows = alone.join(_heights(counts, parts), "part")
    level = F.when(F.col("kind") == GAP, F.col("held") + F.col("g") - F.col("rank")).otherwise(F.col("before") - F.col("rank"))
    rows = rows.withColumn("level", level).where("level > 0")
    # A range has one gap and one piece on a level at most.
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("kind", "level").orderBy("part")))
    p = rows.where(F.col("kind") == PIECE).selectExpr("level", "turn", "id as piece", "size")
    return p.join(rows.where(F.col("kind") == GAP).selectExpr("level", "turn", "id as bin", "size as gap"), ["level", "turn"]).drop("level", "turn")


def assign(pieces_left: DataFrame, gaps: DataFrame, length: int = LENGTH, range_rows: int = RANGE_ROWS) -> list[DataFrame]:
    """Rounds of best fit: pieces (id, size) of at most half a sequence, gaps (id, size) -> tables of (id, bin), one or two a round.

    Sequences opened here have odd numbers; gaps are to have even ones. While many pieces find gaps, none opens; then
    the larger half of the sizes left may open sequences, which smaller pieces fill in the next rounds.
    What fits one range is packed by one sweep. The driver sees totals only.
    """
    state = gaps.selectExpr(f"{GAP} kind", "id", "size").union(pieces_left.selectExpr(f"{PIECE} kind", "id", "size"))
    seen = {r["kind"]: r for r in state.groupBy("kind").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).collect()}
    placed: list[DataFrame] = []
    opening = None
    while PIECE in seen:
        left, least, most = (seen[PIECE][k] for k in ("n", "least", "most"))
        live = state.where((F.col("kind") == PIECE) | (F.col("size") >= least))
        parts = -(-(left + (seen[GAP]["n"] if GAP in seen else 0)) // range_rows)
        if parts == 1:
            opening = 0
        swept = materialise(_sweep(live, parts, length, opening, len(placed)), "sweep")
        done = swept.where(F.col("kind") == PLACED).select("id", "bin")
        placed.append(done)
        alone = swept.where(F.col("kind").isin(PIECE, GAP))
        state = alone.select("kind", "id", "size").union(swept.where(F.col("kind") == CHANGED).selectExpr(f"{GAP} kind", "id", "size"))
        if parts > 1:
            pairs = materialise(across(alone.select("part", "kind", "id", "size", "rank"), parts), "across")
            placed.append(pairs.selectExpr("piece as id", "bin"))
            met = pairs.selectExpr(f"{PIECE} kind", "piece id").union(pairs.selectExpr(f"{GAP} kind", "bin id"))
            state = state.join(met, ["kind", "id"], "left_anti").union(pairs.where("gap > size").selectExpr(f"{GAP} kind", "bin id", "gap - size as size"))
            state = materialise(state, "round")
        seen = {r["kind"]: r for r in state.groupBy("kind").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).collect()}
        now = seen[PIECE]["n"] if PIECE in seen else 0
        # After sequences opened, smaller pieces look for gaps first.
        opening = seen[PIECE]["most"] // 2 if now and opening is None and (left - now) * FEW < left else None
    return placed


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, repeated doc_ids and null doc_ids too; a null or empty text is one
    piece with the end id alone. Other columns are ignored. An empty table gives no rows. A document of
    any length is cut into pieces of ``length``, of which the first may be shorter.
    """
    cut_up = pieces(docs, tokenizer, end_id, length).withColumn("row", F.monotonically_increasing_id())
    cut_up = materialise(cut_up, "pieces")
    alone = cut_up.where(F.col("length") > length // 2).withColumn("sequence_id", 2 * F.col("row"))
    small = cut_up.where(F.col("length") <= length // 2)
    gaps = alone.where(F.col("length") < length).select(F.col("sequence_id").alias("id"), (length - F.col("length")).alias("size"))
    found = assign(small.select(F.col("row").alias("id"), F.col("length").alias("size")), gaps, length, range_rows)
    if not found:
        return alone.drop("row").withColumn("offset", F.lit(0).cast("long"))
    placed = found[0].withColumn("round", F.lit(1))
    for i, more in enumerate(found[1:]):
        placed = placed.union(more.withColumn("round", F.lit(i + 2)))
    joined = small.join(placed.selectExpr("id as row", "bin as sequence_id", "round"), "row").select(*alone.columns, "round")
    # At most ``length`` pieces share a sequence; whole sequences of one piece take no part in the shuffle.
    shared = alone.where(F.col("length") < length).withColumn("round", F.lit(0)).union(joined)
    before = F.expr("sum(length) over (partition by sequence_id order by round, row rows between unbounded preceding and 1 preceding)")
    shared = shared.withColumn("offset", F.coalesce(before, F.lit(0).cast("long"))).drop("round", "row")
    return shared.union(alone.where(F.col("length") == length).drop("row").withColumn("offset", F.lit(0).cast("long")))
