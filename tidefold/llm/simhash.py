"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are grouped into tiles, boxes in the space of the population counts of their four
16-bit quarters. Differing bits are at least the sum over the quarters of the differences in
population count, so a pair of tiles whose boxes lie further apart than the radius is skipped;
every other pair is compared in full with numpy exclusive-or and bit counts. The search is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .runtime import as_empty, hot_keys, join_unique, materialise, width

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 4096
MAX_TILES = 4096
CHUNK = 1 << 16
STRIP = 128
QUARTERS = 4


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text, as a signed integer; memory is bounded by ``CHUNK`` shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes: Iterator[int] = iter([digest(b" ".join(words), seed)])
        total = 1
    else:
        hashes = (digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False))
        total = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    left = total
    while left:
        n = min(left, CHUNK)
        block = np.fromiter(hashes, dtype=np.uint64, count=n)
        bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        left -= n
    return int(np.packbits(ones * 2 > total).view(">i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def _tiles(counts: list[tuple], rows: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Cut the table of population-count classes into boxes of about ``rows`` fingerprints.

    Returns (class..., first tile, number of tiles) per class and the lower and upper corners per tile.
    A class of more than ``rows`` is split over several tiles by a hash.
    """
    keys = np.array([c[:QUARTERS] for c in counts], dtype=np.int64).reshape(-1, QUARTERS)
    sizes = np.array([c[QUARTERS] for c in counts], dtype=np.int64)
    where: list[tuple] = []
    low: list[np.ndarray] = []
    high: list[np.ndarray] = []
    stack = [np.arange(len(keys))] if len(keys) else []
    while stack:
        own = stack.pop()
        total, spread = int(sizes[own].sum()), np.ptp(keys[own], axis=0)
        if total <= rows or not spread.any():
            parts = max(1, -(-total // rows))
            where += [(*map(int, keys[k]), len(low), parts) for k in own]
            low += [keys[own].min(axis=0)] * parts
            high += [keys[own].max(axis=0)] * parts
            continue
        axis = int(spread.argmax())
        order = own[np.argsort(keys[own, axis], kind="stable")]
        along = keys[order, axis]
        cut = along[np.searchsorted(np.cumsum(sizes[order]), total / 2)]
        left = along < cut if along[0] < cut else along <= cut
        stack += [order[left], order[~left]]
    return where, np.array(low).reshape(-1, QUARTERS), np.array(high).reshape(-1, QUARTERS)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components under the links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Compare each tile, which comes first (b = -1), with those that follow; emit a star for each group of linked fingerprints."""
    held: tuple | None = None
    for frame in frames:
        for row in frame.itertuples(index=False):
            fps, ids = np.asarray(row.fps, dtype=np.int64).view(np.uint64), np.asarray(row.ids, dtype=np.int64)
            order = np.argsort(ones := np.bitwise_count(fps), kind="stable")
            tile = fps[order], ids[order], ones[order].astype(int)
            if row.b < 0:
                held = tile
                continue
            same = row.a == row.b
            (fa, ia, pa), (fb, ib, pb) = held, tile
            # Pairs of one strip are reduced to stars at once, so a tile of near copies never holds all its pairs.
            ends: list[np.ndarray] = []
            for s in range(0, len(fa), STRIP):
                e = min(s + STRIP, len(fa))
                lo, hi = np.searchsorted(pb, pa[s] - radius), np.searchsorted(pb, pa[e - 1] + radius, side="right")
                x, y = np.nonzero(np.bitwise_count(fa[s:e, None] ^ fb[None, lo:hi]) <= radius)
                if len(x):
                    ends.append(_stars(x + s, y + lo + (0 if same else len(ia))))
            if not ends:
                continue
            names = ia if same else np.concatenate([ia, ib])
            star = _stars(*np.concatenate(ends, axis=1))
            if star.shape[1]:
                yield pd.DataFrame({"src": names[star[0]], "dst": names[star[1]]})


def _stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links that connect the same nodes as a-b, from each node to the smallest of its component."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = _forest(len(nodes), back[: len(a)], back[len(a) :])
    star = top != np.arange(len(nodes))
    return np.stack([nodes[star], nodes[top[star]]])


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``prints`` (fp, id; one row per fingerprint) -> links (src, dst) whose components are exact.

    The driver holds one number for each population-count class (17^4 at most) and two corners per
    tile (about ``2 * MAX_TILES`` at most: tiles grow with the input beyond that).
    """
    spark = prints.sparkSession
    quarter = [F.expr(f"bit_count(shiftrightunsigned(fp, {16 * q}) & 65535L)").alias(f"q{q}") for q in range(QUARTERS)]
    names = [f"q{q}" for q in range(QUARTERS)]
    classed = prints.select("fp", "id", *quarter)
    counts = [tuple(r) for r in classed.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    total = sum(c[QUARTERS] for c in counts)
    where, low, high = _tiles(counts, max(tile_rows, -(-total // MAX_TILES)))
    links = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
    if not total:
        return spark.createDataFrame([], links)
    schema = ", ".join(f"{n} int" for n in names) + ", first int, parts int"
    tile_of = spark.createDataFrame(where, schema)
    tiles = (
        classed.join(F.broadcast(tile_of), names)
        .withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int"))
        .groupBy("tile").agg(F.collect_list(F.struct("fp", "id")).alias("rows"))
        .select("tile", F.col("rows.fp").alias("fps"), F.col("rows.id").alias("ids"))
    )
    tiles = materialise(tiles, "tiles")

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                gap = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i])).sum(axis=1)
                j = np.flatnonzero(gap <= radius) + i
                yield pd.DataFrame({"a": np.full(len(j), i, dtype=np.int32), "b": j.astype(np.int32)})

    pairs = spark.range(len(low)).mapInPandas(near, "a int, b int")
    # A tile is moved once for itself and once for each pair it is the second of.
    second = pairs.join(tiles.withColumnRenamed("tile", "b"), "b").select("a", "b", "fps", "ids")
    work = second.union(tiles.select(F.col("tile").alias("a"), F.lit(-1).alias("b"), "fps", "ids"))
    work = work.repartition(width(spark), "a").sortWithinPartitions("a", "b")
    return work.mapInPandas(lambda frames: _compare(frames, radius), links)


def _grouped(docs: DataFrame, radius: int, tile_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, fp, tie), fingerprints (fp, group, component_id), and the fingerprints of very many rows."""
    rows = docs.select("doc_id", fingerprint_udf(F.col("text")).alias("fp"), F.xxhash64(as_empty("text")).alias("tie"))
    prints = materialise(rows, "prints")
    heads = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "heads")
    # One id may head several fingerprints when doc_ids repeat: nodes are the fingerprints themselves.
    links = materialise(fingerprint_links(heads.select("fp", F.col("fp").alias("id")), radius, tile_rows), "links")
    groups = connected_components(links)
    joined = heads.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("group"))
    joined = materialise(joined, "groups")
    smallest = joined.groupBy("group").agg(F.min("id").alias("component_id"))
    wide = hot_keys(joined, "group", joined.count())
    named = materialise(join_unique(joined, materialise(smallest, "smallest"), "group", wide).select("fp", "group", "component_id"), "named")
    return prints, named, materialise(hot_keys(prints, "fp", prints.count()), "common")


def simhash_components(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, text) -> one row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Nulls and texts without words have fingerprint zero and link like any other. A repeated doc_id
    gives a row each time. A row without doc_id gets its fingerprint, and the component of the
    documents that share it or null; it names no component. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    prints, named, common = _grouped(docs, radius, tile_rows)
    known = join_unique(prints, named, "fp", common)
    # Fingerprints that only rows without doc_id have are in no group.
    alone = prints.where("doc_id is null").join(named.select("fp"), "fp", "left_anti").withColumn("component_id", F.lit(None).cast(dict(docs.dtypes)["doc_id"]))
    shown = ["doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"]
    return known.select(*shown).union(alone.select(*shown))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Keep one document of each group of near duplicates: the smallest doc_id, then the smallest hash of its text.

    Groups are of texts, so where doc_ids repeat, a text of its own stays whatever else has its doc_id. Of
    rows that repeat both the kept doc_id and its text one stays, whichever comes first. Rows without doc_id
    stay and stand for no one. All columns stay; an empty table gives no rows.
    """
    prints, named, common = _grouped(docs, radius, TILE_ROWS)
    known = join_unique(prints.where("doc_id is not null"), named.select("fp", "group"), "fp", common)
    best = known.groupBy("group").agg(F.min(F.struct("doc_id", "tie")).alias("best")).select("best.*")
    best = materialise(best, "best")
    # Both sides grow with the corpus: the join is by shuffle at every size.
    tied = docs.withColumns({TIE: F.xxhash64(as_empty("text"))})
    again = prints.groupBy("doc_id", "tie").count().where("count > 1 and doc_id is not null").select("doc_id", "tie")
    again = materialise(best.join(again, ["doc_id", "tie"], "left_semi").withColumnRenamed("tie", TIE), "again")
    best = best.withColumnRenamed("tie", TIE)
    kept = tied.join(best.hint("shuffle_hash"), ["doc_id", TIE], "left_semi")
    if not again.isEmpty():
        several = tied.join(again, ["doc_id", TIE], "left_semi").dropDuplicates(["doc_id", TIE])
        kept = tied.join(best.join(again, ["doc_id", TIE], "left_anti").hint("shuffle_hash"), ["doc_id", TIE], "left_semi").unionByName(several)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


#: A column beside those of the documents while they are joined.
TIE = "__tie_of_text__"


def brute_force(rows: list[tuple], radius: int = RADIUS) -> dict[int, tuple[str, int]]:
    """The same by plain Python over all pairs, for tests: doc_id -> (fingerprint, component_id)."""
    prints = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in prints}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{p:016x}", find(d)) for d, p in prints.items()}
