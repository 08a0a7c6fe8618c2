"""Vectors as blocks: cleaning, sharding, and pairing a stated query set with all shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise

EVERY = 50
NONE = np.iinfo(np.int64).max
#: Stands for no score; its negative is a number too.
LEAST = np.iinfo(np.int64).min + 1
#: Share of hits beyond which the best are taken by maxima of whole rows instead of by sorting the hits.
DENSE = 1 / 16


def usable(column: str) -> Column:
    """Whether a vector is there, not empty, and has no null or non-finite component."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad, F.lit(False))


def of_one_length(rows: DataFrame, column: str = "v") -> DataFrame:
    """Rows whose vector has the table's length: the one most vectors have, the shorter of equally common ones."""
    size = F.size(column)
    first = rows.groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").head()
    return rows if first is None else rows.where(size == first["size"])


def is_query(key: str = "vec_id", every: int = EVERY) -> Column:
    return F.col(key) % every == 0


def blocks(rows: DataFrame, group: list[str], name: str, columns: tuple[str, ...] = ("vec_id", "v")) -> DataFrame:
    """One row per group with its rows' columns as arrays; groups must be bounded."""
    packed = rows.groupBy(*group).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return materialise(packed.select(*group, *[F.col(f"rows.{c}").alias(c) for c in columns]), name)


def matrix(rows) -> np.ndarray:
    """An array of arrays as a matrix."""
    return np.array(rows.tolist() if hasattr(rows, "tolist") else rows)


def keep_best(scores: np.ndarray, ids: np.ndarray, new_scores: np.ndarray, new_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of two candidate tables, higher scores first, then smaller ids."""
    all_scores, all_ids = np.concatenate([scores, new_scores], axis=1), np.concatenate([ids, new_ids], axis=1)
    order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
    return np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def product_kind(a: np.ndarray, c: np.ndarray) -> type:
    """Numbers in which every partial sum of inner products is exact, by the rows' norms, the fastest first: none exceeds the product of two norms."""
    most = a.max(initial=0) * c.max(initial=0) * (1 + 1e-9)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def at_least(scores: np.ndarray, kind: type) -> np.ndarray:
    """``scores`` as numbers of a kind, rounded down, so that what reaches a score reaches its number."""
    return scores if kind is np.int64 else np.nextafter(scores.astype(kind), kind(-np.inf))


def at_most(scores: np.ndarray, kind: type) -> np.ndarray:
    """``scores`` as numbers of a kind, rounded up."""
    return scores if kind is np.int64 else np.nextafter(scores.astype(kind), kind(np.inf))


def by_rank(row: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by row, then higher scores, then smaller ids."""
    return np.lexsort((ids, -scores, row))


def first_of_each(row: np.ndarray, k: int) -> np.ndarray:
    """Whether a place is among the first k of its row; equal rows stand together."""
    at = np.arange(len(row))
    start = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    return at - np.maximum.accumulate(np.where(start, at, 0)) < k


Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def kept_hits(hit: np.ndarray, keep: Keep | None) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """Rows and columns of the hits that ``keep`` (of rows and columns) lets pass, or the table of them if they are many."""
    if np.count_nonzero(hit) <= DENSE * hit.size:
        row, at = np.nonzero(hit)
        if keep is not None:
            passed = keep(row, at)
            row, at = row[passed], at[passed]
        return row, at
    if keep is None:
        return hit
    hit = hit & keep(np.arange(hit.shape[0])[:, None], np.arange(hit.shape[1]))
    return np.nonzero(hit) if np.count_nonzero(hit) <= DENSE * hit.size else hit


def ranked_hits(scores: np.ndarray, hits: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, score and id of hits: rows together, higher scores first, then smaller ids."""
    row, at = hits
    found, who = scores[row, at].astype(np.int64), ids[at]
    order = by_rank(row, found, who)
    return row[order], found[order], who[order]


def best_hits(scores: np.ndarray, hit: np.ndarray, ids: np.ndarray, k: int, keep: Keep | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each row of ``scores`` (ids ascending along it): row, score, id; rows together, higher scores first, then smaller ids."""
    hits = kept_hits(hit, keep)
    if isinstance(hits, tuple):
        row, found, who = ranked_hits(scores, hits, ids)
        first = first_of_each(row, k)
        return row[first], found[first], who[first]
    none = LEAST if scores.dtype == np.int64 else -np.inf
    left, each, taken = np.where(hits, scores, scores.dtype.type(none)), np.arange(len(scores)), []
    for _ in range(min(k, scores.shape[1])):
        # The first of equals, so the smallest id.
        at = left.argmax(axis=1)
        taken.append((left[each, at], at))
        left[each, at] = none
    best, at = (np.stack(x, axis=1) for x in zip(*taken, strict=True))
    row, rank = np.nonzero(best != none)
    return row, best[row, rank].astype(np.int64), ids[at[row, rank]]


def gathered(parts: Iterator[dict[str, np.ndarray]], most: int = 65536) -> Iterator[pd.DataFrame]:
    """Frames of about ``most`` rows of many small parts."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(next(iter(part.values())))
        if rows >= most:
            yield pd.DataFrame({n: np.concatenate([p[n] for p in held]) for n in held[0]})
            held, rows = [], 0
    if rows:
        yield pd.DataFrame({n: np.concatenate([p[n] for p in held]) for n in held[0]})
