"""Token ids in canonical Huffman-coded blocks, in ascending order of documents.

A stored corpus is a folder with two Parquet tables. ``codebook`` holds a code length for each id
that occurs. ``blocks`` holds independent blocks of whole documents: where the block stands (part,
block), its documents' ids and token counts, the coded bytes, and the bit offset of every 256th token
of each document, from which decoding can begin.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman
from .lexers import ChunkEncoder
from .runtime import materialise, scratch, width

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_TOKENS = 1 << 18
#: Documents that a task tokenises together.
BATCH = 1024
SAMPLED = 100
#: Ids below this bound; the driver and each task hold one number for each.
VOCABULARY = 1 << 16


def _unplanes(data: bytes) -> np.ndarray:
    """16-bit ids from their low bytes and then their high bytes."""
    return np.frombuffer(data, dtype=np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> doc_id, tie (a hash of the text), nth (a number of the row), n, ids (16-bit planes), counts.

    Ties and row numbers order repeated doc_ids. Each task ends with one row that has nothing but ``counts``:
    the ids that the task met and how often, so that counting takes no pass of its own.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, total = ChunkEncoder.of(tokenizer), np.zeros(VOCABULARY, dtype=np.int64)
        for frame in frames:
            for k in range(0, len(frame), BATCH):
                part = frame.iloc[k : k + BATCH]
                ids, sizes = encoder.encode_all(part["text"].tolist())
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                if int(ids.max()) >= VOCABULARY:
                    raise ValueError("an id is outside the vocabulary bound")
                total += np.bincount(ids, minlength=VOCABULARY)
                low, high = (ids.astype("<u2").view(np.uint8)[b::2].tobytes() for b in (0, 1))
                ends = np.cumsum(sizes).tolist()
                planes = [low[a:b] + high[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                yield part[["doc_id", "tie", "nth"]].assign(n=sizes, ids=planes, counts=None)
        used = np.flatnonzero(total)
        data = used.astype("<i4").tobytes() + total[used].astype("<i8").tobytes()
        yield pd.DataFrame({"doc_id": [None], "tie": [None], "nth": [None], "n": [None], "ids": [None], "counts": [data]})

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("nth"), "text")
    return rows.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, tie bigint, nth bigint, n bigint, ids binary, counts binary")


def _counts(raw: DataFrame) -> np.ndarray:
    """How often each id occurs, over all documents, from the tasks' counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["counts"]:
                used = len(data) // 12
                yield pd.DataFrame({"id": np.frombuffer(data, "<i4", used), "n": np.frombuffer(data, "<i8", used, 4 * used)})

    out = np.zeros(VOCABULARY, dtype=np.int64)
    each = raw.where("counts is not null").select("counts").mapInPandas(run, "id int, n bigint")
    for r in each.groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _key(doc_id, tie, nth) -> tuple:
    """Order of documents: null doc_ids first."""
    return (False, 0, tie, nth) if doc_id is None or doc_id != doc_id else (True, doc_id, tie, nth)


def _bounds(raw: DataFrame, parts: int) -> list[tuple]:
    """Borders of ranges of about equal size, from a sample of about ``SAMPLED`` keys for each range.

    Only the keys are read for it; a range partitioner would run the coding twice to draw its sample.
    """
    share = min(1.0, SAMPLED * parts / max(1, raw.count()))
    keys = sorted(_key(*r) for r in raw.select("doc_id", "tie", "nth").sample(share, seed=1).collect())
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, limit: int = huffman.LIMIT) -> None:
    """Tokenise whole texts, append ``end_id`` to each and write them in ascending order of doc_id.

    Null texts are empty (the end id alone); null doc_ids come first; repeated doc_ids follow each
    other, ordered by a hash of the text and the row's number, so that rows repeated many times are
    still spread over tasks. Ids are coded before they are sorted, so the one shuffle moves compressed
    documents. A document is never cut, so a block holds ``BLOCK_TOKENS`` tokens or one document more.
    """
    spark = docs.sparkSession
    raw = materialise(token_ids(docs, tokenizer, end_id), "ids")
    lengths = huffman.code_lengths(_counts(raw), limit)
    raw = raw.where("counts is null").drop("counts")
    codes = huffman.canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(
        [(int(i), int(lengths[i])) for i in used], "id int, length int"
    ).coalesce(1).write.parquet(f"{path}/codebook")
    code = spark.sparkContext.broadcast((codes, lengths))
    kind = dict(docs.dtypes)["doc_id"]

    parts = width(spark)
    bounds = _bounds(raw, parts)

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, size = code.value
        for frame in frames:
            for k in range(0, len(frame), 256):
                part = frame.iloc[k : k + 256]
                n = part["n"].to_numpy()
                ids = np.concatenate([_unplanes(x) for x in part["ids"]])
                data, offsets, marks = huffman.pack(ids, n, book, size)
                last = np.cumsum(-(-n // huffman.SEGMENT))
                yield pd.DataFrame(
                    {
                        "part": [bisect_right(bounds, k) for k in map(_key, part["doc_id"], part["tie"], part["nth"])],
                        "doc_id": part["doc_id"], "tie": part["tie"], "nth": part["nth"], "n": n,
                        "bits": [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
                        "marks": [m - 8 * o for m, o in zip(np.split(marks, last[:-1]), offsets[:-1], strict=True)],
                    }
                )

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, tokens = 0, [], 0

        def flush() -> pd.DataFrame:
            offsets = np.concatenate([[0], np.cumsum([len(h.bits) for h in held])])
            return pd.DataFrame(
                {
                    "part": [held[0].part], "block": [block], "tokens": [tokens],
                    "doc_ids": [[None if pd.isna(h.doc_id) else h.doc_id for h in held]],
                    "sizes": [[h.n for h in held]],
                    "marks": [np.concatenate([h.marks + 8 * o for h, o in zip(held, offsets, strict=False)])],
                    "payload": [b"".join(h.bits for h in held)],
                }
            )

        for frame in frames:
            for row in frame.itertuples(index=False):
                if held and held[0].part != row.part:
                    yield flush()
                    block, held, tokens = 0, [], 0
                held.append(row)
                tokens += row.n
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    block, held, tokens = block + 1, [], 0
        if held:
            yield flush()

    placed = (
        raw.mapInPandas(coded, f"part int, doc_id {kind}, tie bigint, nth bigint, n bigint, bits binary, marks array<bigint>")
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "doc_id", "tie", "nth")
    )
    out = placed.mapInPandas(
        blocks,
        f"part int, block int, tokens bigint, doc_ids array<{kind}>, sizes array<bigint>, marks array<bigint>, payload binary",
    )
    out.write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode a stored corpus: doc_id, start (ids before it), n_tokens, ids (little-endian 32-bit)."""
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(VOCABULARY, dtype=np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]
    table = spark.sparkContext.broadcast(lengths)
    stored = spark.read.parquet(f"{path}/blocks")
    kind = dict(stored.dtypes)["doc_ids"].removeprefix("array<")[:-1]
    # One number for each partition of the writer comes to the driver; blocks are summed within a part by Spark.
    before, base = 0, {}
    for r in stored.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect():
        base[r["part"]], before = before, before + r["n"]
    begin = stored.select("part", "block", F.expr(
        "coalesce(sum(tokens) over (partition by part order by block rows between unbounded preceding and 1 preceding), 0L)"
    ).alias("begin"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = huffman.decode_table(table.value)
        for frame in frames:
            for row in frame.itertuples(index=False):
                sizes = np.asarray(row.sizes, dtype=np.int64)
                ids = huffman.unpack(row.payload, np.asarray(row.marks), sizes, opened).astype("<u4")
                first = np.cumsum(sizes) - sizes
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series(list(row.doc_ids), dtype="object"), "start": base[row.part] + row.begin + first, "n_tokens": sizes,
                        "ids": [ids[a : a + n].tobytes() for a, n in zip(first, sizes, strict=True)],
                    }
                )

    return stored.join(begin, ["part", "block"]).mapInPandas(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def token_digests(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as a stored corpus, read it back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def brute_force(rows: list[tuple], tokenizer: str = TOKENIZER, end_id: int = END_ID) -> dict:
    """The same by the library alone, for tests: doc_id -> (start, n_tokens, ids_crc32)."""
    library = ChunkEncoder.of(tokenizer).library
    out, at = {}, 0
    for doc_id, text in sorted(rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        out[doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out
