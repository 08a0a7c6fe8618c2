"""Canonical length-limited Huffman codes, packed and unpacked with numpy."""

from __future__ import annotations

import numpy as np

LIMIT = 20
SEGMENT = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; zero for symbols that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, is_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        is_leaf.append(rank < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = previous = 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        size = int(lengths[symbol])
        if size:
            code <<= size - previous
            codes[symbol] = code
            code, previous = code + 1, size
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every window of as many bits as the longest code: its symbol and that symbol's length."""
    bits = max(1, int(lengths.max(initial=1)))
    codes = canonical_codes(lengths)
    symbols, sizes = np.zeros(1 << bits, dtype=np.uint32), np.ones(1 << bits, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    first = (codes[used] << (bits - lengths[used]).astype(np.uint64)).astype(np.int64)
    for s, a, n in zip(used.tolist(), first.tolist(), lengths[used].tolist(), strict=True):
        symbols[a : a + (1 << (bits - n))] = s
        sizes[a : a + (1 << (bits - n))] = n
    return symbols, sizes, bits


def segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents' tokens cut into segments of ``SEGMENT``: first token and number of tokens of each."""
    per = -(-sizes // SEGMENT)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(sizes) - sizes, per) + nth * SEGMENT
    return start, np.minimum(SEGMENT, np.repeat(sizes, per) - nth * SEGMENT)


def pack(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Code documents' ids one after another, each from a new byte.

    Returns the bytes, the documents' byte offsets (one more than documents), and the bit offset of each segment.
    """
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begin = np.concatenate([[0], ends])
    first = np.concatenate([[0], np.cumsum(sizes)])
    bits = begin[first[1:]] - begin[first[:-1]]
    offsets = np.concatenate([[0], np.cumsum(-(-bits // 8))])
    shift = np.repeat(8 * offsets[:-1] - begin[first[:-1]], sizes)
    at = begin[:-1] + shift
    window = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    word, n = at >> 5, int(offsets[-1] // 4 + 2)
    words = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n)
    words += np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return words.astype(">u4").tobytes()[: offsets[-1]], offsets, at[segments(sizes)[0]]


def unpack(payload: bytes, marks: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block: all its segments are decoded side by side, one table lookup for each token."""
    symbols, widths, bits = table
    start, count = segments(sizes)
    out = np.zeros(int(sizes.sum()), dtype=np.uint32)
    raw = np.frombuffer(payload + b"\0" * (12 - len(payload) % 4), dtype=">u4").astype(np.uint64)
    window = (raw[:-1] << np.uint64(32)) | raw[1:]
    order = np.argsort(-count, kind="stable")
    start, at, count = start[order], marks[order].astype(np.int64), count[order]
    active = np.searchsorted(-count, -np.arange(int(count.max(initial=0))), side="left")
    rest = np.uint64(64 - bits)
    for step, n in enumerate(active.tolist()):
        p = at[:n]
        peek = (window[p >> 5] << (p & 31).astype(np.uint64)) >> rest
        out[start[:n] + step] = symbols[peek]
        at[:n] = p + widths[peek]
    return out
