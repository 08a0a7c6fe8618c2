"""Document quality by a linear-chain conditional random field over lines.

Every line has features of its own and of its neighbours; the field labels it good or bad, and the
marginals from forward-backward, weighted by line length, give the document's quality, which a
logistic curve turns into a probability.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents the field is fitted on, at most; a quarter of them fits the curve.
TRAIN_DOCS = 3000
THRESHOLD = 0.7
STEPS = 120
PENALTY = 1e-3
#: Own features of a line; each comes again for the line before and the line after.
OWN = 10
WIDE = 1 + 3 * OWN


def _classes() -> np.ndarray:
    """0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence marks, 6 symbols; beyond the basic plane 6."""
    out = np.full(1 << 16, 6, dtype=np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        out[c] = 2 if kind in ("Lu", "Lt") else 1 if kind[0] in "LM" else 3 if kind[0] == "N" else 4 if chr(c).isspace() else 5 if chr(c) in ".,'\"-:;()" else 6
    return out


_CLASS = _classes()


#: Lines of a segment of a text, and of its neighbourhood on either side. Transitions are clipped to +-2, so what lies
#: further off than that neighbourhood moves a marginal by less than rounding does, and segments give the whole chain's.
SEGMENT, AROUND = 8192, 1024
BLOCK = 1 << 20


def _counts(lines: list[str]) -> np.ndarray:
    """Characters of each class in every line, worked out in blocks of bounded size."""
    count = np.zeros(7 * len(lines), dtype=np.int64)
    held, at, size = [], 0, 0

    def flush(upto: int) -> None:
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = _CLASS[np.minimum(codes, (1 << 16) - 1)].astype(np.int64)
        line = np.repeat(np.arange(at, upto), [len(h) for h in held])
        count[: 7 * upto] += np.bincount(7 * line + kinds, minlength=7 * upto)

    for i, line in enumerate(lines):
        if len(line) > BLOCK:
            if held:
                flush(i)
            for k in range(0, len(line), BLOCK):
                held, at = [line[k : k + BLOCK]], i
                flush(i + 1)
            held, at, size = [], i + 1, 0
            continue
        held.append(line)
        size += len(line)
        if size > BLOCK:
            flush(i + 1)
            held, at, size = [], i + 1, 0
    if held:
        flush(len(lines))
    return count.reshape(-1, 7).astype(float)


def _features(lines: list[str], again: dict[str, int]) -> np.ndarray:
    """Own and neighbouring features (lines x WIDE); ``again`` has how often the text has each line."""
    sizes, count = np.array([len(x) for x in lines]), _counts(lines)
    own = np.zeros((len(lines), OWN))
    n, twice, same = np.zeros(len(lines)), np.zeros(len(lines)), np.zeros(len(lines))
    for i, line in enumerate(lines):
        words = line.split()
        n[i], twice[i], same[i] = len(words), sum(map(eq, words, words[1:])), len(set(words))
    some, letters = np.maximum(n, 1), np.maximum(count[:, 1] + count[:, 2], 1)
    own[:, 0] = count[:, 2] / letters
    own[:, 1] = np.minimum(count[:, 6] / some, 3) / 3
    own[:, 2] = count[:, 6] > 0
    own[:, 3] = twice / some
    own[:, 4] = 1 - same / some
    own[:, 5] = np.log1p(n) / 6
    own[:, 6] = np.minimum(sizes / some / 10, 3)
    own[:, 7] = count[:, 3] / np.maximum(sizes, 1)
    own[:, 8] = np.minimum(count[:, 5] / some, 1)
    own[:, 9] = [bool(x) and again[x] > 1 for x in lines]
    out = np.zeros((len(lines), WIDE))
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = own
    out[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    out[:-1, 1 + 2 * OWN :] = own[1:]
    return out


def segments(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and weights of a text's lines, by segments with their neighbourhoods, whose lines weigh nothing.

    A line weighs as many characters as it has, one at least; a text without lines has one empty line.
    """
    lines = (text or "").split("\n")
    again = Counter(lines)
    for a in range(0, len(lines), SEGMENT):
        low, high = max(0, a - AROUND), min(len(lines), a + SEGMENT + AROUND)
        # One line more on either side gives the outermost ones their neighbours.
        left, right = int(low > 0), int(high < len(lines))
        features = _features(lines[low - left : high + right], again)[left : left + high - low]
        weights = np.array([max(len(x), 1) if a <= low + i < a + SEGMENT else 0 for i, x in enumerate(lines[low:high])])
        yield features, weights


def _padded(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in items])
    out = np.zeros((len(items), sizes.max(), *items[0].shape[1:]))
    for i, x in enumerate(items):
        out[i, : len(x)] = x
    return out, np.arange(sizes.max()) < sizes[:, None]


def forward_backward(unary: np.ndarray, there: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginals' pieces of padded chains with two labels: marginals, expected transitions, log partition."""
    docs, steps, _ = unary.shape
    alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
    alpha[:, 0] = unary[:, 0]
    for t in range(1, steps):
        new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + unary[:, t]
        alpha[:, t] = np.where(there[:, t, None], new, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        new = np.logaddexp.reduce(move + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(there[:, t + 1, None], new, 0.0)
    last = there.sum(axis=1) - 1
    logz = np.logaddexp.reduce(alpha[np.arange(docs), last], axis=1)
    marginal = np.exp(alpha + beta - logz[:, None, None]) * there[:, :, None]
    pair = np.exp(alpha[:, :-1, :, None] + move + (unary[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None])
    return marginal, (pair * there[:, 1:, None, None]).sum(axis=(0, 1)), logz


class LineField:
    """The fitted model: weights of label good over bad, transitions, the curve."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, slope: float, shift: float):
        self.weights, self.move, self.slope, self.shift = weights, move, slope, shift

    @staticmethod
    def _groups(sizes: list[int]) -> Iterator[list[int]]:
        """Documents of similar numbers of lines, at most 512 and about 65,536 padded lines together."""
        group: list[int] = []
        for i in sorted(range(len(sizes)), key=sizes.__getitem__):
            if group and (len(group) == 512 or sizes[i] * (len(group) + 1) > 1 << 16):
                yield group
                group = []
            group.append(i)
        if group:
            yield group

    @classmethod
    def fit(cls, texts: list[str | None], labels: np.ndarray) -> LineField:
        """Maximum likelihood with every line labelled as its document, by Adam with fixed steps; then the curve."""
        if len(texts) < 8 or len(set(labels.tolist())) < 2:
            return cls(np.zeros(WIDE), np.zeros((2, 2)), 0.0, 4.0 if not len(labels) or labels.mean() >= 0.5 else -4.0)
        # Segments learn as texts of their own; the curve is fitted to whole texts.
        held_texts = [t for i, t in enumerate(texts) if i % 4 == 3]
        held = labels[np.arange(len(texts)) % 4 == 3]
        each = [(f, y) for i, (t, y) in enumerate(zip(texts, labels, strict=True)) if i % 4 != 3 for f, _ in segments(t)]
        groups = []
        for own in cls._groups([len(f) for f, _ in each]):
            x, there = _padded([each[i][0] for i in own])
            groups.append((x, there, np.array([int(each[i][1]) for i in own])))
        w, move, step = np.zeros(WIDE), np.zeros((2, 2)), 0
        first, second = np.zeros(WIDE + 4), np.zeros(WIDE + 4)
        lines = sum(g[1].sum() for g in groups)
        for step in range(1, STEPS + 1):
            grad_w, grad_m = -PENALTY * w * lines, -PENALTY * move * lines
            for x, there, y in groups:
                unary = np.zeros((*x.shape[:2], 2))
                unary[:, :, 1] = x @ w
                marginal, pairs, _ = forward_backward(unary, there, move)
                grad_w = grad_w + np.einsum("dt,dtf->f", there * y[:, None] - marginal[:, :, 1], x)
                for label in (0, 1):
                    grad_m[label, label] += (there.sum(axis=1) - 1)[y == label].sum()
                grad_m = grad_m - pairs
            g = np.concatenate([grad_w, grad_m.ravel()]) / lines
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            delta = 0.15 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            w, move = w + delta[:WIDE], np.clip(move + delta[WIDE:].reshape(2, 2), -2, 2)
        model = cls(w, move, 1.0, 0.0)
        raw = model.raw(held_texts)
        slope, shift = 1.0, 0.0
        for _ in range(400):
            p = 1 / (1 + np.exp(-(slope * raw + shift)))
            slope += 0.2 * (((held - p) * raw).mean() - 1e-3 * slope)
            shift += 0.2 * (held - p).mean()
        model.slope, model.shift = max(slope, 0.05), shift
        return model

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Log odds of the length-weighted mean of the lines' marginals, for a bounded number of lines at a time."""
        good, total = np.zeros(len(texts)), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def run() -> None:
            for own in self._groups([len(h[1]) for h in held]):
                x, there = _padded([held[i][1] for i in own])
                size, _ = _padded([held[i][2][:, None].astype(float) for i in own])
                unary = np.zeros((*x.shape[:2], 2))
                unary[:, :, 1] = x @ self.weights
                marginal = forward_backward(unary, there, self.move)[0][:, :, 1]
                which = [held[i][0] for i in own]
                np.add.at(good, which, (marginal * size[:, :, 0]).sum(axis=1))
                np.add.at(total, which, size[:, :, 0].sum(axis=1))
            held.clear()

        lines = 0
        for i, text in enumerate(texts):
            for features, weights in segments(text):
                held.append((i, features, weights))
                lines += len(features)
                if lines > 1 << 16:
                    run()
                    lines = 0
        if held:
            run()
        mean = np.clip(good / np.maximum(total, 1), 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(texts) + self.shift)))


def held_out():
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> LineField:
    """Fit on at most ``train_docs`` labelled documents that are not held out, chosen by a hash of doc_id.

    Of a repeated doc_id the first text in order is learnt from; doc_ids with both labels count as good.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).toPandas()
    return LineField.fit(rows["text"].tolist(), rows["quality"].to_numpy())


def score_quality(docs: DataFrame, model: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with columns score and predicted; null texts are empty, empty texts are one empty line."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts = [shared.value.score(batch.iloc[k : k + 1024].tolist()) for k in range(0, len(batch), 1024)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    scored = docs.withColumn("score", score(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; only the text is scored."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
