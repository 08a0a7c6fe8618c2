"""Byte-pair encoding: a priority queue of merge ranks over a doubly linked symbol list.

Encoding pushes every mergeable neighbour pair with its rank and place; a popped entry whose symbols
have changed meanwhile is stale and skipped. Decoding joins vocabulary strings. Words repeat, so each
process keeps the results of the last ``CACHE`` words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .lexers import WORD_LEVEL, lettered, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
CACHE = 1_000_000
#: Unicode white space.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


class Codec:
    """One vocabulary with word ends: lower case, NFC, white space dropped."""

    _open: dict[str, Codec] = {}

    def __init__(self, name: str):
        with open(tokenizer_path(name), encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.border = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cache: dict[str, tuple[int, str, str]] = {}

    @classmethod
    def of(cls, name: str) -> Codec:
        """One codec for each process and vocabulary."""
        if name not in cls._open:
            cls._open[name] = cls(name)
        return cls._open[name]

    def merge(self, piece: str) -> list[int]:
        """The ids of one pre-token, given as the letters of its bytes."""
        symbols = [*piece[:-1], piece[-1] + self.end]
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        merges = self.merges
        queue = [(found[0], i, found[1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or merges.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i] = new
            alive[j] = False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, found[1]))
        return [t for t, there in zip(ids, alive, strict=True) if there]

    def _words(self, text: str) -> list[str]:
        """White-space-delimited words, normalised; letters are lowered one by one, without regard to neighbours."""
        if text.isascii():
            return SPACE.split(text.lower())
        text = unicodedata.normalize("NFC", text)
        return SPACE.split(text.lower() if "Σ" not in text else "".join(map(str.lower, text)))

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = [t for piece in WORD_LEVEL.findall(word) for t in self.merge(lettered(piece))]
        return len(ids), " ".join(map(str, ids)), " ".join(self.strings[t] for t in ids)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids joined by blanks, and the decoded text of a whole text."""
        found = []
        for part in self.border.split(text or ""):
            if part in self.special:
                found.append((1, str(self.special[part]), part))
                continue
            words = self._words(part)
            got = list(map(self.cache.get, words))
            if None in got:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                for i, (w, g) in enumerate(zip(words, got, strict=True)):
                    if g is None:
                        got[i] = self.cache[w] = self.cache.get(w) or self._word(w)
            found += [g for g in got if g[0]]
        return sum(g[0] for g in found), " ".join([g[1] for g in found]), " ".join([g[2] for g in found])

    def encode(self, text: str | None) -> list[int]:
        return [int(t) for t in self.digest(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by blanks, as a vocabulary without a decoder is read back; unknown ids are skipped."""
        return " ".join(self.strings[t] for t in ids if t in self.strings)


def bpe_digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) -> per row: doc_id, n_tokens, ids_sha256, decoded_sha256; null texts are empty.

    Decoded strings are those of the ids. Repeated rows give a row each; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(tokenizer)
        for frame in frames:
            out = []
            for text in frame["text"]:
                n, ids, decoded = codec.digest(text)
                out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            done = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield done.assign(doc_id=frame["doc_id"].to_numpy())[["doc_id", *done.columns]]

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
