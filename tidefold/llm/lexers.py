"""Whole-text encoding with public tokenizers, cached by white-space-delimited chunk.

Both vocabularies split texts into pre-tokens before merging, and no pre-token crosses the chunk
borders used here, so a chunk's ids are the same in any text. Arrow splits the texts of a batch and
finds its distinct chunks; the library encodes those that are not cached yet, all in one call; numpy
gathers every text's ids. Texts with anything out of the ordinary (special-token strings, characters
beyond those of ``_LETTER_RANGES``, control characters, runs of white space where they count) go to
the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Distinct chunks and pre-tokens that a process keeps, and the characters of texts that are split together.
CACHE = 500_000
GROUP_CHARS = 4_000_000

#: Stands between chunks or pieces; texts that hold it go to the library whole.
_CUT = "\x00"
#: Bytes of a Latin-1 text whose splitting is certain: no controls but tab, line feeds and the like.
_CERTAIN = bytes(b for b in range(256) if b not in {*range(9), *range(14, 32), 0x7F, *range(0x80, 0xA0)})
_SINGLE = bytes(b for b in _CERTAIN if b not in b"\t\r\x0b\x0c\xa0")
#: Precomposed letters and punctuation that normal forms leave alone and that lower one by one.
_LETTER_RANGES = "Ā-įı-ſ‐-―‘-‟•…€™"
_BEYOND = re.compile(f"[{_LETTER_RANGES}]+")
#: How the two vocabularies split a text into pre-tokens.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a vocabulary: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = byte_letters()


def lettered(piece: str) -> str:
    """A piece of text as the letters of its UTF-8 bytes."""
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one range after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not total or int(starts.max()) < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


class ChunkEncoder:
    """ids of whole texts; about ``CACHE`` chunks and pre-tokens are kept, with their ids one after another in an array."""

    _open: dict[str, ChunkEncoder] = {}

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.library.no_padding()
        self.library.no_truncation()
        #: Whether white space is part of the ids (byte-level) or dropped (word ends).
        self.spaces = self.library.model.end_of_word_suffix is None
        #: The same merges without normaliser and splitter, for pieces that are ready.
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        suffix = len(self.library.model.end_of_word_suffix or "")
        #: How many letters each id stands for.
        vocabulary = self.library.get_vocab()
        self.letters = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for string, i in vocabulary.items():
            self.letters[i] = len(string) - (suffix if suffix and string.endswith(self.library.model.end_of_word_suffix) else 0)
        self._clear()

    @classmethod
    def of(cls, name: str) -> ChunkEncoder:
        """One encoder for each process and vocabulary, so that tasks share its cache."""
        if name not in cls._open:
            cls._open[name] = cls(name)
        return cls._open[name]

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        #: In how many groups of texts an entry was met.
        self.uses = np.zeros(1 << 14, dtype=np.int32)

    def _forget(self) -> None:
        """Keep the entries met in several groups, at most half of the cache; single ones are most of a corpus's words."""
        keys, uses = list(self.cache), self.uses[: len(self.cache)].copy()
        kept = np.sort(np.argsort(-uses, kind="stable")[: min(CACHE // 2, int((uses > 1).sum()))])
        ids, sizes = self._gather(kept)
        self._clear()
        self._keep([keys[i] for i in kept], ids, sizes)
        self.uses[: len(kept)] = uses[kept] // 2

    def whole(self, text: str) -> np.ndarray:
        """The ids of one text by the library alone."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The places of distinct chunks in the cache; those that are missing are encoded and kept."""
        if len(self.cache) > CACHE:
            self._forget()
        found = list(map(self.cache.get, chunks))
        if None not in found:
            number = np.array(found, dtype=np.int64)
            self.uses[number] += 1
            return number
        gaps = [i for i, f in enumerate(found) if f is None]
        split = (BYTE_LEVEL if self.spaces else WORD_LEVEL).findall
        pieces, ends, several = [], [], []
        for i in gaps:
            chunk = chunks[i]
            if chunk.isalpha() or (self.spaces and chunk[:1] == " " and chunk[1:].isalpha()):
                pieces.append(chunk)
            else:
                many = split(chunk)
                pieces += many
                if len(many) != 1:
                    several.append(i)
            ends.append(len(pieces))
        at = list(map(self.cache.get, pieces))
        if None in at:
            self._learn(list({p: None for p, a in zip(pieces, at, strict=True) if a is None}))
            at = [self.cache[p] if a is None else a for p, a in zip(pieces, at, strict=True)]
        place = np.array(at, dtype=np.int64)
        ends = np.array(ends, dtype=np.int64)
        number = np.array([-1 if f is None else f for f in found], dtype=np.int64)
        # A chunk of one piece is that piece; chunks of several, or of none, get an entry of their own.
        single = number < 0
        single[several] = False
        number[single] = place[ends[single[gaps]] - 1]
        if several:
            own = ~single[gaps]
            counts = np.diff(ends, prepend=0)[own]
            ids, sizes = self._gather(place[ranges(ends[own] - counts, counts)])
            cuts = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
            number[several] = len(self.cache) + np.arange(len(several))
            self._keep([chunks[i] for i in several], ids, np.diff(cuts, prepend=0))
        self.uses[number] += 1
        np.add.at(self.uses, place, 1)
        return number

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.ends[at]
        sizes = self.ends[at + 1] - first
        return self.ids[ranges(first, sizes)], sizes

    def _learn(self, pieces: list[str]) -> None:
        """Encode distinct pre-tokens by one call of the library and keep them."""
        letters = lettered(_CUT.join(pieces)).replace(_LETTERS[0], " ")
        ids = np.array(self.merges.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
        size = np.array([len(p) if p.isascii() else len(p.encode()) for p in pieces], dtype=np.int64)
        ends = np.searchsorted(np.cumsum(self.letters[ids]), np.cumsum(size), side="right")
        if ends[-1] != len(ids):
            raise ValueError("the vocabulary lacks a byte")
        self._keep(pieces, ids, np.diff(ends, prepend=0))

    def _keep(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known, held = len(self.cache), int(self.ends[len(self.cache)])
        self.ids = _room(self.ids, held + len(ids))
        self.ends = _room(self.ends, known + len(keys) + 1)
        self.uses = _room(self.uses, known + len(keys))
        self.ids[held : held + len(ids)] = ids
        self.ends[known + 1 : known + 1 + len(keys)] = held + np.cumsum(sizes)
        self.cache.update(zip(keys, range(known, known + len(keys)), strict=True))

    def plain(self, text: str) -> bool:
        """Whether chunk borders are certain; at byte level also single blanks inside only."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            try:
                raw = _BEYOND.sub("", text).encode("latin-1")
            except UnicodeEncodeError:
                return False
        if raw.translate(None, _SINGLE if self.spaces else _CERTAIN) or "<|" in text:
            return False
        if not self.spaces:
            return True
        rough = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        return not (rough or text[0] in " \n" or text[-1] in " \n")

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; null is the empty text."""
        ids, sizes, group, held = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)], [], 0
        for text in texts:
            if group and held + len(text or "") > GROUP_CHARS:
                self._group(group, ids, sizes)
                group, held = [], 0
            group.append(text)
            held += len(text or "")
        if group:
            self._group(group, ids, sizes)
        return np.concatenate(ids), np.concatenate(sizes)

    def _group(self, texts: list[str | None], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        odd, ready = {}, []
        for i, text in enumerate(texts):
            if not text:
                ready.append(None)
            elif not self.plain(text):
                odd[i] = self.whole(text)
                ready.append(None)
            elif self.spaces:
                ready.append(text.replace("\n", f"{_CUT}\n").replace(" ", f"{_CUT} "))
            else:
                ready.append(text.lower().replace("\xa0", " "))
        column = pa.array(ready, pa.large_string())
        lists = pc.split_pattern(column, _CUT) if self.spaces else pc.ascii_split_whitespace(column)
        counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        distinct = pc.dictionary_encode(lists.flatten())
        number = self._numbers(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, size_of = self._gather(number[distinct.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(size_of)])[np.cumsum(counts)]
        own = np.diff(ends, prepend=0)
        if odd:
            parts = np.split(flat, ends[:-1])
            for i, whole in odd.items():
                parts[i], own[i] = whole, len(whole)
            flat = np.concatenate(parts)
        ids.append(flat)
        sizes.append(own)
        # Executors are sized tightly: what Arrow keeps for later goes back.
        del column, lists, distinct
        pa.default_memory_pool().release_unused()


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or a larger copy, with room for n items."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), dtype=array.dtype)])
