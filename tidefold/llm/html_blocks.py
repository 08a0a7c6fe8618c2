"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks of text. Each block has a vector of its tag path and hashed words; a
bidirectional LSTM reads the page's blocks in both directions and labels every one as main text or
not. The teacher for the training pages is the markup itself (article and main elements less their
menus, notices and the like); the network is trained by numpy back-propagation.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages the network is trained on, at most.
TRAIN_PAGES = 300
#: Places of a vector: one for each tag of ``TAGS``, hashed names and tag pairs, hashed words, plain measures.
NAMES, WORDS, PLAIN = 64, 16, 8
HIDDEN = 16
ENRICHED = 400
EPOCHS = 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Elements by what HTML does with them.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var wbr math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded"
    " mphantom menclose merror mmultiscripts mprescripts mtable mtr mtd semantics".split()
)
APART = frozenset("nav header footer aside form button select menu dialog option input fieldset legend".split())
#: What a name of an element says when it is noise, alone or with what it is part of before it and details after it.
_WORD = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alerts?|popup|modal|menu|nav\w*|sidebar|side|footer|header"
    r"|comments?|commenter|repl(?:y|ies)|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|breadcrumbs?|pagination|toolbar|widgets?|login|search"
)
NOISE = re.compile(rf"(?:(?:site|page|main|top|bottom|left|right|global|post|user|google|mobile)[-_])*(?:{_WORD})(?:[-_]\w+)*", re.I)
#: Inside a paragraph, an element of such a name is a block of its own, for the network to judge.
INSERTED = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|cookie\w*|share|sharing|newsletter)(?:[-_]\w+)*", re.I)
#: Inline elements that say nothing of their text: named so, they hold adverts and the like; others are words of their paragraph.
HOLDERS = frozenset("span ins font label data".split())
MAIN = frozenset(("article", "main"))
TAGS = tuple(sorted(APART | MAIN | frozenset("html body div section p h1 h2 h3 h4 h5 h6 ul ol li dl dd dt table tbody thead tr td th blockquote pre figure figcaption address center details summary".split())))
_PLACE = {t: i for i, t in enumerate(TAGS)}
PATH = len(TAGS) + NAMES
#: Block elements nested deeper than this count as part of the one around them.
DEPTH = 512


def _names(rest: str) -> str:
    return " ".join(a or b or c for a, b, c in _NAMES.findall(rest)).lower()


#: A leaf of a page: its runs of text in order, each with the block that it belongs to (-1: white space alone).
Leaf = list[tuple[int, str]]


class _Inline:
    """The open inline elements of a leaf: whether one is a link, and the outermost one named as an insertion."""

    def __init__(self):
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.inserted = -1

    def open(self, tag: str, inserted: bool) -> bool:
        """Whether an insertion begins."""
        self.places.setdefault(tag, []).append(len(self.tags))
        begins = inserted and self.inserted < 0
        if begins:
            self.inserted = len(self.tags)
        self.tags.append(tag)
        return begins

    def close(self, tag: str) -> None:
        """End the last element of that tag and all inside it; each is taken off once, so the time is linear."""
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        while len(self.tags) > at:
            self.places[self.tags.pop()].pop()
        if self.inserted >= at:
            self.inserted = -1

    @property
    def linked(self) -> bool:
        return bool(self.places.get("a"))


def read(page: str | None) -> tuple[list[tuple[str, str, int]], list[Leaf]]:
    """The text blocks of a page in order (path of elements with their names, text, characters inside links), and its leaves.

    A leaf is the text between block elements. An inline element named as an insertion is a block of its own
    within it, with that element on its path; what stands around it is one block. The time is linear in
    the page: a path is written only for blocks with text, and block elements deeper than ``DEPTH`` do not lengthen it.
    """
    out: list[tuple[str, str, int]] = []
    found: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    # Text so far as (owner, text): owner 0 is the leaf itself, others are its insertions; their steps and linked characters.
    parts: list[tuple[int, str]] = []
    steps: list[str] = [""]
    linked: list[int] = [0]
    inline = _Inline()
    deeper = 0
    path: str | None = ""
    page = page or ""
    at = 0

    def add(text: str) -> None:
        owner = len(steps) - 1 if inline.inserted >= 0 else 0
        parts.append((owner, text))
        linked[owner] += len(text) if inline.linked else 0

    def flush() -> None:
        nonlocal path
        if not parts:
            return
        raw: dict[int, list[str]] = {}
        leaf: Leaf = []
        for owner, run in groupby(parts, key=lambda p: p[0]):
            text = html.unescape("".join(t for _, t in run))
            leaf.append((owner, text))
            raw.setdefault(owner, []).append(text)
        blocks = {}
        for owner, texts in raw.items():
            if text := _SPACE.sub(" ", "".join(texts)).strip():
                if path is None:
                    path = "/".join(f"{t} {n}" if n else t for t, n in stack)
                blocks[owner] = len(out)
                out.append((f"{path}/{steps[owner]}" if owner else path, text, linked[owner]))
        if blocks:
            found.append([(blocks.get(owner, -1), text) for owner, text in leaf])
        parts.clear()
        steps[1:], linked[:] = [], [0]

    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:
            add(page[at])
            at += 1
            continue
        at = m.end()
        text = m["text"]
        if text is not None:
            add(text)
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        rest = m["rest"] or m["rest2"] or ""
        tag, closing = tag.lower(), m["close"] or m["close2"]
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag in VOID or rest.endswith("/"):
                pass
            elif closing:
                inline.close(tag)
            else:
                names = _names(rest) if "=" in rest else ""
                if inline.open(tag, any(map(INSERTED.fullmatch, names.split()))):
                    steps.append(f"{tag} {names}")
                    linked.append(0)
            continue
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                if tag not in ("script", "style", "annotation", "annotation-xml"):
                    flush()
            continue
        flush()
        inline = _Inline()
        steps[1:], linked[:] = [], [0]
        if closing:
            if deeper and tag not in VOID:
                deeper -= 1
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    path = None
                    break
        elif tag not in VOID:
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("li", "option", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
                stack.pop()
            if len(stack) < DEPTH:
                stack.append((tag, _names(rest)))
            else:
                deeper += 1
            path = None
    flush()
    return out, found


def leaves(page: str | None) -> list[tuple[str, str, int]]:
    """The text blocks of a page in order, see ``read``."""
    return read(page)[0]


def main_text(found: list[Leaf], main: list[bool]) -> str:
    """The runs of blocks labelled main: those of a leaf as they follow each other, white space as one space, leaves joined by line feeds."""
    out = []
    for leaf in found:
        if text := _SPACE.sub(" ", "".join(t for block, t in leaf if block >= 0 and main[block])).strip():
            out.append(text)
    return "\n".join(out)


def _last(path: str) -> tuple[str, str]:
    """The tag of a path's last element, and the path without it."""
    outer, _, step = path.rpartition("/")
    return step.split(" ", 1)[0], outer


#: Characters up to which a run of blocks follows its neighbours on pages without article or main.
SHORT = 25


def teacher(blocks: list[tuple[str, str, int]]) -> np.ndarray:
    """Main text by the markup: inside article or main, if the page has one, and inside nothing set apart or named as noise.

    Without either, blocks are judged in runs of one path by their share of links; a short run also by the nearest longer ones.
    """
    steps = [path.split("/") for path, _, _ in blocks]
    tags = [[s.split(" ", 1)[0] for s in p] for p in steps]
    inside = [any(t in MAIN for t in p) for p in tags]
    named = [[n for t, s in zip(p, q, strict=True) if t not in INLINE or t in HOLDERS for n in s.split(" ")[1:]] for p, q in zip(tags, steps, strict=True)]
    noise = [any(t in APART for t in p) or any(map(NOISE.fullmatch, n)) for p, n in zip(tags, named, strict=True)]
    good = inside if any(inside) else _by_context(blocks, noise)
    return np.array([float(g and not n) for g, n in zip(good, noise, strict=True)])


def _by_context(blocks: list[tuple[str, str, int]], noise: list[bool]) -> list[bool]:
    runs: list[list[int]] = []
    # Words of a paragraph that are a block by their name alone stay in its run.
    last = [_last(path) for path, _, _ in blocks]
    paths = [outer if tag in INLINE and tag not in HOLDERS else path for (tag, outer), (path, _, _) in zip(last, blocks, strict=True)]
    for i, path in enumerate(paths):
        if runs and paths[runs[-1][0]] == path:
            runs[-1].append(i)
        else:
            runs.append([i])
    chars = [sum(len(blocks[i][1]) for i in r) for r in runs]
    good = [not noise[r[0]] and sum(blocks[i][2] for i in r) < 0.5 * n for r, n in zip(runs, chars, strict=True)]
    longer = [j for j, n in enumerate(chars) if n > SHORT]
    out = [False] * len(blocks)
    for j, run in enumerate(runs):
        at = bisect.bisect_left(longer, j)
        near = longer[max(0, at - 1) : at + 1]
        fine = good[j] and (chars[j] > SHORT or not near or any(good[k] for k in near))
        for i in run:
            out[i] = fine
    return out


_paths: dict[str, np.ndarray] = {}
_words: dict[str, int] = {}


def _path_vector(path: str) -> np.ndarray:
    """How often each tag is on a path, and its hashed names, their parts and tag pairs, with signs."""
    if (v := _paths.get(path)) is None:
        if len(_paths) > 20_000:
            _paths.clear()
        v = np.zeros(PATH, dtype=np.float32)
        above = ""
        for step in path.split("/"):
            tag, *names = step.split() or [""]
            if tag in _PLACE:
                v[_PLACE[tag]] += 1.0
            parts = {f".{p}" for n in names for p in (n, *re.split("[-_]", n))}
            for mark in (f"{above}>{tag}", *sorted(parts)):
                h = zlib.crc32(mark.encode("utf-8", "surrogatepass"))
                v[len(TAGS) + h % NAMES] += 1.0 if h & 0x10000 else -1.0
            above = tag
        # Many nested elements of a kind say no more than a few.
        v = np.clip(v, -4, 4)
        _paths[path] = v
    return v


def vectors(blocks: list[tuple[str, str, int]], first: int = 0, total: int | None = None) -> np.ndarray:
    """Path, hashed words and plain measures of blocks that stand from ``first`` on in a page of ``total``."""
    total = total or len(blocks)
    out = np.zeros((len(blocks), PATH + WORDS + PLAIN), dtype=np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        words = text.split(" ")
        out[i, :PATH] = _path_vector(path)
        bins = [_words.get(w) for w in words]
        if None in bins:
            if len(_words) > 500_000:
                _words.clear()
            bins = [_words.setdefault(w, zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS) if b is None else b for w, b in zip(words, bins, strict=True)]
        out[i, PATH : PATH + WORDS] = np.bincount(bins, minlength=WORDS) / len(words)
        out[i, PATH + WORDS :] = (
            np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, min(linked / len(text), 1.0), text[-1] in ".!?…",
            (first + i + 1) / total, path.count("/") / 8, (tag := _last(path)[0]) in HOLDERS, tag in INLINE and tag not in HOLDERS,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Two LSTMs over padded sequences, one per direction, and a logistic layer on both states."""

    def __init__(self, wide: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, 2 * hidden), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, wide**-0.5, (wide, 4 * hidden))
            self.p[f"h{d}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            self.p[f"b{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.hidden = hidden

    def _run(self, x: np.ndarray, there: np.ndarray, d: str, keep: bool = True, state: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """States at every step, a tape if it is to be kept, and the last state; padding leaves the state as it is.

        Gates: in, forget, out, new."""
        n, steps, _ = x.shape
        k, tape = self.hidden, []
        h, c = state or (np.zeros((n, k)), np.zeros((n, k)))
        out = np.zeros((n, steps, k))
        given = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ self.p[f"h{d}"]
            gates, new = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            m = there[:, t, None]
            c2 = f * c + i * new
            th = np.tanh(c2)
            h2 = np.where(m, o * th, h)
            if keep:
                tape.append((t, h, c, i, f, o, new, th, m))
            c, h = np.where(m, c2, c), h2
            out[:, t] = h
        return out, tape, (h, c)

    def score(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(x, there, "f", False)[0], self._run(x, there, "b", False)[0]], axis=2)
        return _sigmoid(states @ self.p["out"] + self.p["bias"])

    def score_long(self, blocks: list[tuple[str, str, int]], part: int) -> np.ndarray:
        """The scores of one page, ``part`` blocks at a time: the state is carried on, so they are those of one run."""
        k, n = self.hidden, len(blocks)
        total = np.full(n, self.p["bias"][0])
        for d, weight in (("f", self.p["out"][:k]), ("b", self.p["out"][k:])):
            state = None
            starts = range(0, n, part)
            for a in starts if d == "f" else reversed(starts):
                x = vectors(blocks[a : a + part], a, n)[None].astype(float)
                out, _, state = self._run(x, np.ones(x.shape[:2], dtype=bool), d, False, state)
                total[a : a + part] += out[0] @ weight
        return _sigmoid(total)

    def gradient(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        k = self.hidden
        runs = {d: self._run(x, there, d) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        error = (_sigmoid(states @ self.p["out"] + self.p["bias"]) - y) * there / there.sum()
        g = {"out": np.einsum("ntk,nt->k", states, error), "bias": np.array([error.sum()])}
        for j, d in enumerate("fb"):
            above = error[:, :, None] * self.p["out"][j * k : (j + 1) * k]
            dz_all = np.zeros((*x.shape[:2], 4 * k))
            gh = np.zeros_like(self.p[f"h{d}"])
            dh, dc = np.zeros((len(x), k)), np.zeros((len(x), k))
            for t, h, c, i, f, o, new, th, m in reversed(runs[d][1]):
                dh = dh + above[:, t]
                live = dh * m
                do, dcell = live * th, dc * m + live * o * (1 - th * th)
                dz = np.concatenate(
                    [dcell * new * i * (1 - i), dcell * c * f * (1 - f), do * o * (1 - o), dcell * i * (1 - new * new)], axis=1
                )
                dz_all[:, t] = dz
                gh += h.T @ dz
                dh = dz @ self.p[f"h{d}"].T + dh * ~m
                dc = dcell * f + dc * ~m
            g[f"h{d}"], g[f"b{d}"] = gh, dz_all.sum(axis=(0, 1))
            g[f"x{d}"] = np.einsum("ntw,ntz->wz", x, dz_all, optimize=True)
        return g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02) -> BiLSTM:
        """Adam on batches of pages of similar length, until three epochs began without an error."""
        first = {n: np.zeros_like(v) for n, v in self.p.items()}
        second = {n: np.zeros_like(v) for n, v in self.p.items()}
        batches = [(_padded([pages[i] for i in b]), _padded([labels[i][:, None] for i in b])[0][:, :, 0]) for b in batched([len(p) for p in pages], 32, 1 << 13)]
        step = sure = 0
        for _ in range(epochs):
            if step and all(((self.score(x, there) >= 0.5) == y)[there].all() for (x, there), y in batches):
                sure += 1
                if sure == 3:
                    break
            for (x, there), y in batches:
                step += 1
                for n, g in self.gradient(x, there, y).items():
                    g = np.clip(g, -1, 1)
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.99 * second[n] + 0.01 * g * g
                    self.p[n] = self.p[n] - rate * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
        return self


def batched(sizes: list[int], many: int, cells: int) -> Iterator[list[int]]:
    """Indices of non-empty sequences in groups of similar length, bounded in number and padded size."""
    group: list[int] = []
    for i in sorted((i for i in range(len(sizes)) if sizes[i]), key=sizes.__getitem__):
        if group and (len(group) == many or sizes[i] * (len(group) + 1) > cells):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _padded(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in items])
    out = np.zeros((len(items), sizes.max(), items[0].shape[1]))
    for i, x in enumerate(items):
        out[i, : len(x)] = x
    return out, np.arange(sizes.max()) < sizes[:, None]


#: Boilerplate that training pages get besides their own, so that the network meets kinds they lack.
EXTRA = tuple(
    [f"{t}{e}" for t in ("nav", "header", "footer", "aside", "form", "menu", "dialog") for e in ("", "/p", "/ul/li", "/div")]
    + [f"div {n}{t}" for n in ("ad", "advert", "sponsored", "cookie-notice", "notice", "banner", "popup", "sidebar", "menu", "comments",
                                "comment-list", "replies", "share", "related", "newsletter", "breadcrumb", "login", "promo") for t in ("", "/p", "/ul/li", "/div", "/h3")]
    + ["section comments/article comment/p", "ul menu/li", "form search/div", "div cookie"]
)


#: Names of insertions in paragraphs.
INSERTIONS = ("ad", "ads", "advert", "ad-unit", "adsbygoogle", "sponsored", "promo", "promo-box", "share", "sharing", "newsletter", "cookie", "cookie-hint")

#: Main text that training pages get inside their article, of kinds that they may lack.
WITHIN = ("figure/figcaption", "figure/pre", "figure/table/tr/td", "figure/blockquote/p", "figure/p", "figure", "pre", "table/tr/td", "blockquote/p", "ul/li", "h2", "h3", "dl/dd")


def enriched(pages: list[list[tuple[str, str, int]]], seed: int = 5) -> list[list[tuple[str, str, int]]]:
    """Pages again, each at least once and ``ENRICHED`` in all, with boilerplate put in under the body or inside the main text."""
    rng = np.random.default_rng(seed)
    texts = [b[1] for p in pages for b in p]
    out = list(pages)
    for i in range(max(len(pages), ENRICHED if pages else 0)):
        page = list(pages[i % len(pages)])
        kind = rng.random()
        if kind < 0.45:
            # Main elements, and pages without either, whose teacher goes by context.
            page = [(re.sub(r"\barticle\b", "main" if kind < 0.25 else "div", path), text, linked) for path, text, linked in page]
        for _ in range(int(rng.integers(1, 6))):
            at = int(rng.integers(0, len(page) + 1))
            near = page[min(at, len(page) - 1)][0].rpartition("/")[0]
            path = EXTRA[int(rng.integers(len(EXTRA)))]
            path = f"{near}/{path}" if near and rng.random() < 0.6 else f"html/body/{path}"
            for _ in range(int(rng.integers(1, 4))):
                text = texts[int(rng.integers(len(texts)))]
                text = " ".join(text.split(" ")[: int(rng.integers(1, 5))]) if rng.random() < 0.4 else text
                page.insert(at, (path, text, int(rng.choice([0, len(text)]))))
        main = [j for j, b in enumerate(page) if b[0].rpartition("/")[0].rpartition("/")[2].split(" ")[0] in MAIN]
        for j in sorted(rng.choice(main, size=min(len(main), int(rng.integers(0, 4))), replace=False).tolist() if main else [], reverse=True):
            text = texts[int(rng.integers(len(texts)))]
            text = " ".join(text.split(" ")[: int(rng.integers(1, 5))]) if rng.random() < 0.4 else text
            page.insert(j + int(rng.integers(2)), (f"{page[j][0].rpartition('/')[0]}/{WITHIN[int(rng.integers(len(WITHIN)))]}", text, 0))
        out.append(page)
    return out


def skeletons(many: int = 120, seed: int = 9) -> list[list[tuple[str, str, int]]]:
    """Plain pages made by rule, with which the network is trained beside the sampled ones, however few these are."""
    rng, other = np.random.default_rng(seed), np.random.default_rng(seed + 1)
    words = "the of and in to a is that for on with as by at from this it was are be or an which were their has more".split()

    def text(n: int) -> str:
        return " ".join(rng.choice(words, size=n)).capitalize() + "."

    def inserted(path: str) -> list[tuple[str, str, int]]:
        """In three paragraphs of ten an advert in an element that says nothing else, or words of the paragraph that happen to be named so."""
        if other.random() >= 0.3:
            return []
        tags = ("span", "span", "ins", "label") if other.random() < 0.5 else ("a", "code", "em", "b", "i", "cite", "strong", "mark", "q")
        tag, name = tags[int(other.integers(len(tags)))], INSERTIONS[int(other.integers(len(INSERTIONS)))]
        said = " ".join(other.choice(words, size=int(other.choice([1, 2, 4, 12]))))
        said = said.upper() if other.random() < 0.3 else said
        return [(f"{path}/{tag} {name}", said, len(said) if tag == "a" or other.random() < 0.2 else 0)]

    out = []
    for _ in range(many):
        around = ("html/body/article", "html/body/main", "article", "div/article", "html/body/div/article", "html/body/div", "html/body/div content", "html/body")[int(rng.integers(8))]
        page = [("html/body/nav/ul/li", w, len(w)) for w in rng.choice(words, size=int(rng.integers(0, 6)))]
        page += [("html/body/header/h1", text(3), 0)] if rng.random() < 0.5 else []
        page.append((f"{around}/h1", text(int(rng.integers(1, 9))), 0))
        for _ in range(int(rng.integers(1, 9))):
            inner = f"{around}/{('p', 'p', 'p', 'div article-header/h2', 'ul/li', 'blockquote/p', 'h2')[int(rng.integers(7))]}"
            page.append((inner, text(int(rng.choice([1, 2, 5, 30, 120]))), 0))
            page += inserted(inner)
            if rng.random() < 0.25:
                noise = text(int(rng.choice([1, 2, 12])))
                page.append((f"{around}/{EXTRA[int(rng.integers(len(EXTRA)))]}", noise, int(rng.choice([0, len(noise)]))))
        page += [("html/body/footer/p", text(4), 0)] if rng.random() < 0.7 else []
        out.append(page)
    return out


def fit_labeller(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> BiLSTM:
    """Train on at most ``train_pages`` pages that are not null or empty, chosen by a hash, and on ``skeletons``.

    A cut in the hash leaves a few times as many before the sort, so that tasks send few pages to the driver.
    """
    some = pages.where("html is not null and html <> ''")
    pick = F.xxhash64("page_id", "html")
    share = min(1.0, 4 * train_pages / max(1, some.count()))
    some = some.where(F.pmod(pick, F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = some.select("html", pick.alias("h")).orderBy("h").limit(train_pages).toPandas()
    # Pages of very many blocks are extracted, but not learnt from: they would be most of the training.
    made = enriched([b for b in map(leaves, rows["html"]) if 0 < len(b) <= LONG] + skeletons())
    return BiLSTM(PATH + WORDS + PLAIN).fit([vectors(b) for b in made], [teacher(b) for b in made])


#: Blocks of a page that are scored together; longer pages are scored part by part.
LONG = 4096


def extract(model: BiLSTM, texts: list[str | None]) -> list[str]:
    """The main text of each page: its leaves as far as their blocks are labelled main, joined by line feeds."""
    pages = [read(t) for t in texts]
    made = [blocks for blocks, _ in pages]
    out = [""] * len(made)
    sizes = [len(b) if len(b) <= LONG else 0 for b in made]
    for group in batched(sizes, 256, 1 << 14):
        x, there = _padded([vectors(made[i]) for i in group])
        main = model.score(x, there) >= 0.5
        for row, i in enumerate(group):
            out[i] = main_text(pages[i][1], main[row].tolist())
    for i, blocks in enumerate(made):
        if len(blocks) > LONG:
            out[i] = main_text(pages[i][1], (model.score_long(blocks, LONG) >= 0.5).tolist())
    return out


def extract_text(pages: DataFrame, model: BiLSTM | None = None) -> DataFrame:
    """(page_id, url, html) -> per row: page_id, url, text, n_chars; null html is empty and gives an empty text.

    Repeated rows give a row each; other columns are ignored; an empty table gives no rows. Block elements
    nested deeper than ``DEPTH`` count as part of the one around them, inline ones have no limit; a page of any number of blocks is read whole.
    """
    model = model or fit_labeller(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([t for k in range(0, len(batch), 512) for t in extract(shared.value, batch.iloc[k : k + 512].tolist())], dtype="object")

    out = pages.select("page_id", "url", text(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
