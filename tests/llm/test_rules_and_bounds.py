"""Whitening, hard negatives and quality rules against brute force, and on awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import line_rules, negatives, whitening


def odd_vectors(size):
    one = [0.5 - 0.01 * i for i in range(size)]
    return [
        (1001, None, 1), (1002, [], 1), (1003, [float("nan"), *one[1:]], 1), (1004, [float("inf"), *one[1:]], 1), (1005, [None, *one[1:]], 1), (1006, one[1:], 1),
        (1050, one, 3), (1051, one, 3), (1052, one, 4), (1053, one, 4), (1054, [0.0] * size, 3), (1056, [1.5 * x for x in one], 5), (1100, one, 4), (1057, [0.8 * x for x in one], 9),
        (1150, [-x for x in one], 3), (1151, [-x for x in one], 3),
    ]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    size = 12
    centres = rng.normal(size=(6, size))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + 0.3 * rng.normal(size=size))], int(rng.integers(0, 10))) for i in range(400)]
    table = spark.createDataFrame(rows + odd_vectors(size) + [(1200, rows[0][1], None)], "vec_id bigint, embedding array<float>, label int")
    return table.selectExpr("*", "1 as cell", "2 as n", "'x' as v").repartition(5)


# ---- whitening ----


def fitted(rows):
    return [(r.vec_id, np.floor(1024 * np.array(r.embedding, dtype=np.float64)).astype(np.int64) + 100_000) for r in rows]


def check_whitened(got, fit):
    n, x = len(fit), np.array([v for _, v in fit])
    s = x.sum(axis=0)
    v = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = defaultdict(list)
    for r in got:
        assert r.n == n and abs(r.identity_error) < 1e-9
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(v), rel_tol=1e-9)
        by[r.component].append((r.vec_id, r.whitened, r.deviation))
    for c, rows in by.items():
        want = sorted((i, float((row - s / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1])), int(((n * row - s) ** 2).sum())) for i, row in fit)
        rows.sort()
        assert [(i, d) for i, _, d in rows] == [(i, d) for i, _, d in want]
        a, b = np.array([w for _, w, _ in rows]), np.array([w for _, w, _ in want])
        gap = min(abs(values[c - 1] - values[j]) for j in (c - 2, c) if 0 <= j < len(values)) / values[0]
        if gap > 1e-6:
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7 / gap
    return set(by)


def test_whitening(spark, vectors, sf):
    usable = [r for r in vectors.collect() if r.embedding and len(r.embedding) == 12 and None not in r.embedding and np.isfinite(r.embedding).all()]
    got = whitening.whiten(vectors)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert check_whitened(got.collect(), fitted(usable)) == set(range(1, 9))
    given = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert check_whitened(whitening.whiten(given).collect(), fitted(given.collect())) == set(range(1, 9))


def test_whitening_of_few_directions(spark):
    """Fewer dimensions or directions than components, equal eigenvalues, repeated and null ids, nothing at all."""
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    plane = [(None, [1.0, 0.0, 2.0]), (1, [-1.0, 0.0, 2.0]), (1, [0.0, 1.0, 2.0]), (2, [0.0, -1.0, 2.0])]
    got = whitening.whiten(make(plane)).collect()
    assert len(got) == 8 and {r.component for r in got} == {1, 2} and all(math.isclose(r.explained, 0.5) and abs(r.identity_error) < 1e-12 for r in got)
    assert whitening.whiten(make([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0
    assert whitening.whiten(make([])).count() == 0
    wide = whitening.whiten(make([(i, [float(i % 7) * 2.0**40, float(i % 5)]) for i in range(100)])).collect()
    assert {r.component for r in wide} == {1, 2} and all(r.deviation is None and r.deviation_exact > 2**63 for r in wide if r.component == 1 and r.vec_id % 7 == 0)
    with pytest.raises(Exception, match="62 bits"):
        whitening.whiten(make([(1, [1e30]), (2, [0.0])])).count()


def test_polynomial_and_roots(spark):
    """Against integer matrices of known eigenvalues, with multiple and close ones."""
    rng = np.random.default_rng(5)
    # Householder reflections scaled to integers: H = (v.v) I - 2 v v' has H H = (v.v)^2 I.
    v = rng.integers(-3, 4, 7)
    v[0] = 2
    h = int(v @ v) * np.eye(7, dtype=object) - 2 * np.outer(v, v).astype(object)
    eigen = [9, 9, 9, 5, 4, 4, 0]
    m = (h @ np.diag(np.array(eigen, dtype=object)) @ h).tolist()
    scale = int(v @ v) ** 2
    c = whitening.characteristic_polynomial(spark, m)
    want = np.array([1], dtype=object)
    for e in eigen:
        want = np.convolve(want, np.array([1, -e * scale], dtype=object))
    assert c == [int(x) for x in want[::-1]]
    roots = whitening.largest_roots(c, 8)
    assert len(roots) == 6 and all(abs((2 * a + 1) / (2 << s) - e * scale) <= 1e-30 * e * scale + 1 / (1 << s) for (a, s), e in zip(roots, eigen, strict=False))
    values, axes = whitening.components(spark, m)
    axes = np.array(axes)
    assert np.abs(axes @ axes.T - np.eye(6)).max() < 1e-14
    assert np.abs(np.array(m, dtype=float) @ axes.T - axes.T * [float(x) for x in values]).max() < 1e-9 * scale


# ---- hard negatives ----


def brute_negatives(rows):
    seen = {}
    for r in rows:
        if r.vec_id is not None and r.label is not None and r.embedding and len(r.embedding) == 12 and None not in r.embedding and np.isfinite(r.embedding).all():
            label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
            seen.setdefault(r.vec_id, (label, np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(np.int64)))
    out = []
    for a, (label, q) in seen.items():
        if a % 50:
            continue
        ranked = sorted(((int(q @ v), i) for i, (_, v) in seen.items() if i != a), key=lambda x: (-x[0], x[1]))
        for p, i in [(s, i) for s, i in ranked if seen[i][0] == label][:5]:
            hits = [(s, j) for s, j in ranked if seen[j][0] != label and 50 * p <= 100 * s <= 95 * p][:3]
            out += [(a, i, k + 1, j, p, s) for k, (s, j) in enumerate(hits)]
    return sorted(out)


def test_hard_negatives(spark, vectors, sf):
    want = brute_negatives(vectors.collect())
    for size, block in ((4096, 512), (40, 3)):
        got = negatives.hard_negatives(vectors, shard_rows=size, block_rows=block)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(tuple(r) for r in got.collect()) == want
    assert negatives.hard_negatives(vectors.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    given = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert sorted(tuple(r) for r in negatives.hard_negatives(given, shard_rows=64, block_rows=4).collect()) == sorted(con.execute(negatives.ORACLE_SQL).fetchall())


def test_hard_negatives_of_near_copies(spark):
    """Anchors in branches of near copies, with products in single floats, in floats and in whole numbers."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 12))
    x = centres[rng.integers(0, 8, 400)] + 0.02 * rng.normal(size=(400, 12))
    for scale in (1, 2**10, 2**17):
        rows = [(i, [float(c) for c in scale * v / 4], int(i * 7919 % 3)) for i, v in enumerate(x)] + [(1000 + i, [float(c) for c in scale * x[0] / 4], i % 2) for i in range(60)]
        table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
        got = sorted(tuple(r) for r in negatives.hard_negatives(table, shard_rows=64, block_rows=8).collect())
        assert got and got == brute_negatives(table.collect())


def test_branches_keep_near_their_head():
    rng = np.random.default_rng(9)
    points = (300 * rng.normal(size=(5, 16)))[rng.integers(0, 5, 40)] + rng.normal(size=(40, 16))
    head, away = negatives.branches(points, negatives.spanning_tree(points))
    assert len(set(head)) == 5 and (head[head] == head).all()
    assert np.allclose(away, np.linalg.norm(points - points[head], axis=1)) and (away <= np.linalg.norm(points[head], axis=1) / 4).all()


def test_bounds_spare_candidates():
    """On clustered rows most candidates are dropped by the tree's bounds, and bounds hold at every depth."""
    rng = np.random.default_rng(2)
    centres = rng.normal(scale=300, size=(20, 16))
    rows = (centres[rng.integers(0, 20, 2000)] + rng.normal(scale=5, size=(2000, 16))).astype(np.int64)
    anchors = (centres[rng.integers(0, 20, 60)] + rng.normal(scale=5, size=(60, 16))).astype(np.int64)
    exact = anchors @ rows.T
    floors = np.sort(exact, axis=1)[:, -5]
    scored = 0

    def wanted(here, low, high):
        assert (low <= exact[here] + 1e-3).all() and (high >= exact[here] - 1e-3).all()
        return high >= floors[here][:, None]

    for here, scores, hit in negatives.bounded(anchors, negatives.spanning_tree(anchors), rows, wanted):
        assert (scores[hit] == exact[here][hit]).all() and (exact[here][~hit] < floors[here][:, None].repeat(2000, 1)[~hit]).all()
        scored += hit.sum()
    assert scored < 0.3 * exact.size


# ---- quality rules ----


def brute_rules(rows, limit=10, loss=50):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda x: re.sub("[1-9]", "0", " ".join(words(x))).lower()
    docs = [(i, t or "", h) for i, t, h in rows]
    count = Counter((h, line) for _, t, h in docs for line in {norm(x) for x in t.split("\n") if words(x)})
    out = []
    for i, t, h in docs:
        w = words(t)
        win = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        n = Counter(win)
        repeat = len({j + k for j, x in enumerate(win) if n[x] > 1 for k in range(5)})
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * repeat > 20 * len(w)
        gone = sum(len(words(x)) for x in lines if count[h, norm(x)] > limit)
        kept = not failed and 100 * gone <= loss * len(w) and len(w) - gone >= 10
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, failed, kept, gone))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rule_rows():
    rng = random.Random(4)
    vocabulary = [f"wörd{i}" for i in range(60)] + ["ÄÖ", "😀", "a|b", "<x>", "7", "12%"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    notice = ["Subscribe to our Newsletter 2024", "All rights reserved.", "one two three four five six seven"]
    rows = []
    for i in range(300):
        lines = [say(rng.randint(1, 12)) for _ in range(rng.randint(0, 6))] + [re.sub("4", str(rng.randint(1, 9)), x) for x in notice if rng.random() < 0.4]
        rng.shuffle(lines)
        rows.append((i, rng.choice(["\n", "\n\n", "\r\n", " \n\t"]).join(lines), rng.choice(["a", "a", "a", "b", None])))
    same = say(40)
    rows += [(1000 + i, same, "b") for i in range(15)] + [(1100 + i, same, "c") for i in range(5)]
    long = say(30)
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, " \n\x0b\t", None), (None, say(30), "a"), (2003, say(30), "a"), (2003, say(30), "a"), (2004, "x " * 60_000, "a"), (2005, long + " " + long, "a")]
    rows += [(2006, "word", "a"), (2007, "  no break " * 20, "a"), (2008, "a b c d e a b c d e", "a"), (2009, "x x x x x x x x x x x x", "a"), (2010, say(300_000), "b")]
    return rows


def test_quality_rules(spark, rule_rows):
    docs = spark.createDataFrame([(i, t, h, 1, "k", 2) for i, t, h in rule_rows], "doc_id bigint, text string, source string, row int, lines string, kept int").repartition(5)
    got = line_rules.quality_rules(docs)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_rules(rule_rows)
    assert line_rules.quality_rules(docs.limit(0)).count() == 0


def test_text_without_frequent_lines(spark, rule_rows):
    docs = spark.createDataFrame([(i, t, h, 1) for i, t, h in rule_rows], "doc_id bigint, text string, source string, row int")
    norm = lambda x: re.sub("[1-9]", "0", " ".join(re.findall(r"[^\x20\x09-\x0D]+", x))).lower()
    count = Counter((h, line) for _, t, h in rule_rows for line in {norm(x) for x in (t or "").split("\n")} - {""})
    want = [(i, t and "\n".join(x for x in t.split("\n") if count[h, norm(x)] <= 10), h, 1) for i, t, h in rule_rows]
    got = line_rules.without_frequent_lines(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_rules_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = line_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))
    want = con.execute(f"select {', '.join(got.columns)} from ({line_rules.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.where(F.col("kept")).count() > 0.7 * got.count()
