"""Vector searches against brute force, and the pipeline against its stages' own rules."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidefold.llm import ann, cells, negatives, simhash, topk


@pytest.fixture(scope="module")
def vectors(spark, sf):
    """The given vectors, and awkward ones: null, empty, zero, NaN, infinite, repeated, equal."""
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    size = len(base.first()["embedding"])
    rng = np.random.default_rng(0)
    one = [float(x) for x in rng.normal(size=size).astype("f4")]
    odd = [(10**6, None), (10**6 + 1, [0.0] * size), (10**6 + 2, [float("nan")] * size), (10**6 + 3, [float("inf")] + one[1:]), (None, one), (10**6 + 4, [None] + one[1:])]
    odd += [(10**6 + 50 + i, one) for i in range(60)] + [(10**6 + 51, one)]
    return base.select("vec_id", "embedding").union(spark.createDataFrame(odd, "vec_id bigint, embedding array<float>")).selectExpr("*", "1 as leaf", "2 as block")


def clean(vectors, zero):
    rows = {r.vec_id: r.embedding for r in vectors.collect() if r.vec_id is not None and r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all()}
    rows = {i: v for i, v in rows.items() if zero or np.any(v)}
    ids = np.array(sorted(rows))
    return ids, np.array([rows[i] for i in ids], dtype=np.float64)


def best(ids, scores, own):
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != own][:5]
    return [(int(ids[j]), scores[j]) for j in order]


def test_exact_top_k(vectors, sf, spark):
    ids, x = clean(vectors, True)
    x = np.floor(256 * x).astype(np.int64)
    want = sorted((int(q), r + 1, i, int(s)) for q, v in zip(ids, x, strict=True) if q % 50 == 0 for r, (i, s) in enumerate(best(ids, x @ v, q)))
    got = sorted(tuple(r) for r in topk.exact_top_k(vectors, shard_rows=64, block_rows=4).collect())
    assert got == want
    assert topk.exact_top_k(vectors.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    twin = sorted(con.execute(topk.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in topk.exact_top_k(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()) == twin


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_larger_tables(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    ids, x = clean(table, False)
    norms = np.linalg.norm(x, axis=1)
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len({i for i, _ in best(ids, x @ v / (norms * n), q)} & got[int(q)]) for q, v, n in zip(ids, x, norms, strict=True) if q % 50 == 0]
    assert sum(hits) / (5 * len(hits)) >= 0.9, sum(hits) / (5 * len(hits))


def test_few_pairs_move(spark, monkeypatch):
    """On clustered vectors a block of queries meets under a tenth of all shards, and the result is exact."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(32, 12))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    own = np.repeat(np.arange(32), 250)
    x = np.floor(256 * (centres[own] + 0.01 * rng.normal(size=(8000, 12)))) / 256
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")
    seen = {"pairs": 0}
    meet, deal = cells.Dealt.meet, topk.deal

    def counted(self, work):
        out = meet(self, work)
        seen["pairs"] += out.count()
        return out

    def kept(*args):
        seen["dealt"] = deal(*args)
        return seen["dealt"]

    monkeypatch.setattr(cells.Dealt, "meet", counted)
    monkeypatch.setattr(topk, "deal", kept)
    got = sorted(tuple(r) for r in topk.exact_top_k(table, shard_rows=125, block_rows=8).collect())
    whole = np.floor(256 * x).astype(np.int64)
    ids = np.arange(8000)
    assert got == sorted((q, r + 1, i, int(s)) for q in range(0, 8000, 50) for r, (i, s) in enumerate(best(ids, whole @ whole[q], q)))
    every = seen["dealt"].blocks.count() * seen["dealt"].stored.count()
    assert seen["pairs"] < 0.1 * every, (seen["pairs"], every)


def shards_moved(spark, monkeypatch, operator, column):
    """How many rows with a shard's vectors each search of ``operator`` reads, and how many pairs of a block and a shard they are for."""
    frame, real, meet, seen = type(spark.range(0)), type(spark.range(0)).mapInPandas, cells.Dealt.meet, {"moved": [], "pairs": []}

    def spied(self, run, schema, *rest, **more):
        if {"anchors", column} <= set(self.columns):
            seen["moved"].append(self.where(f"{column} is not null").count())
        return real(self, run, schema, *rest, **more)

    def counted(self, work):
        out = meet(self, work)
        seen["pairs"].append(out.count())
        return out

    monkeypatch.setattr(frame, "mapInPandas", spied)
    monkeypatch.setattr(cells.Dealt, "meet", counted)
    operator().collect()
    return seen


def test_a_shard_moves_once(spark, sf, monkeypatch):
    """However many blocks ask for a shard, one row with its vectors is shuffled."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    seen = shards_moved(spark, monkeypatch, lambda: topk.exact_top_k(table, shard_rows=64, block_rows=2), "c")
    assert max(seen["pairs"]) > 30 and max(seen["moved"]) <= 20, seen


def test_a_shard_of_negatives_moves_once(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    seen = shards_moved(spark, monkeypatch, lambda: negatives.hard_negatives(table, shard_rows=64, block_rows=2), "c")
    assert max(seen["pairs"]) > 30 and max(seen["moved"]) <= 20, seen


def test_vectors_of_any_kind_of_number(spark):
    """Components of 2, 4 and 8 bytes, the least of a kind among them, and scores beyond what floats hold."""
    rng = np.random.default_rng(7)
    for top in (2**7, 2**15, 2**22):
        x = rng.integers(-top, top, size=(300, 6))
        x[5] = -top
        table = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")
        whole, ids = (256 * x).astype(np.int64), np.arange(300)
        want = sorted((q, r + 1, i, int(s)) for q in range(0, 300, 50) for r, (i, s) in enumerate(best(ids, whole @ whole[q], q)))
        assert sorted(tuple(r) for r in topk.exact_top_k(table, shard_rows=32, block_rows=2).collect()) == want


def test_nearest(vectors):
    ids, x = clean(vectors, False)
    norms = np.linalg.norm(x, axis=1)
    rows = ann.nearest(vectors, chunk_rows=32).collect()
    hits = total = 0
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, v, n in zip(ids, x, norms, strict=True):
        if q % 50 == 0:
            want, got = best(ids, x @ v / (norms * n), q), sorted(by[int(q)])
            assert [g[0] for g in got] == list(range(1, len(got) + 1))
            hits, total = hits + len({w[0] for w in want} & {g[1] for g in got}), total + len(want)
            assert all(abs(g[2] - (x[np.searchsorted(ids, g[1])] @ v) / (norms[np.searchsorted(ids, g[1])] * n)) < 1e-12 for g in got)
    assert hits / total >= 0.9
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_large_integers_are_exact_or_refused(spark):
    rows = [(0, [4e6, 1.0]), (1, [4e6, 2.0]), (2, [4e6, 3.0]), (3, [1.0]), (4, [-4e6, 0.0])]
    got = [(r.vec_id, r.score) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("rank").collect()]
    big = int(256 * 4e6) ** 2
    assert big > 2**53 and got == [(2, big + 256 * 768), (1, big + 256 * 512), (4, -big)]
    over = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_top_k(over).collect()


def test_nearest_at_any_size_and_length(spark):
    rows = [(0, [1.0, 2.0, 0.5]), (1, [1e200, 2e200, 0.5e200]), (2, [1e-200, 2e-200, 4e-200]), (3, [1.0, 2.0]), (4, [-1.0, 0.0, 0.0])]
    rows += [(100 + 7 * i, [2.0**i, 2.0 ** (i + 1), 2.0 ** (i - 1)]) for i in range(40)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    others = [r.vec_id for r in got if r.vec_id != 1]
    assert len(got) == 5 and others == [100 + 7 * i for i in range(len(others))]
    assert all(abs(r.score - 1) < 1e-12 for r in got)
    few = ann.nearest(spark.createDataFrame(rows[:5], "vec_id bigint, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in few] == [1, 2, 4]


def test_tree_visits_every_leaf_once():
    rows = np.random.default_rng(0).normal(size=(500, 8))
    tree = ann.KMeansTree(rows / np.linalg.norm(rows, axis=1, keepdims=True))
    assert sorted(tree.visit(rows[0], tree.leaves)) == list(range(tree.leaves))
    assert set(tree.file(rows).tolist()) <= set(range(tree.leaves))


def test_visits_go_on_until_enough_rows(spark):
    assert ann.TARGET == 0.97
    rng = np.random.default_rng(4)
    tree = ann.KMeansTree(rng.normal(size=(200, 8)), branches=4, leaf=10)
    held = dict.fromkeys(range(tree.leaves), 1)
    query = rng.normal(size=8)
    assert len(tree.visit(query, 1, held, 6)) == 6 and tree.visit(query, 1, held, 6)[:1] == tree.visit(query, 1)
    assert sorted(tree.visit(query, 1, held, 10**6)) == list(range(tree.leaves))


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf))
    assert all(s.columns == docs.columns for s in steps[:-1])
    kept = {r.doc_id for r in steps[1].collect()}
    groups = simhash.brute_force([(r.doc_id, r.text) for r in steps[1].collect()])
    assert {r.doc_id for r in steps[2].collect()} == {d for d in kept if groups[d][1] == d}
    assert {r.doc_id for r in steps[3].collect()} == {r.doc_id for r in steps[2].collect()} == {r.doc_id for r in steps[4].collect()}
    assert corpus_pipeline.run(spark, sf).count() == steps[4].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_awkward_rows(spark):
    """Nulls, empties, repeats and clashing names: no stage fails, and all but the last keep the columns."""
    sf = "/root/testdata/sf0.001"
    rows = [(None, "no id", "en", "s", None, 1.0, 2), (1, None, None, None, None, None, None), (2, "", "en", "s", 0, 1.0, 1), (2, "", "en", "s", 0, 1.0, 1)]
    rows += [(3, "a@b.cc " * 3000, "en", "s", 1, 0.0, 0), (4, "one\n\ntwo", "de", "t", 8, 0.5, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted int")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            assert out.count() >= 0
            assert name == "packing" or out.columns == docs.columns
    kept = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.score or 0.0) for r in kept) == sorted([(0, 1.0), (1, 0.0), (3, 0.0), (4, 0.5)])
