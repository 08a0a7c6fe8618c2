"""Coordinates of several sources, key sets, distinct ranked points and bucketed joins against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidefold.operators import buckets, coordinates, distinct_set, keysets

# ---- coordinates ----


@pytest.mark.parametrize(("range_rows", "fan"), [(10**6, 1024), (9, 1024), (3, 4)])
def test_coordinates(spark, monkeypatch, range_rows, fan):
    """In one range, in many, and with offsets added up over groups of groups."""
    monkeypatch.setattr(coordinates, "FAN", fan)
    rng = random.Random(1)
    tables = {n: [rng.choice([None, rng.randint(-50, 50) / 2, float("nan")]) if rng.random() < 0.1 else rng.randint(-50, 50) / 2 for _ in range(200)] + [3.5] * 300 for n in ("a", "b", "c")}
    sources = {n: (spark.createDataFrame([(v, 1) for v in x], "v double, idx int"), "v") for n, x in tables.items()}
    got = [tuple(r) for r in coordinates.coordinates(sources, range_rows).orderBy("idx").collect()]
    held = {n: {v for v in x if v is not None and not math.isnan(v)} for n, x in tables.items()}
    want = [(v, i, sorted(n for n in held if v in held[n])) for i, v in enumerate(sorted(set().union(*held.values())))]
    assert got == want
    lacks = {r.source: (r.n_missing, r.first_missing) for r in coordinates.disagreements(coordinates.coordinates(sources, range_rows), list(tables)).collect()}
    every = {v for v, _, _ in want}
    assert lacks == {n: (len(every - h), min(every - h)) for n, h in held.items()}


def test_coordinates_of_one_type(spark):
    """Whole numbers and fractions meet; a planted conflict is found; sources that agree or are empty are told."""
    a = spark.createDataFrame([(1,), (2,), (3,)], "y int")
    b = spark.createDataFrame([(1.0,), (2.5,), (3.0,)], "lat double")
    found = coordinates.coordinates({"a": (a, "y"), "b": (b, "lat")})
    assert [tuple(r) for r in found.orderBy("idx").collect()] == [(1.0, 0, ["a", "b"]), (2.0, 1, ["a"]), (2.5, 2, ["b"]), (3.0, 3, ["a", "b"])]
    assert {tuple(r) for r in coordinates.disagreements(found, ["a", "b"]).collect()} == {("a", 1, 2.5, 2.5), ("b", 1, 2.0, 2.0)}
    same = coordinates.coordinates({"a": (a, "y"), "c": (a, "y")})
    assert {tuple(r) for r in coordinates.disagreements(same, ["a", "c"]).collect()} == {("a", 0, None, None), ("c", 0, None, None)}
    assert coordinates.coordinates({"a": (a.limit(0), "y")}).count() == 0


def test_numbered_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([(3, "x"), (3, "x"), (1, "y"), (None, "z")], "v int, order string")
    got = coordinates.numbered(rows, "v", "n", 1, range_rows=2).orderBy("n").collect()
    assert [(r.v, r.order, r.n) for r in got] == [(None, "z", 1), (1, "y", 2), (3, "x", 3), (3, "x", 4)]


# ---- key sets ----


def test_key_sets(spark):
    keys = lambda *x: spark.createDataFrame([(v, v) for v in x], "k bigint, source bigint")
    equal = keys(1, 2, 3, 3, None), keys(None, 3, 2, 1).repartition(3)
    sources = [("same", "a", equal[0], "k"), ("same", "b", equal[1], "k"), ("as many", "a", keys(1, 2, 3), "k"), ("as many", "b", keys(1, 2, 4), "k"), ("none", "a", keys(7), "k"), ("none", "b", keys(7).limit(0), "k"), ("empty", "a", keys(7).limit(0), "k")]
    assert {tuple(r) for r in keysets.alignment(sources).collect()} == {("same", True, 4), ("as many", False, 3), ("none", False, 1), ("empty", True, 0)}
    assert {tuple(r) for r in keysets.conflicts(sources).collect()} == {("as many", "a", "4"), ("as many", "b", "3"), ("none", "b", "7")}
    assert keysets.conflicts(sources[:2]).count() == 0
    # Wider integers are the same keys.
    narrow = keys(1, 2, 3).select(F.col("k").cast("int").alias("k"))
    assert keysets.alignment([("d", "a", narrow, "k"), ("d", "b", keys(3, 1, 2), "k")]).first().aligned


def test_digests_are_exact_on_many_keys(spark):
    some = spark.range(100_000)
    one_off = some.where("id <> 77").unionByName(spark.createDataFrame([(-1,)], "id bigint"))
    rows = keysets.key_digests([("d", "a", some, "id"), ("d", "b", some.sort(F.desc("id")), "id"), ("d", "c", one_off, "id")]).collect()
    by = {r.source: (r.n, r.total, r.mix) for r in rows}
    assert by["a"] == by["b"] and by["a"][0] == by["c"][0] and by["a"] != by["c"]
    assert {(r.source, r.key) for r in keysets.conflicts([("d", "a", some, "id"), ("d", "c", one_off, "id")]).collect()} == {("c", "77"), ("a", "-1")}


# ---- distinct ranked points ----


def brute_distinct(rows, bounds, distance, most=None):
    taken = []
    usable = [r for r in rows if r[1] is not None and math.isfinite(r[1]) and all(v is not None and math.isfinite(v) for v in r[2:])]
    for r in sorted(set(usable), key=lambda r: (r[1], r[0])):
        x = [(v - low) / (high - low) for v, (low, high) in zip(r[2:], bounds, strict=True)]
        if all(math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) >= distance for _, y in taken):
            taken.append((r[0], x))
    return [i for i, _ in taken][:most]


@pytest.mark.parametrize("axes", [1, 3])
@pytest.mark.parametrize("finish", [0, 10_000])
def test_distinct_ranked(spark, axes, finish):
    """Rounds and one task give the sequential choice: ties, copies, a crowded place, points that may not be taken."""
    rng = random.Random(axes)
    spot = lambda: [rng.choice([rng.uniform(-2, 3), 0.5]) for _ in range(axes)]
    rows = [(i, rng.choice([rng.uniform(0, 1), 0.25]), *spot()) for i in range(250)] + [(1000, 0.0, *[0.5] * axes)] * 3
    rows += [(2000, None, *spot()), (2001, float("nan"), *spot()), (2002, float("inf"), *spot()), (2003, 0.0, *[None] * axes), (2004, 0.0, *[float("nan")] * axes)]
    names = [f"p{i}" for i in range(axes)]
    bounds = [(-2.0, 3.0)] * axes
    table = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, loss double, " + ", ".join(f"{n} double" for n in names) + ", rank string").repartition(4)
    for distance, most in ((0.15, None), (0.15, 4), (0.6, None), (2.0, 3))[:: 1 if finish else 2]:
        got = distinct_set.distinct_ranked(table, ["loss", "id"], dict(zip(names, bounds, strict=True)), distance, most, finish)
        assert got.columns == [*table.columns, "place"]
        assert [(r.place, r.id) for r in got.orderBy("place").collect()] == list(enumerate(brute_distinct(rows, bounds, distance, most), 1))


def test_distinct_ranked_of_odd_tables(spark):
    table = spark.createDataFrame([(i, float(i % 3), 0.5) for i in range(9)], "id bigint, loss double, p double")
    bounds = {"p": (0.0, 1.0)}
    assert distinct_set.distinct_ranked(table.limit(0), ["loss", "id"], bounds, 0.1).count() == 0
    assert [r.id for r in distinct_set.distinct_ranked(table, ["loss", "id"], bounds, 0.0).orderBy("place").collect()] == [0, 3, 6, 1, 4, 7, 2, 5, 8]
    assert [r.id for r in distinct_set.distinct_ranked(table, ["id"], bounds, 0.1).collect()] == [0]


def test_distinct_ranked_in_few_rounds(spark, monkeypatch):
    """A hundred thousand points, half of them in one place, need rounds by the logarithm, not by the rows."""
    written = []
    keep = distinct_set.written
    monkeypatch.setattr(distinct_set, "written", lambda df, name: written.append(name) or keep(df, name))
    crowd = F.rand(1) < 0.5
    points = spark.range(100_000).select("id", F.rand(2).alias("loss"), *[F.when(crowd, 0.31).otherwise(F.rand(3 + i)).alias(f"p{i}") for i in range(2)])
    points = keep(points, "points")
    got = distinct_set.distinct_ranked(points, ["loss", "id"], {"p0": (0.0, 1.0), "p1": (0.0, 1.0)}, 0.05, finish=50)
    chosen = got.select("p0", "p1").collect()
    assert 150 < len(chosen) < 500 and written.count("ranked") < 16
    assert min(math.dist(a, b) for i, a in enumerate(chosen) for b in chosen[:i]) >= 0.05


# ---- buckets ----


def test_bucketed_join_moves_nothing(spark):
    left = spark.range(5000).select((F.col("id") % 97).alias("k"), (F.col("id") % 5).alias("t"), "id").withColumn("k", F.when(F.col("k") != 3, F.col("k")))
    right = spark.range(200).select((F.col("id") % 97).alias("k"), (F.col("id") % 5).alias("t"), (F.col("id") * 10).alias("v"))
    keys = ["k", "t"]
    names = [buckets.store(df, n, keys, 4) for df, n in ((left, "left"), (right, "right"))]
    got = buckets.joined(spark, *names, keys)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = left.join(right, keys)
    assert sorted(map(tuple, got.select("k", "t", "id", "v").collect())) == sorted(map(tuple, want.select("k", "t", "id", "v").collect()))
    assert [buckets.bucket_count(n, 10) for n in (0, 1, 10, 11, 20, 21, 100)] == [1, 1, 1, 2, 2, 4, 16]
