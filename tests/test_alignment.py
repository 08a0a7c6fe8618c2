"""Alignment in time and space against brute force, on both sides of every border of size; random streams and priors."""

from __future__ import annotations

import bisect
import math
import random
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.functions import random_streams
from tidefold.operators import align

ZERO = datetime(2000, 1, 1)
METHODS = ("ffill", "nearest", "linear")


def brute_as_of(sources, targets, method):
    """Values for (key, time) targets of (key, time, value) sources, times in minutes."""
    series = {}
    for k, t, v in sources:
        if t is not None and v is not None:
            low, high = series.setdefault(k, {}).get(t, (v, v))
            series[k][t] = (min(low, v), max(high, v))
    sorted_times = {k: sorted(x) for k, x in series.items()}
    out = []
    for k, t in targets:
        if t is None or k not in series:
            out.append(None)
            continue
        times, values = sorted_times[k], series[k]
        i, j = bisect.bisect_right(times, t) - 1, bisect.bisect_left(times, t)
        if method == "ffill":
            out.append(values[times[i]][1] if i >= 0 else None)
        elif method == "nearest":
            low = j == len(times) or (i >= 0 and t - times[i] < times[j] - t)
            out.append(values[times[i]][1] if low else values[times[j]][0])
        elif len(times) == 1:
            only = values[times[0]]
            out.append(only[0] if t < times[0] else only[1])
        elif i == j:
            out.append(values[times[i]][1])
        elif i < 0:
            (x0, y0), (x1, y1) = [(x, values[x][0]) for x in times[:2]]
            out.append(y0 + (y1 - y0) * (t - x0) / (x1 - x0))
        elif j == len(times):
            (x0, y0), (x1, y1) = [(x, values[x][1]) for x in times[-2:]]
            out.append(y0 + (y1 - y0) * (t - x0) / (x1 - x0))
        else:
            x0, x1 = times[i], times[j]
            y0, y1 = values[x0][1], values[x1][0]
            out.append(y0 + (y1 - y0) * (t - x0) / (x1 - x0))
    return out


def made_series(n, seed):
    """One key with most rows, small keys, a null key, repeated and null times, null values, stretches without sources or targets."""
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 8 + ["a", None, "c"])
    time = lambda top: None if rng.random() < 0.02 else rng.randint(0, top) + (rng.random() < 0.3) * 5 * top
    sources = [(key(), time(3 * n), None if rng.random() < 0.02 else float(rng.randint(-50, 50))) for _ in range(n)]
    targets = [(rng.choice([key(), "absent"]) if rng.random() < 0.1 else key(), time(4 * n)) for _ in range(n)]
    return sources + [("single", 7, 3.0)], targets + [("single", 1), ("single", 9), ("hot", 5), ("hot", 5)]


def frames(spark, sources, targets):
    at = lambda t: None if t is None else ZERO + timedelta(minutes=t)
    s = spark.createDataFrame([(k, at(t), v, 1) for k, t, v in sources], "k string, T timestamp, value double, at int").repartition(4)
    t = spark.createDataFrame([(k, at(t), i, "x") for i, (k, t) in enumerate(targets)], "k string, T timestamp, number int, v string").repartition(3)
    return s, t


@pytest.mark.parametrize("range_rows", [1_000_000, 7])
@pytest.mark.parametrize("method", METHODS)
def test_as_of(spark, method, range_rows, monkeypatch):
    monkeypatch.setattr(align.sweep, "FAN", 4)
    sources, targets = made_series(150, 1)
    s, t = frames(spark, sources, targets)
    got = align.as_of(s, t, method, ["k"], range_rows=range_rows)
    assert got.columns == ["k", "T", "number", "v", "value"]
    want = brute_as_of(sources, targets, method)
    rows = sorted(got.collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(len(targets)))
    assert [r.value for r in rows] == pytest.approx(want)
    assert [(r.k, r.T and round((r.T - ZERO).total_seconds() / 60)) for r in rows] == targets


@pytest.mark.parametrize("method", METHODS)
def test_as_of_of_many_rows(spark, method):
    sources, targets = made_series(60_000, 2)
    s, t = frames(spark, sources, targets)
    got = {r.number: r.value for r in align.as_of(s, t, method, ["k"], range_rows=9_000).select("number", "value").collect()}
    want = brute_as_of(sources, targets, method)
    assert len(got) == len(want) and [got[i] for i in range(len(want))] == pytest.approx(want)


def test_as_of_without_rows_or_keys(spark):
    s, t = frames(spark, *made_series(20, 3))
    for method in METHODS:
        assert [r.value for r in align.as_of(s.limit(0), t, method, ["k"]).collect()] == [None] * 24
        assert align.as_of(s, t.limit(0), method, ["k"]).count() == 0
        # Keys that targets lack come from the sources, null ones too.
        spread = align.as_of(s, t.select("T").limit(3), method, ["k"])
        assert spread.columns == ["k", "T", "value"] and spread.count() == 3 * s.select("k").distinct().count()
    unkeyed = align.as_of(s.select("T", "value"), t.select("T"), "ffill")
    assert unkeyed.columns == ["T", "value"] and unkeyed.count() == 24


def test_null_times_are_no_sources(spark):
    s = spark.createDataFrame([(None, 99.0), (ZERO + timedelta(days=3), 3.0), (ZERO + timedelta(days=4), 5.0)], "T timestamp, value double")
    t = spark.createDataFrame([(ZERO,)], "T timestamp")
    assert [align.as_of(s, t, m).first().value for m in METHODS] == [None, 3.0, -3.0]


def brute_index(points, coords, method, tolerance):
    places = {}
    for i, c in coords:
        if c is not None and math.isfinite(c) and i is not None:
            places[c] = min(i, places.get(c, i))
    xs = sorted(places)
    out = []
    for p in points:
        got = None
        if p is not None and not math.isnan(p) and xs:
            below, above = [x for x in xs if x <= p], [x for x in xs if x >= p]
            if method == "nearest":
                got = below[-1] if below and (not above or p - below[-1] < above[0] - p) else above[0]
            elif method == "exact":
                got = p if p in places else None
            else:
                got = (below or [None])[-1] if method == "ffill" else (above or [None])[0]
            if got is not None and tolerance is not None and not abs(p - got) <= tolerance:
                got = None
        out.append(None if got is None else places[got])
    return out


@pytest.mark.parametrize("tolerance", [None, 0.25])
@pytest.mark.parametrize("method", ["nearest", "ffill", "bfill", "exact"])
def test_nearest_index(spark, method, tolerance):
    """Searched and swept, in one range and in many: the same rows."""
    rng = random.Random(5)
    coords = [(i, round(rng.uniform(-20, 20), 1)) for i in range(60)] + [(90, 0.0), (3, 0.0), (91, None), (92, float("nan")), (93, float("inf")), (94, -0.0), (None, 1.05)]
    points = [round(rng.uniform(-25, 25), 2) for _ in range(200)] + [c for _, c in coords] + [None, float("nan"), float("inf"), float("-inf"), -0.0, 1e300]
    c = spark.createDataFrame(coords, "idx int, value double")
    p = spark.createDataFrame([(i, x, i) for i, x in enumerate(points)], "number int, x double, lo int").repartition(3)
    want = brute_index(points, coords, method, tolerance)
    for searched, rows in ((1000, 10**6), (0, 10**6), (5, 13)):
        got = align.nearest_index(p, c, "x", tolerance, method, searched, rows)
        assert got.columns == ["number", "x", "lo", "x_idx"]
        assert [r.x_idx for r in sorted(got.collect(), key=lambda r: r.number)] == want
    assert {r.x_idx for r in align.nearest_index(p, c.limit(0), "x", tolerance, method).collect()} == {None}
    assert align.nearest_index(p.limit(0), c, "x").count() == 0


def test_nearest_index_on_both_sides_of_the_border(spark):
    """As many coordinates as are searched at most, and one more; nulls and NaN among 200,000 points stay."""
    points = spark.range(200_000).select("id", F.when(F.col("id") % 1000 == 1, None).when(F.col("id") % 1000 == 2, float("nan")).otherwise(F.col("id") * 0.05).alias("x"))
    for n in (align.SEARCHED, align.SEARCHED + 1):
        coords = spark.range(n).select(F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("value"))
        got = align.nearest_index(points, coords, "x", range_rows=50_000)
        wrong = got.where(~F.col("x_idx").eqNullSafe(F.when(F.col("x").isNull() | F.isnan("x"), None).otherwise(F.least(F.floor(F.col("x") + 0.5), F.lit(n - 1)).cast("int"))))
        assert got.count() == 200_000 and wrong.count() == 0


def test_extracted_observations(spark):
    outputs = spark.createDataFrame([(t, f, 10.0 * t + i, 0) for t in range(3) for i, f in enumerate("ab")] + [(0, "a", -5.0, 0)], "t_idx int, F string, v double, extra int")
    days = spark.createDataFrame([(i, ZERO + timedelta(days=i)) for i in range(3)] + [(1, ZERO + timedelta(days=1))], "idx int, value timestamp")
    obs = spark.createDataFrame([(1, ZERO + timedelta(hours=13), "b", 7.0), (2, None, "a", 8.0), (3, ZERO, None, 9.0), (4, ZERO, "z", 9.5), (5, ZERO, "a", None)], "id int, T timestamp, F string, seen double")
    got = align.extract_observations(outputs, obs, {"T": days}, "seen", "v", carried=("id",))
    assert got.columns == ["T", "F", "id", "seen", "pred"]
    assert {r.id: r.pred for r in got.collect()} == {1: 11.0, 2: None, 3: None, 4: None, 5: 0.0}
    with pytest.raises(ValueError, match="no coordinate"):
        align.extract_observations(outputs, obs, {"T": days}, "seen", "v")
    with pytest.raises(ValueError, match="no column"):
        align.extract_observations(outputs, obs, {"T": days}, "none", "v")


# ---- random streams ----


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.75, 0.925, 0.999, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", random_streams.normal_quantile(F.col("p")).alias("z")).collect()
    got = {r.p: r.z for r in rows}
    assert got[0.0] is None and got[1.0] is None and got[None] is None
    for p in ps:
        assert got[p] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-14, abs=1e-15)


def test_draws_do_not_depend_on_the_plan(spark):
    keys = spark.range(1000).withColumn("other", F.lit("x"))
    draw = lambda df: {r.id: r.u for r in df.select("id", random_streams.uniform(1, "s", F.col("id"), 2).alias("u")).collect()}
    first = draw(keys.repartition(1))
    assert first == draw(keys.repartition(7).sort(F.desc("id"))) and len(set(first.values())) == 1000
    other = [random_streams.uniform(2, "s", F.col("id"), 2), random_streams.uniform(1, "t", F.col("id"), 2), random_streams.uniform(1, "s", F.col("id"), 3)]
    far = keys.select(*[F.corr(random_streams.uniform(1, "s", F.col("id"), 2), u) for u in other]).first()
    assert all(abs(x) < 0.1 for x in far)
    odd = spark.createDataFrame([(None,), (2**63 - 1,), (-(2**63),), (3_470_000_001,)], "id bigint")
    assert all(0 < u < 1 for u in draw(odd).values())


FAMILIES = {
    "even": (random_streams.even(2.0, 5.0), 3.5, 3 / math.sqrt(12)),
    "normal": (random_streams.normal(-1.0, 2.0), -1.0, 2.0),
    "log": (random_streams.log_normal(0.2, 0.4), math.exp(0.28), math.exp(0.28) * math.sqrt(math.exp(0.16) - 1)),
    "half": (random_streams.half_normal(3.0), 3 * math.sqrt(2 / math.pi), 3 * math.sqrt(1 - 2 / math.pi)),
    "cut": (random_streams.truncated_normal(0.0, 1.0, -0.5, 1.0), None, None),
    "far": (random_streams.truncated_normal(0.0, 1.0, 9.0, 20.0), None, None),
    "low": (random_streams.truncated_normal(0.0, 1.0, -20.0, -9.0), None, None),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_priors(spark, name):
    prior, mean, deviation = FAMILIES[name]
    drawn = random_streams.sample(spark.range(40_000), "id", {"x": prior})
    x = np.sort([r.x for r in drawn.collect()])
    low, high = prior.bounds
    # The density adds up to one, and the draws follow it.
    grid = np.linspace(low, high, 4001)
    density = np.exp([r[0] for r in spark.createDataFrame([(float(g),) for g in grid], "x double").select(prior.log_density(F.col("x"))).collect()])
    total = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(grid))])
    assert total[-1] == pytest.approx(1.0, abs=0.005)
    share = np.searchsorted(x, grid) / len(x)
    assert np.abs(share - total - share[0]).max() < 0.012
    if mean is not None:
        assert x.mean() == pytest.approx(mean, abs=4 * deviation / 200) and x.std() == pytest.approx(deviation, rel=0.03)
    else:
        assert low <= x[0] and x[-1] <= high
    outside = spark.createDataFrame([(low - 100 if name in ("normal",) else low - 1e-9 * abs(low) - 1e-9,), (None,), (float("nan"),)], "x double")
    got = [r[0] for r in outside.select(prior.log_density(F.col("x"))).collect()]
    assert got[1] is None and (name == "normal" or got[0] == -math.inf or name in ("log",)) and (name == "normal" or got[2] == -math.inf or name == "log")


def test_samples_of_priors(spark):
    rows = spark.range(50)
    priors = {"a": random_streams.even(0.0, 1.0), "b": random_streams.normal(0.0, 1.0)}
    got = random_streams.sample(rows, "id", priors, seed=3, sizes={"a": 4}).collect()
    assert all(len(r.a) == 4 and len(set(r.a)) == 4 for r in got)
    alone = {r.id: r.b for r in random_streams.sample(rows, "id", {"b": priors["b"]}, seed=3).collect()}
    assert alone == {r.id: r.b for r in got}
    assert random_streams.bounds(priors)["b"] == pytest.approx((-3.0902, 3.0902), abs=1e-4)
    for wrong in (lambda: random_streams.even(1.0, 1.0), lambda: random_streams.normal(0.0, 0.0), lambda: random_streams.truncated_normal(0.0, 1.0, 2.0, 1.0), lambda: random_streams.sample(rows, "id", {"id": priors["a"]})):
        with pytest.raises(ValueError):
            wrong()


def test_sampled_observations(spark):
    """The choice of rows says nothing about their noise, whose mean is nothing."""
    rows = spark.range(100_000).select((F.col("id") + 3_469_990_000).alias("id"), F.lit(10.0).alias("v"))
    got = [r.v for r in align.sample_observations(rows, "id", "v", 0.2, 0.1).collect()]
    assert len(got) == pytest.approx(20_000, rel=0.03)
    assert np.mean(got) == pytest.approx(10.0, abs=0.02) and min(got) < 9.01 and max(got) > 10.99
    assert np.std(got) == pytest.approx(1 / math.sqrt(3), rel=0.02)
