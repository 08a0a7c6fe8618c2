"""Time grids, dimensions, recurrences, transport, cohorts, writers."""

from __future__ import annotations

import itertools
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold import dims, errors
from tidefold.functions import biology, transport
from tidefold.operators import align, catalogue, metrics, recurrence, sinks
from tidefold.plans.timegrid import TimeGrid, chunk_ranges, parse_dt

DAY = 86400.0


@pytest.mark.parametrize(("text", "seconds"), [("2d", 172800), ("0.5 h", 1800), ("1.5e1min", 900), (" 90 sec ", 90), ("1week", 604800), ("1yr", 31557600)])
def test_steps(text, seconds):
    assert parse_dt(text) == seconds


@pytest.mark.parametrize("text", ["d", "3 fortnights", "-1d", "1d2h", "0 h", "1D"])
def test_texts_that_are_no_steps(text):
    with pytest.raises(ValueError, match="not a time step"):
        parse_dt(text)


def test_time_grid(spark):
    grid = TimeGrid.of("2023-02-27T06:00:00", datetime(2023, 3, 2, 6), "8h")
    assert grid.n_timesteps == 9 and grid.coords()[3] == datetime(2023, 2, 28, 6)
    rows = grid.frame(spark, 2, 5).orderBy("t_idx").collect()
    assert [(r.t_idx, r.T) for r in rows] == [(i, grid.time(i)) for i in range(2, 5)]
    assert TimeGrid.of("2024-02-01", "2024-03-01", "1d").n_timesteps == 29
    with pytest.raises(ValueError, match="not evenly divisible"):
        TimeGrid.of("2023-01-01", "2023-01-02", "5h")
    assert chunk_ranges(7, 3) == [(0, 3), (3, 6), (6, 7)] and chunk_ranges(0, None) == [] and chunk_ranges(2, 9) == [(0, 2)]
    with pytest.raises(errors.ChunkingError, match="E303"):
        chunk_ranges(7, -1)


def test_dimensions(spark):
    assert dims.canonical_order(["Y", "depth", "E", "Y"]) == ("E", "Y", "depth")
    assert dims.broadcast_dims([["T", "Z", "X"], ["F"]], ["Z"]) == ("T", "F", "X")
    table = spark.createDataFrame([(1, 2, 3.0)], "lon int, T int, value double")
    assert dims.transpose(dims.rename_dims(table, {"lon": "X", "lat": "Y"})).columns == ["T", "X", "value"]
    with pytest.raises(errors.TransposeError, match="E204"):
        dims.transpose(table, ["Z"])


# ---- recurrences ----


def test_recurrences_agree(spark):
    """In one fold, in stretches, and by numpy: the same trajectory, that of a plain loop."""
    rows = spark.createDataFrame([(i, 0.5 + i, "x") for i in range(6)] + [(9, None, "n")], "k int, a double, t_idx string")
    step = lambda s, i: {"a": s["a"] * 1.1 + i, "b": s["a"] - s["b"]}
    start = {"a": F.col("a"), "b": F.lit(0.0)}
    fold = recurrence.trajectory(rows, ["k"], start, step, 11)
    assert fold.columns == ["k", "t_idx", "a", "b"]
    plain = lambda df: {(r.k, r.t_idx): (r.a, r.b) for r in df.collect()}
    got = plain(fold)
    for k in range(6):
        a, b = 0.5 + k, 0.0
        for i in range(11):
            a, b = a * 1.1 + i, a - b
            assert got[k, i] == pytest.approx((a, b), rel=1e-12)
    assert got[9, 10] == (None, None) and len(got) == 77
    assert plain(recurrence.trajectory_by_chunks(rows, ["k"], start, step, 11, 4)) == got
    kernel = recurrence.trajectory_by_kernel(rows.where("k < 9"), ["k"], start, lambda s, i: {"a": s["a"] * 1.1 + i, "b": s["a"] - s["b"]}, 11)
    assert plain(kernel) == {k: pytest.approx(v) for k, v in got.items() if k[0] < 9}
    assert recurrence.trajectory(rows, ["k"], start, step, 0).count() == 0 and recurrence.trajectory(rows.limit(0), ["k"], start, step, 3).count() == 0


def test_recurrence_of_given_series(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, []), (3, None), (4, [None, 1.0])], "k int, food array<double>")
    out = recurrence.trajectory(rows, ["k"], {"s": F.lit(10.0)}, lambda s, x: recurrence.euler(s, {"s": x}, 2.0, high=20.0), given="food")
    assert {(r.k, r.t_idx, r.s) for r in out.collect()} == {(1, 0, 12.0), (1, 1, 16.0), (1, 2, 20.0), (4, 0, None), (4, 1, None)}


def test_last_state_is_the_last_of_the_trajectory(spark):
    rows = spark.createDataFrame([(1, 2.0, [1.0, 2.0, 4.0]), (2, 3.0, []), (3, 4.0, None), (4, 5.0, [None, 1.0]), (5, None, [1.0]), (None, 1.0, [2.0])], "k int, a double, food array<double>")
    start = {"s": F.col("a"), "n": F.lit(0)}
    for given, steps, x in (("food", None, lambda x: x), (None, 7, lambda i: i * 0.5), (None, 0, lambda i: i)):
        step = lambda s, v, x=x: {**recurrence.euler({"s": s["s"]}, {"s": x(v)}, 2.0, high=20.0), "n": s["n"] + 1}
        whole = recurrence.trajectory(rows, ["k"], start, step, steps, given).toPandas().astype(object)
        last = [tuple(None if v != v else v for v in r) for r in whole.sort_values("t_idx").groupby("k", dropna=False).tail(1)[["k", "s", "n"]].itertuples(index=False)]
        got = recurrence.last_state(rows, ["k"], start, step, steps, given)
        assert got.columns == ["k", "s", "n"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(last, key=str) and len(last) == {"food": 4, None: 6 if steps else 0}[given]


def test_members_of_a_sweep_go_to_many_tasks(spark, sf, monkeypatch):
    """The suppliers are one small file; the work on them grows with the cells and steps, and must not stay in its one task."""
    assert catalogue.table(spark, sf, "supplier").rdd.getNumPartitions() == 1
    assert catalogue.ensemble_sweep(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(recurrence, "SERIES", 30)
    members, cells = catalogue.table(spark, sf, "supplier").count(), 25
    assert catalogue.ensemble_sweep(spark, sf).rdd.getNumPartitions() == -(-members * cells // 30)


# ---- functions ----


def column(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_cohorts_keep_what_they_move(spark):
    rng = np.random.default_rng(4)
    for age in (1e9, 2.5 * DAY, 0.0):
        production, ages = rng.uniform(0, 5, 6), np.cumsum(rng.uniform(0.5, 2, 6)) * DAY
        p, a = (F.array(*[F.lit(float(x)) for x in v]) for v in (production, ages))
        flow = column(spark, biology.aging_flow(p, a, F.lit(age)))
        loss, gain = (column(spark, x) for x in biology.recruitment_flow(p, a, F.lit(age)))
        assert sum(flow) == pytest.approx(0, abs=1e-12) and -sum(loss) == pytest.approx(gain)
        share = 1 / (1 + np.exp(-np.clip(math.log(99) / DAY * (ages - age), -700, 700)))
        gap = np.append(np.diff(ages), ages[-1] - ages[-2])
        assert loss == pytest.approx((-share * production / gap).tolist())
    assert column(spark, biology.npp_injection(F.lit(3.0), F.lit(0.5), F.array(F.lit(7.0), F.lit(8.0)))) == [1.5, 0.0]


def test_functions_of_light_and_warmth(spark):
    assert column(spark, biology.day_length(F.lit(0.0), F.lit(200.0))) == pytest.approx(0.5)
    north, south = (column(spark, biology.day_length(F.lit(x), F.lit(170.0))) for x in (50.0, -50.0))
    assert north + south == pytest.approx(1.0) and north > 0.6
    assert column(spark, biology.day_length(F.lit(None).cast("double"), F.lit(1.0))) is None
    assert column(spark, biology.threshold_temperature(F.lit(None).cast("double"), F.lit(1.0))) is None
    layers = F.array(F.lit(4.0), F.lit(8.0))
    assert column(spark, biology.layer_weighted_mean(layers, F.lit(0.25), F.lit(1), F.lit(0))) == 5.0
    assert column(spark, biology.layer_weighted_mean(layers, F.lit(0.25), F.lit(None).cast("int"), F.lit(0))) is None
    for wrong in (2, -1):
        with pytest.raises(Exception, match="no layer"):
            column(spark, biology.layer_weighted_mean(layers, F.lit(0.25), F.lit(wrong), F.lit(0)))


# ---- transport ----


def grids(ny, nx):
    rng = np.random.default_rng(ny)
    one = np.ones((ny, nx))
    mask = one.copy()
    mask[1, 2] = 0
    return {
        "c": rng.uniform(0, 10, (ny, nx)) * mask, "u": rng.normal(0, 0.2, (ny, nx)), "v": rng.normal(0, 0.2, (ny, nx)), "dx": 900 * one, "dy": 1100 * one,
        "face_height": 1100 * one, "face_width": 900 * one, "cell_area": 990_000 * one, "mask": mask,
    }


@pytest.mark.parametrize("bc", [{"east": 0, "west": 0, "north": 0, "south": 0}, {"east": 2, "west": 2, "north": 1, "south": 0}])
def test_transport_forms_agree(spark, bc):
    ny, nx = 4, 6
    g = grids(ny, nx)
    args = {("state" if k == "c" else k): v[None] for k, v in g.items()}
    adv, dif = transport.grid_tendency(**args, D=50.0, **{f"bc_{s}": b for s, b in bc.items()})
    rows = [(y, x, *[float(g[f][y, x]) for f in transport.FIELDS]) for y, x in itertools.product(range(ny), range(nx))]
    cells = spark.createDataFrame(rows, "Y int, X int, " + ", ".join(f"{f} double" for f in transport.FIELDS))
    for got in (transport.tendency_by_window(cells, 50.0, bc, ny, nx), transport.tendency_by_tiles(cells, 50.0, bc, ny, nx, tile=2)):
        got = got.orderBy("Y", "X").toPandas()
        assert np.allclose(got["advection_rate"].to_numpy().reshape(ny, nx), adv[0], atol=1e-12)
        assert np.allclose(got["diffusion_rate"].to_numpy().reshape(ny, nx), dif[0], atol=1e-12)
    if not any(bc.values()):
        assert abs((adv + dif).sum()) < 1e-9
    assert adv[0][1, 2] == 0


def test_writers(spark, tmp_path):
    chunk = spark.createDataFrame([(3, 0, 1.5), (4, 1, 2.5), (4, 2, None)], "X int, t_idx int, b double")
    for writer in (sinks.build_writer(spark, ["b"]), sinks.build_writer(spark, ["b"], str(tmp_path / "out"))):
        with writer:
            writer.append(chunk)
            writer.append(chunk.withColumn("t_idx", F.col("t_idx") + 500))
            assert writer.finalize().count() == 6
            with pytest.raises(errors.EngineIOError, match="E304"):
                writer.append(chunk.drop("b"))
    with pytest.raises(errors.EngineIOError):
        sinks.MemoryWriter().append(chunk)


# ---- metrics and completeness ----


def test_metrics_of_odd_pairs(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, 2.0, True), (1, 3.0, None, True), (1, None, 1.0, True), (1, 5.0, 2.0, False), (2, float("nan"), 1.0, True), (None, 2.0, 2.0, True), (4, None, None, True)],
        "E int, pred double, obs double, m boolean",
    )
    got = {r.E: (r.a, r.b) for r in rows.groupBy("E").agg(metrics.mse(F.col("pred"), F.col("obs")).alias("a"), metrics.mse(F.col("pred"), F.col("obs"), F.col("m")).alias("b")).collect()}
    assert got[1] == (5.0, pytest.approx(1 / 3)) and math.isnan(got[2][0]) and got[None] == (0.0, 0.0) and got[4][0] is None
    loss = {r.E: r.loss for r in metrics.composite_loss([(rows, "rmse", 2.0)]).collect()}
    assert loss == {1: pytest.approx(2 * math.sqrt(5)), 2: 1e6, None: 0.0, 4: 1e6}
    assert metrics.composite_loss([(rows.limit(0), "mse", 1.0)]).count() == 0


def test_completeness(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = spark.createDataFrame([("a", at(0)), ("a", at(0)), ("a", at(2)), (None, at(1)), ("b", None), ("b", at(9))], "k string, T timestamp")
    steps = spark.createDataFrame([(at(h),) for h in (0, 1, 2, 2)] + [(None,)], "T timestamp")
    got = {r.k: (r.n_missing, r.n_repeated) for r in align.completeness(rows, steps, ["k"]).collect()}
    assert got == {"a": (1, 1), None: (2, 0), "b": (3, 0)}
    assert align.completeness(rows.limit(0), steps, ["k"]).count() == 0
    assert {r.n_missing for r in align.completeness(rows, steps.limit(0), ["k"]).collect()} == {0}


def test_combined_groups(spark):
    rows = spark.createDataFrame([(1, 2.0, 1.0), (1, None, 1.0), (1, 3.0, 0.5), (None, 1.0, None), (2, None, 1.0)], "k int, pred double, w double")
    assert {r.k: r.pred for r in metrics.combined_groups(rows, ["k"], weight=F.col("w")).collect()} == {1: 3.5, None: None, 2: None}
    assert metrics.combined_groups(rows.limit(0), ["k"]).count() == 0
