"""Streams against batch results, restarts, and the chunk data source: pruning, brackets, failed tasks."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidefold.operators import align, catalogue
from tidefold.plans.timegrid import TimeGrid
from tidefold.sources import chunks
from tidefold.streaming import as_of, stateful

ZERO = datetime(2024, 1, 1)
SERIES = "k string, T timestamp, number bigint, v double"


def made(n=400, seed=1):
    """Sources and targets of some keys in order of time, one key with most rows, a null key, values repeated at a time."""
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", None])
    minutes = sorted(rng.randint(0, 3000) for _ in range(n))
    rows = [(key(), ZERO + timedelta(minutes=m, microseconds=rng.randint(0, 999)), i if i % 2 else 0, None if i % 2 else float(rng.randint(0, 99))) for i, m in enumerate(minutes)]
    return rows + [(rows[0][0], rows[0][1], 0, 200.0)]


END = (None, ZERO + timedelta(days=90), -1, 0.0)


def batch_answers(spark, rows):
    table = spark.createDataFrame(rows, SERIES)
    sources, targets = table.where("v is not null and number >= 0").select("k", "T", F.col("v").alias("value")), table.where("v is null").drop("v")
    return sorted((tuple(r) for r in align.as_of(sources, targets, "ffill", ["k"]).select("k", "T", "number", "value").collect()), key=str)


def stream_of(spark, path):
    return spark.readStream.schema(SERIES).option("maxFilesPerTrigger", 1).parquet(str(path))


def put(spark, rows, path):
    spark.createDataFrame(rows, SERIES).coalesce(1).write.mode("append").parquet(str(path))
    time.sleep(0.01)


@pytest.mark.parametrize("shares", [1, 3])
def test_streamed_ffill_equals_batch(spark, tmp_path, shares):
    rows = made()
    parts = [rows[i : i + 90] for i in range(0, len(rows), 90)]
    random.Random(2).shuffle(parts[0])
    for part in [*parts, [END]]:
        put(spark, part, tmp_path / "in")
    home = f"file://{tmp_path}/run"
    as_of.run_to_folder(as_of.stream_as_of(stream_of(spark, tmp_path / "in"), "40 days", shares), home).awaitTermination()
    got = sorted((tuple(r) for r in as_of.results(spark, home).collect()), key=str)
    assert got == batch_answers(spark, rows)


def on_grid(grid, n=1500, seed=5):
    """Sources of ``made``, some at a step or a microsecond beside one, and targets on steps, some twice; in order of time."""
    rng = random.Random(seed)
    rows = [r for r in made(n, seed) if r[3] is not None]
    for i in range(0, grid.n_timesteps, 5):
        rows += [("hot", grid.time(i) + timedelta(microseconds=d), 0, float(rng.randint(0, 99))) for d in rng.sample((-1, 0, 1), 2)]
    asked = [(k, grid.time(i), 2**60 + i, None) for k in ("hot", "a", None, "no source") for i in range(grid.n_timesteps) if rng.random() < 0.8]
    return sorted(rows + asked + asked[::9], key=lambda r: r[1])


@pytest.mark.parametrize("delay", ["1 hour", "40 days"])
def test_targets_on_a_grid(spark, tmp_path, delay):
    """The same answers with one source a step in the state of a key, however many there are; over a restart, and for rows within the delay."""
    grid = TimeGrid.of(ZERO - timedelta(hours=2, minutes=53), ZERO + timedelta(hours=49, minutes=7), "30min")
    rows = on_grid(grid)
    parts = [rows[i : i + 450] for i in range(0, len(rows), 450)]
    # One is late, though not by the delay.
    late = next(r for r in parts[0][::-1] if r[0] == "hot" and r[3] is not None and r[1] < parts[0][-1][1] - timedelta(minutes=25))
    parts[0].remove(late)
    home, removed, dropped = f"file://{tmp_path}/run", 0, 0
    for run in ([parts[0], [late], *parts[1:2]], [*parts[2:], [END]]):
        for part in run:
            put(spark, part, tmp_path / "in")
        query = as_of.run_to_folder(as_of.stream_as_of(stream_of(spark, tmp_path / "in"), delay, 2, grid), home)
        query.awaitTermination()
        found = [o for p in query.recentProgress for o in p["stateOperators"]]
        removed += sum(o["numRowsRemoved"] for o in found if o["operatorName"] == "stateStoreSave")
        dropped += sum(o["numRowsDroppedByWatermark"] for o in found)
    got = sorted((tuple(r) for r in as_of.results(spark, home).collect()), key=str)
    assert got == batch_answers(spark, rows) and dropped == 0
    sources, steps = sum(r[3] is not None for r in rows), {(r[0], -((grid.start - r[1]) // timedelta(minutes=30))) for r in rows if r[3] is not None}
    targets = {r[:3] for r in rows if r[3] is None}
    assert removed == len(steps) + len(targets) and len(steps) < sources / 2


def test_targets_beside_the_grid_are_an_error(spark, tmp_path):
    grid = TimeGrid.of(ZERO, ZERO + timedelta(days=1), "1h")
    put(spark, [("a", ZERO, 0, 1.0), ("a", ZERO + timedelta(minutes=59), 1, None)], tmp_path / "in")
    stream = stream_of(spark, tmp_path / "in")
    with pytest.raises(Exception, match="no step of the grid"):
        as_of.run_to_folder(as_of.stream_as_of(stream, "1 hour", grid=grid), f"file://{tmp_path}/run").awaitTermination()
    with pytest.raises(ValueError, match="whole milliseconds"):
        as_of.stream_as_of(stream, "1 hour", grid=TimeGrid.of(ZERO, ZERO + timedelta(seconds=1), "0.0005s"))


def test_the_query_thins_its_sources(spark, sf, monkeypatch):
    """As many sources a step and type as there are, one reaches the state."""
    given, start = [], as_of.stream_as_of
    monkeypatch.setattr(as_of, "stream_as_of", lambda *a, **b: given.append(b.get("grid")) or start(*a, **b))
    assert catalogue.streaming_ffill_6h(spark, sf).count() > 0
    assert given == [catalogue.event_grid(spark, sf, "6h")]


def test_stream_resumes_and_drops_late_rows(spark, tmp_path):
    """Killed after some batches and started again on the same folder: every answer once. What comes after the watermark is not used."""
    rows = made(300, 3)[:-1]
    home = f"file://{tmp_path}/run"
    start = lambda trigger=None: as_of.run_to_folder(as_of.stream_as_of(stream_of(spark, tmp_path / "in"), "1 hour"), home, trigger)
    for i in range(0, 200, 50):
        put(spark, rows[i : i + 50], tmp_path / "in")
    query = start({"processingTime": "0 seconds"})
    began = time.time()
    while not query.recentProgress and time.time() - began < 60:
        time.sleep(0.05)
    query.stop()
    # A source of the first day, two days late, and then the rest.
    start().awaitTermination()
    early = as_of.results(spark, home).count()
    put(spark, [("hot", ZERO + timedelta(seconds=1), 0, -7.0)], tmp_path / "in")
    put(spark, rows[200:], tmp_path / "in")
    put(spark, [END], tmp_path / "in")
    query = start()
    query.awaitTermination()
    got = sorted((tuple(r) for r in as_of.results(spark, home).collect()), key=str)
    assert 0 < early < len(got) and got == batch_answers(spark, rows)
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    assert dropped == 1


def test_totals_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("b", 4.0)] * 50, "k string, v double").repartition(6)
    source = stateful.as_stream(rows, "totals", batches=3, file_rows=10)
    out = []
    run = stateful.running_totals(source, "k", "v").writeStream.outputMode("complete").foreachBatch(lambda df, n: out.append({r.k: (r.n, r.total) for r in df.collect()}))
    run.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert out[-1] == {"a": (50, 50.0), None: (50, 100.0), "b": (50, 200.0)} and len(out) >= 3


# ---- chunks ----


def grid(spark, first, last, cells=3):
    """Hourly steps of a value by cell, with a null and a missing row."""
    rows = [(ZERO + timedelta(hours=h), y, -y, None if h % 7 == 3 and y == 1 else 10.0 * h + y) for h in range(first, last) for y in range(cells) if (h, y) != (5, 2)]
    return spark.createDataFrame(rows, "T timestamp, Y int, X int, value double")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_chunks_round_trip_and_append(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    chunks.write_chunks(grid(spark, 0, 30), path, 3600.0, steps=8)
    chunks.write_chunks(grid(spark, 30, 50), path, 3600.0, steps=8)
    back = chunks.read_chunks(spark, path)
    assert back.dtypes == [("T", "timestamp"), ("Y", "bigint"), ("X", "bigint"), ("value", "double")]
    assert plain(back) == plain(grid(spark, 0, 50))
    # Times that are there already are no append; nothing changes.
    with pytest.raises(Exception, match="do not follow"):
        chunks.write_chunks(grid(spark, 49, 60), path, 3600.0)
    with pytest.raises(Exception, match="has columns"):
        chunks.write_chunks(grid(spark, 60, 61).withColumnRenamed("value", "other"), path, 3600.0)
    assert plain(chunks.read_chunks(spark, path)) == plain(grid(spark, 0, 50))
    assert len(list((tmp_path / "table/blocks").iterdir())) == sum(len(m["blocks"]) for m in chunks.Folder(path).manifests())
    chunks.write_chunks(grid(spark, 2, 4), path, 3600.0, mode="overwrite")
    assert plain(chunks.read_chunks(spark, path)) == plain(grid(spark, 2, 4))
    chunks.write_chunks(grid(spark, 0, 0), path, 3600.0, mode="overwrite")
    assert chunks.read_chunks(spark, path).count() == 0


def test_chunks_are_pruned(spark, tmp_path):
    """A window reads only the blocks that may hold it; brackets add a step on either side. One scan says nothing to the next."""
    path = f"file://{tmp_path}/table"
    whole = grid(spark, 0, 100)
    chunks.write_chunks(whole, path, 3600.0, steps=10)
    back = chunks.read_chunks(spark, path)
    at = lambda h: F.lit(ZERO + timedelta(hours=h))
    for asked in (lambda t: t == at(42), lambda t: t > at(90), lambda t: t == at(500), lambda t: (t < at(5)) | (t > at(95)), lambda t: t.isNotNull()):
        assert plain(back.where(asked(F.col("T")))) == plain(whole.where(asked(F.col("T"))))
    blocks = [b for m in chunks.Folder(path).manifests() for b in m["blocks"]]
    micros = lambda h: int((ZERO - datetime(1970, 1, 1)) / timedelta(microseconds=1)) + h * 3_600_000_000
    iso = lambda h: (ZERO + timedelta(hours=h)).isoformat()
    for low, high in ((42, 42), (38, 51), (0, 10), (95, 999), (500, 501), (-9, 999)):
        got = chunks.read_chunks(spark, path, iso(low), iso(high))
        many = sum(b[2] >= micros(low) and b[1] <= micros(high) for b in blocks)
        assert got.rdd.getNumPartitions() == max(1, many) and plain(got) == plain(whole.where(F.col("T").between(at(low), at(high))))
    inner = chunks.read_chunks(spark, path, "2024-01-02T17:30:00", "2024-01-02T20:00:00")
    assert plain(inner) == plain(whole.where(F.col("T").between(at(42), at(44)))) and inner.rdd.getNumPartitions() <= 2
    wide = chunks.read_chunks(spark, path, "2024-01-02T15:30:00", "2024-01-02T16:30:00", bracket=True)
    assert plain(wide) == plain(whole.where(F.col("T").between(at(39), at(41)))) and wide.rdd.getNumPartitions() <= 2
    beyond = chunks.read_chunks(spark, path, "2023-01-01", "2025-01-01", bracket=True)
    assert plain(beyond) == plain(whole)
    # What is interpolated inside a window is the same from the pruned table.
    steps = spark.createDataFrame([(ZERO + timedelta(hours=39, minutes=30 + 10 * i),) for i in range(9)], "T timestamp")
    same = [align.as_of(t.select("T", "Y", "value"), steps, m, ["Y"]) for m in ("linear", "nearest", "ffill") for t in (wide, whole.withColumn("Y", F.col("Y").cast("long")))]
    assert all(plain(a) == plain(b) for a, b in zip(same[::2], same[1::2], strict=True))


def test_failed_task_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    chunks.write_chunks(grid(spark, 0, 10), path, 3600.0)
    broken = grid(spark, 10, 40).repartition(4).withColumn("value", F.when(F.hour("T") == 13, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        chunks.write_chunks(broken, path, 3600.0, steps=2)
    assert plain(chunks.read_chunks(spark, path)) == plain(grid(spark, 0, 10))
    assert len(chunks.Folder(path).manifests()) == 1
    chunks.write_chunks(grid(spark, 10, 40), path, 3600.0)
    assert plain(chunks.read_chunks(spark, path)) == plain(grid(spark, 0, 40))
    with pytest.raises(Exception, match="must not be null"):
        chunks.write_chunks(grid(spark, 50, 52).withColumn("Y", F.lit(None).cast("int")), path, 3600.0)
    with pytest.raises(Exception, match="no chunks"):
        chunks.read_chunks(spark, f"file://{tmp_path}/nothing").count()
    with pytest.raises(Exception, match="not so"):
        chunks.write_chunks(grid(spark, 50, 52).withColumn("name", F.lit("x")), path, 3600.0)


def test_commit_is_safe_to_repeat(tmp_path):
    folder = chunks.Folder(str(tmp_path / "table"))
    for _ in range(2):
        folder.commit({"job": "one", "replaces": False, "schema": {}, "blocks": []})
    folder.commit({"job": "two", "replaces": False, "schema": {}, "blocks": []})
    assert [m["job"] for m in folder.manifests()] == ["one", "two"]
