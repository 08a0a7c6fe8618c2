"""Observations against outputs, by target and by transform."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidefold.operators import metrics, objectives

ZERO = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def outputs(spark):
    return spark.createDataFrame([(e, t, y, 100.0 * e + 10 * t + y, "x") for e in range(2) for t in range(4) for y in range(3)], "E int, t_idx int, Y int, biomass double, obs string")


def test_target(spark, outputs):
    days = spark.createDataFrame([(i, ZERO + timedelta(days=i)) for i in range(4)], "idx int, value timestamp")
    rows = [(ZERO + timedelta(days=1, hours=11), 2, 0.5), (ZERO + timedelta(days=9), 0, 1.5), (None, 0, 2.5), (ZERO, None, 3.5), (ZERO, 9, 4.5), (ZERO, 1, None)]
    seen = spark.createDataFrame(rows, "T timestamp, Y int, seen double")
    got = objectives.paired(outputs, seen, "seen", target="biomass", coords={"T": days})
    assert got.columns == ["E", "T", "Y", "obs", "pred"]
    assert {(r.E, r.Y, r.obs, r.pred) for r in got.collect()} == {(0, 2, 0.5, 12.0), (1, 2, 0.5, 112.0), (0, 0, 1.5, 30.0), (1, 0, 1.5, 130.0), (0, 1, None, 1.0), (1, 1, None, 101.0)}
    losses = {r.E: r.loss for r in metrics.composite_loss([(got, "mse", 1.0)]).collect()}
    assert losses[0] == pytest.approx((11.5**2 + 28.5**2) / 2)
    with pytest.raises(ValueError, match="different keys"):
        objectives.paired(outputs, seen, "seen", target="biomass", coords={"T": days}, strict=True)
    assert objectives.paired(outputs, seen.limit(0), "seen", target="biomass", coords={"T": days}).count() == 0


def test_transform(spark, outputs):
    mean = lambda rows: rows.groupBy("E", "t_idx").agg(F.avg("biomass").alias("pred"))
    seen = spark.createDataFrame([(t, 10.0 * t) for t in range(4)], "t_idx int, seen double")
    got = objectives.paired(outputs, seen, "seen", transform=mean, strict=True)
    assert {(r.E, r.t_idx, r.obs, r.pred) for r in got.collect()} == {(e, t, 10.0 * t, 100.0 * e + 10 * t + 1) for e in range(2) for t in range(4)}
    for other in (seen.where("t_idx < 3"), seen.union(spark.createDataFrame([(7, 0.0)], seen.schema))):
        with pytest.raises(ValueError, match="different keys"):
            objectives.paired(outputs, other, "seen", transform=mean, strict=True)
    for wrong, message in (
        ({}, "either"), ({"target": "biomass", "transform": mean}, "either"), ({"transform": lambda rows: rows}, "gives no pred"), ({"target": "none"}, "no column none"),
    ):
        with pytest.raises(ValueError, match=message):
            objectives.paired(outputs, seen, "seen", **wrong)
    with pytest.raises(ValueError, match="no column"):
        objectives.paired(outputs, seen, "none", target="biomass")
