"""Error metrics between predictions and observations, masked or not, as aggregations.

A pair with a null on either side counts in no mean, masked means count it in their number; NaN makes a metric NaN. No pairs, or
none under the mask, give null, or 0 for a masked mean. Every metric is one aggregation with partial sums in every task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weight(mask: Column | None) -> Column:
    return F.lit(1.0) if mask is None else F.coalesce(mask.cast("boolean").cast("double"), F.lit(0.0))


def _mean(x: Column, mask: Column | None) -> Column:
    """Mean; a masked one divides by the masked count, one at least."""
    if mask is None:
        return F.avg(x)
    w = _weight(mask)
    return F.sum(F.when(w > 0, x * w).otherwise(0.0)) / F.greatest(F.sum(w), F.lit(1.0))


def mse(pred: Column, obs: Column, mask: Column | None = None) -> Column:
    return _mean((pred - obs) * (pred - obs), mask)


def rmse(pred: Column, obs: Column, mask: Column | None = None) -> Column:
    return F.sqrt(mse(pred, obs, mask))


def nrmse(pred: Column, obs: Column, mask: Column | None = None, mode: str = "std") -> Column:
    """rmse over the population standard deviation, the absolute mean or the range of the observations.

    A norm that is not finite counts as 1, one below 1e-10 as 1e-10.
    """
    seen = obs if mask is None else F.when(_weight(mask) > 0, obs)
    if mode == "std":
        mean_square, mean = _mean(obs * obs, mask), _mean(obs, mask)
        norm = F.stddev_pop(seen) if mask is None else F.coalesce(F.stddev_pop(seen), F.sqrt(F.greatest(mean_square - mean * mean, F.lit(0.0))))
    elif mode == "mean":
        norm = F.abs(_mean(obs, mask))
    elif mode == "minmax":
        norm = F.max(seen) - F.min(seen)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    norm = F.when(norm.isNull() | F.isnan(norm) | (F.abs(norm) == float("inf")), 1.0).otherwise(norm)
    return rmse(pred, obs, mask) / F.greatest(norm, F.lit(1e-10))


METRICS: dict[str, Callable[..., Column]] = {
    "mse": mse,
    "rmse": rmse,
    "nrmse": nrmse,
    "nrmse_std": nrmse,
    "nrmse_mean": lambda p, o, m=None: nrmse(p, o, m, "mean"),
    "nrmse_minmax": lambda p, o, m=None: nrmse(p, o, m, "minmax"),
}


def metric(name: str | Callable[..., Column]) -> Callable[..., Column]:
    if callable(name):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; there are {', '.join(METRICS)}")
    return METRICS[name]


def composite_loss(parts: list[tuple[DataFrame, str | Callable[..., Column], float]], key: str = "E", penalty: float = 1e6) -> DataFrame:
    """Weighted sum of metrics per member: each part is (rows with key, pred, obs), a metric and a weight.

    A loss that is not finite becomes ``penalty``, also where a member has no pairs in a part. A member that
    no part has is not returned, a null key is a member. Other columns are ignored.
    """
    rows = None
    for df, name, weight in parts:
        one = df.groupBy(key).agg((metric(name)(F.col("pred"), F.col("obs")) * F.lit(float(weight))).alias("loss"))
        rows = one if rows is None else rows.unionByName(one)
    loss = F.sum("loss")
    return rows.groupBy(key).agg(loss.alias("loss")).withColumn(
        "loss", F.when(F.col("loss").isNull() | F.isnan("loss") | (F.abs("loss") == float("inf")), F.lit(penalty)).otherwise(F.col("loss"))
    )


def combined_groups(rows: DataFrame, keys: list[str], value: str = "pred", weight: Column | float = 1.0) -> DataFrame:
    """Weighted sum of ``value`` over the groups that one observation of ``keys`` covers, as ``pred``; nulls count as nothing."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return rows.groupBy(*keys).agg(F.sum(F.col(value) * w).alias("pred"))


def population_stats(losses: DataFrame, key: str = "E") -> DataFrame:
    """Best member (the first of equals), best loss, mean of the finite losses and their number."""
    finite = F.when(~F.isnan("loss") & (F.abs("loss") < float("inf")), F.col("loss"))
    best = F.min(F.when(finite.isNotNull(), F.struct(F.col("loss"), F.col(key))))
    return losses.agg(best.alias("b"), F.avg(finite).alias("mean_loss"), F.count(finite).alias("n_valid")).select(
        F.col(f"b.{key}").alias("best"), F.col("b.loss").alias("best_loss"), "mean_loss", "n_valid"
    )
