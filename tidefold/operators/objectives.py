"""What is observed against what members predict: by the nearest output, or by a transform of the outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import coords_to_indices

Transform = Callable[[DataFrame], DataFrame]


def paired(
    outputs: DataFrame, observations: DataFrame, observed: str, target: str | None = None, transform: Transform | None = None,
    coords: dict[str, DataFrame] | None = None, member: str = "E", strict: bool = False,
) -> DataFrame:
    """(member, keys, obs, pred): each observation with what every member predicts for it. Exactly one of ``target`` and ``transform``.

    All columns of ``observations`` but ``observed`` are keys. With ``target``, a key with ``coords`` is found by
    the nearest coordinate and joined with the outputs' index (t_idx for T, else its own name), others by
    equality; ``outputs`` has a row for each member and key. With ``transform``, it makes rows (member, keys,
    pred) of the outputs, joined by equality. Observations that a member does not predict do not come back;
    ``strict`` makes them, and predictions without observation, an error. Null keys meet nothing. Metrics take
    the result, see ``metrics.composite_loss``.
    """
    if (target is None) == (transform is None):
        raise ValueError("an objective has either a target or a transform")
    if observed not in observations.columns:
        raise ValueError(f"observations have no column {observed!r}")
    keys = [c for c in observations.columns if c != observed]
    coords = coords or {}
    if transform is not None:
        made = transform(outputs)
        if lacking := [c for c in (member, *keys, "pred") if c not in made.columns]:
            raise ValueError(f"the transform gives no {', '.join(lacking)}")
        seen, names = observations, {k: k for k in keys}
    else:
        names = {k: "t_idx" if k == "T" and k in coords else k for k in keys}
        if lacking := [n for n in (member, target, *names.values()) if n not in outputs.columns]:
            raise ValueError(f"outputs have no column {', '.join(lacking)}")
        made = outputs.withColumn("pred", F.col(target))
        seen = coords_to_indices(observations, coords, [k for k in keys if k in coords])
    made = made.select(F.col(member).alias("_member"), *[F.col(n).alias(f"_{k}") for k, n in names.items()], "pred")
    same = [F.col(f"{k}_idx" if k in coords and transform is None else k) == F.col(f"_{k}") for k in keys]
    if strict:
        gone, more = seen.join(made, same, "left_anti"), made.join(seen, same, "left_anti")
        if not gone.isEmpty() or (transform is not None and not more.isEmpty()):
            raise ValueError("predictions and observations have different keys")
    return seen.join(made, same).select(F.col("_member").alias(member), *keys, F.col(observed).alias("obs"), "pred")
