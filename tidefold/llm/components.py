"""Connected components by minimum labels with pointer shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import hot_keys, join_unique, materialise

MAX_ROUNDS = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst bigint) -> (node, component), component the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (a partial minimum before the
    shuffle, so hubs stay cheap), then replaces each label by the label of the node it names, which
    doubles the reach. Rounds grow with the logarithm of the diameter. Labels are written out each
    round; only counts come to the driver. Hubs and large components are joined apart, by broadcast. Null ends and self links are ignored;
    nodes that occur in no link are not returned; no links give an empty table.
    """
    links = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = materialise(links.union(links.select(F.col("dst"), F.col("src"))).distinct(), "links")
    hubs = materialise(hot_keys(both, "dst", both.count()), "hubs")
    labels = materialise(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
        .select("node", F.least("node", "m").alias("component")),
        "labels",
    )
    for _ in range(MAX_ROUNDS):
        seen = (
            join_unique(both, labels.withColumnRenamed("node", "dst"), "dst", hubs)
            .groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        )
        near = labels.join(seen, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("component")
        )
        near = materialise(near, "labels")
        up = near.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = join_unique(near, up, "component", hot_keys(near, "component", near.count())).select(
            "node", F.col("top").alias("component"), (F.col("top") != F.col("old")).alias("moved")
        )
        jumped = materialise(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
