"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Settled


def components(links: DataFrame, settle: Settled) -> DataFrame:
    """(id, component) of every id in links(src, dst); component is the smallest id reachable.

    Each round points every vertex at its smallest neighbour, follows those pointers to their
    ends by doubling, and contracts every tree to its root. A vertex that has a neighbour is in
    a tree of two at least, so the number of live vertices halves per round whatever the shape
    of the graph; a star of any size takes one round. Nothing is collected but counts.
    Null ends and self-links are ignored.
    """
    live = links.select("src", "dst").where("src <> dst")
    live = settle(live.union(live.select(F.col("dst"), F.col("src"))).distinct())
    total = None
    while not live.isEmpty():
        up = settle(live.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("id"), F.least("src", "low").alias("root")))
        while True:
            over = up.select(F.col("id").alias("root"), F.col("root").alias("next")).where("root <> next")
            jumped = settle(up.join(over, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            settle.drop(up)
            up = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        if total is None:
            total = up
        else:
            old = total
            total = settle(old.join(up.select(F.col("id").alias("root"), F.col("root").alias("higher")), "root", "left").select("id", F.coalesce("higher", "root").alias("root")))
        step = up.where("id <> root")
        for end in ("src", "dst"):
            live = live.join(step.select(F.col("id").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        live = settle(live.where("src <> dst").distinct())
    if total is None:
        return live.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return total.select("id", F.col("root").alias("component"))
