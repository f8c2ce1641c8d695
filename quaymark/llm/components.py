"""Connected components by hooking and pointer jumping, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _flatten(parents: DataFrame) -> DataFrame:
    """``x, p`` with p <= x: follow p until it no longer changes."""
    while True:
        up = parents.select(F.col("x").alias("p"), F.col("p").alias("g"))
        jumped = keep(
            parents.join(up, "p", "left").select("x", F.coalesce("g", "p").alias("q"), "p"), "jump"
        )
        done = jumped.where("q <> p").isEmpty()
        parents = jumped.select("x", F.col("q").alias("p"))
        if done:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (a, b longs) with its component's least node.

    Returns ``node, label``. Each round hooks every label to its least
    neighbour, flattens the chains by pointer jumping and contracts the
    edges; the rounds grow with the logarithm of the longest path. No edges
    give an empty table; loops and repeated edges do no harm.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
        edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
    )
    live = keep(both.where("x <> y").distinct(), "edges")
    labels = live.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct()
    while not live.isEmpty():
        least = live.groupBy("x").agg(F.min("y").alias("m"))
        hooks = _flatten(keep(least.select("x", F.least("x", "m").alias("p")), "hook"))
        named = hooks.select(F.col("x").alias("label"), F.col("p"))
        labels = keep(
            labels.join(named, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "label"
        )
        left = hooks.select("x", F.col("p").alias("px"))
        right = hooks.select(F.col("x").alias("y"), F.col("p").alias("py"))
        live = keep(
            live.join(left, "x").join(right, "y").where("px <> py")
            .select(F.col("px").alias("x"), F.col("py").alias("y")).distinct(),
            "edges",
        )
    return labels
