"""Identity edges: both directions, and one step towards the least identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_directions(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, other) twice per edge; self-loops go."""
    pair = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("other"))
    return edges.where(F.col(a) != F.col(b)).select(F.inline(F.array(pair(a, b), pair(b, a))))


def step(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One step of label propagation: (least, id, is_new) for every node's neighbourhood.

    Each id of a neighbourhood but the least is tied to the least. is_new: the neighbourhood has
    more than two ids and its own node isn't the least, so that the step may have found
    something. The least comes from a partial aggregate and is joined back, so no neighbourhood
    is gathered in memory.
    """
    both = both_directions(edges, a, b).distinct()
    least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"), F.count("*").alias("n"))
    members = both.select("node", F.col("other").alias("id")).union(least.select("node", F.col("node").alias("id")))
    return (
        members.join(least.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
        .where("id <> least")
        .select("least", "id", ((F.col("n") + 1 > 2) & (F.col("node") != F.col("least"))).alias("is_new"))
    )
