"""Connected components of an edge relation, by alternating large-star and small-star steps.

Both steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) keep the
components and end in stars around each component's least node. The number of rounds grows
with the logarithm of the graph, also on long chains. Least neighbours come from a partial
aggregate, so a hub's edges never gather in one task; joining them back is a plain
equi-join of two exchanged sides, which adaptive execution may broadcast or split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Materialises a DataFrame into at most so many files (None: as they come) and cuts its lineage.
Cut = Callable[[DataFrame, int | None], DataFrame]
#: Edges of one file: small graphs are written by few tasks.
FILE_EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b, distinct. One large-star or small-star step over them."""
    if large:
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # a node itself is tied to its least neighbour, the others to that as well
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        out = joined.select(F.inline(F.array(pair("v"), pair("u"))))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, cut: Cut, drop: Callable[[DataFrame], None] = lambda df: None, rounds: int = 100) -> DataFrame:
    """(node, root) for every node that isn't the least of its component.

    edges: two columns of one orderable type; self-loops and nulls are ignored, repeats do no
    harm. cut: materialises a DataFrame and cuts its lineage; drop: frees what cut made.
    """
    left, right = edges.columns
    now = cut(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct(),
        None,
    )
    before = _print(now)
    for _ in range(rounds if before[0] else 0):
        # both steps of a round are one plan, written once
        then = cut(_star(_star(now, True), False), 1 + before[0] // FILE_EDGES)
        drop(now)
        now = then
        after = _print(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _print(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: equal sets have equal ones."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
