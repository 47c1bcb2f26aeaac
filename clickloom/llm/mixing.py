"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every row has a hash; a source takes whole passes over its rows, and then the rows below a hash
threshold. The threshold comes from histograms: sizes summed by source and hash bucket (a
partial aggregate, so a hot source's rows never gather), a running sum over a source's buckets
to the one that crosses the budget, and the same again inside that bucket alone, level by level
down to single hash values. No row is sorted, and applying the thresholds is a narrow filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, discard, materialise

#: Hashes have HASH_BITS bits; each level of the histogram splits a bucket by LEVEL_BITS of them.
HASH_BITS, LEVEL_BITS = 60, 10
#: Sources up to which their thresholds are broadcast; beyond, they are joined by an exchange.
BROADCAST_SOURCES = 20_000
#: Sources up to which a table of them is written by one task.
FEW_SOURCES = 200


def size_of(text: str = "text") -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def row_hash(key: str = "doc_id") -> Column:
    """60 bits of the MD5 of the key, so that any SQL engine can compute it; null hashes as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, carry weights in turn. share of all sizes is dealt by
    weight; a target stops at most times its source's size and the excess goes to the rest by
    weight, until none is above. With sources in the order of size / weight the capped ones come
    first, so running sums give the level: one window over one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_fill = W.orderBy(F.col("cap") / F.col("w"), F.col("k"))
    before, after = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    return (
        sizes.withColumn("k", F.row_number().over(by_name)).withColumn("w", w)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
        # the level of the first source that isn't full holds for all that follow
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("k"), F.col("level")))).over(everything)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))))
        .select("source", "source_size", "target")
    )


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, below): take each row passes times, and once more if its hash < below.

    rows: (source, size, h); goal: targets(). Of the two hash values around the budget the one
    that comes nearer to it wins, the lower at equal distance; rows of one hash go together.
    """
    files = 1 if goal.count() <= FEW_SOURCES else None
    state = materialise(
        goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("low", F.lit(0).cast("long")).withColumn("taken", F.lit(0).cast("long")).withColumn("last", F.lit(0).cast("long")),
        files,
    )
    bits, narrowed = HASH_BITS, None
    while bits > 0:
        step = min(LEVEL_BITS, bits)
        bits -= step
        inside = _with(rows, state.where("need > 0").select("source", "low", "need", "taken")).where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << (bits + step))))
        if bits + step < HASH_BITS and not narrowed:  # from here on, only the boundary buckets' rows are read
            rows = narrowed = materialise(inside.select("source", "size", "h"))
            inside = _with(rows, state.where("need > 0").select("source", "low", "need", "taken"))
        histogram = inside.groupBy("source", "low", "need", "taken", F.shiftright(F.col("h"), bits).alias("bucket")).agg(F.sum("size").alias("n"))
        running = F.col("taken") + F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        # the bucket that crosses the budget; without one (rounding at the end), the last
        crossed = (
            histogram.withColumn("run", running).withColumn("over", F.col("run") > F.col("need"))
            .groupBy("source").agg(
                F.min(F.when(F.col("over"), F.struct("bucket", "run", "n"))).alias("b"), F.max(F.struct("bucket", "run", "n")).alias("e"),
            )
            .select(F.col("source").alias("s"), F.coalesce("b", "e").alias("x"))
        )
        new = state.join(crossed, F.col("source").eqNullSafe(F.col("s")), "left")
        then = materialise(
            new.withColumn("low", F.coalesce(F.shiftleft(F.col("x.bucket"), bits), "low"))
            .withColumn("taken", F.coalesce(F.col("x.run") - F.col("x.n"), "taken")).withColumn("last", F.coalesce(F.col("x.n"), "last")).drop("s", "x"),
            files,
        )
        discard(state)
        state = then
    # low is one hash value now: rows below it come to taken, with it to taken + last
    extra = (F.col("need") > 0) & (F.abs(F.col("taken") + F.col("last") - F.col("need")) < F.abs(F.col("need") - F.col("taken")))
    return materialise(state.select("source", "source_size", "target", "passes", F.when(F.col("need") > 0, F.col("low") + extra.cast("long")).otherwise(F.lit(0)).cast("long").alias("below")), files)


def _with(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows with the columns of their source. Few sources (counted) are broadcast; many are joined
    by an exchange that adaptive execution splits where a source is hot."""
    named = per_source.withColumnRenamed("source", "_source")
    if per_source.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Sizes (doc_id, source, size, h) per row, and thresholds() per source."""
    rows = materialise(docs.select("doc_id", "source", size_of().alias("size"), row_hash().alias("h")))
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    return rows, thresholds(rows.select("source", "size", "h"), materialise(targets(sizes, weights, share, most)))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of docs (doc_id, source, text; others are ignored).

    taken is size times the copies the mix takes. Null text has size 0, a null source is a
    source of its own, null ids share a hash; repeated rows of one id are taken alike. A source
    without words, and an empty table, get nothing.
    """
    rows, limits = plan(docs, weights, share, most)
    copies = F.col("passes") + (F.col("h") < F.col("below")).cast("long")
    return _with(rows, limits).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs as the mix has them: rows repeated as often as they are taken, at most `most` times rounded up.

    Columns stay as they are, whatever their names. Nulls, ties, repeated rows and empty tables: see mix().
    """
    rows, limits = plan(docs, weights, share, most)
    discard(rows)
    named = limits.select(F.col("source").alias("of"), "passes", "below")
    if limits.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    tagged = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("source"), row_hash().alias("h"))
    copies = (F.col("passes") + (F.col("h") < F.col("below")).cast("long")).cast("int")
    out = tagged.join(named, F.col("source").eqNullSafe(F.col("of"))).where(copies > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")
