"""Whole-number time buckets: hours since the epoch and what they roll up to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Granularities with hours per bucket; a month is 28 days.
GRANULARITIES = {"h": 1, "d": 24, "w": 24 * 7, "m": 24 * 28}
HOUR = 3600


def quotient(a: Column, b: int) -> Column:
    """Whole-number division towards zero."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def hour_bucket(secs: Column) -> Column:
    """Hours since the epoch, towards zero: second -3599 is in hour 0."""
    return quotient(secs, HOUR)


def buckets(hour: Column) -> dict[str, Column]:
    """The bucket of an hour bucket at each granularity."""
    day = quotient(hour, 24)
    return {name: hour.cast("long") if hours == 1 else day if hours == 24 else quotient(day, hours // 24) for name, hours in GRANULARITIES.items()}


def granularities(hour: Column, **more: dict[str, Column]) -> Column:
    """A generator of (granularity, bucket) for an hour bucket: four rows, without a join. more: further columns, by granularity."""
    return F.inline(F.array(*[F.struct(F.lit(g).alias("granularity"), b.alias("bucket"), *[c[g].alias(n) for n, c in more.items()]) for g, b in buckets(hour).items()]))
