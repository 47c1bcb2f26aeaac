"""Looking at rows on their way, without taking them to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def debug(rows: DataFrame, seen: Observation, name: str = "debug") -> DataFrame:
    """rows, each with a 1 in a new column; computing them tells `seen` their number, the least and the greatest, as JSON.

    Rows aren't printed one by one: that would fill the logs of every executor. An empty table
    has no least and no greatest row.
    """
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name} already")
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.observe(seen, F.count("*").alias("rows"), F.min(row).alias("least"), F.max(row).alias("greatest")).withColumn(name, F.lit(1))
