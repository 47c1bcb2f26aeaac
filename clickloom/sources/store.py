"""The fact store: an append-only Parquet table, one folder per unit and property.

Folders are `unit=U/prop=P/ingest=I` (prop 0 for edges; I names the append), so a scan of some
units prunes the rest by partition filters, columns of other units are never read, and an append
that runs again replaces what it wrote.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import PROPERTIES, RECORD, is_valid
from ..workspace import children, delete, exists, file_system, get_text, put_text, rename

#: Records of one file, about.
FILE_RECORDS = 2_000_000


def target(unit: Column, prop: Column) -> Column:
    """The folders of a record: the unit, and for properties the property value."""
    return F.when(unit.isin(*[u for u, p in PROPERTIES.items() if p]), F.array(unit.cast("string"), prop.cast("string"))).otherwise(F.array(unit.cast("string")))


def is_target(folders: Column) -> Column:
    """Whether a list of folder names leads to records: a known unit; a property's known value; edges take any rest."""
    first, second = F.try_element_at(folders, F.lit(1)), F.try_element_at(folders, F.lit(2))
    known = F.lit(False)
    for unit, props in PROPERTIES.items():
        fits = second.try_cast("int").isin(*props) if props else F.lit(True)
        known = known | ((first.try_cast("int") == unit) & F.coalesce(fits, F.lit(False)))
    return F.coalesce(known, F.lit(False))


class FactStore:
    """A store of records at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        self.recover()
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(StructType([*RECORD.fields, StructField("ingest", StringType())])).parquet(self.path).drop("ingest")

    def scan(self, *targets: int | Sequence[int]) -> DataFrame:
        """Records of the given targets, each a unit or a (unit, property) pair; pruned by folder."""
        wanted = F.lit(False)
        for t in targets:
            unit, prop = (t, None) if isinstance(t, int) else (t[0], t[1] if len(t) > 1 else None)
            one = F.col("unit") == unit
            wanted = wanted | (one if prop is None else one & (F.col("prop") == prop))
        return self.read().where(wanted)

    def append(self, records: DataFrame, check: bool = True, ingest: str | None = None) -> None:
        """Add records. Those that lack required fields stop the write, if checked.

        Records are dealt by folder and a salt: rebalancing splits a hot folder and joins small
        ones, so each folder gets few files of a good size. ingest: a name of this append; one of
        the same name and records before it is replaced.
        """
        if check:
            bad = F.when(~is_valid(), F.raise_error(F.lit("a record lacks required fields"))).otherwise(F.lit(True))
            records = records.where(bad)
        dealt = records.select(RECORD.fieldNames()).hint("rebalance", "unit", "prop").withColumn("ingest", F.lit(ingest or uuid.uuid4().hex))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit", "prop", "ingest").option("maxRecordsPerFile", FILE_RECORDS).parquet(self.path)

    def compact(self, into: str | None = None) -> FactStore:
        """The same records in few files: a copy at another path, or this store itself.

        In place, the copy is written beside the store and then takes its name by two renames; a
        crash before them leaves the store as it was, one between them is mended by the next
        read. Nobody may append meanwhile.
        """
        out = FactStore(self.spark, into or f"{self.path}.compacting")
        if not into:
            delete(self.spark, out.path)
        out.append(self.read(), check=False)
        if into:
            return out
        if exists(self.spark, out.path):
            rename(self.spark, out.path, f"{self.path}.compact")
            rename(self.spark, self.path, f"{self.path}.old")
            self.recover()
        return self

    def recover(self) -> None:
        """Finish the renames of a compaction that a crash cut off."""
        if exists(self.spark, f"{self.path}.compact"):
            if not exists(self.spark, self.path):
                rename(self.spark, f"{self.path}.compact", self.path)
            else:  # the store had not made way yet
                delete(self.spark, f"{self.path}.compact")
        if exists(self.spark, f"{self.path}.old") and exists(self.spark, self.path):
            delete(self.spark, f"{self.path}.old")


class Landing:
    """Where new records arrive, unpartitioned."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, records: DataFrame) -> None:
        records.select(RECORD.fieldNames()).write.mode("append").parquet(self.path)

    def snapshot(self) -> list[str]:
        """The complete files of this moment."""
        if not exists(self.spark, self.path):
            return []
        fs, p = file_system(self.spark, self.path)
        return sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(".parquet"))

    def read(self, files: Iterable[str]) -> DataFrame:
        files = list(files)
        return self.spark.read.schema(RECORD).parquet(*files) if files else self.spark.createDataFrame([], RECORD)

    def drop(self, files: Iterable[str]) -> None:
        for f in files:
            fs, p = file_system(self.spark, f)
            fs.delete(p, False)


def ingest(landing: Landing, master: FactStore) -> int:
    """Move what has arrived into the master, once each; returns the files moved.

    Just the files listed at the start are read and then dropped, so records that arrive meanwhile
    stay for the next time. The list is written down first, and whether its records are in the
    master after that: a move that a crash cut off is finished by the next one, and its records
    replace what it wrote. One ingest runs at a time.
    """
    moved, notes, spark = 0, f"{landing.path}/_ingest", landing.spark
    while True:
        plans = [n for n in children(spark, notes) if n.endswith(".plan")]
        if plans:
            name = plans[0].removesuffix(".plan")
            files = json.loads(get_text(spark, f"{notes}/{plans[0]}"))
        else:
            name, files = uuid.uuid4().hex, landing.snapshot()
            if not files:
                return moved
            put_text(spark, f"{notes}/{name}.plan", json.dumps(files))
        if not exists(spark, f"{notes}/{name}.written"):
            master.append(landing.read(files), ingest=name)
            put_text(spark, f"{notes}/{name}.written", "")
        landing.drop(files)
        delete(spark, f"{notes}/{name}.plan")
        delete(spark, f"{notes}/{name}.written")
        moved += len(files)
        if not plans:
            return moved
