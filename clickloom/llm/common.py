"""What the operators of this subpackage share: shipping code, shared folders, Arrow mapping."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import discard, materialise, work_dir  # noqa: F401

#: A word, as every operator here counts them: a run without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch to Python, unless the session sets its own: executors hold a few batches per task outside the heap.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors once per Spark context, and bound the session's Arrow batches by bytes.

    Spark's own bounds are 10,000 rows and 64 MB, and growing buffers double on the way there.
    """
    sc = spark.sparkContext
    if sc.getConf().get(BATCH_SETTING) is None and spark.conf.get(BATCH_SETTING) == f"{64 << 20}b":
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    if getattr(sc, "_clickloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="clickloom-"), "clickloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    sc._clickloom_shipped = True


def binary_text(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.encode(F.col(name), "UTF-8"), F.lit(b"")).alias(name)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], piece_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow over bounded slices.

    make() runs once per task and returns a function from a record batch to columns. Batches
    are cut so that a slice holds about piece_bytes (or one row): memory follows the longest
    document, not the batch.
    """
    ship(df.sparkSession)
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in slices(batch, piece_bytes):
                got = work(piece)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if not isinstance(got[f.name], pa.Array) else got[f.name] for f in target], schema=target)

    return df.mapInArrow(run, schema)


def gather(entries: list[bytes], index: np.ndarray, cuts: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of entries[i] for each i of index, in one array, and where those of index[cuts] begin (with the end)."""
    size = np.fromiter(map(len, entries), np.int32, len(entries)) // kind().itemsize
    start = (np.cumsum(size) - size).astype(np.int32)
    pool = np.frombuffer(b"".join(entries), kind)
    n = size[index]
    stops = np.cumsum(n, dtype=np.int64)
    if not len(stops) or stops[-1] < 1 << 31:
        stops = stops.astype(np.int32)
    at = np.repeat(start[index] - (stops - n), n)
    at += np.arange(len(at), dtype=at.dtype)
    return pool[at], np.r_[stops[:0], np.zeros(1, stops.dtype), stops][cuts]


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def slices(batch: pa.RecordBatch, piece_bytes: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    step = -(-n // max(1, round(batch.nbytes / piece_bytes)))
    for i in range(0, n, step):
        yield batch.slice(i, min(step, n - i))
