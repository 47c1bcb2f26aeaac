"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir.

    Where that is unset (tests, one machine) a local temporary folder stands in; a cluster
    without the setting is refused, since its executors would not see one another's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "clickloom-checkpoints")
    return f"{base.rstrip('/')}/clickloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame, files: int | None = None, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    files: at most so many, for tables known to be small; their last stage then has as few tasks.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    (df.coalesce(files) if files else df).write.mode("overwrite").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._clickloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_clickloom_path", None)
    if path:
        delete(df.sparkSession, path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its type."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, sorted; none where it doesn't exist."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: under another name first, then renamed."""
    fs, p = file_system(spark, path + ".writing")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, path + ".writing", path)


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = file_system(spark, path)
    if not fs.rename(p, file_system(spark, to)[1]):
        raise OSError(f"could not rename {path} to {to}")
