"""The corpus pipeline: documents through five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import mixing, pieces, quality, secret_scan, simhash
from clickloom.llm.common import work_dir
from clickloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_first(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark."""
    return secret_scan.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows taken as often as the sources' target weights ask for."""
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row's text, with what decoding them says."""
    return pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("secret scans", secret_redaction),
    ("source mix", source_mix),
    ("piece encoding", piece_encoding),
]

#: XXH64 fingerprints, zstandard and the piece automaton have no SQL; a brute-force version tests run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
