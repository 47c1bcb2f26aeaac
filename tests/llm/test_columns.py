"""Extra columns with the names that operators use inside come back untouched."""

import pytest

pytest.importorskip("clickloom.llm.queries")
from clickloom.llm import mixing, quality, secret_scan, simhash  # noqa: E402

NAMES = ["below", "passes", "_h", "_copy", "_source", "of", "row", "h", "n", "c", "fp", "k", "x", "col", "component_id", "band", "keep", "named", "source_size", "bucket"]


@pytest.mark.parametrize("stage", [mixing.mixed, simhash.keep_first, secret_scan.redact, quality.keep_good], ids=lambda f: f.__name__)
@pytest.mark.parametrize("ids", [[1, 2, 3, 4], [1, 1, None, 4]])
def test_clashing_names(spark, stage, ids):
    words = "the quick brown fox jumps over a lazy dog and then it runs far away into some other wood".split()
    rows = [(i, " ".join(words[k:] + words[:k]), None if k == 3 else "s", *(f"{n}{k}" for n in NAMES)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in NAMES))
    out = stage(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and {tuple(r) for r in got} <= {tuple(r) for r in rows}
    assert stage(df.limit(0)).collect() == []


def test_empty_tables(spark):
    from clickloom.llm import pieces, queries

    df = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.scan_documents(df).collect() == [] and secret_scan.scan_digest(df).collect() == []
    path = queries.tokenizer_path("piece_bpe_32k.model")
    assert pieces.decode_documents(pieces.encode_documents(df, path), path).collect() == []
