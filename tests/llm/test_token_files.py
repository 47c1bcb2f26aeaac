"""Token files read by another session, texts with special strings, many rows of one id."""

import subprocess
import sys
from collections import Counter
from pathlib import Path
from zlib import crc32

import pytest

pytest.importorskip("clickloom.llm.queries")
from clickloom.llm import queries, token_files  # noqa: E402
from test_operators import docs  # noqa: E402

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|> z's", "plain text, no strings", "<|endoftext| >", "", None, "\u00e9 <|endoftext|>\u3042"]


def want(rows, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out[(i, len(ids), crc32(b"".join(x.to_bytes(4, "little") for x in ids)))] += 1
    return out


def test_special_strings_as_the_library_has_them(spark, tmp_path):
    """What op1 does: the library as it comes."""
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rows = list(enumerate(TEXTS))
    docs(spark, [(i, t, "s") for i, t in rows]).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op1_token_files(spark, f"file://{tmp_path}").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want(rows, path)


def test_another_session_reads_them(spark, tmp_path):
    """The files hold all that reading takes: a session of its own decodes them."""
    path, base = queries.tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/out"
    rows = [(k % 9 or None, f"{t} {k % 4}") for k, t in enumerate([x or "" for x in TEXTS] * 12)]
    token_files.write_token_files(docs(spark, [(i, t, "s") for i, t in rows]), base, path, 2, special=True)
    code = f"""
import sys
sys.path.insert(0, {str(Path(token_files.__file__).parents[2])!r})
from pyspark.sql import SparkSession
from clickloom.llm.token_files import read_token_files
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("GOT", [tuple(r) for r in read_token_files(spark, {base!r}).collect()])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout
    got = eval(next(x for x in out.splitlines() if x.startswith("GOT"))[4:])
    assert Counter((i, n, c) for i, _, n, c in got) == want(rows, path)
    at = 0
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [i or 0 for i, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order)


def test_other_ranks_are_refused(spark, tmp_path):
    path, base = queries.tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/out"
    token_files.write_token_files(docs(spark, [(1, "some text", "s")]), base, path, 2)
    spark.createDataFrame([(0, 5), (1, 2)], "rank int, id long").write.mode("overwrite").parquet(f"{base}/ranks")
    with pytest.raises(Exception, match="another table of ranks"):
        token_files.read_token_files(spark, base).collect()
