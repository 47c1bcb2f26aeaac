"""The pipeline against a brute-force version of its five stages."""

import hashlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("clickloom.llm.queries")
pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
import zstandard  # noqa: E402
from clickloom.llm import pieces, quality, queries, secret_scan  # noqa: E402
from test_operators import WORD, base, brute_components, brute_fingerprint  # noqa: E402


def brute(rows):
    """(doc_id, ids) of rows (doc_id, text, source) after all stages, as a Counter."""
    z, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    kept = []
    for i, text, source in rows:
        n, _, _, _, repeated = base(text or "")
        if n >= 10 and 100 * repeated <= 20 * n and quality.compression_verdict((text or "").encode(), bands, z)[3]:
            kept.append((i, text, source))
    fps = {i: brute_fingerprint(t or "") for i, t, _ in kept}
    of = brute_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[of[f]] = min(least.get(of[f], i), i)
    kept = [(i, secret_scan.redact_text(t), s) for i, t, s in kept if least[of[fps[i]]] == i]
    size = {i: len(WORD.findall(t)) for i, t, _ in kept}
    total = defaultdict(int)
    for i, _, s in kept:
        total[s] += size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate([*sorted(s for s in total if s is not None), *([None] if None in total else [])])}
    target, left, rest = {}, set(total), 1.5 * sum(total.values())
    while True:
        level = rest / sum(weight[s] for s in left)
        full = {s for s in left if 2 * total[s] <= level * weight[s]}
        for s in full:
            target[s] = 2.0 * total[s]
            rest -= target[s]
        left -= full
        if not full or not left:
            break
    target |= {s: level * weight[s] for s in left}
    model = pieces.pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    out = Counter()
    for s in total:
        order = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, t) for i, t, x in kept if x == s)
        passes = int(target[s] // total[s])
        need, run, taken = target[s] - passes * total[s], 0, set()
        for h, i, _ in order:
            if abs(run + size[i] - need) < abs(run - need):
                taken.add(i)
            run += size[i]
            if run > need:
                break
        for _, i, t in order:
            if passes + (i in taken):
                out[(i, tuple(model.encode(t).tolist()))] = passes + (i in taken)
    return out


def test_pipeline(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(9000, None, None), (9001, "", None), (9002, rows[3][1], rows[3][2]), (9003, "token = abcdefabcdefabcdef and nine or more other words of plain text that stay here", None)]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())
    assert got == brute(rows)
    columns = df.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, f"file://{tmp_path}").columns == columns


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
