"""The compression bands: an independent verdict, held-out accuracy of the fit, and short texts."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard

pytest.importorskip("clickloom.llm.queries")
from clickloom.llm import quality  # noqa: E402
from test_operators import base, docs, sample  # noqa: E402


def limits(knots, n):
    """By numpy's interpolation over log2 of the length."""
    at = [math.log2(max(k, 1)) for k, _, _ in knots]
    return tuple(float(np.interp(math.log2(n), at, [k[i] for k in knots])) for i in (1, 2))


def verdict(text):
    n, _, _, _, repeated = base(text)
    b, bands, z = text.encode(), quality.Bands(), zstandard.ZstdCompressor(level=3)
    if n < 10 or 100 * repeated > 20 * n:
        return False
    low, high = limits(bands.whole, len(b))
    if not low <= len(b) / len(z.compress(b)) <= high:
        return False
    if len(b) <= 1024:
        return True
    low, high = limits(bands.chunk, len(b))
    chunks = [c for c in (b[i : i + 1024] for i in range(0, len(b), 1024)) if len(c) >= 512]
    return sum(not low <= len(c) / len(z.compress(c)) <= high for c in chunks) <= 0.2 * len(chunks)


def test_whole_verdict(spark, sf):
    rnd = random.Random(1)
    rows = [*sample(spark, sf), *((20_000 + k, "".join(rnd.choices("abcdefghij  \n#&%", k=10 + 37 * k)), "s") for k in range(120))]
    got = {(r.doc_id, r.n_words, r.word_chars): r.kept for r in quality.quality(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        assert got[(i, *base(t or "")[:2])] == verdict(t or ""), i


def labelled(sf="/root/testdata/sf0.01"):
    """(text, quality) of labelled documents that pass the base rules."""
    of = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    out = [(i, texts[i], q) for i, q in of.items() if texts.get(i)]
    fine = lambda f: f[0] >= 10 and 100 * f[4] <= 20 * f[0]
    return [x for x in out if fine(quality.base_features(x[1].encode()))]


def kept(rows, bands):
    z = zstandard.ZstdCompressor(level=bands.level)
    return np.mean([quality.compression_verdict(t.encode(), bands, z)[3] for _, t, _ in rows])


def test_the_bands_decide():
    """Good texts stay, and most of the bad ones that the base rules let pass go."""
    rows = labelled()
    assert kept([x for x in rows if x[2] == 1], quality.Bands()) >= 0.98
    assert kept([x for x in rows if x[2] == 0], quality.Bands()) <= 0.5


def test_fit_on_held_out_texts():
    rows = labelled()
    z = zstandard.ZstdCompressor(level=3)
    half = [x for x in rows if x[0] % 2 == 0 and x[2] == 1][: quality.FIT_TEXTS]
    sizes = np.array([len(t.encode()) for _, t, _ in half])
    ratios = np.array([len(t.encode()) / len(z.compress(t.encode())) for _, t, _ in half])
    whole = quality.fit(sizes, ratios, (256, 512, 1024, 2048, 4096, 8192), (0.7, 6.0))
    assert all(low < high for _, low, high in whole) and sum(x[1:] != (0.7, 6.0) for x in whole) >= 3
    bands, rest = quality.Bands(whole=whole, chunk=((0, 0.0, 99.0),)), [x for x in rows if x[0] % 2]
    assert kept([x for x in rest if x[2] == 1], bands) >= 0.93
    assert kept([x for x in rest if x[2] == 0], bands) <= 0.6


def test_fit_without_enough_texts():
    assert quality.fit(np.array([500, 600]), np.array([1.5, 1.6]), (512, 1024), (0.5, 4.0)) == ((512, 0.5, 4.0), (1024, 0.5, 4.0))


def test_short_texts_and_noise():
    z, b = zstandard.ZstdCompressor(level=3), quality.Bands()
    rnd = random.Random(5)
    noise = lambda n: "".join(chr(rnd.randrange(33, 127)) for _ in range(n)).encode()
    for n in (128, 200, 300, 1000, 5000, 50_000):
        assert not quality.compression_verdict(noise(n), b, z)[3]
        assert not quality.compression_verdict((b"all work and no play " * 4000)[:n], b, z)[3] or n < 256
    assert quality.compression_verdict(b"", b, z)[3]
