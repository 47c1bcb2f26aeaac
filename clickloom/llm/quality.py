"""Quality rules: zstandard compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, map_rows, ship

#: Labelled good texts that fit() takes at most, and the fewest within an octave of a length that it goes by.
FIT_TEXTS, FIT_LEAST = 4096, 50


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio bytes / compressed bytes.

    whole, chunk: (bytes of the text, least ratio, most ratio), ascending. Between two lengths the
    limits change with the logarithm of the length; before the first and after the last they stay.
    chunk_bytes: length of the fixed chunks of texts longer than one; a last chunk under half of
    it isn't judged. A document goes if its whole ratio is outside its band, or if more than
    chunk_share of its judged chunks are outside the chunk band of its length.

    The defaults come from fit() over the good texts among the test tables' 3,980 labelled
    documents. Lengths of which there are too few (up to 64 bytes, from 32 KB on) have wide
    limits, against runs of one sentence and noise alone.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.7, 3.0), (64, 0.7, 3.0), (128, 0.997, 1.366), (256, 1.304, 1.642), (512, 1.394, 1.762), (1024, 1.676, 2.027),
        (2048, 1.868, 2.145), (4096, 2.034, 2.266), (8192, 2.178, 2.366), (16384, 2.282, 2.44), (32768, 1.3, 6.0),
    )
    chunk_bytes: int = 1024
    chunk: tuple[tuple[int, float, float], ...] = (
        (1024, 1.536, 2.0), (2048, 1.515, 1.977), (4096, 1.558, 1.989), (8192, 1.544, 1.979), (16384, 1.551, 1.986), (32768, 1.1, 4.0),
    )
    chunk_share: float = 0.2
    level: int = 3

    def limits(self, size: int, of: str) -> tuple[float, float]:
        """The least and the most ratio for a text of so many bytes."""
        knots = getattr(self, of)
        if size >= knots[-1][0]:
            return knots[-1][1:]
        k = next(k for k, x in enumerate(knots) if size < x[0])
        if not k:
            return knots[0][1:]
        (a, *before), (b, *after) = knots[k - 1], knots[k]
        t = (log2(size) - log2(max(a, 1))) / (log2(b) - log2(max(a, 1)))
        return tuple(x + t * (y - x) for x, y in zip(before, after))


def fit(sizes: np.ndarray, ratios: np.ndarray, knots: tuple[int, ...], wide: tuple[float, float], of: np.ndarray | None = None, tail: float = 0.001, margin: float = 0.01) -> tuple[tuple[int, float, float], ...]:
    """Limits at the lengths of knots from the ratios of good texts.

    The middle is the least-squares line through the knots over log2 of the length; the limits are
    the tail and 1 - tail quantiles of what is left within an octave of a knot, and margin. A knot
    with fewer than FIT_LEAST texts around it has the wide limits. of: the text that each ratio
    belongs to, where there are several of a text (chunks).
    """
    at, lg = np.log2(knots), np.log2(sizes)
    place = np.clip(lg - 0, at[0], at[-1])
    hats = np.stack([np.interp(place, at, row) for row in np.eye(len(knots))], axis=1)
    middle = np.linalg.lstsq(np.r_[hats, 1e-3 * np.eye(len(knots))], np.r_[ratios, np.zeros(len(knots))], rcond=None)[0]
    left = ratios - hats @ middle
    out = []
    for k, m, x in zip(knots, middle, at):
        near = np.abs(lg - x) <= 1
        texts = near.sum() if of is None else len(np.unique(of[near]))
        low, high = (m + np.quantile(left[near], [tail, 1 - tail])) if texts >= FIT_LEAST else wide
        out.append((k, *wide) if texts < FIT_LEAST else (k, round(float(low) - margin, 3), round(float(high) + margin, 3)))
    return tuple(out)


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of so many words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    code, size = ids[:n], len(seen)
    for k in range(1, width):
        if size * len(seen) >= 1 << 62:
            code, left = pd.factorize(code)
            size = len(left)
        code, size = code * len(seen) + ids[k : k + n], size * len(seen)
    codes, _ = pd.factorize(code)
    twice = np.bincount(codes)[codes] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_features(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = sum(joined.count(s) for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_window_words(words)


def compression_verdict(text: bytes, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """Whole ratio, chunks judged, chunks outside, and whether the text stays within its bands."""
    if not text:
        return None, 0, 0, True
    ratio = len(text) / len(z.compress(text))
    low, high = bands.limits(len(text), "whole")
    judged = outside = 0
    step = bands.chunk_bytes
    if len(text) > step:
        least, most = bands.limits(len(text), "chunk")
        view = memoryview(text)
        for i in range(0, len(text), step):
            part = view[i : i + step]
            if 2 * len(part) >= step:
                judged += 1
                outside += not least <= len(part) / len(z.compress(part)) <= most
    return ratio, judged, outside, low <= ratio <= high and outside <= bands.chunk_share * judged


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): counts, ratios and the verdict.

    Null text is empty: no words, so base_failed. Empty tables give no rows; repeated rows and
    null ids give a row each. One narrow pass, no shuffle; memory follows the longest text.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_outside long"

    def make():
        z = zstandard.ZstdCompressor(level=bands.level, write_content_size=True)

        def work(batch):
            rows = []
            for text in batch.column("text").to_pylist():
                f = base_features(text)
                failed = f[0] < 10 or 100 * f[4] > 20 * f[0]
                ratio, judged, outside, fine = compression_verdict(text, bands, z)
                rows.append((*f, failed, fine and not failed, ratio, judged, outside))
            names = [x.split()[0] for x in schema.split(", ")][1:]
            return {"doc_id": batch.column("doc_id")} | dict(zip(names, map(list, zip(*rows))))

        return work

    return map_rows(docs.select("doc_id", binary_text()), schema, make)


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that pass quality(), with all their columns, in one narrow pass and no join.

    Null, empty and short texts go; repeated rows and rows with null ids are judged one by one. An
    empty table gives no rows.
    """
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        z = zstandard.ZstdCompressor(level=bands.level, write_content_size=True)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = []
            for i in range(batch.num_rows):
                text = (texts[i].as_py() or "").encode()
                f = base_features(text)
                keep.append(f[0] >= 10 and 100 * f[4] <= 20 * f[0] and compression_verdict(text, bands, z)[3])
            yield batch.filter(pa.array(keep, pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)
