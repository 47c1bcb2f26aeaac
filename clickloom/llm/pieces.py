"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton over all pieces reads the text once; at each character its output links give
every piece that ends there, and each relaxes the best score at that position. The result is
the segmentation of the highest total score, as SentencePiece defines it for unigram models.
A model of another type is read as a unigram model over its pieces and scores: its ids then
are those of the best-scoring path, not of the merge order.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, map_rows

SPACE = "▁"
#: Penalty below the least score for a character that no piece covers (SentencePiece's value).
UNKNOWN_PENALTY = 10.0
#: Bytes of text that are encoded together: the more, the fewer of their words are distinct.
TOGETHER = 3 << 20


class Pieces:
    """A piece model: encode() to ids, decode() back. Needs identity normalisation."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and escaped white space are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.byte_fallback = model.trainer_spec.byte_fallback
        kinds = pb.ModelProto.SentencePiece
        self.automaton = ahocorasick.Automaton()
        self.singles = set()
        self.lengths = [len(p.piece) for p in model.pieces]
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        least = 0.0
        splits = True
        for i, p in enumerate(model.pieces):
            out = b""
            if p.type == kinds.NORMAL:
                self.automaton.add_word(p.piece, (i, len(p.piece), p.score))
                least = min(least, p.score)
                if len(p.piece) == 1:
                    self.singles.add(p.piece)
                splits &= SPACE not in p.piece.lstrip(SPACE)
                out = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                out = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
                out = " ⁇ ".encode()
            elif p.type == kinds.USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
            self.bytes_of.append(out)
        self.automaton.make_automaton()
        self.unknown_score = least - UNKNOWN_PENALTY
        #: No piece goes on past a word's start, so a text's best path is that of its words.
        self.splits = splits

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path through escaped text; of equal paths to a position, that with the longest last piece."""
        if self.singles.issuperset(text):
            return self._plain_viterbi(text)
        n = len(text)
        score = [0.0] + [None] * n
        came: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        singles, unknown, unknown_score = self.singles, self.unknown, self.unknown_score
        done = 0

        def lone(end):  # positions that no piece ended at, and the single unknown character
            if text[end - 1] not in singles and score[end - 1] is not None:
                s = score[end - 1] + unknown_score
                if score[end] is None or s > score[end]:
                    score[end], came[end] = s, (end - 1, unknown)

        for last, (i, length, value) in self.automaton.iter(text):
            end = last + 1
            while done < last:
                done += 1
                lone(done)
            if score[end - length] is None:
                continue
            s = score[end - length] + value
            if score[end] is None or s > score[end]:
                score[end], came[end] = s, (end - length, i)
        while done < n:
            done += 1
            lone(done)
        ids: list[int] = []
        end = n
        while end:
            start, i = came[end]
            if i == unknown and self.byte_fallback:
                ids += [self.byte_ids[b] for b in reversed(text[start:end].encode())]
            else:
                ids.append(i)
            end = start
        return ids[::-1]

    def _plain_viterbi(self, text: str) -> list[int]:
        """viterbi() of a text whose characters are all pieces: every position is reached."""
        n = len(text)
        score = [0.0] + [float("-inf")] * n
        came = [0] * (n + 1)
        for last, (i, length, value) in self.automaton.iter(text):
            last += 1
            s = score[last - length] + value
            if s > score[last]:
                score[last], came[last] = s, i
        ids, lengths = [], self.lengths
        while n:
            i = came[n]
            ids.append(i)
            n -= lengths[i]
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; an empty text has none."""
        if not text:
            return np.zeros(0, np.int32)
        escaped = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        chunks = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", escaped) if self.splits else [escaped]
        return np.array([i for c in chunks for i in self.viterbi(c)], np.int32)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, none null, in one array, and where each text's begin (with the end).

        Where no piece goes past a word's start, texts are cut at spaces and each distinct word
        is searched once; texts with runs of spaces, or with the space's sign, go one by one.
        """
        if not len(texts) or not (self.splits and self.dummy_prefix):
            each = [self.encode(t) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.int32), *each]), np.r_[0, np.cumsum([len(x) for x in each], dtype=np.int64)]
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        flat = parts.flatten()
        odd = _odd(pc.match_substring(texts, SPACE), len(texts))
        odd[np.searchsorted(offsets, np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0), "right") - 1] = True
        plain = ~np.repeat(odd, np.diff(offsets))
        coded = flat.filter(pa.array(plain)).dictionary_encode()
        ids = [b"", *(array("i", self.viterbi(SPACE + w)).tobytes() for w in coded.dictionary.to_pylist())]
        index = np.zeros(len(flat), np.int32)
        index[plain] = coded.indices.to_numpy(zero_copy_only=False) + 1
        for i in np.flatnonzero(odd):
            index[offsets[i]] = len(ids)
            ids.append(self.encode(texts[i].as_py()).tobytes())
        return gather(ids, index, offsets, np.int32)

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined (bad sequences replaced), the dummy prefix taken off."""
        table = self.bytes_of
        out = b"".join([table[i] for i in ids])
        if self.dummy_prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")


def _odd(mask: pa.Array, n: int) -> np.ndarray:
    return np.array(mask.to_numpy(zero_copy_only=False), bool).reshape(n)


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes (ids of the byte fallback), ids_crc32, round_trip per row of docs.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers. round_trip says whether
    decoding gives the text again: only texts that hold U+2581, which stands for a space, don't.
    Null text is empty: no ids. Other columns are ignored; repeated rows and null ids give a
    row each; an empty table gives none. model_file must be readable on every executor.
    """

    def make():
        model = pieces(model_file)
        low, high = (min(model.byte_ids.values()), max(model.byte_ids.values())) if model.byte_ids else (0, -1)

        def work(batch):
            flat, cuts = model.encode_batch(batch.column("text"))
            spans = list(zip(cuts.tolist(), cuts[1:].tolist()))
            falls = np.r_[0, np.cumsum((flat >= low) & (flat <= high))][cuts]
            view, listed = memoryview(flat.astype("<u4")).cast("B"), flat.tolist()
            same = [model.decode(listed[a:b]) == t for (a, b), t in zip(spans, batch.column("text").to_pylist())]
            return {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat, pa.int32())), "n_ids": np.diff(cuts).astype(np.int64), "n_bytes": np.diff(falls), "ids_crc32": [crc32(view[4 * a : 4 * b]) for a, b in spans], "round_trip": same}

        return work

    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id long, ids array<int>, n_ids long, n_bytes long, ids_crc32 long, round_trip boolean", make, TOGETHER)


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids). Null ids decode to an empty text."""

    def make():
        model = pieces(model_file)
        return lambda batch: {"doc_id": batch.column("doc_id"), "text": [model.decode(x or []) for x in batch.column("ids").to_pylist()]}

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", make)
