"""Token-ID output: frequency-ranked ids in byte-aligned variable-length code.

Each id is replaced by its rank by frequency in the corpus and written in 1 to 4 bytes; the
lengths go to separate control bytes, four 2-bit lengths each. Decoding expands control bytes
by table lookup, sums lengths to offsets and gathers, all in numpy. A file's records are
blocks (Parquet rows of binary columns), so writing keeps Spark's commit protocol: a lost
executor's half-written files are never read. The table of ranks lies beside the blocks.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, gather, map_rows, materialise, ship, work_dir

#: Tokens per block, but for documents that alone hold more.
BLOCK = 1 << 18
#: Bytes of text that are encoded together: the more, the fewer of their chunks are distinct.
TOGETHER = 8 << 20
#: ASCII marks that end a chunk apart from the letters before them: the pattern always cuts between.
MARKS = ".,;:!?%*#$&|"

_MARKS = np.isin(np.arange(256), np.frombuffer(MARKS.encode(), np.uint8))
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    r = ranks.astype(np.uint32)
    quads = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    quads[: len(r)] = (r > 0xFF).view(np.uint8) + (r > 0xFFFF).view(np.uint8) + (r > 0xFFFFFF).view(np.uint8)
    more = quads[: len(r)]
    at = np.arange(len(r), dtype=np.int64) + np.cumsum(more, dtype=np.int64) - more
    data = np.empty(int(at[-1]) + int(more[-1]) + 1 if len(r) else 0, np.uint8)
    data[at] = r.astype(np.uint8)
    for k in range(1, 4):
        longer = np.flatnonzero(more >= k)
        data[at[longer] + k] = (r[longer] >> np.uint32(8 * k)).astype(np.uint8)
    control = quads[0::4] | quads[1::4] << 2 | quads[2::4] << 4 | quads[3::4] << 6
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that pack() wrote."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    d = np.r_[np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]
    out = d[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= d[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for U+0100 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ChunkEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, each distinct chunk once a batch.

    The tokenizer's pattern always cuts before a single space between two characters that are
    no white space, and merges never cross its cuts; so the ids of a text are those of its
    chunks in turn. A batch's texts are cut at spaces and dictionary-encoded, distinct chunks
    are encoded, and the texts' ids are gathered from theirs. A chunk of letters
    alone is one pre-token and goes to the library's BPE model as such; other chunks, a
    text's first, and texts with other white space around a space, go through the library's
    encoder. Strings of special tokens are plain text, unless special: then they become
    their ids, as the library has it by default, and texts with such strings go through it whole.
    """

    def __init__(self, tokenizer_file: str, special: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.type = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.chunked = self._byte_level()
        self.code = "H" if self.type is np.uint16 else "I"
        self.letters = byte_letters()

    def _byte_level(self) -> bool:
        """Whether the tokenizer cuts as the class comment says: plain byte-level pre-tokens, no normaliser."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)

    def id_bytes(self) -> list[bytes]:
        """What each id decodes to, for byte-level vocabularies."""
        if not self.chunked:
            raise ValueError("not a plain byte-level vocabulary")
        byte_of = {c: b for b, c in self.letters.items()}
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        return [added[i] if i in added else bytes(byte_of[c] for c in self.tokenizer.id_to_token(i) or "") for i in range(self.vocabulary)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, each after a space; letters alone go to the model as one pre-token."""
        tokenize, code, letters = self.model.tokenize, self.code, self.letters
        out, others = [], []
        for k, c in enumerate(chunks):
            if c.isalpha():
                out.append(array(code, [t.id for t in tokenize("\u0120" + (c if c.isascii() else c.encode().decode("latin-1").translate(letters)))]).tobytes())
            else:
                out.append(b"")
                others.append(k)
        for k, ids in zip(others, self._encoded([" " + chunks[k] for k in others])):
            out[k] = ids
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids per text as native unsigned integers of self.type."""
        if not self.chunked or not len(texts):
            return [self.whole(t) for t in texts.to_pylist()]
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        flat = parts.flatten()
        stops = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + 1 + len(flat)] if len(flat) else np.zeros(1, np.int32)
        data = np.r_[np.zeros(8, np.uint8), np.frombuffer(flat.buffers()[2] or b"", np.uint8), np.zeros(1, np.uint8)]
        starts, ends = stops[:-1] + 8, stops[1:] + 8
        first, last = data[starts], data[ends - 1]
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(offsets, np.flatnonzero(_spaced(flat, starts == ends, first, last)), "right") - 1] = True
        for x in self.special:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        later = ~np.repeat(odd, np.diff(offsets))
        later[offsets[:-1]] = False

        # letters and the marks after them apart, where that is a cut; entry 0 is empty
        marked = np.flatnonzero(later & _MARKS[last])
        bodies = pc.utf8_rtrim(flat.take(pa.array(marked)), MARKS)
        tail = (ends - starts)[marked] - pc.binary_length(bodies).to_numpy(zero_copy_only=False)
        cut = _last_letters(bodies) & (tail <= 8)
        marked, tail, bodies = marked[cut], tail[cut], bodies.filter(pa.array(cut))
        later[marked] = False
        units = pa.concat_arrays([flat.filter(pa.array(later)), bodies]).dictionary_encode()
        which = units.indices.to_numpy(zero_copy_only=False) + 1
        ids = [b"", *self._ids(units.dictionary.to_pylist())]
        index = np.zeros((len(flat), 2), np.int32)
        index[later, 0] = which[: len(which) - len(marked)]
        index[marked, 0] = which[len(which) - len(marked) :]
        if len(marked):
            codes = np.zeros(len(marked), np.uint64)
            for k in range(int(tail.max())):
                has = tail > k
                codes[has] |= data[ends[marked[has]] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
            known, which = np.unique(codes, return_inverse=True)
            index[marked, 1] = which + len(ids)
            ids += [self.whole(int(x).to_bytes(8, "big").lstrip(b"\0").decode()) for x in known]
        # a text's first chunk, or the whole of an odd text
        index[offsets[:-1], 0] = np.arange(len(texts)) + len(ids)
        heads = flat.take(pa.array(offsets[:-1])).to_pylist()
        ids += self._encoded([texts[i].as_py() if odd[i] else heads[i] for i in range(len(texts))])

        out, cuts = gather(ids, index.reshape(-1), 2 * offsets, self.type)
        cuts = cuts.tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def _spaced(words: pa.Array, empty: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each word is empty or has white space at an end; words that begin and end in printing ASCII need no look."""
    ascii_ends = (first > 0x20) & (first < 0x80) & (last > 0x20) & (last < 0x80)
    out = empty.copy()
    look = np.flatnonzero(~ascii_ends & ~empty)
    some = words.take(pa.array(look))
    out[look] = pc.binary_length(pc.utf8_trim_whitespace(some)).to_numpy(zero_copy_only=False) != pc.binary_length(some).to_numpy(zero_copy_only=False)
    return out


def _last_letters(words: pa.Array) -> np.ndarray:
    """Whether each word ends in a letter."""
    return pc.utf8_is_alpha(pc.utf8_slice_codeunits(words, -1)).to_numpy(zero_copy_only=False).astype(bool) & (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, special: bool = False) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_file, special)


def encode_rows(docs: DataFrame, tokenizer_file: str, end_id: int, special: bool = False) -> DataFrame:
    """(doc_id, ids): each whole text's ids and the end id, 32-bit or, where the vocabulary fits, 16-bit. Null text is empty."""

    def make():
        enc = encoder(tokenizer_file, special)
        end = np.array([end_id], enc.type).tobytes()

        def work(batch):
            return {"doc_id": batch.column("doc_id"), "ids": [x + end for x in enc.encode(batch.column("text"))]}

        return work

    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id long, ids binary", make, TOGETHER)


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, special: bool = False) -> None:
    """Write the ids of docs (doc_id, text) below path, in ascending doc_id order: blocks/ and ranks/ (rank, id).

    Texts are encoded once, into the shared folder; ids are counted there (the counts that reach
    the driver are one per vocabulary entry at most), then dealt out by ranges of doc_id, sorted
    and coded. Files in name order hold documents in order; null ids come first, rows of one
    doc_id in the order of a hash of their ids, so that many of them spread over files. Every
    block has the checksum of its table of ranks. Null text is empty: the end id alone. An empty
    table writes no block. special: see ChunkEncoder.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = encoder(tokenizer_file).vocabulary
    small = vocabulary <= 1 << 16
    if end_id >= (1 << 16 if small else 1 << 32):
        raise ValueError("the end id doesn't fit the vocabulary's integers")
    kind = np.uint16 if small else np.uint32
    rows = materialise(encode_rows(docs, tokenizer_file, end_id, special).withColumn("h", F.xxhash64("ids")).withColumn("n", F.monotonically_increasing_id()), codec="zstd")
    most = max(vocabulary, end_id + 1)

    def count(batches):
        total = np.zeros(most, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=most)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counts = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], np.uint32)
    rank = np.zeros(most, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    table, check = rank.tobytes(), crc32(by_rank.tobytes())
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, id long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("ranks_crc32", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])

    def code(batches):
        from pyspark import TaskContext

        shard, ranks = TaskContext.get().partitionId(), np.frombuffer(table, np.uint32)
        ids, docs_in, lengths, block, n = [], [], [], 0, 0

        def done():
            control, data = pack(ranks[np.concatenate(ids)])
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, block, check, len(ids), n, docs_in, lengths, control, data), schema)], schema=schema)

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(x.as_py(), kind)
                ids.append(one)
                docs_in.append(d)
                lengths.append(len(one))
                n += len(one)
                if n >= BLOCK:
                    yield done()
                    ids, docs_in, lengths, block, n = [], [], [], block + 1, 0
        if ids:
            yield done()

    (
        rows.repartitionByRange(parts, "doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").select("doc_id", "ids")
        .mapInArrow(code, "shard int, block int, ranks_crc32 long, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, control binary, data binary")
        .write.mode("overwrite").parquet(f"{path}/blocks")
    )
    discard(rows)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, decoded from the files below path by whoever can read them.

    start counts the ids of all documents before; sums per file, then per block, give it. One row
    per file reaches a single window: as many as files were written. The table of ranks, a row
    per vocabulary entry at most, comes to the driver; a block of another table stops the read.
    Without blocks there are no rows.
    """
    ship(spark)
    by_rank = np.array([r.id for r in sorted(spark.read.parquet(f"{path}/ranks").collect())], np.uint32)
    files, check = spark.read.parquet(f"{path}/blocks"), crc32(by_rank.tobytes())
    blocks = files.select("shard", "block", "n_tokens")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("shard_start"))
    inside = blocks.select("shard", "block", (F.sum("n_tokens").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")).alias("block_start"))
    starts = inside.join(shards, "shard").select(F.col("shard").alias("s"), F.col("block").alias("b"), (F.col("shard_start") + F.col("block_start")).alias("block_start"))
    ids = by_rank.tobytes()
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        table = np.frombuffer(ids, "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                if row["ranks_crc32"] != check:
                    raise ValueError("a block was written with another table of ranks")
                got = table[unpack(row["control"], row["data"], row["n_tokens"])]
                n = np.array(row["lengths"], np.int64)
                ends = np.cumsum(n)
                view = memoryview(got).cast("B")
                crc = [crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, row["shard"], np.int32)), pa.array(np.full(k, row["block"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], schema=schema)

    decoded = files.select("shard", "block", "ranks_crc32", "n_tokens", "doc_ids", "lengths", "control", "data").mapInArrow(decode, "shard int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return decoded.join(materialise(starts), (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b"))).select("doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 2, path: str | None = None, special: bool = False) -> DataFrame:
    """Write the token files of docs and return what reading them back gives; see the two functions above."""
    path = path or work_dir(docs.sparkSession)
    write_token_files(docs, path, tokenizer_file, end_id, special)
    return read_token_files(docs.sparkSession, path)
