"""Chat formatting by token-level assembly.

Every segment (a turn's text, a role's name) is encoded by itself; reserved ids, which no
encoder gives, are spliced in between, so no content can forge them. Control strings that occur
in a text are escaped reversibly, so the rendered text parses back as well. Loss masks follow
from prefix sums over the segments' lengths. A long conversation is formatted in parts, each of
whole turns, so that memory follows the longest turn and not the conversation.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, materialise, ship, slices
from .token_files import ChunkEncoder

#: The template's control strings, as text and, in this order, as ids from the vocabulary's size on.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>")
ESCAPE = "\\"
#: Ids from which on a part of a conversation ends with its turn; bytes of text encoded at once.
PART_IDS, TOGETHER = 1 << 18, 2 << 20
_SPECIAL = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TOKENS = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROLS)), re.S)

#: How a role's turn is laid out: the controls before and after its text.
LAYOUT = {"system": (("<<SYS>>",), ("<</SYS>>",)), "user": (("<s>", "[INST]"), ("[/INST]",)), "assistant": ((), ("</s>",))}


def escape(text: str) -> str:
    """An escape sign before each control string and each escape sign."""
    return _SPECIAL.sub(lambda m: ESCAPE + m[0], text) if ESCAPE in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if ESCAPE in text else text


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered conversation."""
    turns, at, state, role = [], 0, None, ""
    start = 0
    for m in _TOKENS.finditer(text):
        mark = m[0]
        if mark[0] == ESCAPE:
            continue
        inside = text[start : m.start()]
        if mark == "</s>" and state in (None, "text"):
            turns.append((role if state == "text" else "assistant", unescape(inside)))
            state = None
        elif mark == "[/INST]":
            turns.append(("user", unescape(inside)))
            state = None
        elif mark == "<</SYS>>":
            turns.append(("system", unescape(inside)))
            state = None
        elif mark == "<|text|>":
            role, state = unescape(inside), "text"
        start = m.end()
    return turns


class Assembler:
    """Encodes turns with a tokenizer of the tokenizers library and splices control ids."""

    def __init__(self, tokenizer_file: str):
        self.encoder = ChunkEncoder(tokenizer_file)
        self.base = self.encoder.vocabulary
        self.ids = {c: self.base + k for k, c in enumerate(CONTROLS)}
        self.marks = {c: np.array([i], np.int32) for c, i in self.ids.items()}
        self.table = [*self.encoder.id_bytes(), *(c.encode() for c in CONTROLS)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids per text, control strings in it escaped; equal texts are encoded once."""
        known = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        got = self.encoder.encode(pa.array([escape(t) for t in known], pa.string()))
        return [np.frombuffer(got[known[t]], self.encoder.type).astype(np.int32) for t in texts]

    def segments(self, role: str, name: np.ndarray, text: np.ndarray) -> list[tuple[np.ndarray, bool]]:
        """A turn's segments, each with whether its ids bear loss; name and text are encoded."""
        mark = lambda c: (self.marks[c], False)
        if role in LAYOUT:
            before, after = LAYOUT[role]
            return [*map(mark, before), (text, role == "assistant"), *map(mark, after)]
        return [mark("<|role|>"), (name, False), mark("<|text|>"), (text, False), mark("</s>")]

    def render(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The formatted text of ids as UTF-8, and where the text of ids[cuts] begins in it."""
        text, at = gather(self.table, ids, cuts, np.uint8)
        return text.tobytes(), at


@lru_cache(maxsize=2)
def assembler(tokenizer_file: str) -> Assembler:
    return Assembler(tokenizer_file)


FORMATTED = "conv_id long, part long, ids array<int>, loss_starts array<int>, loss_ends array<int>"


def format_chats(turns: DataFrame, tokenizer_file: str) -> DataFrame:
    """conv_id, part, ids, and the spans [loss_starts, loss_ends) of ids that bear loss, per part of a conversation.

    turns: conv_id, turn, role, text; other columns are ignored. Turns are dealt by ranges of
    (conv_id, turn) and sorted by (conv_id, turn, role, text), nulls first, so a conversation of
    any length spreads over tasks and streams through each; its parts in ascending order make it
    up. A part ends with the turn that brings it to PART_IDS ids. Null text is empty, a null role
    is the role of an empty name; rows with null conv_id are one conversation; repeated rows are
    turns of their own. An empty table gives no rows.
    """
    spark = turns.sparkSession
    ship(spark)
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])

    def assemble(batches):
        from pyspark import TaskContext

        a, number = assembler(tokenizer_file), TaskContext.get().partitionId() << 32
        now, parts, lossy, n, begun = None, [], [], 0, False

        def done():
            nonlocal number
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)  # prefix sums place the masks
            starts = ends - [len(p) for p in parts]
            mask = np.array(lossy, bool)
            number += 1
            return [now, number, np.concatenate(parts), starts[mask], ends[mask]]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        ready, held = [], 0
        for batch in batches:
            for piece in slices(batch, TOGETHER):
                convs, roles, texts = (piece.column(k).to_pylist() for k in range(3))
                encoded = a.encode([*texts, *(r for r in roles if r not in LAYOUT)])
                names = iter(encoded[len(texts) :])
                for conv, role, text in zip(convs, roles, encoded):
                    if begun and (conv != now or n >= PART_IDS):
                        ready.append(done())
                        held += n
                        if held >= 1 << 20:
                            yield batch_of(ready)
                            ready, held = [], 0
                        parts, lossy, n = [], [], 0
                    now, begun = conv, True
                    for ids, loss in a.segments(role, None if role in LAYOUT else next(names), text):
                        parts.append(ids)
                        lossy.append(loss)
                        n += len(ids)
        if begun:
            ready.append(done())
        if ready:
            yield batch_of(ready)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(assemble, FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long"


def read_chats(formatted: DataFrame, tokenizer_file: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_ids, read back from format_chats().

    Parts are rendered, parsed and unescaped where they lie. A conversation of one part is
    digested there; the parts of longer ones, counted first, are dealt by conversation, sorted,
    and digested as they stream by, so a task holds one part. A conversation of empty or null
    texts has their digests; no conversation gives no row. formatted is read several times: have
    it materialised.
    """
    spark = formatted.sparkSession
    ship(spark)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    counts = formatted.groupBy("conv_id").agg(F.count("*").alias("parts"))
    long = materialise(counts.where("parts > 1").select(F.col("conv_id").alias("c")))
    several = {"conv_id": pa.int64(), "part": pa.int64(), "n_turns": pa.int64(), "turns": pa.binary(), "loss_chars": pa.int64(), "loss": pa.binary(), "formatted_chars": pa.int64(), "n_ids": pa.int64()}

    def opened(batches):
        a = assembler(tokenizer_file)
        for batch in batches:
            for piece in slices(batch, TOGETHER):
                ids, starts, ends = (piece.column(k) for k in (2, 3, 4))
                at = ids.offsets.to_numpy().astype(np.int64)
                flat = ids.flatten().to_numpy()
                spans = starts.offsets.to_numpy().astype(np.int64)
                spans -= spans[0]
                here = np.repeat(at[:-1] - at[0], np.diff(spans))
                cuts = np.concatenate([at - at[0], here + starts.flatten().to_numpy(), here + ends.flatten().to_numpy()])
                text, where = a.render(flat, cuts)
                where = where.tolist()
                n, m = len(at), len(here)
                rows = []
                for r in range(n - 1):
                    whole = text[where[r] : where[r + 1]].decode()
                    turns = parse(whole)
                    loss = "".join([unescape(text[where[n + k] : where[n + m + k]].decode()) for k in range(spans[r], spans[r + 1])])
                    rows.append((len(turns), "".join([f"{x}\n{y}\n" for x, y in turns]).encode(), len(loss), loss.encode(), len(whole), int(at[r + 1] - at[r])))
                columns = [pa.array([x[k] for x in rows], t) for k, t in enumerate(list(several.values())[2:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], names=list(several))

    def one(batches):
        for batch in opened(batches):
            digests = {c: pa.array([sha(x.as_py()) for x in batch.column(c)]) for c in ("turns", "loss")}
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("n_turns"), digests["turns"], batch.column("loss_chars"), digests["loss"], batch.column("formatted_chars"), batch.column("n_ids")], names=[x.split()[0] for x in READ.split(", ")])

    def all_parts(batches):
        now, begun = None, False
        for batch in batches:
            for r in batch.to_pylist():
                if not begun or r["conv_id"] != now:
                    if begun:
                        yield row(now, totals, turns, loss)
                    now, begun, totals, turns, loss = r["conv_id"], True, [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                turns.update(r["turns"])
                loss.update(r["loss"])
                totals = [x + r[c] for x, c in zip(totals, ("n_turns", "loss_chars", "formatted_chars", "n_ids"))]
        if begun:
            yield row(now, totals, turns, loss)

    def row(conv, totals, turns, loss):
        values = (conv, totals[0], turns.hexdigest(), totals[1], loss.hexdigest(), totals[2], totals[3])
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[x.split()[0] for x in READ.split(", ")])

    columns = ["conv_id", "part", "ids", "loss_starts", "loss_ends"]
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    short = formatted.join(long, same, "left_anti").select(columns).mapInArrow(one, READ)
    if long.isEmpty():
        return short
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = formatted.join(long, same, "left_semi").select(columns).mapInArrow(opened, "conv_id long, part long, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long, n_ids long")
    return short.union(parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(all_parts, READ))
