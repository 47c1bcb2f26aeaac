"""Conversations of many parts, and what the assembler's tables give against the library."""

import hashlib
import random

import pytest

pytest.importorskip("clickloom.llm.queries")
from clickloom.llm import chat, common, queries  # noqa: E402


def test_parts(spark, monkeypatch):
    """A conversation that holds most rows is cut at turns, spreads over tasks, and reads back whole."""
    monkeypatch.setattr(chat, "PART_IDS", 50)
    rnd = random.Random(2)
    words = ["alpha", "[INST]", "beta\\", "</s>", "\U0001f600", "<|role|>", "\n", "  ", "gamma's"]
    rows = [(7 if k % 3 else k, k, rnd.choice(("user", "assistant", "system", "tool", None)), " ".join(rnd.choices(words, k=rnd.randrange(12)))) for k in range(400)]
    rows += [(None, None, "user", "x")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    formatted = common.materialise(chat.format_chats(df, path))
    assert formatted.where("conv_id = 7").count() > 20
    got = {r.conv_id: r for r in chat.read_chats(formatted, path).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        turns = [(r or "", t) for x, _, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0)) if x == c]
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_ids_are_the_library_s():
    """Encoding by chunks and decoding by table give what the library gives for each escaped text."""
    import numpy as np

    a = chat.assembler(queries.tokenizer_path("byte_bpe_50k.json"))
    texts = ["", " a  b", "</s>[INST] ok [/INST]", "\u00e9\u3042 \U0001f600\U0001f601", "<|endoftext|> it's\tx", "\\\\ \n\n"]
    for t, ids in zip(texts, a.encode(texts)):
        assert ids.tolist() == a.encoder.tokenizer.encode(chat.escape(t), add_special_tokens=False).ids
        text, at = a.render(ids, np.array([0, len(ids)]))
        assert text.decode() == chat.escape(t) == a.encoder.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        assert at.tolist() == [0, len(text)]
