"""Links between near copies against all pairs of a small table."""

import random

import numpy as np
import pytest

pytest.importorskip("clickloom.llm.simhash")
from clickloom.llm import simhash  # noqa: E402


def groups(links, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    out = {}
    for x in nodes:
        out.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def variants(rnd):
    """Texts in chains and clusters around the similarity sought, with copies, empty and short ones."""
    out = []
    for every in (150, 45, 30, 22):
        words = [f"w{rnd.randrange(9000)}" for _ in range(200)]
        for _ in range(25):
            out.append(" ".join(f"x{rnd.random()}" if rnd.random() < 1 / every else w for w in words))
    words = [f"c{k}" for k in range(300)]
    for _ in range(12):  # each near the next, the ends far apart
        out.append(" ".join(words))
        for _ in range(4):
            words[rnd.randrange(300)] = f"n{rnd.random()}"
    return [*out, out[0], out[30].upper(), None, "", " ", "one two", "One\ttwo", "a b c d e f"]


@pytest.mark.parametrize("turns, block, lead", [(2, 64, 500), (1, 4, 3), (3, 1, 1)])
def test_against_all_pairs(spark, monkeypatch, turns, block, lead):
    monkeypatch.setattr(simhash, "TURNS", turns)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(simhash, "LEAD_ROWS", lead)
    texts = variants(random.Random(5))
    sets, fps = [], []
    for t in texts:
        words = (t or "").lower().split()
        sets.append(set(zip(*(words[k:] for k in range(5)))) or {tuple(words)})
        fps.append(int(np.uint64(simhash.fingerprint((t or "").encode())).view(np.int64)))
    want = [(fps[i], fps[j]) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.a, r.b) for r in simhash.near_copies(table).collect()]
    assert groups(got, set(fps)) == groups(want, set(fps))
    assert len(groups(got, set(fps))) < len(set(fps)) - 40


@pytest.mark.parametrize("columns", [3, 4096])
def test_overlaps(columns):
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 300, n).astype(np.uint64)) for n in (1, 1, 7, 200, 900, 40)] + [np.array([1000], np.uint64)]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets]
    assert simhash.overlaps(sets, columns).tolist() == want
