"""SimHash near-dedup: segment popcounts as a grid, range-joined under Manhattan distance.

A fingerprint's set bits per segment form a point; flipping one bit moves one coordinate by
one, so the Hamming distance of two fingerprints is at least the Manhattan distance of their
points. Points of whole numbers within two of each other differ in at most two coordinates; with
the coordinates in G groups they agree on G - 2 groups at least. So every fingerprint goes to
one cell per choice of G - 2 groups (6 cells for 4 groups, whatever the table's size), and pairs
that meet are verified exactly by XOR and popcount, which costs less than the distance of the
coordinates left. A cell with too many rows is refined: its rows go to a finer grid of more
segments, then of more groups, down to cells that agree on all bits but two, which hold at most
four fingerprints. No pair is lost and none of a group's pairs are written. A task keeps a
union-find and emits only the links that join two groups it hadn't joined yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import binary_text, discard, map_rows, materialise, ship

DISTANCE = 2
#: (segments, groups) of the grids, coarse to fine. The first is used at any size unless a caller names
#: a coarser one; the others for the rows of crowded cells alone.
GRIDS = ((8, 4), (16, 4), (32, 4), (64, 4), (64, 8), (64, 16), (64, 64))
FIRST_SEGMENTS = 32
#: MinHash bands of near_copies(), and MinHashes in each.
BANDS, BAND_ROWS = 20, 5
#: Turns of leaders in near_copies(), rows a leader's set is joined with at once, and rows and hashes of a block of the rest.
TURNS, LEAD_ROWS, BLOCK_ROWS, BLOCK_HASHES = 2, 500, 512, 1_000_000
#: Rows of a cell that are held at once, and comparisons in it, beyond which it is refined.
CELL_ROWS, CELL_PAIRS = 100_000, 8_000_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over XXH64 of the word shingles of a UTF-8 text (A-Z lower-cased)."""
    words = text.lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [h64(b" ".join(words), seed)]
    else:
        hashes = [h64(x, seed) for x in map(b" ".join, zip(*(words[k:] for k in range(shingle))))]
    h = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text is empty (fingerprint 0)."""

    def make():
        def work(batch):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))}

        return work

    return map_rows(docs.select("doc_id", binary_text()), "doc_id long, fp long", make)


def popcounts(fp: np.ndarray, segments: int) -> np.ndarray:
    """Set bits per segment, (n, segments); the first segment is the lowest."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fp), segments, -1).sum(axis=2, dtype=np.int8)


def cell_keys(counts: np.ndarray, segments: int) -> np.ndarray:
    """Points as one 64-bit key of fields of 1 to 4 bits."""
    field = field_bits(segments)
    key = np.zeros(len(counts), np.uint64)
    for k in range(segments):  # segment by segment: all at once would widen the points eightfold
        key += counts[:, k].astype(np.uint64) << np.uint64(k * field)
    return key


def field_bits(segments: int) -> int:
    return (64 // segments).bit_length()


def kept_fields(segments: int, groups: int) -> list[int]:
    """Masks of cell_keys() that each leave two of the groups of coordinates out."""
    field, each = field_bits(segments), segments // groups
    group = [((1 << field * each) - 1) << (field * each * g) for g in range(groups)]
    return [((1 << field * segments) - 1) & ~(group[i] | group[j]) for i in range(groups) for j in range(i)]


def to_cells(fp: np.ndarray, segments: int, groups: int, chunk: int = 4096):
    """Yields (cell, fp) arrays: every fingerprint once per choice of groups.

    The cell is a 64-bit mix of the choice and the coordinates that stay. Two cells of one mix
    are read as one: their rows meet by chance, and the exact check keeps them apart.
    """
    masks = kept_fields(segments, groups)
    for i in range(0, len(fp), chunk):
        part = fp[i : i + chunk]
        at = cell_keys(popcounts(part, segments), segments)
        for k in range(0, len(masks), 64):
            some = np.array(masks[k : k + 64], np.uint64)
            x = (at[:, None] & some) + np.arange(k + 1, k + 1 + len(some), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            yield (x ^ (x >> np.uint64(31))).reshape(-1), np.repeat(part, len(some))


class Forest:
    """Union-find over fingerprints met so far; joined() says which links were new."""

    def __init__(self, most: int = 2_000_000):
        self.up: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        up, seen = self.up, []
        while (y := up.get(x, x)) != x:
            seen.append(x)
            x = y
        for y in seen:
            up[y] = x
        return x

    def joined(self, pairs) -> list[tuple[int, int]]:
        if len(self.up) > self.most:  # forgetting repeats links, and loses none
            self.up.clear()
        out = []
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def close_pairs(rows: np.ndarray, distance: int, block: int = 1024):
    """Pairs of rows at most so many bits apart, by blocks."""
    for i in range(0, len(rows), block):
        m = rows[i : i + block]
        for j in range(i, len(rows), block):
            n = rows[j : j + block]
            x, y = np.nonzero(np.bitwise_count(m[:, None] ^ n[None, :]) <= distance)
            keep = (m[x] != n[y]) & ((i != j) | (x < y))
            yield m[x[keep]], n[y[keep]]


def _meet(cells: DataFrame, last: bool) -> DataFrame:
    """cells: (cell, fp) sorted by cell within partitions. Rows (a, b): links, and (fp, null) of cells to refine."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        forest = Forest()
        out_a, out_b = [], []

        def flush():
            a = pa.array([x for p in out_a for x in p], pa.int64())
            b = pa.array([x for p in out_b for x in p], pa.int64())
            out_a.clear()
            out_b.clear()
            return pa.RecordBatch.from_arrays([a, b], schema=schema)

        def refine(fp):
            out_a.append(fp.view(np.int64).tolist())
            out_b.append([None] * len(fp))

        def link(a, b):
            if len(a):
                new = forest.joined(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()))
                out_a.append([x for x, _ in new])
                out_b.append([y for _, y in new])

        def many(cell, fp):
            """All complete cells of a sorted run; the small ones at once."""
            edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[edge, len(cell)])
            work = size.astype(np.int64) ** 2
            big = work > 4096
            for g in np.flatnonzero(big):
                rows = fp[edge[g] : edge[g] + size[g]]
                if work[g] > CELL_PAIRS and not last:
                    refine(rows)
                else:
                    for a, b in close_pairs(rows, DISTANCE):
                        link(a, b)
            # each row against those after it in its cell, for all small cells together
            group = np.repeat(np.arange(len(edge)), size)
            after = edge[group] + size[group] - 1 - np.arange(len(cell))
            at = np.flatnonzero(~big[group] & (after > 0))
            for k in range(0, len(at), 200_000):
                rows = at[k : k + 200_000]
                n = after[rows]
                left = np.repeat(rows, n)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
                ok = (np.bitwise_count(fp[left] ^ fp[right]) <= DISTANCE) & (fp[left] != fp[right])
                if ok.any():
                    link(fp[left[ok]], fp[right[ok]])

        held: list[np.ndarray] = []
        flooding = None  # the cell that grew beyond CELL_ROWS
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)]
            if flooding is not None:
                n = int(np.searchsorted(now[0] != flooding, True)) if (now[0] != flooding).any() else len(now[0])
                refine(now[1][:n])
                now = [x[n:] for x in now]
                if not len(now[0]):
                    yield flush()
                    continue
                flooding = None
            if held:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            cut = int(np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])[-1])
            if cut:
                many(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
            if len(held[0]) > CELL_ROWS and not last:
                flooding = held[0][0]
                refine(held[1])
                held = []
            if out_a:
                yield flush()
        if held and len(held[0]):
            many(*held)
        if out_a:
            yield flush()

    return cells.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, segments: int | None = None) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints within DISTANCE connect; distinct: (fp), distinct.

    segments: of the first grid; results are the same for all.
    """
    spark = distinct.sparkSession
    ship(spark)
    grids = [g for g in GRIDS if g[0] >= (segments or FIRST_SEGMENTS)]
    out, rows = None, distinct.select("fp")
    for grid in grids:

        def run(batches, grid=grid):
            for batch in batches:
                fp = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint64)
                for c, f in to_cells(fp, *grid):
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(f.view(np.int64))], names=["cell", "fp"])

        cells = rows.mapInArrow(run, "cell long, fp long")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = materialise(_meet(cells.repartition(n, "cell").sortWithinPartitions("cell"), grid == grids[-1]))
        found, rest = met.where("b is not null"), met.where("b is null")
        out = out.union(found) if out else found
        if grid == grids[-1] or rest.isEmpty():
            break
        rows = materialise(rest.select(F.col("a").alias("fp")).distinct())
    return out


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, sorted; a shorter text is one shingle."""
    words = text.lower().split()
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.unique(np.array([xxhash.xxh64_intdigest(x, seed) for x in parts], np.uint64))


def min_hashes(hashes: np.ndarray, n: int = BANDS * BAND_ROWS) -> np.ndarray:
    """The least value of hashes under each of n fixed multiply-add permutations."""
    rnd = np.random.default_rng(42)
    a, b = rnd.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(0, 1 << 63, n, np.uint64)
    out = np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 4096):
        out = np.minimum(out, (hashes[i : i + 4096, None] * a + b).min(axis=0))
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    return len(np.intersect1d(x, y, assume_unique=True))


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many hashes each two of some sorted sets share, by products of an incidence matrix in strips."""
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = (np.cumsum(n > 1) - 1)[at]
    often = n[at] > 1  # a hash of one set alone is shared by no two
    order = np.flatnonzero(often)[np.argsort(column[often], kind="stable")]
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [first, first + columns])
        strip = np.zeros((len(sets), columns), np.float32)
        strip[row[i:j], column[i:j] - first] = 1
        out += strip @ strip.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def _leaders(cells: DataFrame, sets: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(cell, lead, k, near, ring): each row of a cell measured against the cell's leader.

    One leader is drawn per cell, alike in cells of the same rows, so that a pair is measured once.
    A leader of many rows is joined in parts.
    """
    lead = cells.groupBy("cell").agg(F.min_by("k", F.xxhash64("k", F.lit(turn))).alias("lead"))
    led = materialise(cells.join(lead, "cell").where("k <> lead"))
    pairs = materialise(led.select("lead", "k").distinct())
    many = materialise(pairs.groupBy("lead").agg((F.floor(F.count("*") / LEAD_ROWS) + 1).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part")
    leads = many.join(sets.select(F.col("k").alias("lead"), F.col("hashes").alias("of")), "lead").select("lead", "of", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = pairs.join(many, "lead").select("lead", "k", part).join(leads, ["lead", "part"]).join(sets.select("k", "hashes"), "k")
    width = 1 - similarity + 1e-6

    def make():
        def work(batch):
            near, ring = [], []
            for x, y in zip(batch.column("of").to_pylist(), batch.column("hashes").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = overlap(x, y)
                union = len(x) + len(y) - n
                near.append(n >= similarity * union)
                ring.append(int((1 - n / union) / width))
            return {"lead": batch.column("lead"), "k": batch.column("k"), "near": near, "ring": ring}

        return work

    measured = materialise(map_rows(both.select("lead", "k", "of", "hashes"), "lead string, k string, near boolean, ring long", make))
    return materialise(led.join(measured, ["lead", "k"]))


def _rest(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (lead, k) that join the components c within cells (cell, k, c), from tasks of two blocks of a cell each."""
    of = cells.join(sets, "k")
    size = of.groupBy("cell").agg(F.greatest(F.floor(F.count("*") / BLOCK_ROWS), F.floor(F.sum("n") / BLOCK_HASHES)).cast("int").alias("last"))
    mine = cells.join(size, "cell").select("cell", "k", "c", F.pmod(F.xxhash64("k"), F.col("last") + 1).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    rows = mine.select("cell", "k", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets.select("k", "hashes"), "k")

    def run(table):
        ks, cs, blocks = (np.array(table.column(x).to_pylist()) for x in ("k", "c", "block"))
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        size = np.array([len(x) for x in hashes])
        both = overlaps(hashes)
        near = (both >= similarity * (size[:, None] + size - both)) & (cs[:, None] != cs)
        if len(set(blocks.tolist())) > 1:  # two blocks meet here; each within itself elsewhere
            near &= blocks[:, None] != blocks
        x, y = np.nonzero(np.triu(near))
        new = set(Forest().joined(zip(cs[x].tolist(), cs[y].tolist())))
        out = {(cs[i], cs[j]): (ks[i], ks[j]) for i, j in zip(x, y) if (cs[i], cs[j]) in new}
        return pa.table({"lead": pa.array([i for i, _ in out.values()], pa.string()), "k": pa.array([j for _, j in out.values()], pa.string())})

    return materialise(rows.groupBy("cell", "i", "j").applyInArrow(run, "lead string, k string"))


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """Links (a, b) that connect the fingerprints of texts whose word shingles have at least that Jaccard similarity.

    Candidates share one of BANDS bands of BAND_ROWS MinHashes (a pair at 0.8 shares one with
    probability 0.9996) and are checked exactly over the whole sets. Pairs of a cell aren't
    written: its rows are measured against one leader, which links a group of near copies by one
    row each. By the triangle inequality of the Jaccard distance two rows can be near only where
    their distances to the leader are, so the cell falls into rings as wide as the distance
    sought, and rings that still hold several components get leaders of their own. What is left
    after TURNS turns is compared in tasks of two blocks of rows, which emit links alone.
    Equal texts meet once, null text is empty, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    # copies go before anything is dealt by text: a partial aggregate leaves one of a task's
    texts = materialise(docs.select(F.md5(binary_text()).alias("k"), binary_text()).dropDuplicates(["k"]))

    def bands():
        def work(batch):
            keys = []
            for t in batch.column("text").to_pylist():
                rows = min_hashes(shingle_set(t, shingle)).reshape(BANDS, BAND_ROWS)
                keys += [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)]
            cells = pa.array(np.array(keys, np.uint64).view(np.int64))
            return {"k": batch.column("k"), "cells": pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS, cells)}

        return work

    def hashes():
        def work(batch):
            texts = batch.column("text").to_pylist()
            sets = [shingle_set(t, shingle) for t in texts]
            fps = np.array([fingerprint(t) for t in texts], np.uint64)
            return {"k": batch.column("k"), "fp": pa.array(fps.view(np.int64)), "n": [len(x) for x in sets], "hashes": [x.tobytes() for x in sets]}

        return work

    every = materialise(map_rows(texts, "k string, cells array<long>", bands).select("k", F.explode("cells").alias("cell")))
    shared = every.groupBy("cell").agg(F.count("*").alias("rows")).where("rows > 1").select("cell")
    cells = materialise(every.join(shared, "cell"))
    members = materialise(cells.select("k").distinct())
    sets = materialise(map_rows(texts.join(members, "k", "left_semi"), "k string, fp long, n long, hashes binary", hashes))
    discard(texts)
    discard(every)
    edges = None
    for turn in range(TURNS):
        led = _leaders(cells, sets, similarity, turn)
        found = led.where("near").select("lead", "k").distinct()
        edges = edges.union(found) if edges else found
        stars = connected_components(edges, materialise, discard).select(F.col("node").alias("k"), "root")
        rings = led.join(stars, "k", "left").select("cell", "k", F.coalesce("root", "k").alias("c"), F.explode(F.array("ring", F.col("ring") + 1)).alias("ring"))
        rings = materialise(rings.select(F.xxhash64("cell", "ring").alias("cell"), "k", "c"))
        several = rings.groupBy("cell").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("cell")
        cells = materialise(rings.join(several, "cell"))
        if cells.isEmpty():
            break
        cells, left = cells.select("cell", "k"), cells
    else:
        edges = edges.union(_rest(left, sets, similarity))
    fps = sets.select("k", "fp")
    both = edges.join(fps.withColumnRenamed("fp", "b"), "k").join(fps.toDF("lead", "a"), "lead")
    return materialise(both.where("a <> b").select("a", "b").distinct())


def near_groups(docs: DataFrame, shingle: int = 3, segments: int | None = None, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs (doc_id, text; other columns are ignored).

    Documents of one fingerprint are one class; classes within two bits are linked, and
    component_id is the least doc_id reachable. Null text is empty; empty texts have
    fingerprint 0, linked like any other. Rows with null doc_id link others but give no
    component number: a component of such rows alone has null. An empty table gives no rows.
    With a similarity, classes holding near_copies() of that similarity are linked as well.
    """
    fps = materialise(fingerprints(docs, shingle))
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = links(classes.select("fp"), segments)
    if similarity is not None:
        edges = edges.union(near_copies(docs, similarity))
    stars = connected_components(edges, materialise, discard)
    rooted = materialise(classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = materialise(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = materialise(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; see near_groups()."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """docs with one document of each near-duplicate group, the one of least doc_id; see near_groups() for similarity.

    Rows of one doc_id are one document, and one of them stays at most. Every group asks for its
    least id, and an id that several ask for goes to the group of the least component_id; groups
    left without one ask for another of their ids that nobody got, in an order of their own,
    until none can: a group goes without a survivor only if all its ids stand for other groups.
    Of a group's rows of one id, that of the least fingerprint and hash of all columns stays.
    Rows with null doc_id go where their group has a named row; of a group of such rows alone,
    that of the least fingerprint and hash stays. Null text is empty; an empty table gives no rows.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        # written, so that its size is known: few ids are broadcast, and the texts stay where they are
        gone = materialise(near_groups(docs, similarity=similarity).where("doc_id <> component_id").select("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # rows get numbers, and every choice is a partial aggregate over numbers
    whole = F.struct(*docs.columns)
    rows = materialise(docs.select(whole.alias("row"), "doc_id", "text", F.xxhash64(F.to_json(whole)).alias("h"), F.monotonically_increasing_id().alias("n")))
    groups = near_groups(rows.select(F.col("n").alias("doc_id"), "text"), similarity=similarity)
    placed = materialise(groups.select(F.col("doc_id").alias("n"), "fp", F.col("component_id").alias("c")).join(rows.select("n", "doc_id", "h"), "n"))
    pairs = placed.where("doc_id is not null").groupBy("c", "doc_id").agg(F.min(F.struct("fp", "h", "n"))["n"].alias("n"))
    least = placed.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    waiting, stay = materialise(pairs.join(least, "c")), placed.groupBy("c").agg(F.count("doc_id").alias("named"), F.min(F.struct("fp", "h", "n"))["n"].alias("n")).where("named = 0").select("n")
    k = 0
    while not waiting.isEmpty():
        asked = waiting.groupBy("c", "component_id").agg(F.min_by(F.struct("doc_id", "n"), F.xxhash64("c", "doc_id", F.lit(k)) if k else F.col("doc_id")).alias("x"))
        won = materialise(asked.groupBy("x.doc_id").agg(F.min(F.struct("component_id", "c", "x.n")).alias("y")).select("doc_id", "y.c", "y.n"))
        stay = stay.union(won.select("n"))
        waiting = materialise(waiting.join(won.select("doc_id"), "doc_id", "left_anti").join(won.select("c"), "c", "left_anti"))
        k += 1
    return rows.join(stay, "n", "left_semi").select("row.*")
