"""Exact top-k inner products by a pivot-distance index.

Vectors of whole numbers get one more coordinate, the square root of the largest squared norm
less their own, so that a larger inner product with a query (whose added coordinate is 0) means
a smaller distance. Every vector is keyed by its nearest pivot and its distance to it; a pivot's
vectors are cut into annuli by distance. A query reads annuli in the order of their lower bound
|d(q, pivot) - annulus|, some at a time, and stops when the triangle inequality says that no
vector of the others comes near enough. Scores are exact; bounds have slack for rounding.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise, ship

#: Rows that pivots are picked from; the fewest and most pivots, and annuli per pivot: the directory
#: of annuli grows with the table, to 32768 entries.
SAMPLE_ROWS, PIVOTS, RINGS = 4096, (16, 512), (8, 64)
#: Rows of an index block and of a block of queries; numbers of one block of scores.
BLOCK_ROWS, QUERY_ROWS, SCORES = 8192, 4096, 1 << 21
#: Annuli that a query reads in the first round, and how many times more in each round after.
FIRST, MORE = 8, 32
SLACK = 1e-6
LONGEST = (1 << 63) - 1


def whole_numbers(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) per component, x as double; null where the vector or a component is null or not finite.

    What is beyond a long becomes the nearest double within its range.
    """
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    edge = F.lit(float(1 << 63) - 1024)
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * factor, -edge), edge)).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    """A list<long> column of equal lengths as (n, d)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def pick_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points, from the one nearest to the mean; fewer if the points are fewer."""
    at = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    near = ((points - points[at[0]]) ** 2).sum(axis=1)
    while len(at) < n and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[at[-1]]) ** 2).sum(axis=1))
    return points[at]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


def raised(v: np.ndarray, top: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.c_[v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of q by rows of x); those beyond a long are its least or greatest."""
    size = max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * q.shape[1]
    if size < 1 << 52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if size <= LONGEST:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -LONGEST - 1, LONGEST).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, starts: np.ndarray, own: tuple[np.ndarray, np.ndarray], least: np.ndarray, k: int):
    """(row, id, score) of the k best per row: highest score, then least id.

    Column c has ids[starts[c]:starts[c + 1]]. own: per row an id that takes no part, and whether
    there is one; least: scores below it are of no use.
    """
    floor = least
    own_id, has_own = own
    alone = np.diff(starts) == 1
    dropped = np.zeros(score.shape, bool)
    for r in np.flatnonzero(has_own):
        dropped[r] = alone & (ids[starts[:-1]] == own_id[r])
    if score.shape[1] > k:
        seen = np.where(dropped, -LONGEST - 1, score) if has_own.any() else score
        floor = np.maximum(floor, np.partition(seen, -k, axis=1)[:, -k])
    r, c = np.nonzero((score >= floor[:, None]) & ~dropped)
    n = np.diff(starts)[c]
    rows, value = np.repeat(r, n), np.repeat(score[r, c], n)
    named = ids[np.repeat(starts[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    fine = ~(has_own[rows] & (named == own_id[rows]))
    rows, value, named = rows[fine], value[fine], named[fine]
    order = np.lexsort((named, ~value, rows))  # ~value: descending, and safe for the least long
    rows, value, named = rows[order], value[order], named[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    return rows[rank < k], named[rank < k], value[rank < k]


class Index:
    """The keyed table: one row per distinct vector with its `keep` least ids, in annuli and blocks."""

    def __init__(self, vectors: DataFrame, keep: int, pivots: int | None = None, rings: int | None = None, sample: int = SAMPLE_ROWS, block: int = BLOCK_ROWS):
        """vectors: (id long, v array<long>), no nulls, v of one length.

        Equal vectors score alike, and ties go to lesser ids, so of equal ones only the `keep`
        least ids can be in a result; the limit is taken before rows are dealt (a window group
        limit), so many copies of one vector do not meet in one task. Unless given, pivots and
        rings follow the number of vectors.
        """
        spark = vectors.sparkSession
        ship(spark)
        ranked = vectors.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= keep)
        self.distinct = materialise(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, top = self.distinct.agg(F.count("*"), F.max(norm)).first()
        self.top = float(top or 0)
        self.rows = None
        if not n:
            return
        pivots = pivots or int(min(max(4 * sqrt(n / block), PIVOTS[0]), PIVOTS[1]))
        rings = rings or int(min(max(n / (pivots * block), RINGS[0]), RINGS[1]))
        picked = self.distinct.orderBy(F.xxhash64("v"), "v").limit(sample).select("v").toArrow().column(0).combine_chunks()
        self.pivots = p = pick_pivots(raised(matrix(picked), self.top), pivots)
        top = self.top

        def make():
            def work(batch):
                d = distances(raised(matrix(batch.column("v")), top), p)
                near = d.argmin(axis=1)
                return {"v": batch.column("v"), "ids": batch.column("ids"), "pivot": near.astype(np.int32), "d": d[np.arange(len(d)), near]}

            return work

        keyed = materialise(map_rows(self.distinct, "v array<long>, ids array<long>, pivot int, d double", make, 1 << 20))
        cuts = keyed.groupBy("pivot").agg(F.percentile_approx("d", [k / rings for k in range(1, rings)] or [1.0], 1000).alias("cuts"))
        # at most `pivots` rows of `rings` numbers
        with_ring = keyed.join(F.broadcast(materialise(cuts, 1)), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("d")))).drop("cuts")
        counted = with_ring.groupBy("pivot", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")).collect()
        # the directory: pivots x rings rows at most
        self.directory = sorted((r.pivot, r.ring, r.low, r.high, -(-r.n // block)) for r in counted)
        places = F.broadcast(spark.createDataFrame([(x[0], x[1], k, x[4]) for k, x in enumerate(self.directory)], "pivot int, ring int, annulus int, chunks int"))
        chunk = F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int")
        self.rows = materialise(with_ring.join(places, ["pivot", "ring"]).select("annulus", chunk.alias("chunk"), "v", "ids"))
        discard(keyed)


def search(vectors: DataFrame, queries: DataFrame, k: int, index: Index | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best other rows of vectors by inner product.

    vectors, queries: (id, v), whole numbers, one length, distinct rows; queries are rows of
    vectors. Ties go to the lesser id, fewer than k others give fewer rows. Queries of one vector
    are answered once, with k + 1 results from which each leaves itself out; an id that occurs
    with several vectors is asked for by itself and leaves all its rows out as it goes. Rounds
    read 8, 256, ... annuli per query: a block of the index meets the blocks of queries that
    asked for it, and a query's results stay its best k + 1 throughout. Scores beyond a long are
    its least or greatest value, ties among them included.
    """
    spark = vectors.sparkSession
    index = index or Index(vectors, k + 1)
    result = "query_id long, rank int, vec_id long, score long"
    if index.rows is None:
        return spark.createDataFrame([], result)
    keep, top, pivots, directory = k + 1, index.top, index.pivots, index.directory
    lows, highs = (np.array([x[i] for x in directory]) for i in (2, 3))
    of, chunks = (np.array([x[i] for x in directory]) for i in (0, 4))
    slack = SLACK * (1 + sqrt(top))

    # ids with several vectors ask by themselves (own); the others of one vector ask together
    several = queries.groupBy("id").count().where("count > 1").select("id", F.col("id").alias("own"))
    asking = materialise(queries.join(several, "id", "left"))
    numbered = materialise(asking.select("v", "own").distinct().withColumn("q", F.monotonically_increasing_id()))
    n_queries = numbered.count()
    parts = -(-n_queries // QUERY_ROWS)
    empty = F.array().cast("array<long>")
    state = numbered.select("q", "v", "own", empty.alias("ids"), empty.alias("scores"), F.lit(0).alias("seen"))
    finished, take, read = [], FIRST, 0
    asks = "q long, part int, v array<long>, own long, ids array<long>, scores array<long>, seen int, units array<struct<annulus:int,chunk:int>>"

    while True:

        def ask(batch, n=take):
            """Per query the units (annulus, chunk) of the next n annuli that may still hold a result; none when it is done."""
            v, scores, seen = matrix(batch.column("v")), batch.column("scores").to_pylist(), batch.column("seen").to_numpy()
            units = []
            step = max(1, SCORES // len(directory))
            for i in range(0, len(v), step):
                some = v[i : i + step].astype(np.float64)
                d = distances(np.c_[some, np.zeros(len(some))], pivots)[:, of]
                gap = np.maximum(np.maximum(np.maximum(d - highs, lows - d), 0) - SLACK * (d + highs) - slack, 0)
                order = np.argsort(gap, axis=1, kind="stable")
                norms = (some**2).sum(axis=1)
                for r in range(len(some)):
                    s = scores[i + r]
                    # <q, x> = (|q|^2 + top - d^2) / 2: a result needs at least the last kept score
                    far = norms[r] + top - 2.0 * s[-1] + SLACK * (1 + norms[r] + top) if len(s) == keep and s[-1] > -LONGEST - 1 else np.inf
                    at = order[r, seen[i + r] : seen[i + r] + n]
                    units.append([{"annulus": int(a), "chunk": c} for a in at[gap[r, at] ** 2 <= far] for c in range(chunks[a])])
            q = batch.column("q").to_numpy()
            return {c: batch.column(c) for c in ("q", "v", "own", "ids", "scores")} | {"part": (q % parts).astype(np.int32), "seen": pa.array((seen + n).astype(np.int32)), "units": units}

        now = materialise(map_rows(state, asks, lambda work=ask: work, 1 << 20))
        discard(state)
        finished.append(now.where("size(units) = 0").select("q", "ids", "scores"))
        state = now.where("size(units) > 0")
        if state.isEmpty():
            break
        wanted = state.select("q", "v", "own", "part", F.try_element_at("scores", F.lit(keep)).alias("least"), F.inline("units"))
        # which parts of the queries ask a block: the block's rows go once to each of them
        there = index.rows.join(state.select(F.col("part").alias("to"), F.inline("units")).distinct(), ["annulus", "chunk"])

        def meet(left, right):
            q, x = matrix(left.column("v").combine_chunks()), matrix(right.column("v").combine_chunks())
            lists = right.column("ids").combine_chunks()
            starts, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            own, has_own = left.column("own").fill_null(0).to_numpy(), left.column("own").is_valid().to_numpy()
            least, key = left.column("least").fill_null(-LONGEST - 1).to_numpy(), left.column("q").to_numpy()
            out = []
            step = max(1, SCORES // max(1, len(x)))
            for a in range(0, len(q), step):
                s = slice(a, a + step)
                rows, ids, score = best(products(q[s], x), flat, starts, (own[s], has_own[s]), least[s], keep)
                out.append((key[s][rows], ids, score))
            return pa.table({n: pa.array(np.concatenate([o[i] for o in out]) if out else [], pa.int64()) for i, n in enumerate(("q", "id", "score"))})

        got = wanted.groupBy("annulus", "chunk", "part").cogroup(there.groupBy("annulus", "chunk", "to")).applyInArrow(meet, "q long, id long, score long")
        rows = state.select("q", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score")))).union(got)
        ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= keep)
        lists = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("x"))
        state = materialise(state.select("q", "v", "own", "seen").join(lists, "q", "left").select("q", "v", "own", F.coalesce(F.col("x.id"), empty).alias("ids"), F.coalesce(F.col("x.score"), empty).alias("scores"), "seen"))
        read += take
        if read >= len(directory):
            finished.append(state.select("q", "ids", "scores"))
            break
        take *= MORE
    answers = finished[0]
    for x in finished[1:]:
        answers = answers.union(x)
    named = asking.join(numbered.withColumnRenamed("own", "o"), (numbered["v"] == asking["v"]) & F.col("own").eqNullSafe(F.col("o"))).select("id", "q").join(answers, "q")
    others = F.filter(F.arrays_zip(F.col("ids").alias("ids"), F.col("scores").alias("scores")), lambda x: x["ids"] != F.col("id"))
    return named.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def top_products(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by `every`.

    embeddings: (vec_id, embedding), other columns are ignored. Vectors null, empty, or holding
    a null or non-finite component take no part, nor do rows with null vec_id, which nothing
    could name. Shorter vectors count as zero in the components they lack. An id that occurs
    with several vectors is one candidate per distinct vector of it; as a query, each of its
    vectors is answered by itself, and a query never finds its own id. Components and scores
    beyond a long are cut to its range. An empty table gives no rows.
    """
    whole = embeddings.select(F.col("vec_id").alias("id"), whole_numbers(F.col("embedding")).alias("v")).where("id is not null and v is not null and size(v) > 0")
    longest = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    clean = materialise(whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("v")))).distinct())
    return search(clean, clean.where(F.col("id") % every == 0), k)
