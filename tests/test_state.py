"""Keyed state: kinds, key checks, updates, removal, snapshots; state with timers; safe ingest and compaction; messages."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from clickloom.operators import sessions
from clickloom.operators.debug import debug
from clickloom.sources import serving, store as stores, topics
from clickloom.sources.store import FactStore, Landing, ingest
from clickloom.streaming import views as streams
from clickloom.streaming.state import PLAIN, KeyedState, ReadCache
from clickloom.workspace import children, rename
from test_views import SPEED, stream_of, views_of

SCHEMA = "row string, col string, v long"


def rows(spark, *values):
    return spark.createDataFrame([(r, c, v) for r, c, v in values], SCHEMA)


def test_plain_state_counts_every_put(spark, tmp_path):
    state = KeyedState(spark, f"file://{tmp_path}/s", ("row", "col"), PLAIN)
    for _ in range(3):
        state.put(rows(spark, ("k", "c", 2)), 0)
    assert state.total(SCHEMA, "row", "col").first().v == 6


def test_refusals(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with pytest.raises(ValueError, match="opaque"):
        KeyedState(spark, path, kind="opaque")
    with pytest.raises(ValueError, match="a row, or a row and a column"):
        KeyedState(spark, path, ("a", "b", "c"))
    with pytest.raises(ValueError, match="lack key columns"):
        KeyedState(spark, path, ("row", "x")).put(rows(spark, ("k", "c", 1)), 0)
    with pytest.raises(Exception, match="a key is null"):
        KeyedState(spark, path, ("row", "col")).put(rows(spark, ("k", None, 1)), 0)


def test_global_value(spark, tmp_path):
    state = KeyedState(spark, f"file://{tmp_path}/s", ())
    assert state.latest("v long").collect() == []
    for b, v in ((0, 4), (1, 9)):
        state.put(spark.createDataFrame([(v,)], "v long"), b)
    assert [r.v for r in state.latest("v long").collect()] == [9] and state.total("v long").first().v == 13
    add = lambda old, new: F.struct((F.coalesce(old["v"], F.lit(0)) + new["v"]).alias("v"))
    state.update("v long", spark.createDataFrame([(1,)], "v long"), 2, add)
    assert state.latest("v long").first().v == 10


def test_random_history(spark, tmp_path):
    """Puts, updates, removals and snapshots against a dictionary."""
    rnd = random.Random(5)
    state, want = KeyedState(spark, f"file://{tmp_path}/s", ("row", "col")), {}
    add = lambda old, new: F.struct(new["row"].alias("row"), new["col"].alias("col"), (F.coalesce(old["v"], F.lit(0)) + new["v"]).alias("v"))
    for b in range(8):
        keys = rnd.sample([(r, c) for r in "abc" for c in "xyz"], 4)
        kind = rnd.choice(("put", "update", "remove"))
        values = [(r, c, rnd.randrange(9)) for r, c in keys]
        for _ in range(2):  # every batch runs twice
            if kind == "put":
                state.put(rows(spark, *values), b)
            elif kind == "update":
                state.update(SCHEMA, rows(spark, *values), b, add, "row", "col")
            else:
                state.remove(rows(spark, *values).select("row", "col"), b)
        for r, c, v in values:
            want[r, c] = v if kind == "put" else want.get((r, c), 0) + v if kind == "update" else None
            if kind == "remove":
                del want[r, c]
        if b % 3 == 2:
            state.compact(SCHEMA, "row", "col")
            assert len([n for n in children(spark, state.path) if n.startswith("batch=")]) == 1
        assert {(r.row, r.col): r.v for r in state.latest(SCHEMA, "row", "col").collect()} == want
    got = state.get(SCHEMA, spark.createDataFrame([("a", "x"), ("b", "y")], "row string, col string")).collect()
    assert {(r.row, r.col): r.v for r in got} == {k: v for k, v in want.items() if k in (("a", "x"), ("b", "y"))}


def test_totals_keep_through_snapshots(spark, tmp_path):
    state = KeyedState(spark, f"file://{tmp_path}/s")
    for b in range(5):
        state.put(rows(spark, ("k", "c", b + 1)), b)
        state.compact(SCHEMA, "row", "col", totals=True)
    assert state.total(SCHEMA, "row", "col").first().v == 15
    state.put(rows(spark, ("k", "c", 50)), 4)
    assert state.total(SCHEMA, "row", "col").first().v == 60


def test_read_cache(spark, tmp_path, monkeypatch):
    state = KeyedState(spark, f"file://{tmp_path}/s", ("col", "row"))
    cache, asked = ReadCache(state, SCHEMA, size=2), []
    get = KeyedState.get
    monkeypatch.setattr(KeyedState, "get", lambda self, schema, keys: asked.append(sorted(map(tuple, keys.collect()))) or get(self, schema, keys))
    cache.put(rows(spark, ("a", "x", 1), ("b", "y", 2), ("c", "z", 3)), 0)
    assert cache.get(("x", "a"), ("y", "b"), ("y", "b")) == {("x", "a"): ("a", "x", 1), ("y", "b"): ("b", "y", 2)}
    assert cache.get(("x", "a"), ("y", "b")) == cache.get(("x", "a")) | cache.get(("y", "b")) and len(asked) == 1
    assert cache.get(("x", "none"), ("z", "c")) == {("x", "none"): None, ("z", "c"): ("c", "z", 3)} and len(cache.held) == 2
    assert cache.get(("x", "none")) == {("x", "none"): None} and len(asked) == 2  # that there is none is held as well
    assert cache.get(("y", "b"))[("y", "b")] == ("b", "y", 2) and asked[2] == [("y", "b")]
    cache.put(rows(spark, ("b", "y", 5)), 1)
    assert cache.get(("y", "b"), ("x", "a")) == {("y", "b"): ("b", "y", 5), ("x", "a"): ("a", "x", 1)}
    cache.remove(rows(spark, ("b", "y", 0)).select("col", "row"), 2)
    assert cache.get(("y", "b"), ("x", None)) == {("y", "b"): None, ("x", None): None}
    assert cache.get() == {}
    with pytest.raises(ValueError, match="key columns"):
        ReadCache(KeyedState(spark, f"file://{tmp_path}/t"), SCHEMA)


def test_debug(spark):
    seen = Observation()
    got = debug(rows(spark, ("a", "x", 1), ("b", None, 2)), seen).collect()
    assert [tuple(r) for r in got] == [("a", "x", 1, 1), ("b", None, 2, 1)]
    assert seen.get == {"rows": 2, "least": '{"row":"a","col":"x","v":1}', "greatest": '{"row":"b","v":2}'}
    assert debug(rows(spark).limit(0), Observation()).collect() == []
    with pytest.raises(ValueError, match="column v already"):
        debug(rows(spark), Observation(), "v")


def test_visits_with_state(spark, tmp_path):
    views, state, cp = stream_of(spark, SPEED, tmp_path, (slice(0, 4), slice(4, 8)))
    streams.start_bounces(views, state, cp, close=streams.visits_with_state).awaitTermination()
    assert [tuple(r) for r in state.total(streams.BOUNCES, "domain").collect()] == [("foo.com", 4, 3)]


def test_sweep_and_timers_agree_on_closed_visits(spark, tmp_path):
    """Over views in time order, one sweeping task and the state with timers close the same visits, but for those the sweep hasn't come to."""
    rnd = random.Random(6)
    rows, t = [], 0
    for _ in range(150):
        t += rnd.choice((1, 30, 400, 1900))
        rows.append((rnd.randrange(4), 1, t))
    rows.append((9, 1, t + 100_000))
    views, state, cp = stream_of(spark, rows, tmp_path, (slice(0, 70), slice(70, 151)))
    streams.start_bounces(views, state, cp, close=streams.visits_with_state).awaitTermination()
    got = state.total(streams.BOUNCES, "domain").first()
    want = list(sessions.visits(spark.createDataFrame([("foo.com", u, s) for u, _, s in rows[:-1]], "domain string, person int, secs int"), "timed").first())
    assert list(got) == want
    swept = list(sessions.replay([("foo.com", u, s) for u, _, s in rows], literal=False))
    assert len(swept) <= got.visits and sum(b for _, b in swept) <= got.bounces


@pytest.mark.parametrize("crash", ["write", "note", "drop"])
def test_ingest_after_a_crash(spark, tmp_path, monkeypatch, crash):
    """A move that was cut off is finished by the next, and no record is there twice."""
    landing, master = Landing(spark, f"file://{tmp_path}/new"), FactStore(spark, f"file://{tmp_path}/m")
    landing.write(views_of(spark, SPEED))

    def fail(*a, **k):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        if crash == "write":
            m.setattr(FactStore, "append", fail)
        elif crash == "drop":
            m.setattr(Landing, "drop", fail)
        else:
            put = stores.put_text
            m.setattr(stores, "put_text", lambda s, path, text: fail() if path.endswith(".written") else put(s, path, text))
        with pytest.raises(RuntimeError):
            ingest(landing, master)
    landing.write(views_of(spark, [(8, 1, 5)]))
    ingest(landing, master)
    ingest(landing, master)
    assert master.read().count() == len(SPEED) + 1 and landing.snapshot() == [] and ingest(landing, master) == 0


def test_compaction_in_place(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/m")
    for part in (SPEED[:3], SPEED[3:6], SPEED[6:]):
        store.append(views_of(spark, part))
    before = sorted(map(repr, store.read().collect()))
    files = len(store.read().inputFiles())
    assert sorted(map(repr, store.compact().read().collect())) == before and len(store.read().inputFiles()) < files
    rename(spark, store.path, f"{store.path}.compact")  # as if cut off between the renames
    assert sorted(map(repr, store.read().collect())) == before


def test_messages(spark):
    views = topics.views(views_of(spark, [*SPEED, (1, "nonsense \u00e9\"", 5)]))
    sent = topics.messages(views)
    assert dict(sent.dtypes) == {"key": "binary", "value": "binary"}
    assert sorted(map(repr, topics.parsed(sent).collect())) == sorted(map(repr, views.collect()))
    bad = spark.createDataFrame([(bytearray(b"{not json"),)], "value binary")
    with pytest.raises(Exception):
        topics.parsed(bad).collect()


def test_export_is_sorted_and_sharded(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    pairs = spark.range(5000).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("key"), F.encode(F.lit("v"), "UTF-8").alias("value"))
    serving.export(pairs, path)
    got = spark.read.parquet(path).select("key", "shard", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).collect()
    assert len(got) == 5000
    by_file = {}
    for r in sorted(got, key=lambda r: r.n):
        by_file.setdefault(r.f, []).append((r.shard, bytes(r.key)))
    assert all(x == sorted(x) for x in by_file.values())
    assert [bytes(r.key) for r in serving.lookup(spark, path, [b"77"]).collect()] == [b"77"]
