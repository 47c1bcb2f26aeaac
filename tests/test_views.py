"""Batch and stream views on the small fixtures, and the cases that the fixtures leave out."""

import random

import pytest
from pyspark.sql import functions as F

from clickloom import schema as S
from clickloom.functions import keys as K
from clickloom.functions.time_buckets import granularities, hour_bucket
from clickloom.functions.urls import authority, is_wellformed, normalized, normalized_or_same
from clickloom.operators import edges, sessions
from clickloom.operators.components import connected_components
from clickloom.plans import batch
from clickloom.sources import serving, topics
from clickloom.sources.store import FactStore, Landing, ingest, is_target
from clickloom.streaming import views as streams
from clickloom.streaming.state import KeyedState
from clickloom.workspace import discard, materialise

POST = "http://foo.com/post"
BATCH = [(1, 1, 60), (3, 1, 62), (1, 1, 4000), (1, 2, 4000), (1, 2, 10000), (5, 3, 10600), (2, 1, 60), (2, 3, 62)]
SPEED = [(1, 1, 60), (2, 1, 60), (3, 1, 62), (2, 3, 62), (1, 1, 4000), (1, 2, 4000), (1, 2, 10000), (5, 3, 10600)]


def views_of(spark, rows):
    df = spark.createDataFrame([(u, f"{POST}{p}" if isinstance(p, int) else p, t) for u, p, t in rows], "u long, url string, t int")
    return S.page_views(df, S.person_by_id(F.col("u")), F.col("url"), F.col("t"))


def equivs_of(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    return S.equivalences(df, S.person_by_id(F.col("a")), S.person_by_id(F.col("b")))


@pytest.fixture(scope="module")
def master(spark):
    return views_of(spark, BATCH).unionByName(equivs_of(spark, [(1, 3), (3, 5)]))


def test_batch_views(spark, master):
    made = batch.views(master)
    got = {(r.url[len(POST) :], r.granularity, r.bucket): r.total_pageviews for r in made["pageviews"].collect()}
    want = {("1", "h", 0): 3, ("1", "h", 1): 1, ("2", "h", 1): 1, ("2", "h", 2): 1, ("3", "h", 0): 1, ("3", "h", 2): 1}
    want |= {(p, g, 0): n for p, n in (("1", 4), ("2", 2), ("3", 2)) for g in "dwm"}
    assert got == want
    uniques = {(r.url[len(POST) :], r.granularity, r.bucket): r.n for r in made["uniques"].select("url", "granularity", "bucket", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    assert uniques == {k: {("1", "h", 0): 2, ("3", "d", 0): 2, ("3", "w", 0): 2, ("3", "m", 0): 2, ("1", "d", 0): 2, ("1", "w", 0): 2, ("1", "m", 0): 2}.get(k, 1) for k in want}
    assert [tuple(r) for r in made["bounces"].collect()] == [("foo.com", 4, 0)]
    assert [tuple(r) for r in batch.views(master, "literal")["bounces"].collect()] == [("foo.com", 8, 8)]


def test_identity_steps(spark):
    e = spark.createDataFrame([(1, 3), (3, 5)], "a long, b long")
    new = []
    for _ in range(3):
        s = edges.step(e).collect()
        new.append(sum(r.is_new for r in s))
        e = spark.createDataFrame(sorted({(r.least, r.id) for r in s}), "a long, b long")
    assert new == [2, 4, 0] and sorted(map(tuple, e.collect())) == [(1, 3), (1, 5)]


def test_run_exports(spark, master, tmp_path):
    base = f"file://{tmp_path}"
    landing = Landing(spark, f"{base}/new")
    landing.write(master)
    batch.run(spark, f"{base}/new", f"{base}/master", f"{base}/out")
    assert landing.snapshot() == []
    key = f"{POST}1/h-0".encode()
    assert bytes(serving.lookup(spark, f"{base}/out/pageviews", [key], K.url_shard).first().value).hex() == "0000000000000003"
    assert bytes(serving.lookup(spark, f"{base}/out/bounces", [b"foo.com"]).first().value).hex() == "0" * 15 + "4" + "0" * 16
    assert serving.pageviews_between(spark, f"{base}/out/pageviews", f"{POST}1", 0, 700) == 4
    assert serving.pageviews_between(spark, f"{base}/out/pageviews", f"{POST}1", 1, 30) == 1
    literal = batch.bounces(batch.view_fields(master.where("unit = 4")), "literal")
    assert bytes(serving.bounce_pairs(literal).first().value).hex() == "00000000000000080000000000000008"


def test_buckets_between():
    for first, end in ((0, 672), (5, 900), (23, 25), (3, 3), (670, 1345)):
        hours = []
        for g, b in serving.buckets_between(first, end):
            n = {"h": 1, "d": 24, "w": 168, "m": 672}[g]
            hours += range(b * n, b * n + n)
        assert hours == list(range(first, end))


def test_shards(spark):
    df = spark.createDataFrame([(f"{POST}{k}",) for k in (1, 2, 3)] + [("é日\U0001f600x",), ("",)], "u string")
    got = df.select("u", K.string_hash(F.col("u")).alias("h"), K.url_shard(K.bucketed_key(F.col("u"), F.lit("h"), F.lit(0))).alias("s")).collect()
    for r in got:
        h = 0
        raw = r.u.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "big")) & 0xFFFFFFFF
        h = h - (1 << 32) if h >> 31 else h
        assert (r.h, r.s) == (h, h % 32)
    assert [r.s for r in got[:3]] == [9, 10, 11]


def test_big_endian(spark):
    values = [0, 1, -1, 255, 1 << 40, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", K.big_endian(F.col("v")).alias("b"))
    for r in df.select("v", "b", K.from_big_endian(F.col("b")).alias("w")).collect():
        assert bytes(r.b) == r.v.to_bytes(8, "big", signed=True) and r.w == r.v


URLS = [
    ("http://foo.com/post1", "http://foo.com/post1", "foo.com"),
    ("HTTP://User:pw@Foo.COM:8080/a/../b/./c?x=1#f", "http://Foo.COM/a/../b/./c", "User:pw@Foo.COM:8080"),
    ("foo.com/x", None, None), ("", None, None), ("gopher://x/y", None, None), ("s3://b/k", None, None),
    ("http://foo.com?q=1", "http://foo.com", "foo.com"), ("  http://foo.com/a b|c  ", "http://foo.com/a b|c", "foo.com"),
    ("http://a_b.com/x", "http://a_b.com/x", "a_b.com"), ("http://日本.jp/é", "http://日本.jp/é", "日本.jp"), ("https://[::1]:80/z", "https://[::1]/z", "[::1]:80"),
    ("mailto:a@b.c", "mailto://a@b.c", None), ("file:///x/y", "file:///x/y", ""), ("http:///p", "http:///p", ""), ("http:foo", "http://foo", None),
    ("http://foo.com:abc/x", None, None), ("http://foo.com:-1/x", "http://foo.com/x", "foo.com:-1"), ("url:http://x.com/1", "http://x.com/1", "x.com"), (None, None, None),
]


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URLS], "u string")
    got = df.select("u", normalized(F.col("u")).alias("n"), authority(F.col("u")).alias("a"), normalized_or_same(F.col("u")).alias("s"), is_wellformed(F.col("u")).alias("w")).collect()
    for r, (u, n, a) in zip(got, URLS):
        assert (r.n, r.a, r.s, r.w) == (n, a, u if n is None else n, n is not None), u


def test_time_buckets(spark):
    df = spark.createDataFrame([(-3599,), (-3600,), (0,), (3600 * 24 * 28 + 1,)], "t int")
    assert [r[0] for r in df.select(hour_bucket(F.col("t"))).collect()] == [0, -1, 0, 672]
    got = df.where("t > 0").select(granularities(hour_bucket(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [("h", 672), ("d", 28), ("w", 4), ("m", 1)]


def fold(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up if root(x) != x}


@pytest.mark.parametrize("kind", ["chain", "star", "cycle", "random", "empty", "loops"])
def test_components(spark, kind):
    rnd = random.Random(1)
    pairs = {
        "chain": [(i, i + 1) for i in range(100)], "star": [(50, i) for i in range(100)], "cycle": [(i, (i + 1) % 40) for i in range(40)],
        "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)], "empty": [], "loops": [(1, 1), (2, 2)],
    }[kind]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), materialise, discard).collect()
    assert {r.node: r.root for r in got} == fold(pairs) and len(got) == len(fold(pairs))


def test_cookies_come_first(spark):
    df = spark.createDataFrame([(1,)], "u long")
    e = S.equivalences(df, S.person_by_id(F.col("u")), S.person_by_cookie(F.lit("z")))
    got = batch.person_map(e).first()
    assert (got.node.user_id, got.root.cookie) == (1, "z")
    out = batch.resolve_persons(views_of(spark, [(1, 1, 60), (9, 1, 60)]), batch.person_map(e)).collect()
    assert sorted((r.page_view.person.cookie or "", r.page_view.person.user_id or 0) for r in out) == [("", 9), ("z", 0)]


def test_malformed_urls(spark):
    m = views_of(spark, [(1, "nonsense", 60), (1, 1, 60)])
    made = batch.views(m)
    assert {r.url for r in made["pageviews"].collect()} == {"nonsense", f"{POST}1"}
    assert [tuple(r) for r in made["bounces"].collect()] == [("foo.com", 1, 1)]


def test_repeats(spark):
    m = views_of(spark, [(1, 1, 60), (1, 1, 60), (1, 1, 61)])
    other = m.limit(1).withColumn("page_view", F.col("page_view").withField("nonce", F.lit(2).cast("long")))
    once = batch.distinct_views(m.unionByName(other))
    assert once.count() == 3 and batch.distinct_views(once).count() == 3


@pytest.mark.parametrize(("mode", "gap", "want"), [("intended", 899, (1, 0)), ("intended", 900, (1, 0)), ("intended", 901, (2, 2)), ("timed", 1800, (1, 0)), ("timed", 1801, (2, 2)), ("timed", 0, (1, 1)), ("intended", 0, (1, 0))])
def test_gaps(spark, mode, gap, want):
    df = spark.createDataFrame([("d", 1, 100), ("d", 1, 100 + gap)], "domain string, person int, secs int")
    assert tuple(sessions.visits(df, mode).first())[1:] == want


def test_replay():
    got = list(sessions.replay([("foo.com", u, t) for u, _, t in SPEED]))
    assert got == [("foo.com", False), ("foo.com", True)]
    two = [("a", 1, 100), ("b", 2, 5000)]
    assert list(sessions.replay(two)) == [("b", True)] and list(sessions.replay(two, literal=False)) == [("a", True)]


def test_store(spark, master, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/m")
    assert store.read().isEmpty()
    store.append(master)
    df = spark.createDataFrame([(1,)], "u long")
    store.append(S.person_properties(df, S.person_by_id(F.col("u")), F.lit(1), location=F.struct(F.lit(None).cast("string").alias("city"), F.lit("CA").alias("state"), F.lit(None).cast("string").alias("country"))))
    assert store.scan(S.EQUIV).count() == 2 and store.scan((S.PERSON_PROPERTY, S.LOCATION)).count() == 1 and store.scan(S.EQUIV, S.PAGE_VIEW).count() == 10
    plan = store.scan(S.PAGE_VIEW).select("page_view.page.url")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(unit" in plan and "person_property" not in plan.split("ReadSchema")[-1]
    with pytest.raises(Exception, match="lacks required fields"):
        store.append(master.withColumn("pedigree", F.col("pedigree").withField("source", F.lit(None).cast("int"))))


def test_ingest_keeps_later_arrivals(spark, master, tmp_path):
    landing, store = Landing(spark, f"file://{tmp_path}/new"), FactStore(spark, f"file://{tmp_path}/m")
    landing.write(master)
    files = landing.snapshot()
    landing.write(views_of(spark, [(8, 1, 5)]))
    store.append(landing.read(files))
    landing.drop(files)
    assert store.read().count() == 10 and landing.read(landing.snapshot()).count() == 1
    ingest(landing, store)
    assert store.read().count() == 11 and ingest(landing, store) == 0


def test_targets(spark):
    cases = {"1/2": True, "2/1": True, "3": True, "4/anything": True, "": False, "1": False, "1/9": False, "9": False, "x": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = df.select("p", is_target(F.filter(F.split("p", "/"), lambda x: x != "")).alias("ok")).collect()
    assert {r.p: r.ok for r in got} == cases


def stream_of(spark, rows, tmp_path, parts):
    for part in parts:
        topics.send(views_of(spark, rows[part]).coalesce(1), f"file://{tmp_path}/topic")
    return topics.views(topics.from_folder(spark, f"file://{tmp_path}/topic", 1)), KeyedState(spark, f"file://{tmp_path}/state"), f"file://{tmp_path}/cp"


def test_stream_pageviews(spark, tmp_path):
    rows = [*SPEED, (7, "nonsense", 50), (7, 1, 61)]  # the last is late by hours
    views, state, cp = stream_of(spark, rows, tmp_path, (slice(0, 5), slice(5, 9), slice(9, 10)))
    streams.start_pageviews(views, state, cp).awaitTermination()
    got = {(r.url[len(POST) :], r.bucket): r.pageviews for r in state.latest(streams.PAGEVIEWS, "url", "bucket").collect()}
    assert got == {("1", 0): 4, ("1", 1): 1, ("2", 1): 1, ("2", 2): 1, ("3", 0): 1, ("3", 2): 1}


def test_stream_uniques(spark, tmp_path):
    views, state, cp = stream_of(spark, SPEED, tmp_path, (slice(0, 2), slice(2, 8)))
    streams.start_uniques(views, state, cp).awaitTermination()
    got = {(r.url[len(POST) :], r.bucket): r.n for r in state.latest(streams.UNIQUES, "url", "bucket").select("url", "bucket", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    assert got == {("1", 0): 3, ("1", 1): 1, ("2", 1): 1, ("2", 2): 1, ("3", 0): 1, ("3", 2): 1}


def test_stream_bounces(spark, tmp_path):
    views, state, cp = stream_of(spark, SPEED, tmp_path, (slice(0, 4), slice(4, 8)))
    streams.start_bounces(views, state, cp).awaitTermination()
    assert [tuple(r) for r in state.total(streams.BOUNCES, "domain").collect()] == [("foo.com", 4, 3)]


def test_state_replaces_a_repeated_batch(spark, tmp_path):
    state = KeyedState(spark, f"file://{tmp_path}/s")
    put = lambda v, b: state.put(spark.createDataFrame([("k", "c", v)], "row string, col string, v long"), b)
    for v, b in ((1, 0), (5, 1), (6, 1)):
        put(v, b)
    schema = "row string, col string, v long"
    assert state.latest(schema, "row", "col").first().v == 6 and state.total(schema, "row", "col").first().v == 7
    assert state.get(schema, spark.createDataFrame([("k", "c")], "row string, col string")).count() == 1
    assert state.prune(schema, f"file://{tmp_path}/t", "row", "col").latest(schema, "row", "col").first().v == 6
