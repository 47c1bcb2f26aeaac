"""Visits of a stream whose batches don't follow one another in time, or lie unevenly in files."""

import datetime

import duckdb
import pytest

from clickloom import workload
from clickloom.streaming import views as streams
from test_views import stream_of

#: The second batch begins in the last second of the first; in the third, a view joins two that were apart.
ROWS = [(1, 1, 5000), (3, 1, 3000), (1, 1, 6000), (2, 1, 6000), (4, 1, 4500), (4, 1, 6400), (4, 1, 5500), (5, 1, 6400), (1, 1, 90000), (6, 1, 1000)]
PARTS = (slice(0, 3), slice(3, 6), slice(6, 8), slice(8, 9), slice(9, 10))


@pytest.mark.parametrize("close", [streams.closed_visits, streams.visits_with_state])
def test_batches_out_of_order(spark, tmp_path, close):
    """Visits 1: 5000-6000, 2: 6000, 3: 3000, 4: 4500-6400, 5: 6400; user 6 is late."""
    views, state, cp = stream_of(spark, ROWS, tmp_path, PARTS)
    streams.start_bounces(views, state, cp, close=close).awaitTermination()
    assert [tuple(r) for r in state.total(streams.BOUNCES, "domain").collect()] == [("foo.com", 5, 3)]


@pytest.mark.parametrize("query", ["stream_bounces", "stream_visits_state"])
def test_second_half_in_more_files(spark, tmp_path, query):
    """Events in order of time, the first half in one file and the second in three, one of them the latest of all and written first."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i * 4000), i % (4 + i // 100 % 2), "view", '{"k": 7}') for i in range(4000)]
    for a, b in [(0, 2000), (3900, 4000), (2000, 3000), (3000, 3900)]:
        df = spark.createDataFrame(rows[a:b], "event_id long, ts timestamp_ntz, user_id long, event_type string, props string")
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    want = duckdb.connect().sql(workload.oracle_sql()[query].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    with_many = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        got = [tuple(r) for r in workload.queries()[query](spark, f"file://{tmp_path}").select("domain", "visits", "bounces").collect()]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", with_many)
    assert got == want and 1000 < want[0][1]
