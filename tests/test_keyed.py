"""Keyed streaming state against batch twins: batches bring a request's events in any order within the delay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cellselect.streaming import events as X
from cellselect.streaming import keyed as K

SCHEMA = "request_id long, event_id long, ts timestamp, event string"
T0 = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out, n = [], 0
    for request in range(25):
        t = rng.uniform(0, 3000)
        for i in range(rng.randrange(1, 14)):
            out.append((request, n, T0 + dt.timedelta(seconds=round(t, 3)), rng.choice(["stage1_done", "heartbeat"])))
            n += 1
            t += rng.choice([0, 0.2, 30, 400, 1100])
        if request % 3:
            out.append((request, n, T0 + dt.timedelta(seconds=round(t, 3)), "done"))
            n += 1
    return out


def streamed(spark, rows, build, tmp_path, delay=10_000):
    """Three batches with every request's events shuffled over them, then one far away event."""
    rng = random.Random(7)
    rng.shuffle(rows := list(rows))
    parts = [rows[0::3], rows[1::3], rows[2::3], [(-1, -1, T0 + dt.timedelta(days=90), "done")]]
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = build(spark.readStream.schema(SCHEMA).parquet(src), f"{delay} seconds")
        stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(out).where("request_id >= 0").collect())


def plain_gap(rows, gap):
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if r[0] not in last or (r[2] - last[r[0]]).total_seconds() >= gap:
            out.append(r)
            last[r[0]] = r[2]
    return sorted(out)


@pytest.mark.parametrize("gap", [0, 0.2, 1, 500])
def test_least_gap_in_batch(spark, rows, gap):
    got = sorted(tuple(r) for r in K.least_gap(spark.createDataFrame(rows, SCHEMA), gap).collect())
    assert got == plain_gap(rows, gap)


def test_two_events_either_side_of_a_second_are_too_close(spark):
    """What a calendar slot lets through."""
    rows = [(1, 0, T0 + dt.timedelta(milliseconds=999), "a"), (1, 1, T0 + dt.timedelta(milliseconds=1001), "b"), (1, 2, T0 + dt.timedelta(milliseconds=2000), "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.event_id for r in K.least_gap(df).orderBy("event_id").collect()] == [0, 2]
    assert X.throttle(df).count() == 3


def test_least_gap_stream_with_shuffled_batches(spark, rows, tmp_path):
    got = streamed(spark, rows, lambda e, d: K.least_gap(e, 300, d), tmp_path)
    assert got == plain_gap(rows, 300) and len(got) < len(rows)


def test_stalled_stream_with_shuffled_batches(spark, rows, tmp_path):
    got = streamed(spark, rows, lambda e, d: K.stalled_keyed(e, 900, 2000, d), tmp_path)
    want = sorted(tuple(r) for r in X.stalled(spark.createDataFrame(rows, SCHEMA), 900, 2000).collect())
    assert got == want and {r[2] for r in got} == {"gap", "silent", "total"}


def test_no_events(spark):
    assert K.least_gap(spark.createDataFrame([], SCHEMA)).withColumn("x", F.lit(1)).collect() == []


def test_state_grows_with_groups_not_with_requests(spark, tmp_path):
    """A call and a timer for each request do not fit large streams; a missing request is one of its own."""
    rows = [(r if r else None, 2 * r + i, T0 + dt.timedelta(seconds=r % 50 + 5 * i), "stage1_done") for r in range(6 * K.GROUPS) for i in range(2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "src"))
    for name, build in (("stream", X.stalled_stream), ("keyed", K.stalled_keyed)):
        stream = build(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "src")), 900, 3000, "1 second")
        query = (stream.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True)
                 .format("parquet").option("path", str(tmp_path / f"{name}-out")).start())
        query.awaitTermination()
        held = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
        assert 0 < held <= 4 * (K.GROUPS + 1), name  # a state of events, of requests, and a timer with its index


def test_a_missing_request_is_one_request(spark, rows, tmp_path):
    rows = [(None if r == 4 else r, *rest) for r, *rest in rows]
    want = sorted((tuple(r) for r in X.stalled(spark.createDataFrame(rows, SCHEMA), 900, 2000).collect()), key=repr)
    parts = [sorted(rows, key=lambda r: r[2]), [(-1, -1, T0 + dt.timedelta(days=90), "done")]]
    for name, build in (("stream", X.stalled_stream), ("keyed", K.stalled_keyed)):
        src, out, state = (str(tmp_path / name / x) for x in ("src", "out", "state"))
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            stream = build(spark.readStream.schema(SCHEMA).parquet(src), 900, 2000, "10000 seconds")
            stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        got = spark.read.schema(stream.schema).parquet(out).where("request_id is null or request_id >= 0").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want, name
