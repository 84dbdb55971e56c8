"""Keyed limits and numbering: streams against tables and plain loops, hot keys, restarts and odd rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verilens.streaming import limits, pipelines

START = dt.datetime(2024, 1, 1)
HITS = "key string, ts timestamp, request_id long, body_hash string"


def hits(n, seed=0, keys=("hot", "hot", "hot", "a", "b")):
    rng = random.Random(seed)
    return [
        (rng.choice(keys), START + dt.timedelta(milliseconds=rng.randrange(400_000)), i, rng.choice("xyz"))
        for i in range(n)
    ]


def drained(spark, df, tmp_path):
    query = (
        df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def source(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def window_by_loop(rows, limit, window):
    kept, out = {}, {}
    for key, ts, rid, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        mine = kept.setdefault(key, [])
        recent = [t for t in mine if (ts - t).total_seconds() <= window]
        out[rid] = len(recent) < limit
        kept[key] = [*recent, ts] if out[rid] else recent
    return out


def test_hot_key_goes_through_sorted_runs(spark, tmp_path, monkeypatch):
    """A key with many more hits than are held: stream, table and loop agree."""
    monkeypatch.setattr(limits, "HELD", 300)
    monkeypatch.setattr(limits, "PART", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = hits(3000)
        streamed = drained(spark, limits.sliding_window(source(spark, rows, HITS, tmp_path / "in"), 7), tmp_path)
        found = {r.request_id: r.allowed for r in streamed.collect()}
        table = limits.sliding_window(spark.createDataFrame(rows, HITS), 7)
        assert found == {r.request_id: r.allowed for r in table.collect()} == window_by_loop(rows, 7, 60)
        assert {r.request_id: r.ts for r in streamed.collect()} == {r[2]: r[1] for r in rows}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_numbers_survive_a_replayed_batch(spark, tmp_path):
    schema = "trace_id string, ts timestamp, event_id long, type string, size double"
    parts = [hits(60, 1), [(k, t + dt.timedelta(hours=1), i + 60, b) for k, t, i, b in hits(50, 2)]]
    log = tmp_path / "log"
    for rows in parts:
        events = source(spark, [(k, t, i, None if i == 3 else b, float(i)) for k, t, i, b in rows], schema, tmp_path / "in")
        pipelines.numbered_log(events, str(log), str(tmp_path / "cp")).awaitTermination(120)
    first = sorted(map(tuple, spark.read.parquet(str(log)).select("trace_id", "seq", "event_id", "type", "size").collect()), key=str)
    # the last batch with rows was written, but its commit is lost
    last = max(int(p.name.split("=")[1]) for p in log.iterdir() if spark.read.parquet(str(p)).count())
    for commit in (tmp_path / "cp" / "commits").iterdir():
        number = commit.name.strip(".").split(".")[0]
        if number.isdigit() and int(number) >= last:
            commit.unlink()
    pipelines.numbered_log(events, str(log), str(tmp_path / "cp")).awaitTermination(120)
    again = sorted(map(tuple, spark.read.parquet(str(log)).select("trace_id", "seq", "event_id", "type", "size").collect()), key=str)
    assert again == first and len(first) == 110
    everything = sorted(parts[0], key=lambda r: (r[1], r[2])) + sorted(parts[1], key=lambda r: (r[1], r[2]))
    for key in ("hot", "a", "b"):
        assert [i for k, _, i, _ in everything if k == key] == [r[2] for r in sorted((r for r in first if r[0] == key), key=lambda r: r[1])]
    assert {r[2]: r[3] for r in first}[3] is None


def test_token_bucket_and_ingest_of_tables(spark):
    at = [START + dt.timedelta(seconds=s) for s in (0, 0, 0, 30, 31)]
    events = spark.createDataFrame([("k", t, i, "x") for i, t in enumerate(at)], HITS)
    bucket = limits.token_bucket(events, 2).orderBy("request_id").collect()
    assert [r.allowed for r in bucket] == [True, True, False, True, False]
    bodies = [("k", START + dt.timedelta(seconds=s), i, b) for i, (s, b) in enumerate(((0, None), (60, None), (60, "y"), (61, "y")))]
    ingest = limits.idempotent_ingest(spark.createDataFrame(bodies, HITS), 60).orderBy("request_id").collect()
    assert [r.outcome for r in ingest] == ["new", "duplicate", "conflict", "new"]


@pytest.mark.parametrize(
    ("rows", "allowed"),
    [
        ([], []),
        ([(None, START, 1, None), (None, START, 2, None)], [True, False]),
        ([("k", None, 1, None), ("k", START, 2, None)], [True]),
        ([("k", START, None, None), ("k", START, None, None)], [True, False]),
        # the end of the window still counts
        ([("k", START, 1, None), ("k", START + dt.timedelta(seconds=60), 2, None)], [True, False]),
        ([("k", START, 1, None), ("k", START + dt.timedelta(seconds=60, microseconds=1), 2, None)], [True, True]),
    ],
)
def test_odd_rows(spark, rows, allowed):
    found = limits.sliding_window(spark.createDataFrame(rows, HITS), 1).orderBy("ts", "request_id", F.desc("allowed")).collect()
    assert [r.allowed for r in found] == allowed
    unlimited = limits.sliding_window(spark.createDataFrame(rows, HITS), 0).collect()
    assert all(r.allowed for r in unlimited) and len(unlimited) == len(allowed)


def test_columns_with_clashing_names_are_kept(spark):
    rows = [("t", START, 2, "k", 5), ("t", START, 1, None, 6)]
    events = spark.createDataFrame(rows, "trace_id string, ts timestamp, event_id long, key string, request_id long")
    found = limits.sequenced(events).orderBy("seq").collect()
    assert [(r.trace_id, r.event_id, r.seq, r.key, r.request_id) for r in found] == [("t", 1, 1, None, 6), ("t", 2, 2, "k", 5)]
