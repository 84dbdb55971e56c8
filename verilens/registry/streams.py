"""Keyed limits, ingest and numbering over the given events: the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import limits
from . import corpus as X

QUERIES = {}
DAY = 86_400


def add(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def hits(spark, sf_dir):
    return X.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("request_id"), "event_type")


def one_by_one(first: str, state: str, step: str, select: str) -> str:
    """SQL that goes through the hits of every key in order: state of the first one, then one step each."""
    return f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, ts, epoch_us(ts) AS us, event_id AS request_id, event_type,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
r AS (SELECT e.*, {first} FROM e WHERE n = 1 UNION ALL
 SELECT key, ts, us, request_id, event_type, n, {step} FROM (SELECT e.*, {state} FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT key, ts, request_id, {select} FROM r"""


@add(
    "r1_sliding_window",
    one_by_one(
        "[us] AS kept, true AS allowed",
        f"list_filter(r.kept, lambda t: e.us - t <= {DAY}000000) AS k",
        "CASE WHEN len(k) < 2 THEN list_append(k, us) ELSE k END, len(k) < 2",
        "allowed, (2 - len(kept))::DOUBLE AS remaining",
    ),
)
def r1(spark, sf_dir):
    """At most two events of a user a day, every event decided."""
    return limits.sliding_window(hits(spark, sf_dir), 2, DAY)


@add(
    "r2_token_bucket",
    one_by_one(
        "2.0::DOUBLE - 1 AS tokens, true AS allowed",
        f"least(2.0::DOUBLE, r.tokens + (e.us - r.us) / 1e6::DOUBLE * 2 / {DAY}::DOUBLE) AS t",
        "CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1",
        "allowed, round(tokens, 6) AS remaining",
    ),
)
def r2(spark, sf_dir):
    """A bucket of two tokens for every user, refilled within a day (R2)."""
    return limits.token_bucket(hits(spark, sf_dir), 2, DAY).withColumn("remaining", F.round("remaining", 6))


@add(
    "r3_idempotent_ingest",
    one_by_one(
        "event_type AS body, us AS since, 'new' AS outcome",
        f"r.body AS b, CASE WHEN e.us - r.since <= {DAY}000000 THEN r.since END AS s",
        "CASE WHEN s IS NULL THEN event_type ELSE b END, coalesce(s, us), "
        "CASE WHEN s IS NULL THEN 'new' WHEN event_type IS NOT DISTINCT FROM b THEN 'duplicate' ELSE 'conflict' END",
        "outcome",
    ),
)
def r3(spark, sf_dir):
    """The first event type of a user counts for a day: new, duplicate or conflict."""
    return limits.idempotent_ingest(hits(spark, sf_dir).withColumnRenamed("event_type", "body_hash"), DAY)


@add(
    "r4_sequenced_events",
    "SELECT user_id::VARCHAR AS trace_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, value, props "
    "FROM events WHERE ts IS NOT NULL",
)
def r4(spark, sf_dir):
    """All events, numbered without gaps per user."""
    return limits.sequenced(X.read(spark, sf_dir, "events").withColumnRenamed("user_id", "trace_id"))
