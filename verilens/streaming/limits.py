"""Keyed limits, idempotent ingest and numbering of events (R1-R4), on streams and on tables.

State is per key and small: the allowed hits of the last minute, a token count, one
recorded body or a counter.  Rows of one key are handled in the order of time, then
``request_id`` (none first), then content, however many there are.  A table is dealt out
by key and sorted by Spark, and one pass over the sorted rows holds the state of one key.
In a batch of a stream, more than ``HELD`` rows of a key go to the state store as sorted
runs, which are merged part by part.  State goes once the watermark has passed the time
from which it has no effect; rows later than the watermark are not decided.  Rows without
a time are left out of both.

Streams need the RocksDB state store, which ``build_session`` sets.
"""

from __future__ import annotations

import heapq
import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 60.0
DELAY = "10 minutes"
#: Rows of one key in memory before they are put aside, and rows of one part of a run.
HELD = 50_000
PART = 1_000

HIT = "key string, us long, rid long, extra string"
NO_ID = -(2**63)

Hit = tuple[int, int, str]


class InOrder(StatefulProcessor):
    """Rows of a key one after the other in the order of time, request and content.

    A subclass starts a key in ``fresh``, decides in ``one``, and in a stream loads its
    state in ``begin`` and saves it in ``end``, which returns the time in microseconds
    from which the state has no effect.
    """

    columns: tuple[str, ...] = ()

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run int, part int", "us array<bigint>, id array<bigint>, extra array<string>")
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def fresh(self) -> None:
        raise NotImplementedError

    def begin(self) -> None:
        raise NotImplementedError

    def one(self, us: int, extra: str | None) -> tuple:
        raise NotImplementedError

    def end(self) -> int | None:
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.begin()
        out: list[tuple] = []
        for us, rid, extra in self.sorted_hits(rows):
            out.append((key[0], us, rid, extra, *self.one(us, extra)))
            if len(out) == 10 * PART:
                yield self.frame(out)
                out = []
        until = self.end()
        if until is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(until // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())

    def close(self) -> None:
        pass

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "us", "rid", "extra", *self.columns])

    def sorted_hits(self, frames: Iterator[pd.DataFrame]) -> Iterator[Hit]:
        held: list[Hit] = []
        parts: list[int] = []
        for frame in frames:
            # absent content sorts first and comes back as none
            content = ["" if e is None else "=" + e for e in frame["extra"].tolist()]
            held.extend(zip(frame["us"].tolist(), frame["rid"].tolist(), content, strict=True))
            if len(held) > HELD:
                parts.append(self.put_aside(len(parts), held))
                held = []
        held.sort()
        for us, rid, extra in heapq.merge(held, *(self.read_run(run, n) for run, n in enumerate(parts))):
            yield us, rid, extra[1:] if extra else None

    def put_aside(self, run: int, hits: list[Hit]) -> int:
        hits.sort()
        for part, at in enumerate(range(0, len(hits), PART)):
            us, rid, extra = zip(*hits[at : at + PART], strict=True)
            self.runs.updateValue((run, part), (list(us), list(rid), list(extra)))
        return part + 1

    def read_run(self, run: int, parts: int) -> Iterator[Hit]:
        for part in range(parts):
            us, rid, extra = self.runs.getValue((run, part))
            self.runs.removeKey((run, part))
            yield from zip(us, rid, extra, strict=True)


def _run(
    events: DataFrame, kind: type[InOrder], parameters: tuple, outputs: str, extra: Column | None = None, delay: str = DELAY
) -> DataFrame:
    """Decisions of ``kind`` over events(key, ts, request_id) as HIT columns and ``outputs``."""
    rule, schema = kind(*parameters), f"{HIT}, {outputs}"
    hits = events.filter("ts IS NOT NULL").select(
        F.col("key").cast("string").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.coalesce(F.col("request_id").cast("long"), F.lit(NO_ID)).alias("rid"),
        (F.lit(None).cast("string") if extra is None else extra).alias("extra"),
    )
    if events.isStreaming:
        grouped = hits.withWatermark("ts", delay).groupBy("key")
        return grouped.transformWithStateInPandas(rule, schema, "append", "EventTime")
    in_order = hits.drop("ts").repartition("key").sortWithinPartitions("key", "us", "rid", "extra")
    return in_order.mapInPandas(_walker(rule), schema)


def _walker(rule: InOrder):
    """One pass over rows sorted by key and order."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, started = None, False
        for frame in frames:
            out = []
            for row in zip(*(frame[c].tolist() for c in ("key", "us", "rid", "extra")), strict=True):
                if not started or row[0] != key:
                    key, started = row[0], True
                    rule.fresh()
                out.append((*row, *rule.one(row[1], row[3])))
            yield rule.frame(out)

    return walk


def _hits(found: DataFrame, events: DataFrame, *outputs: str | Column) -> DataFrame:
    ts = F.timestamp_micros("us").cast(events.schema["ts"].dataType)
    return found.select("key", ts.alias("ts"), F.nullif("rid", F.lit(NO_ID)).alias("request_id"), *outputs)


class _Sliding(InOrder):
    columns = ("allowed", "remaining")

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, round(window * 1e6)

    def open(self, handle) -> None:
        self.state = handle.getListState("allowed", "us bigint")

    def fresh(self) -> None:
        self.kept: deque[int] = deque()

    def begin(self) -> None:
        self.kept = deque(us for (us,) in self.state.get())

    def one(self, us: int, extra: str | None) -> tuple:
        if self.limit <= 0:
            return True, float("inf")
        while self.kept and us - self.kept[0] > self.window:
            self.kept.popleft()
        allowed = len(self.kept) < self.limit
        if allowed:
            self.kept.append(us)
        return allowed, float(self.limit - len(self.kept))

    def end(self) -> int | None:
        if not self.kept:
            return None
        self.state.put([(us,) for us in self.kept])
        return self.kept[-1] + self.window

    def clear(self) -> None:
        self.state.clear()


def sliding_window(events: DataFrame, limit: int, window: float = WINDOW, delay: str = DELAY) -> DataFrame:
    """Allowed while fewer than ``limit`` allowed hits lie in the last window, its end included.

    Denied hits do not count; a limit of 0 or less allows all.  ``events(key, ts, request_id)``.
    """
    found = _run(events, _Sliding, (limit, window), "allowed boolean, remaining double", delay=delay)
    return _hits(found, events, "allowed", "remaining")


class _Bucket(InOrder):
    columns = ("allowed", "remaining")

    def __init__(self, capacity: int, window: float):
        self.capacity, self.window = capacity, window

    def open(self, handle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, us bigint")

    def fresh(self) -> None:
        self.tokens, self.last = float(self.capacity), None

    def begin(self) -> None:
        self.fresh()
        if self.state.exists():
            self.tokens, self.last = self.state.get()

    def one(self, us: int, extra: str | None) -> tuple:
        if self.capacity <= 0:
            return True, float("inf")
        if self.last is not None:
            self.tokens = min(float(self.capacity), self.tokens + max(0, us - self.last) / 1e6 * self.capacity / self.window)
        self.last = us
        allowed = self.tokens >= 1
        self.tokens -= allowed
        return allowed, self.tokens

    def end(self) -> int | None:
        if self.last is None:
            return None
        self.state.update((self.tokens, self.last))
        return self.last + round(self.window * 1e6)  # by then the bucket is full again

    def clear(self) -> None:
        self.state.clear()


def token_bucket(events: DataFrame, capacity: int, window: float = WINDOW, delay: str = DELAY) -> DataFrame:
    """One token per hit, ``capacity`` tokens refilled evenly over a window (R2); 0 or less allows all."""
    found = _run(events, _Bucket, (capacity, window), "allowed boolean, remaining double", delay=delay)
    return _hits(found, events, "allowed", "remaining")


class _Ingest(InOrder):
    columns = ("outcome",)

    def __init__(self, ttl: float):
        self.ttl = round(ttl * 1e6)

    def open(self, handle) -> None:
        self.state = handle.getValueState("recorded", "body string, us bigint")

    def fresh(self) -> None:
        self.body, self.since = None, None

    def begin(self) -> None:
        self.fresh()
        if self.state.exists():
            self.body, self.since = self.state.get()

    def one(self, us: int, extra: str | None) -> tuple:
        if self.since is None or us - self.since > self.ttl:
            self.body, self.since = extra, us
            return ("new",)
        return ("duplicate" if extra == self.body else "conflict",)

    def end(self) -> int | None:
        self.state.update((self.body, self.since))
        return self.since + self.ttl

    def clear(self) -> None:
        self.state.clear()


def idempotent_ingest(events: DataFrame, ttl: float, delay: str = DELAY) -> DataFrame:
    """new, duplicate (same body) or conflict (other body) within the time to live.

    ``events(key, ts, request_id, body_hash)``; no body is a body of its own.
    """
    return _hits(_run(events, _Ingest, (ttl,), "outcome string", F.col("body_hash"), delay), events, "outcome")


class _Sequence(InOrder):
    columns = ("seq",)

    def open(self, handle) -> None:
        self.state = handle.getValueState("last", "seq bigint")

    def fresh(self) -> None:
        self.seq = 0

    def begin(self) -> None:
        self.fresh()
        if self.state.exists():
            (self.seq,) = self.state.get()

    def one(self, us: int, extra: str | None) -> tuple:
        self.seq += 1
        return (self.seq,)

    def end(self) -> int | None:
        self.state.update((self.seq,))  # a trace may go on at any time, so its counter stays

    def clear(self) -> None:
        self.state.clear()


def sequenced(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events of each trace numbered from 1 without gaps.

    ``events(trace_id, ts, event_id, ...)``; further columns are kept.  A later batch goes
    on where the last one ended, inside a batch time and ``event_id`` decide.
    """
    others = [f for f in events.schema.fields if f.name not in ("trace_id", "ts", "event_id")]
    packed = F.to_json(F.struct(*[F.col(f.name) for f in others]), {"ignoreNullFields": "false"}) if others else None
    hits = events.select(
        F.col("trace_id").alias("key"), "ts", F.col("event_id").alias("request_id"),
        (F.lit(None).cast("string") if packed is None else packed).alias("packed"),
    )
    found = _run(hits, _Sequence, (), "seq long", F.col("packed"), delay)
    if others:
        of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
        found = found.withColumn("extra", F.from_json("extra", of))
    rest = [F.col("extra")[f.name].alias(f.name) for f in others]
    ts = F.timestamp_micros("us").cast(events.schema["ts"].dataType).alias("ts")
    return found.select(F.col("key").alias("trace_id"), ts, F.nullif("rid", F.lit(NO_ID)).alias("event_id"), "seq", *rest)


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark (R3, dropping form)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])
