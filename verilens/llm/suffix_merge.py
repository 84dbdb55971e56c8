"""Removal of long repeated byte strings by merged Burrows-Wheeler transforms (operator 1).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere.

Anchors.  Of each ``WINDOW`` consecutive starts the one with the least hash of its
next ``GRAM`` bytes is an anchor.  Which one depends on those bytes only, so equal
strings have their first anchor at the same place, and the ``CORE`` bytes behind it
lie in the string.  A string repeats only if its anchor's core does; cores are
counted by hash, and what is left are the contexts of repeated anchors: the bytes
around an anchor that strings with this anchor can reach.

Merging.  Contexts of one core are aligned at their anchor.  Shards of contexts get
their (positional) Burrows-Wheeler transform: column by column, the symbols in the
order of what stands before them.  Shards are merged by refining their interleave: a
column's symbols, read from each shard's transform in turn, move the interleave to
the next column by one stable distribution, and no context is sorted again.  The
column at which two neighbours began to agree is carried along; where it lies
``LENGTH`` columns back, a run of neighbours is a repeated interval.

Equal contexts are counted before, so each takes part once.  A core with more than
``CLASS`` different contexts (a passage in very many surroundings) is not brought
together: its strings are counted by hash, for ranges of starts that are cut finer
only where their ends differ.

Scale: rows carry hashes and places; text is read, and moved once for contexts and
once for the result.  Aggregates are map-side combined, groups in a task bounded.

Cases: a null text counts as empty; texts shorter than ``LENGTH`` stay whole;
repeated rows are copies of each other; null ids keep their rows; extra columns are
left aside; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_table

LENGTH = 400
WINDOW = 200
GRAM = 16
CORE = LENGTH - WINDOW + 1
REACH = WINDOW - 1
WIDTH = REACH + LENGTH
SHARD = 512
BATCH = 4096
CLASS = 512
#: Starts per range at each step of counting by hash; the last step takes each start alone.
RANGES = (36, 6, 1)

_U = np.uint64
_TABLE = np.random.default_rng(77).integers(0, 1 << 64, 256, dtype=_U)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.where(np.arange(size) > 0, _U(base), _U(1)), dtype=_U) for base in (_BASE, _INVERSE)
            )
        return self.up, self.down


POWERS = Powers()


class Hashes:
    """Hashes of any substring of a byte string, by prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(grid, axis=1).ravel()
    count = n - width + 1
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places, core hashes, context hashes, and context lengths left and right of all anchors."""
    n = len(data)
    hashes = Hashes(data)
    starts = n - LENGTH + WINDOW
    grams = mixed(hashes.of(slice(0, starts), slice(GRAM, GRAM + starts)))
    # the upper half decides, the place breaks ties to the left
    ranked = (grams & ~_U(0xFFFFFFFF)) | np.arange(starts, dtype=_U)
    at = np.unique(sliding_least(ranked, WINDOW) & _U(0xFFFFFFFF)).astype(np.int64)
    core = mixed(hashes.of(at, at + CORE))
    left, right = np.minimum(at, REACH), np.minimum(n - at, LENGTH)
    lengths = (left * 1024 + right).astype(_U) * _U(_BASE)
    context = mixed(hashes.of(at - left, at + right) ^ lengths)
    return at, core.view(np.int64), context.view(np.int64), left, right


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id and text with two hashes that name a row; rows equal in both columns share them."""
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return plain.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.crc32(F.col("text").cast("binary")))


def to_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def anchors(texts: DataFrame) -> DataFrame:
    """k1, k2, at, core, context, l and r of all anchors of all texts."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = []
            for k1, k2, text in zip(rows["k1"], rows["k2"], rows["text"], strict=True):
                data = to_bytes(text)
                if len(data) >= LENGTH:
                    at, core, context, left, right = anchors_of(data)
                    parts.append((np.full(len(at), k1), np.full(len(at), k2), at, core, context, left, right))
            if parts:
                names = ["k1", "k2", "at", "core", "context", "l", "r"]
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    return texts.select("k1", "k2", "text").mapInPandas(
        find, "k1 long, k2 long, at int, core long, context long, l short, r short"
    )


class Shard:
    """Positional Burrows-Wheeler transform of some contexts, given as columns of symbols."""

    def __init__(self, columns: np.ndarray):
        width, n = columns.shape
        self.symbols = np.empty((width, n), np.uint16)
        self.order = np.empty((width + 1, n), np.int32)
        order = np.arange(n, dtype=np.int32)
        for k in range(width):
            self.order[k] = order
            self.symbols[k] = row = columns[k, order]
            order = order[np.argsort(row, kind="stable")]
        self.order[width] = order


def merge(shards: list[Shard], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Refine the interleave of the shards' transforms column by column.

    Yields, for each column from ``length`` on, (column, shard numbers, places in
    their shards' orders, interval numbers) of the contexts in merged order; contexts
    of one interval agree on the last ``length`` columns.
    """
    sizes = [s.order.shape[1] for s in shards]
    interleave = np.repeat(np.arange(len(shards)), sizes)
    n, width = len(interleave), len(shards[0].symbols)
    agree = np.zeros(n, np.int32)  # first column from which a context agrees with the one before it
    agree[0] = 1 << 30
    levels = max(1, n.bit_length())
    for k in range(width):
        turns = np.argsort(interleave, kind="stable")
        symbols = np.empty(n, np.uint16)
        symbols[turns] = np.concatenate([s.symbols[k] for s in shards])
        moved = np.argsort(symbols, kind="stable")
        # neighbours of one symbol agree since the latest start between their old places
        table = [agree]
        for level in range(1, levels):
            last, step = table[-1], 1 << (level - 1)
            if step >= n:
                break
            table.append(np.concatenate([last[:step], np.maximum(last[step:], last[:-step])]))
        new = np.full(n, k + 1, np.int32)
        new[0] = 1 << 30
        same = np.flatnonzero(symbols[moved[1:]] == symbols[moved[:-1]]) + 1
        low, high = moved[same - 1] + 1, moved[same]
        span = high - low + 1
        level = np.frexp(span)[1] - 1
        stack = np.stack(table)
        new[same] = np.maximum(stack[level, high], stack[level, low + (1 << level) - 1])
        agree, interleave = new, interleave[moved]
        if k + 1 >= length:
            turns = np.argsort(interleave, kind="stable")
            places = np.empty(n, np.int64)
            places[turns] = np.concatenate([np.arange(size) for size in sizes])
            yield k + 1, interleave, places, np.cumsum(agree > k + 1 - length)


def repeated_starts(contexts: list[bytes], left: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance before the anchor at which each context's string repeats; -1 for none.

    A context's string at distance d repeats if another context, or another anchor
    with this context (``weight`` counts them), has the same one.
    """
    n = len(contexts)
    columns = np.zeros((WIDTH, n), np.uint16)
    for i, (data, l) in enumerate(zip(contexts, left, strict=True)):
        columns[REACH - l : REACH - l + len(data), i] = np.frombuffer(data, np.uint8).astype(np.uint16) + 1
    right = np.array([len(c) for c in contexts]) - left
    bounds = list(range(0, n, SHARD))
    shards = [Shard(columns[:, a : a + SHARD]) for a in bounds]
    least, most = np.full(n, -1), np.full(n, -1)
    for end, interleave, places, interval in merge(shards, LENGTH):
        number = np.empty(n, np.int64)
        for s, (first, shard) in enumerate(zip(bounds, shards, strict=True)):
            mine = interleave == s
            number[mine] = first + shard.order[end][places[mine]]
        distance = REACH - (end - LENGTH)
        total = np.bincount(interval, weight[number])
        hit = number[total[interval] >= 2]
        hit = hit[(left[hit] >= distance) & (right[hit] >= LENGTH - distance)]
        most[hit] = np.maximum(most[hit], distance)
        least[hit] = distance  # distances fall from column to column
    return least, most


def merged_classes(contexts: DataFrame) -> DataFrame:
    """(core, context, least, most) for ``contexts(core, context, l, number, data)`` of bounded classes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            least, most = repeated_starts(
                rows["data"].tolist(), rows["l"].to_numpy().astype(np.int64), rows["number"].to_numpy().astype(float)
            )
            out = pd.DataFrame({"core": rows["core"], "context": rows["context"], "least": least, "most": most})
            return out[out["most"] >= 0]

        held = None
        for rows in batches:
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            while len(held) > BATCH:
                cores = held["core"].to_numpy()
                # whole classes only: up to where the class that crosses the border begins
                cut = int(np.flatnonzero(cores[:BATCH] != cores[BATCH])[-1]) + 1
                yield solve(held.iloc[:cut].reset_index(drop=True))
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    placed = contexts.repartition("core").sortWithinPartitions("core", "context")
    return placed.mapInPandas(work, "core long, context long, least int, most int")


def counted_classes(contexts: DataFrame) -> DataFrame:
    """The same for classes of any size, by counting hashes of ranges of strings.

    A range of distances is repeated as a whole if all its strings together occur
    again; it is not if even what they have in common does not; else it is cut.
    """
    found = None
    ranges = contexts.select("core", "context", F.array(F.lit(0)).alias("from"))
    wider = WINDOW
    for step in RANGES:
        span, inside = step, wider

        def hash_ranges(batches: Iterator[pd.DataFrame], span: int = span, inside: int = inside) -> Iterator[pd.DataFrame]:
            for rows in batches:
                out = []
                for core, context, l, data, starts in zip(
                    rows["core"], rows["context"], rows["l"], rows["data"], rows["from"], strict=True
                ):
                    sums = Hashes(np.frombuffer(data, np.uint8))
                    r = len(data) - l
                    low, high = max(0, LENGTH - r), min(REACH, l)
                    for start in starts:
                        for a in range(int(start), min(int(start) + inside, WINDOW), span):
                            b = min(a + span, WINDOW) - 1
                            if b < low or a > high:
                                continue
                            common = int(mixed(sums.of([l - a], [l - b + LENGTH]))[0].view(np.int64))
                            whole = None
                            if a >= low and b <= high:
                                whole = int(mixed(sums.of([l - b], [l - a + LENGTH]))[0].view(np.int64))
                            out.append((core, context, a, b, common, whole))
                made = pd.DataFrame(out, columns=["core", "context", "a", "b", "common", "whole"])
                made["whole"] = made["whole"].astype("Int64")
                yield made

        rows = write_table(
            contexts.join(ranges, ["core", "context"]).mapInPandas(
                hash_ranges, "core long, context long, a int, b int, common long, whole long"
            ),
            "repeat-ranges",
        )
        numbers = contexts.select("core", "context", "number")
        weighed = rows.join(numbers, ["core", "context"])
        by = lambda c: weighed.filter(F.col(c).isNotNull()).groupBy("core", "a", c).agg(F.sum("number").alias("n_" + c))
        judged = rows.join(by("common").filter("n_common > 1"), ["core", "a", "common"]).join(
            by("whole").filter("n_whole > 1"), ["core", "a", "whole"], "left"
        )
        judged = write_table(judged, "repeat-judged")
        sure, open_ = judged.filter("n_whole is not null"), judged.filter("n_whole is null")
        decided = sure.select("core", "context", F.col("a").alias("least"), F.col("b").alias("most"))
        found = decided if found is None else found.unionByName(decided)
        # what is cut finer may repeat strings of what is decided; one of each kind goes on with it
        others = sure.groupBy("core", "a", "common", "whole").agg(F.min("context").alias("context"))
        others = others.join(open_.select("core", "a", "common").distinct(), ["core", "a", "common"], "left_semi")
        further = open_.select("core", "context", "a").unionByName(others.select("core", "context", "a"))
        ranges = further.groupBy("core", "context").agg(F.collect_set("a").alias("from"))
        wider = step
    return found.groupBy("core", "context").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k1, k2 and the (start, end) spans, overlapping, of repeated bytes of each text."""
    texts = _texts(docs)
    found = write_table(anchors(texts), "repeat-anchors")
    cores = (
        found.groupBy("core")
        .agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("x"), F.max("context").alias("y"))
        .filter("n > 1")
        .select("core", (F.col("x") != F.col("y")).alias("varied"))
    )
    # a table of its own, so that the join's hot cores can be split
    repeated = write_table(found.join(write_table(cores, "repeat-cores"), "core"), "repeat-found")
    contexts = write_table(
        repeated.groupBy("core", "context").agg(
            F.count(F.lit(1)).alias("number"),
            F.max("varied").alias("varied"),
            F.min("l").alias("l"),
            F.min("r").alias("r"),
            F.min(F.struct("k1", "k2", "at")).alias("place"),
        ),
        "repeat-contexts",
    )
    copies = contexts.filter(F.col("number") > 1).select(
        "core",
        "context",
        F.greatest(F.lit(0), LENGTH - F.col("r").cast("int")).alias("least"),
        F.col("l").cast("int").alias("most"),
    )
    classes = contexts.filter("varied").groupBy("core").agg((F.count(F.lit(1)) > CLASS).alias("wide"))
    varied = contexts.filter("varied").join(classes, "core")
    wanted = varied.groupBy(F.col("place.k1").alias("k1"), F.col("place.k2").alias("k2")).agg(
        F.collect_list(F.struct("core", "context", "number", "l", "r", F.col("place.at").alias("at"), "wide")).alias("wanted")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text, wanted_ in zip(rows["text"], rows["wanted"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted_:
                    part = data[w["at"] - w["l"] : w["at"] + w["r"]]
                    out.append((w["core"], w["context"], w["number"], w["l"], w["wide"], part))
            yield pd.DataFrame(out, columns=["core", "context", "number", "l", "wide", "data"])

    one = texts.select("k1", "k2", "text").join(wanted, ["k1", "k2"])
    data = one.select("text", "wanted").mapInPandas(
        cut, "core long, context long, number long, l int, wide boolean, data binary"
    )
    data = write_table(data.dropDuplicates(["core", "context"]), "repeat-data")
    merged = merged_classes(data.filter("not wide").drop("wide"))
    counted = counted_classes(data.filter("wide").drop("wide"))
    judged = copies.unionByName(merged).unionByName(counted)
    judged = judged.groupBy("core", "context").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    judged = write_table(judged.filter(F.col("most") >= F.col("least")), "repeat-judged-all")
    return repeated.join(judged, ["core", "context"]).select(
        "k1", "k2", (F.col("at") - F.col("most")).alias("start"), (F.col("at") - F.col("least") + LENGTH).alias("end")
    )


def merged_spans(docs: DataFrame) -> DataFrame:
    """k1, k2 and the disjoint [start, end) spans of bytes to remove, in order."""
    found = repeated_spans(docs).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    # spans that touch or overlap grow together
    grow = F.aggregate(
        "s",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    return found.select("k1", "k2", grow.alias("spans"))


def without_spans(text: str, spans) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    at, parts = 0, []
    for s in spans if spans is not None else ():
        parts.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*parts, data[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans ([start, end) in bytes) and the kept bytes of every document."""

    @F.pandas_udf("binary")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    whole = _texts(docs).join(merged_spans(docs), ["k1", "k2"], "left")
    return whole.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        kept("text", "spans").alias("kept"),
    )


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of the texts; no row goes.

    A character that loses some of its bytes goes as a whole; ``n_chars``, where
    there is one, is that of the new text.  Texts without repeats are untouched.
    """

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        cut = [t if s is None else without_spans(t, s).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)]
        return pd.Series(cut, dtype=object)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.withColumn("_k1", F.xxhash64(F.col("doc_id").cast("long"), text)).withColumn(
        "_k2", F.crc32(text.cast("binary"))
    )
    spans = merged_spans(docs).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("spans").alias("_spans"))
    out = keys.join(spans, ["_k1", "_k2"], "left").withColumn("text", kept(F.col("text").cast("string"), "_spans"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*docs.columns)


def digests(cleaned: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
