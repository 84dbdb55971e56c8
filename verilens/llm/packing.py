"""Pattern packing of token sequences by non-negative least squares (operator 3).

Documents are encoded, ended by ``END`` and cut into pieces of at most ``capacity``
tokens.  Only the histogram of piece lengths decides the packing:

1. patterns of two or three lengths that fill a sequence exactly are enumerated;
2. their repeat counts are fitted to the histogram by non-negative least squares;
3. counts are rounded, limited to what the histogram still holds, and taken out;
4. residual lengths go, longest first, each into the fullest open sequence that
   has room, for all equal lengths at once.

Every step works on ``capacity`` numbers, whatever the number of documents, and so
does its plan: for each length, ranges of ranks that go to consecutive sequences.
Pieces get their rank among pieces of their length from counts per task, so no
length is sorted or collected, though a third of all pieces may have one length.

Cases: a null or empty text is one piece that holds ``END`` alone; repeated rows
and null ids are packed as documents of their own; extra columns are left aside;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import TEXT_ROWS, write_table
from .tokens import encoder

CAPACITY = 1024
END = 2
STEPS = 300

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids array<int>"
)


def pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents; ``nth`` numbers a task's pieces of one length.

    Of a document longer than ``capacity`` the first piece takes what is left over
    by full ones.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder().encode, END.to_bytes(4, "little")
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for rows in batches:
            out = []
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                data = encode(text) + end
                total, at, number = len(data) // 4, 0, 0
                length = (total - 1) % capacity + 1
                while at < total:
                    part = data[4 * at : 4 * (at + length)]
                    ids = np.frombuffer(part, np.uint32).astype(np.int32) if keep_ids else None
                    out.append((doc, number, at, length, zlib.crc32(part), task, int(seen[length]), ids))
                    seen[length] += 1
                    at, number, length = at + length, number + 1, capacity
            made = pd.DataFrame(
                out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
            )
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return texts.mapInPandas(cut, PIECES)


def patterns(capacity: int) -> np.ndarray:
    """Rows of three lengths, in falling order, that fill ``capacity``; 0 for no third one."""
    first, second = np.meshgrid(np.arange(1, capacity), np.arange(1, capacity), indexing="ij")
    third = capacity - first - second
    keep = (first >= second) & (second >= third) & (third >= 0)
    return np.stack([first[keep], second[keep], third[keep]], axis=1)


def fit(shapes: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts >= 0 that bring the shapes' lengths nearest to the histogram.

    Least squares over the numbers of pieces of each length, by accelerated
    projected gradient; a shape has three lengths, so a step costs three lookups
    a shape.  Length 0 stands for no piece and does not count.
    """
    wanted = histogram.astype(float).copy()
    wanted[0] = 0.0
    size = len(histogram)
    present = (histogram[shapes] > 0) | (shapes == 0)
    usable = present.all(axis=1)
    used = shapes[usable]
    result = np.zeros(len(shapes))
    if not len(used):
        return result

    def gradient(x: np.ndarray) -> np.ndarray:
        made = sum(np.bincount(used[:, k], x, size) for k in range(3)) - wanted
        made[0] = 0.0
        return made[used].sum(axis=1)

    # the largest eigenvalue bounds the step
    probe = np.ones(len(used))
    for _ in range(20):
        made = sum(np.bincount(used[:, k], probe, size) for k in range(3))
        made[0] = 0.0
        probe = made[used].sum(axis=1)
        largest = np.linalg.norm(probe)
        probe /= largest
    x = y = np.zeros(len(used))
    momentum = 1.0
    for _ in range(steps):
        following = np.maximum(0.0, y - gradient(y) / (1.05 * largest))
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = following + (momentum - 1) / grown * (following - x)
        x, momentum = following, grown
    result[usable] = x
    return result


def plan(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, rank from, rank to, first sequence, offset) that place all pieces.

    Rank r of a length, from <= r < to, lies in sequence ``first + r - from`` at
    ``offset``.
    """
    left = histogram.astype(np.int64).copy()
    taken = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, number: int, first: int, offset: int) -> None:
        rows.append((length, taken[length], taken[length] + number, first, offset))
        taken[length] += number
        left[length] -= number

    if left[capacity]:
        number = int(left[capacity])
        place(capacity, number, sequences, 0)
        sequences += number
    shapes = patterns(capacity)
    repeats = np.rint(fit(shapes, left)).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        lengths = [int(n) for n in shapes[k] if n]
        number = min(int(repeats[k]), *(int(left[n]) // lengths.count(n) for n in lengths))
        if number > 0:
            offset = 0
            for n in lengths:
                place(n, number, sequences, offset)
                offset += n
            sequences += number
    # residuals: runs of equally full sequences, by room left
    room: dict[int, list[tuple[int, int]]] = {}
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            best = min((r for r, runs in room.items() if runs and r >= length), default=None)
            if best is None:
                # as many of this length as fit go into each new sequence
                each = capacity // length
                number = int(left[length]) // each or 1
                each = min(each, int(left[length]))
                for slot in range(each):
                    place(length, number, sequences, slot * length)
                room.setdefault(capacity - each * length, []).append((sequences, number))
                sequences += number
                continue
            first, many = room[best].pop()
            number = min(many, int(left[length]))
            place(length, number, first, capacity - best)
            if number < many:
                room[best].append((first + number, many - number))
            if best > length:
                room.setdefault(best - length, []).append((first, number))
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; the sequences are gapless from 0.

    With ``keep_ids`` each piece carries its token ids in ``ids``.
    """
    made = write_table(pieces(docs, capacity, keep_ids), "pack-pieces", TEXT_ROWS)
    counts = write_table(
        made.groupBy("task", "length").agg((F.max("nth") + 1).alias("number")), "pack-counts"
    )
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("number").alias("number")).collect():  # capacity rows at most
        histogram[row.length] = row.number
    placed = plan(histogram, capacity)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    # one searchable key for (length, rank): ranks of a length are below the width
    width = int(histogram.max(initial=0)) + 1
    keys = placed[:, 0] * width + placed[:, 1]
    before = F.sum("number").over(W.partitionBy("length").orderBy("task")) - F.col("number")
    offsets = counts.select(
        F.col("task").alias("_task"), F.col("length").alias("_length"), before.alias("_before")
    )
    ranked = made.join(
        offsets, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length"))
    ).withColumn("rank", F.col("_before") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * width + rank.to_numpy(), "right") - 1
        row = placed[at]
        return pd.DataFrame({"sequence_id": row[:, 3] + rank.to_numpy() - row[:, 1], "offset": row[:, 4]})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return ranked.withColumn("_at", place("length", "rank")).select(
        *columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")
    )
