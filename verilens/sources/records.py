"""Records of delimited files whose quoted fields may hold line breaks, read in parallel blocks.

A block of a file cannot know whether it begins inside a quoted field.  Each block is
therefore scanned under both assumptions: that gives a map from the state before the
block to the state behind it.  The maps of a file are composed over its blocks (one
small row each), and a second scan cuts the lines into records with the state known.
Only lines of records that span several lines are shuffled.

Quotes open a field only at its start, as the ``csv`` module has it; a quote left open
runs to the end of the file, as there, without the file's last line break.  Line
breaks inside a field become ``\\n``.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DELIMITERS = (",", ";", "\t", "|")
#: Characters at the start of a file that decide its delimiter.
SAMPLE = 8192

LINES = "path string, block long, n long, value string, starts array<long>, opens int"
BLOCKS = "path string, block long, starts array<long>, opens int, several int, delimiter string"


def open_after(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted field is open behind ``line``, which began inside one or not."""
    at = 0
    if not inside:
        inside = line.startswith('"')
        at = int(inside)
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
        at = line.find(delimiter, at) + 1
        if not at:
            return False
        inside = line[at : at + 1] == '"'
        at += inside


def choose_delimiter(sample: str) -> str:
    """Most frequent candidate; another one if that leaves the first record in a single column."""
    best = max(DELIMITERS, key=sample.count)
    if best not in sample:
        return ","
    width = {d: len(next(csv.reader(io.StringIO(sample), delimiter=d), [])) for d in DELIMITERS}
    if width[best] == 1:
        return next((d for d in (",", "\t", ";", "|") if width[d] > 1), best)
    return best


class _Block:
    """States of one block under each (delimiter, begins inside) assumption."""

    def __init__(self, path: str, block: int, delimiters: Sequence[str]):
        self.path, self.block, self.delimiters = path, block, delimiters
        self.n = 0
        self.open = [bool(h % 2) for h in range(2 * len(delimiters))]
        self.start = [-1] * len(self.open)  # first line of the current record, -1: before the block
        self.several = [False] * len(self.open)
        self.head: list[str] = []
        self.head_size = 0

    def sample(self, values: pa.Array) -> None:
        for value in values:
            if self.block or self.head_size >= SAMPLE:
                return
            self.head.append(value.as_py())
            self.head_size += len(self.head[-1]) + 1

    def plain(self, starts: np.ndarray, opens: np.ndarray) -> None:
        """Lines without a quote keep their state."""
        if not len(opens):
            return
        numbers = np.arange(self.n, self.n + len(opens))
        self.n += len(opens)
        for h, is_open in enumerate(self.open):
            starts[:, h] = self.start[h] if is_open else numbers
            self.several[h] |= is_open
            if not is_open:
                self.start[h] = self.n - 1
        opens[:] = _bits(self.open)

    def quoted(self, line: str, starts: np.ndarray, opens: np.ndarray) -> None:
        after = {}
        for h, is_open in enumerate(self.open):
            if not is_open:
                self.start[h] = self.n
            key = self.delimiters[h // 2], is_open
            if key not in after:
                after[key] = open_after(line, *key)
            self.open[h] = after[key]
            self.several[h] |= is_open or self.open[h]
        starts[0], opens[0] = self.start, _bits(self.open)
        self.n += 1

    def summary(self) -> dict[str, list]:
        delimiter = None if self.block else choose_delimiter("\n".join(self.head)[:SAMPLE])
        row = (self.path, self.block, self.start, _bits(self.open), _bits(self.several), delimiter)
        return dict(zip(("path", "block", "starts", "opens", "several", "delimiter"), ([v] for v in row), strict=True))


def _bits(flags: Sequence[bool]) -> int:
    return sum(1 << h for h, flag in enumerate(flags) if flag)


BLOCK_ROW = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("starts", pa.list_(pa.int64())), ("opens", pa.int32())]
    + [("several", pa.int32()), ("delimiter", pa.string())]
)


def _scanner(delimiters: Sequence[str], blocks_only: bool):
    width = 2 * len(delimiters)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task reads its blocks one after the other, each in file order.
        now: _Block | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("path").dictionary_encode().indices.to_numpy()
            places = batch.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(places) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                path, block = batch.column("path")[int(a)].as_py(), int(places[a])
                if now is None or (now.path, now.block) != (path, block):
                    if now and blocks_only:
                        yield pa.RecordBatch.from_pydict(now.summary(), BLOCK_ROW)
                    now = _Block(path, block, delimiters)
                first, values = now.n, batch.column("value").slice(a, b - a)
                starts, opens = np.empty((b - a, width), np.int64), np.empty(b - a, np.int32)
                now.sample(values)
                at = 0
                for q in np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)):
                    now.plain(starts[at:q], opens[at:q])
                    now.quoted(values[int(q)].as_py(), starts[q : q + 1], opens[q : q + 1])
                    at = q + 1
                now.plain(starts[at:], opens[at:])
                if not blocks_only:
                    offsets = pa.array(np.arange(0, starts.size + 1, width, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("path").slice(a, b - a),
                            batch.column("block").slice(a, b - a),
                            pa.array(np.arange(first, now.n)),
                            values,
                            pa.ListArray.from_arrays(offsets, pa.array(starts.ravel())),
                            pa.array(opens),
                        ],
                        ["path", "block", "n", "value", "starts", "opens"],
                    )
        if now and blocks_only:
            yield pa.RecordBatch.from_pydict(now.summary(), BLOCK_ROW)

    return scan


def _text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _bit(bits: str, h: Column) -> Column:
    return F.getbit(F.col(bits), h)


def scan_blocks(spark: SparkSession, paths: str | list[str], delimiters: Sequence[str] = DELIMITERS) -> DataFrame:
    """One row per block of each file, with its states under every assumption."""
    return _text(spark, paths).mapInArrow(_scanner(delimiters, True), BLOCKS)


def block_states(blocks: DataFrame, known: DataFrame | str | None) -> DataFrame:
    """State before each block: (path, block, delimiter, choice, inside, from_block, from_line, several).

    ``known`` names the delimiter of all files or of each; without it the start of the
    file decides.  A file has one row per block, so the window of a file is small.
    """
    whole = Window.partitionBy("path")
    upto = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    if isinstance(known, str):
        placed = blocks.withColumn("delimiter", F.lit(known)).withColumn("choice", F.lit(0))
    else:
        if known is None:
            placed = blocks.withColumn("delimiter", F.max("delimiter").over(whole))
        else:
            placed = blocks.drop("delimiter").join(known.select("path", "delimiter"), "path")
        place = F.array_position(F.array(*map(F.lit, DELIMITERS)), F.col("delimiter"))
        unknown = F.raise_error(F.concat(F.lit("not a known delimiter: "), "delimiter"))
        placed = placed.withColumn("choice", F.when(place == 0, unknown.cast("int")).otherwise((2 * (place - 1)).cast("int")))
    # the map of a block: constant, or kept, or turned
    ends = placed.withColumn("_out", _bit("opens", F.col("choice"))).withColumn("_in", _bit("opens", F.col("choice") + 1))
    turned = F.sum(F.when((F.col("_out") == 1) & (F.col("_in") == 0), 1).otherwise(0))
    turns = ends.withColumn("_turns", turned.over(upto))
    fixed = F.when(F.col("_out") == F.col("_in"), (F.col("_out") + F.col("_turns")) % 2)
    last_fixed = F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.lit(0))
    turns_before = F.coalesce(F.last("_turns").over(before), F.lit(0))
    states = turns.withColumn("inside", ((last_fixed + turns_before) % 2).cast("int"))
    chosen = F.col("choice") + F.col("inside")
    start = F.element_at("starts", (chosen + 1).cast("int"))
    begun = F.when((_bit("opens", chosen) == 1) & (start >= 0), F.struct("block", start.alias("line")))
    return states.withColumn("_from", F.last(begun, ignorenulls=True).over(before)).select(
        "path", "block", "delimiter", chosen.cast("int").alias("choice"), "inside",
        F.col("_from.block").alias("from_block"), F.col("_from.line").alias("from_line"),
        (_bit("several", chosen) == 1).alias("several"),
    )


def read_records(spark: SparkSession, paths: str | list[str], delimiters: DataFrame | str | None = None) -> DataFrame:
    """Records of delimited files: (path, row_idx, delimiter, record).

    ``row_idx`` is the start of the block that holds the record's first line plus the
    number of that line in the block, so it orders the records of a file and does not
    depend on how blocks are dealt out to tasks.  An empty file has no record.
    """
    candidates = (delimiters,) if isinstance(delimiters, str) else DELIMITERS
    # Written, so that Spark knows how small the table is when it plans the joins.
    states = written(block_states(scan_blocks(spark, paths, candidates), delimiters))
    lines = _text(spark, paths).mapInArrow(_scanner(candidates, False), LINES)
    start = F.element_at("starts", F.col("choice") + 1)
    alone = (start == F.col("n")) & (_bit("opens", F.col("choice")) == 0)
    single = lines.join(states, ["path", "block"]).filter(alone)
    parts = lines.join(states.filter("several"), ["path", "block"]).filter(~alone)
    first = F.when(start >= 0, F.col("block") + start).otherwise(F.col("from_block") + F.col("from_line"))
    pieces = F.sort_array(F.collect_list(F.struct("block", "n", "value")))
    joined = (
        parts.groupBy("path", first.alias("row_idx"), "delimiter")
        .agg(pieces.alias("pieces"))
        .select("path", "row_idx", "delimiter", F.concat_ws("\n", "pieces.value").alias("record"))
    )
    return single.select("path", (F.col("block") + F.col("n")).alias("row_idx"), "delimiter", F.col("value").alias("record")).unionByName(joined)
