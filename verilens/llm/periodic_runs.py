"""Periodic runs of words by scale-tiled distribution (operator 12).

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` words
long, that no neighbouring word extends with that period.  Word i *agrees* at q
when it equals word i + q; a run is a maximal stretch of agreeing positions of at
least 3 q (5 for q = 1) positions whose block of q words is no power of a shorter one.

1. Octaves and tiles.  Periods 2^k to 2^(k+1) - 1 form octave k.  A text is cut into
   tiles of ``CORE`` 2^k positions, each seen with ``OVERLAP`` 2^k more behind it, so
   a stretch that is long enough is long enough within some tile, and the parts that
   two tiles see of a longer one overlap.
2. Boundaries.  Inside a tile a boundary stands at every 2^k-th position, so each part
   that counts holds three.  Sampled positions behind a boundary are compared for all
   periods of the octave at once; only boundaries where one agrees are solved.
3. Z-functions.  Forward and backward Z-functions at a boundary give, for every period
   at once, how far agreement reaches to both sides within the tile, and whether the
   block at the boundary is a power.  A tile is solved from its own words alone.
4. Fragments (document, period, start, end) are shuffled by document and period and
   overlapping ones are stitched to whole stretches.

Texts with no fragment are digested where they are read; only texts with one are
written beside the fragments and joined with their runs.  A task holds a batch of
texts and one tile's Z-functions at a time; the work of a tile grows with its length.

Cases: a null or blank text has no words, no run and the digest of an empty text; a
null ``doc_id`` or a repeated one stays a row of its own; texts of any length have more
tiles; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import write_table

CORE = 64
OVERLAP = 6
SAMPLES = 8
SHORTEST = 6
EXPONENT = 4
#: Words of one batch of texts whose positions are compared together.
GROUP = 1 << 18

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than the six ASCII white spaces, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def shortest_stretch(q: int) -> int:
    """Agreeing positions of the shortest run with period q."""
    return max(SHORTEST, EXPONENT * q) - q


def is_power(forward: list[int], q: int) -> bool:
    """Whether the block of q words where ``forward`` starts is a power of a shorter block."""
    rest, p = q, 2
    while p * p <= rest:
        if rest % p == 0:
            if forward[q // p] >= q - q // p:
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return rest > 1 and forward[q // rest] >= q - q // rest


def z_function(s: list[int], stop: int | None = None) -> list[int]:
    """For each i before ``stop``, the length of the longest common prefix of s and s[i:]."""
    n = len(s)
    stop = n if stop is None else min(stop, n)
    z = [n] + [0] * max(stop - 1, 0)
    left = right = 0
    for i in range(1, stop):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def solve_tile(words: list[int], candidates: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the long stretches of octave k through one of the boundaries of a tile.

    ``candidates`` are boundaries, rising, with the periods that may agree there;
    positions count from the tile's first word.
    """
    low, high = 1 << k, 2 << k
    n = len(words)
    seen = np.full(low, -1, np.int64)  # up to which position a period's stretch is known
    found = []
    for c, periods in candidates:
        unseen = periods[seen[periods - low] < c].tolist()
        if not unseen:
            continue
        forward = z_function(words[c:], high)
        # common suffixes of words[:c] and words[:c + q], as prefixes of the reversed words
        width = min(c + high, n)
        backward = z_function([*words[:c][::-1], -1, *words[:width][::-1]], width + 2 - low)
        for q in unseen:
            end = c + forward[q]
            start = c - backward[1 + width - q] if c else 0
            seen[q - low] = end
            if end - start >= shortest_stretch(q) and not is_power(forward, q):
                found.append((q, start, end))
    return found


def candidates_of(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, boundary, period) where sampled positions behind a boundary agree, for octave k.

    A part of a stretch that counts has a boundary with 2 * 2^k agreeing positions
    from there on, so samples of these lose none.
    """
    low = 1 << k
    offsets = np.arange(2 * low) if 2 * low <= SAMPLES else np.arange(SAMPLES) * (2 * low // SAMPLES)
    texts = np.flatnonzero(lengths >= max(SHORTEST, EXPONENT * low))
    counts = lengths[texts] // low - 1
    owner = np.repeat(texts, counts)
    local = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * low
    periods = low + np.arange(low)
    last = len(ids) - 1
    step = max(1, GROUP // low)
    for at in range(0, len(owner), step):
        text, c = owner[at : at + step], local[at : at + step]
        base = starts[text] + c
        ends = starts[text] + lengths[text]
        far = base[:, None] + periods[None, :]
        agree = (ids[np.minimum(far, last)] == ids[base][:, None]) & (far + offsets[-1] < ends[:, None])
        i, j = np.nonzero(agree)
        for offset in offsets[1:]:
            same = ids[base[i] + offset] == ids[base[i] + periods[j] + offset]
            i, j = i[same], j[same]
        yield text[i], c[i], periods[j]


def fragments(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, period, start, end) of what each tile of each octave sees of long stretches."""
    starts = np.cumsum(lengths) - lengths
    for k in range(int(lengths.max(initial=0)).bit_length()):
        core, overlap = CORE << k, OVERLAP << k
        parts = list(candidates_of(ids, starts, lengths, k))
        text, c, q = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
        tile = c // core
        again = (tile > 0) & (c % core < overlap)  # the overlap of the tile before
        text, c, q = (np.concatenate((a, a[again])) for a in (text, c, q))
        tile = np.concatenate((tile, tile[again] - 1))
        order = np.lexsort((q, c, tile, text))
        text, c, q, tile = text[order], c[order], q[order], tile[order]
        new_tile = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(tile) != 0)][: len(text)])
        for a, b in zip(new_tile, np.r_[new_tile, len(text)][1:], strict=True):
            first = int(tile[a]) * core
            begin = int(starts[text[a]]) + first
            stop = min(begin + core + overlap + (2 << k), int(starts[text[a]] + lengths[text[a]]))
            cuts = np.flatnonzero(np.diff(c[a:b])) + 1
            places = np.split(q[a:b], cuts)
            boundaries = c[a:b][np.r_[0, cuts]] - first
            for period, s, e in solve_tile(ids[begin:stop].tolist(), list(zip(boundaries.tolist(), places, strict=True)), k):
                yield int(text[a]), period, first + s, first + e


class Numbers(dict):
    """Words to numbers, the next one for a new word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


SCANNED = "row long, doc_id long, n_words long, plain_sha256 string, words string, period long, start long, stop long"


def scan(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """A written table: one row per document (``period`` null) and one per fragment.

    Documents without fragment carry the digest of their words, the others the words,
    joined by one space.  ``rewrite(doc_id, words)`` may change the words first.
    """

    def group(rows: list[tuple[int, int | None, list[bytes]]]) -> Iterator[tuple]:
        numbers = Numbers()
        lengths = np.array([len(w) for _, _, w in rows], np.int64)
        ids = np.fromiter((numbers[w] for _, _, words in rows for w in words), np.int64, int(lengths.sum()))
        touched = set()
        for text, period, start, stop in fragments(ids, lengths):
            touched.add(text)
            yield rows[text][0], None, None, None, None, period, start, stop
        for text, (row, doc_id, words) in enumerate(rows):
            plain, joined = (None, b" ".join(words).decode()) if text in touched else (digest(words), None)
            yield row, doc_id, len(words), plain, joined, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCANNED.split(", ")]
        schema = pa.schema([(c, pa.string() if c in ("plain_sha256", "words") else pa.int64()) for c in names])

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*group(rows), strict=True), schema.types, strict=True)], schema=schema
            )

        held, size = [], 0
        for rows in batches:
            for row, doc_id, text in zip(*(rows.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                words = words_of(text)
                held.append((row, doc_id, rewrite(doc_id, words) if rewrite else words))
                size += len(words)
                if size >= GROUP:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return write_table(texts.mapInArrow(run, SCANNED), "periodic")


def stitched(scanned: DataFrame) -> DataFrame:
    """row, start, length, period of each run: overlapping fragments of a document and period are one."""
    by_period = W.partitionBy("row", "period").orderBy("start", "stop")
    before = by_period.rowsBetween(W.unboundedPreceding, -1)
    opened = (
        scanned.filter(F.col("period").isNotNull())
        .select("row", "period", "start", "stop")
        .withColumn("_new", (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int"))
        .withColumn("_run", F.sum("_new").over(by_period.rowsBetween(W.unboundedPreceding, W.currentRow)))
    )
    whole = opened.groupBy("row", "period", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return whole.select("row", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")


def kept_words(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """Words outside all runs or among the first period of each run that holds them."""
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.array([r["start"] + r["period"] for r in runs], np.int64)
    ends = np.array([r["start"] + r["length"] for r in runs], np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def collapsed(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """row, doc_id, runs (start, length, period, in this order), text: repeats of each run taken out.

    ``text`` is null where nothing is, with its digest in ``collapsed_sha256`` either way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, sums = [], []
            for words, runs in zip(rows.column("words").to_pylist(), rows.column("runs").to_pylist(), strict=True):
                kept = kept_words(words_of(words), runs)
                texts.append(b" ".join(kept).decode())
                sums.append(digest(kept))
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("doc_id"), rows.column("runs"), pa.array(texts, pa.string()), pa.array(sums, pa.string())],
                ["row", "doc_id", "runs", "text", "collapsed_sha256"],
            )

    scanned = scan(docs, rewrite)
    runs = stitched(scanned).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    documents = scanned.filter(F.col("period").isNull())
    kind = "array<struct<start:long,length:long,period:long>>"
    changed = (
        documents.filter(F.col("words").isNotNull())
        .select("row", "doc_id", "words")
        .join(runs, "row")
        .mapInArrow(run, f"row long, doc_id long, runs {kind}, text string, collapsed_sha256 string")
    )
    same = documents.filter(F.col("words").isNull()).select(
        "row", "doc_id", F.array().cast(kind).alias("runs"), F.lit(None).cast("string").alias("text"), F.col("plain_sha256").alias("collapsed_sha256")
    )
    return same.unionByName(changed)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and the digests of all runs and of the collapsed text."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("a"), (-r["period"]).alias("b")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed_sha256", longest.alias("_longest"), lines.alias("_lines")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.a")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.b")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.b").alias("exponent_milli"),
        F.sha2(F.array_join("_lines", ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail where the checksum of the id asks for one (never without an id)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
