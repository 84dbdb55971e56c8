"""Byte-pair encoding and decoding as streaming transducers of constant memory (operator 11).

Encoding.  A text is read in blocks.  Three machines hand on what can't change
any more and keep a bounded rest:

* special strings: at most their length less one is held back;
* the split pattern: no match reaches from a visible character into the white
  space behind it, so all before the last such place is settled; without one, a
  match is settled when something stands behind it that ended it;
* the merges: a piece longer than a window is encoded window by window.  Tokens of
  a window are those of the whole piece once they end more than the *sufficient
  lookahead* before the window's end (``sufficient_lookahead``).  A settled token
  end splits the encoding: no merge crosses it, so the window restarts there.

Sufficient lookahead.  Compare the merges of a piece with those of its first n
bytes.  Let reach(r) bound n - b over all merges by rule r = (u, v) at a place b
(between u and v) that only one of both makes.  Such a merge crosses n, so that
n - b < len(v); or, at an earlier rule, the other side merged something across the
end of v (its left part is v) or across the start of u (its right part is u); or a
merge inside u or v was already one of these.  In rule order this is one pass over
the merge list; its maximum is the lookahead: 123 bytes for the 50,000 merges of
``byte_bpe_50k.json``.

Decoding.  Tokens give bytes; a byte-to-text machine holds back at most three bytes
of an unfinished character and turns what can't be UTF-8 into U+FFFD.

Repeated segments (white space and the visible run behind it) are looked up in
caches of each worker, bounded in entries and in the length of an entry; their size
does not change results.

Cases: a null text counts as empty; an empty text has no ids and decodes to an empty
text; a special string inside a text is one id, the library's default; texts of any
length take blocks of ``BLOCK`` characters; null or repeated ``doc_id`` stay rows of
their own; other columns, whatever their names, are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SEGMENT, SPACE

VOCABULARY = "byte_bpe_50k.json"
BLOCK = 1 << 16
WINDOW = 512
CACHED = 500_000
CACHED_LENGTH = 64
PIECE = regex.compile(public_tokenizers.PATTERN)
#: A run that one match of the split pattern may take whole, by its first character.
RUNS = tuple(regex.compile(p) for p in (r"\s+", r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+"))
#: No contraction of the pattern is longer.
CONTRACTION = 3


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token end after which no later byte can move it; ``merges`` in rule order."""
    as_left: dict[bytes, int] = {}  # largest reach of an earlier rule with this left part
    as_right: dict[bytes, int] = {}
    inside: dict[bytes, int] = {}  # largest reach + offset of its place, over the merges inside a token
    most = 0
    for u, v in merges:
        reach = max(
            len(v) - 1,
            as_left[v] + len(v) if v in as_left else 0,
            as_right.get(u, 0) - len(u),
            inside.get(v, 0),
            inside.get(u, 0) - len(u),
        )
        as_left[u] = max(as_left.get(u, 0), reach)
        as_right[v] = max(as_right.get(v, 0), reach)
        inside[u + v] = max(inside.get(u + v, 0), inside.get(u, 0), reach + len(u), inside.get(v, 0) + len(u))
        most = max(most, reach)
    return most


class Merges:
    """The merge rules of a vocabulary file and exact encodings of short byte strings."""

    def __init__(self, name: str = VOCABULARY):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            made = json.load(file)
        stand_in = byte_characters()
        vocabulary = {bytes(map(stand_in.__getitem__, t)): i for t, i in made["model"]["vocab"].items()}
        pairs = [tuple(bytes(map(stand_in.__getitem__, part)) for part in pair) for pair in made["model"]["merges"]]
        self.lookahead = sufficient_lookahead(pairs)
        self.byte_ids = [vocabulary[bytes([b])] for b in range(256)]
        #: (left id, right id) in one number -> rank of the rule; rank -> id of the merged token.
        self.rank = {vocabulary[u] << 32 | vocabulary[v]: r for r, (u, v) in enumerate(pairs)}
        self.merged = [vocabulary[u + v] for u, v in pairs]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.bytes_of = {i: t for t, i in vocabulary.items()} | {i: s.encode() for s, i in self.special.items()}

    def encode(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equal ones, until none is left."""
        ids = [self.byte_ids[b] for b in data]
        rank, never = self.rank.get, len(self.merged)
        ranks = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            ids[at : at + 2] = [new] = [self.merged[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | new, never)
            if at < len(ranks):
                ranks[at] = rank(new << 32 | ids[at + 1], never)
        return ids


class LongPiece:
    """One piece of the split pattern, fed in parts; emits ids as soon as they are stable."""

    def __init__(self, merges: Merges):
        self.merges, self.window = merges, b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = WINDOW + self.merges.lookahead
        for start in range(0, len(data), step):
            self.window += data[start : start + step]
            if len(self.window) >= step:
                stable = len(self.window) - self.merges.lookahead - 1
                end = 0
                for i in self.merges.encode(self.window):
                    longer = end + len(self.merges.bytes_of[i])
                    if longer > stable:
                        break
                    out.append(i)
                    end = longer
                self.window = self.window[end:]
        return out

    def finish(self) -> list[int]:
        rest, self.window = self.window, b""
        return self.merges.encode(rest)


class Irregular(Exception):
    """A part between two blanks that is empty or has white space at an end."""


class Cache(dict):
    """Ids, as little-endian 32-bit bytes, of short strings; filled on first use, emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        code = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[key] = code
        return code


class Encoder:
    """Ids of settled texts; shared by all transducers of a worker."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pieces = Cache(lambda piece: array("I", merges.encode(piece.encode())).tobytes())
        self.after_blank = Cache(self._after_blank)

    def by_piece(self, text: str) -> bytes:
        return b"".join([self.pieces[p] for p in PIECE.findall(text)])

    def _after_blank(self, part: str) -> bytes:
        if not part or part[0] in SPACE or part[-1] in SPACE:
            raise Irregular
        return self.by_piece(" " + part)

    def settled(self, text: str) -> bytes:
        """Ids of a text that ends where a match of the split pattern must end."""
        first, *rest = text.split(" ")
        known = self.after_blank
        try:
            if rest and (not first or first[-1] in SPACE):
                raise Irregular
            return self.by_piece(first) + b"".join([known[p] for p in rest])
        except Irregular:
            out = []
            for segment in SEGMENT.findall(text):
                plain = segment[0] == " " and len(segment) > 1 and segment[1] not in SPACE
                out.append(known[segment[1:]] if plain else self.by_piece(segment))
            return b"".join(out)


class Transducer:
    """Text blocks in, ids out (as little-endian 32-bit bytes); holds a bounded rest."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.merges = encoder, encoder.merges
        self.rest = ""
        self.run: LongPiece | None = None
        self.kind: regex.Pattern | None = None

    def feed(self, text: str) -> bytes:
        self.rest += text
        out = []
        for special, number in self.merges.special.items():
            *before, self.rest = self.rest.split(special)
            for part in before:
                out += [self._ordinary(part, True), array("I", [number]).tobytes()]
            held = max((k for k in range(1, len(special)) if self.rest.endswith(special[:k])), default=0)
            part, self.rest = self.rest[: len(self.rest) - held], self.rest[len(self.rest) - held :]
            out.append(self._ordinary(part, False, self.rest))
        return b"".join(out)

    def finish(self) -> bytes:
        rest, self.rest = self.rest, ""
        return self._ordinary(rest, True)

    def _ordinary(self, text: str, ends: bool, held: str = "") -> bytes:
        """Ids of text without special strings; what is not settled goes back to ``rest``."""
        out = []
        if self.run is not None:
            going = self.kind.match(text)
            stop = going.end() if going else 0
            if stop == len(text) and not ends:
                keep = stop - 1 if self.kind is RUNS[0] and stop else stop  # the last blank may go with what follows
                self.rest = text[keep:] + held
                return array("I", self.run.feed(text[:keep].encode())).tobytes()
            if self.kind is RUNS[0] and stop < len(text):
                stop = max(stop - 1, 0)
            ids = self.run.feed(text[:stop].encode()) + self.run.finish()
            out.append(array("I", ids).tobytes())
            self.run, text = None, text[stop:]
        if ends:
            out.append(self._closed(text))
            return b"".join(out)
        cut = self._last_settled(text)
        out.append(self.encoder.settled(text[:cut]))
        text = text[cut:]
        if len(text) >= BLOCK:
            code, text = self._within_run(text)
            out.append(code)
        self.rest = text + held
        return b"".join(out)

    def _closed(self, text: str) -> bytes:
        """Ids of a text with nothing behind it, long pieces window by window."""
        if len(text) < BLOCK:
            return self.encoder.settled(text)
        out = []
        for match in PIECE.finditer(text):
            out.append(self._piece(match[0]))
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        if len(piece) <= CACHED_LENGTH:
            return self.encoder.pieces[piece]
        long = LongPiece(self.merges)
        return array("I", long.feed(piece.encode()) + long.finish()).tobytes()

    @staticmethod
    def _last_settled(text: str) -> int:
        """The last place between a visible character and white space; 0 without one."""
        end = len(text)
        while end and text[end - 1] not in SPACE:
            end -= 1
        while end and text[end - 1] in SPACE:
            end -= 1
        return end

    def _within_run(self, text: str) -> tuple[bytes, str]:
        """Settle whole matches; a match as long as a block becomes a ``LongPiece``."""
        out, done = [], 0
        for match in PIECE.finditer(text):
            if match.end() < len(text) and match.start() + CONTRACTION <= len(text):
                out.append(self._piece(match[0]))
                done = match.end()
                continue
            break
        text = text[done:]
        if len(text) > 2 * CACHED_LENGTH:
            self.kind = next(k for k in RUNS if k.match(text[-1]))
            self.run = LongPiece(self.merges)
            keep = len(text) - 1 if self.kind is RUNS[0] else len(text)
            out.append(array("I", self.run.feed(text[:keep].encode())).tobytes())
            text = text[keep:]
        return b"".join(out), text


class Decoder:
    """Ids in, text out; an unfinished character stays inside until its bytes are there."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        """The text that is certain after ``ids``; numbers outside the vocabulary give nothing."""
        known = self.bytes_of
        try:
            data = b"".join([known[i] for i in ids])
        except KeyError:
            data = b"".join([known.get(i, b"") for i in ids])
        return self.machine.decode(data, final)


@lru_cache(maxsize=1)
def worker_encoder() -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(Merges())


def id_blocks(text: str, block: int = BLOCK) -> Iterator[array]:
    """The ids of a text, block by block."""
    machine = Transducer(worker_encoder())
    for start in range(0, len(text), block):
        yield array("I", machine.feed(text[start : start + block]))
    yield array("I", machine.finish())


def encode(docs: DataFrame) -> DataFrame:
    """row, doc_id, block, ids: the ids of each document in bounded rows, in order of ``block``.

    ``row`` tells rows of equal or missing ``doc_id`` apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, text in enumerate(rows.column("text").to_pylist()):
                one = rows.slice(i, 1)
                for number, ids in enumerate(id_blocks(text)):
                    yield pa.RecordBatch.from_arrays(
                        [one.column("row"), one.column("doc_id"), pa.array([number]), pa.array([list(ids)], pa.list_(pa.int32()))],
                        ["row", "doc_id", "block", "ids"],
                    )

    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return texts.mapInArrow(run, "row long, doc_id long, block long, ids array<int>")


def decode(blocks: DataFrame) -> DataFrame:
    """row, block, text: the texts of ids that ``encode`` wrote, in bounded rows.

    The decoder runs through the blocks of a document in order, so a character cut
    between two blocks is whole in the later one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one block is looked ahead, to know the last one of a document
        machine, ahead = None, None
        merges = worker_encoder().merges

        def out(row, block, ids, final):
            return pa.RecordBatch.from_arrays(
                [pa.array([row], pa.int64()), pa.array([block], pa.int64()), pa.array([machine.feed(ids, final)])],
                ["row", "block", "text"],
            )

        for rows in batches:
            for row, block, ids in zip(*(rows.column(c).to_pylist() for c in ("row", "block", "ids")), strict=True):
                if ahead is not None:
                    yield out(*ahead, final=ahead[0] != row)
                if ahead is None or ahead[0] != row:
                    machine = Decoder(merges)
                ahead = (row, block, ids)
        if ahead is not None:
            yield out(*ahead, final=True)

    ordered = blocks.select("row", "block", "ids").repartition("row").sortWithinPartitions("row", "block")
    return ordered.mapInArrow(run, "row long, block long, text string")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both machines in one pass, digests in place of ids and text."""

    def digests(text: str) -> tuple[int, str, str]:
        decoder = Decoder(worker_encoder().merges)
        ids_sum, text_sum, count = hashlib.sha256(), hashlib.sha256(), 0
        for ids in id_blocks(text):
            if ids:
                numbers = ids.tolist()
                ids_sum.update(("," if count else "").encode() + ",".join(map(str, numbers)).encode())
                text_sum.update(decoder.feed(numbers).encode())
                count += len(numbers)
        text_sum.update(decoder.feed((), final=True).encode())
        return count, ids_sum.hexdigest(), text_sum.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [digests(text) for text in rows.column("text").to_pylist()]
            columns = zip(*found, strict=True) if found else ((), (), ())
            counts, ids_sums, text_sums = map(list, columns)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(text_sums, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
