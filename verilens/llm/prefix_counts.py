"""Token counts at every prefix, by dynamic programming (operator 8).

Counts are a recurrence over prefixes, so no prefix is encoded from its start:

* between segments (a run of white space and the visible run behind it):
  count(prefix up to a segment's end) = count(up to its start) + tokens of the segment;
* inside a segment, over bytes: the last token of an encoded byte-pair string is
  unique, it is the one that may stand behind the last token of what is in front
  of it, so count(prefix) = count(prefix without its last token) + 1.

A document's table holds the first for every segment end, where the second ends for
that segment; the counts inside a segment are kept when a question falls into it.  Truncation ("longest
prefix of at most k tokens") and budget questions are answered from the table by
bisection; no text is encoded again.

Segments repeat, so their counts are kept in bounded caches of each worker, whose
size does not change results.  Work is one pass over the table, without a shuffle.

Cases: a null text counts as empty, an empty text has 0 tokens; a special string
inside a text is one token, as the tokenizer's default has it; ids, repeated rows
and extra columns pass through untouched; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SEGMENT, SPACE

LIMIT = 1024
CACHED_SEGMENTS = 50_000
CACHED_TOTALS = 1_500_000
CACHED_PAIRS = 300_000
SPECIAL = "<|endoftext|>"
PIECE = regex.compile(public_tokenizers.PATTERN)
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Token counts at every code point of text segments."""

    def __init__(self) -> None:
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.longest = max(map(len, self.ranks))
        self.tables: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.totals: dict[str, int] = {}
        self.single_piece = tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}
        )._encode_single_piece

    def stays_apart(self, left: bytes, right: bytes) -> bool:
        """Whether the bytes of both encode to just these two tokens (or to the right one alone)."""
        if len(self.fits) > CACHED_PAIRS:
            self.fits.clear()
        want = [self.ranks[t] for t in (left, right) if t]
        self.fits[left, right] = fits = self.single_piece(left + right) == want
        return fits

    def pieces(self, new: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Counts at every byte of pieces of the split pattern, from 0 bytes on.

        The pieces come in byte order, so a piece goes on from where it leaves the
        one before: prefixes that pieces share are counted once.
        """
        ranks, longest, fits, apart = self.ranks, self.longest, self.fits, self.stays_apart
        counts, last, before, out = [0], [b""], b"", {}
        for data in sorted(new):
            same = 0
            for x, y in zip(data, before, strict=False):
                if x != y:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(data) + 1):
                for start in range(max(0, end - longest), end):
                    token = data[start:end]
                    if token in ranks:
                        ok = fits.get((last[start], token))
                        if ok or ok is None and apart(last[start], token):
                            counts.append(counts[start] + 1)
                            last.append(token)
                            break
            out[data] = counts[:]
            before = data
        return out

    def ordinary(self, text: str) -> list[int]:
        """Counts at every code point of a segment without special strings.

        While only white space has been seen, all of it is one piece; before a
        visible character its last character goes with what follows.
        """
        blank = len(text) - len(text.lstrip(SPACE))
        out = [0]
        if blank > 1:
            head = self.at_characters(text[:blank], self.pieces([text[:blank].encode()]))
            out = head
            if blank == len(text):
                return out
            base, text = head[blank - 1], text[blank - 1 :]
            return out + [base + n for n in self.by_piece(text)[2:]]
        return self.by_piece(text)

    def at_characters(self, piece: str, known: dict[bytes, list[int]]) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        counts = known[data]
        if len(data) != len(piece):
            at, chosen = 0, [0]
            for c in piece:
                at += len(c.encode("utf-8", "surrogatepass"))
                chosen.append(counts[at])
            counts = chosen
        if piece in LONG_CONTRACTIONS:  # cut in two, the apostrophe stands alone
            counts = [0, 1, 2, counts[3]]
        return counts

    def by_piece(self, text: str, known: dict[bytes, list[int]] | None = None) -> list[int]:
        pieces = PIECE.findall(text)
        known = known or self.pieces({p.encode("utf-8", "surrogatepass") for p in pieces})
        out, done = [0], 0
        for piece in pieces:
            counts = self.at_characters(piece, known)
            out += [done + n for n in counts[1:]] if done else counts[1:]
            done += counts[-1]
        return out

    def total(self, text: str) -> int:
        """Tokens of a whole segment: where the recurrence over its prefixes ends."""
        if len(self.totals) > CACHED_TOTALS:
            self.totals.clear()
        self.totals[text] = n = self.counts(text)[-1]
        return n

    def segment(self, text: str) -> tuple[int, ...]:
        """Counts at every code point of a segment, from 0 to its end."""
        known = self.tables.get(text)
        if known is None:
            if len(self.tables) > CACHED_SEGMENTS:
                self.tables.clear()
            self.tables[text] = known = tuple(self.counts(text))
        return known

    def counts(self, text: str) -> list[int]:
        """The same, not kept."""
        out, base = [0], 0
        *before, rest = text.split(SPECIAL)
        for chunk in before:  # up to its last character, a special string is ordinary text
            counts = self.ordinary(chunk + SPECIAL[:-1])
            out += [base + n for n in counts[1:]]
            base += counts[len(chunk)] + 1
            out.append(base)
        return out + [base + n for n in self.ordinary(rest)[1:]]


class Prefixes:
    """The prefix table of one document."""

    def __init__(self, segments: list[str], counter: PrefixCounter):
        self.counter, self.segments = counter, segments
        known, total = counter.totals.get, counter.total
        last = [known(s) or total(s) for s in segments]
        self.totals = np.concatenate(([0], np.cumsum(np.array(last, np.int64))))
        self.starts = np.concatenate(([0], np.cumsum(np.array([len(s) for s in segments], np.int64))))

    @property
    def tokens(self) -> int:
        return int(self.totals[-1])

    def count(self, characters: int) -> int:
        """Tokens of the prefix of that many code points."""
        if characters >= self.starts[-1]:
            return self.tokens
        at = int(np.searchsorted(self.starts, characters, "right")) - 1
        return int(self.totals[at]) + self.counter.segment(self.segments[at])[characters - int(self.starts[at])]

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens.

        Totals rise from segment to segment, counts inside one need not; so the
        first segment that goes over the budget is looked through from its end.
        """
        if self.tokens <= budget:
            return int(self.starts[-1])
        at = int(np.searchsorted(self.totals, budget, "right")) - 1
        inside = self.counter.segment(self.segments[at])
        room = budget - int(self.totals[at])
        return int(self.starts[at]) + max(i for i, n in enumerate(inside) if n <= room)


@lru_cache(maxsize=1)
def counter() -> PrefixCounter:
    """One counter for each Python worker."""
    return PrefixCounter()


def prefix_counts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and the exact cut: the longest prefix within ``limit``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["text"]:
                table = Prefixes(SEGMENT.findall(text), counter())
                out.append((len(text.encode("utf-8", "surrogatepass")), table.tokens, table.longest(limit)))
            made = pd.DataFrame(out, columns=["n_bytes", "n_tokens", "limit_chars"], dtype="int64")
            made.insert(0, "doc_id", rows["doc_id"].array)
            made["over_limit"] = made["n_tokens"] > limit
            yield made

    # ids as text: pandas has no exact long column with nulls
    texts = docs.select(
        F.col("doc_id").cast("long").cast("string").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    counted = texts.mapInPandas(
        count, "doc_id string, n_bytes long, n_tokens long, limit_chars long, over_limit boolean"
    )
    return counted.withColumn("doc_id", F.col("doc_id").cast("long"))


def truncated(docs: DataFrame, budget: int) -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else t[: Prefixes(SEGMENT.findall(t), counter()).longest(budget)]
        )

    return docs.withColumn("text", cut(F.col("text").cast("string")))
