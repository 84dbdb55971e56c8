"""Exact byte-level BPE ids of whole texts, with a bounded cache of text segments.

No match of the tokenizer's split pattern reaches from a visible character into
the white space behind it, so a text may be encoded segment by segment, a
segment being a run of white space and the visible run after it.  Segments
repeat a lot; their ids are kept as little-endian 32-bit bytes, and a text's ids
are the bytes of its segments put together.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken

#: The tokenizer's white space (Unicode White_Space).
SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
CACHED_SEGMENTS = 300_000


class Irregular(Exception):
    """A part between two blanks that is empty or has white space at an end."""


class Parts(dict):
    """Ids of a blank and a part behind it, learnt when first asked for."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, part: str) -> bytes:
        if not part or part[0] in SPACE or part[-1] in SPACE:
            raise Irregular
        self[part] = code = array("I", self.ids(" " + part)).tobytes()
        return code


class SegmentEncoder:
    """Ids as the ``tokenizers`` library gives them for this vocabulary, without added special tokens.

    New segments go through the same vocabulary in rank form (``tiktoken``), which
    is several times faster on short strings; the special string is recognised
    inside texts, the library's default.
    """

    def __init__(self, limit: int = CACHED_SEGMENTS):
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding(
            "segments",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=self.ranks,
            special_tokens={"<|endoftext|>": 50256},
        )
        self.limit = limit
        self.known = Parts(self.ids)

    def ids(self, text: str) -> list[int]:
        if "<|endoftext|>" in text:
            return self.bpe.encode(text, allowed_special="all", disallowed_special=())
        return self.bpe.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.limit:
            self.known.clear()
        first, *rest = text.split(" ")
        if rest and (not first or first[-1] in SPACE):
            return self.by_segment(text)
        known = self.known
        try:
            return array("I", self.ids(first)).tobytes() + b"".join([known[p] for p in rest])
        except Irregular:
            return self.by_segment(text)

    def by_segment(self, text: str) -> bytes:
        """The same for any white space."""
        known = self.known
        out = []
        for segment in SEGMENT.findall(text):
            if segment[0] == " " and len(segment) > 1 and segment[1] not in SPACE:
                out.append(known[segment[1:]])
            else:
                out.append(array("I", self.ids(segment)).tobytes())
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder() -> SegmentEncoder:
    """One encoder for each Python worker."""
    return SegmentEncoder()
