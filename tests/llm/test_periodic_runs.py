"""Runs of words by tiles against a brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from verilens.llm import periodic_runs
from verilens.llm.queries import op12_periodic_runs


def brute_runs(words):
    """(start, length, period): each maximal stretch per period whose words have no smaller period."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(all(part[x] == part[x + d] for x in range(length - d)) for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(words):
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        len(runs),
        *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


def planted(doc_id, text):
    words = text.encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def random_words(rng):
    out = []
    for _ in range(rng.randrange(6)):
        block = [rng.choice(["a", "b", "c"]) for _ in range(rng.choice([1, 2, 3, 5, 9, 20]))]
        out += block * rng.choice([1, 2, 4, 5, 17]) + block[: rng.randrange(len(block))]
    return out


@pytest.mark.parametrize("core", [4, 64])
def test_tiles_against_brute_force(monkeypatch, core):
    """Small cores make every long run cross tiles; stitched fragments are the runs."""
    monkeypatch.setattr(periodic_runs, "CORE", core)
    rng = random.Random(core)
    for _ in range(250):
        texts = [random_words(rng) for _ in range(3)] + [["x"] * rng.randrange(400)]
        numbers = periodic_runs.Numbers()
        ids = np.array([numbers[w] for t in texts for w in t], np.int64)
        got = {}
        for text, q, start, stop in periodic_runs.fragments(ids, np.array([len(t) for t in texts], np.int64)):
            got.setdefault((text, q), []).append((start, stop))
        runs = [[] for _ in texts]
        for (text, q), parts in got.items():
            at = None
            for start, stop in sorted(parts):
                if at and start <= at[1]:
                    at[1] = max(at[1], stop)
                else:
                    at = [start, stop]
                    runs[text].append((at, q))
        for text, found in zip(texts, runs, strict=True):
            assert sorted((a, b - a + q, q) for (a, b), q in found) == sorted(brute_runs(text))


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic_runs.z_function(s)[: len(s)] == want


def test_long_text_is_linear():
    """A text of one word or one long period is solved once per tile."""
    for words in (["x"] * 200_000, [str(i % 30_000) for i in range(200_000)]):
        numbers = periodic_runs.Numbers()
        ids = np.array([numbers[w] for w in words], np.int64)
        found = list(periodic_runs.fragments(ids, np.array([len(ids)])))
        assert min(s for _, _, s, _ in found) == 0
        assert {q for _, q, _, _ in found} == {len(numbers)}
        assert max(e + q for _, q, _, e in found) == len(ids)


def test_cases(spark):
    texts = {
        1: None,
        2: "",
        3: " \t\n",
        4: "a b a b a b a b",
        5: "x x x x x",
        6: "x x x x x x",
        7: "  " * 6,
        8: "one two three",
        9: "a\x1cb " * 7,
        None: "ho " * 9,
    }
    rows = [(i, t, "clash", 3) for i, t in texts.items()] + [(4, texts[4], "again", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, row int")
    got = periodic_runs.run_digests(periodic_runs.collapsed(docs)).collect()
    assert len(got) == len(rows)
    for row in got:
        assert tuple(row)[1:] == brute_row((texts[row.doc_id] or "").encode().split())
    assert periodic_runs.run_digests(periodic_runs.collapsed(docs.limit(0))).count() == 0


def test_fragments_are_stitched_across_tiles(spark, monkeypatch):
    text = "start " + "one two three " * 700 + "end " + "x " * 900
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    scanned = periodic_runs.scan(docs)
    assert scanned.filter("period is not null").count() > 10
    runs = sorted(tuple(r)[1:] for r in periodic_runs.stitched(scanned).collect())
    assert runs == [(1, 2100, 3), (2102, 900, 1)]


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows)
    checked = 0
    for r in rows:
        words = planted(r.doc_id, r.text or "")
        if len(words) < 1500:
            assert got[r.doc_id] == brute_row(words), r.doc_id
            checked += 1
    assert checked > 150
