"""The streaming encoder and decoder against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verilens.llm import bpe_stream
from verilens.llm.queries import op11_bpe_round_trip

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = ["a", "e", "St", "ab", "ing", " the", "'", "'re", "'s", " ", "  ", "\n", "\t", "　", "\xa0", "\x1c"]
PARTS += ["1", "é", "日本", "\U0001f600", "<|endoftext|>", "<|end", "|>", "...", "\r\n"]


def wanted(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def streamed(text, block):
    return [i for ids in bpe_stream.id_blocks(text, block) for i in ids]


def random_text(rng):
    return "".join(rng.choice(PARTS) * rng.choice([1, 1, 1, 2, 90]) for _ in range(rng.choice([0, 1, 4, 40])))


@pytest.mark.parametrize("block", [5, 64, 1 << 16])
def test_ids_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(bpe_stream, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(400):
        text = random_text(rng)
        assert streamed(text, block) == wanted(text), text


def test_long_runs_keep_a_bounded_rest():
    rng = random.Random(3)
    letters = "".join(rng.choice("abSt") for _ in range(90_000))
    for text in (letters, "a" * 90_000, " " * 70_000 + "x", "日本語" * 25_000, "!" * 70_000 + "'re"):
        machine = bpe_stream.Transducer(bpe_stream.worker_encoder())
        out, held = b"", 0
        for start in range(0, len(text), 10_000):
            out += machine.feed(text[start : start + 10_000])
            held = max(held, len(machine.rest) + len(machine.run.window if machine.run else b""))
        out += machine.finish()
        assert list(memoryview(out).cast("I")) == wanted(text)
        assert held <= bpe_stream.BLOCK + 10_000


def test_lookahead_is_sufficient():
    """Ids that end more than the lookahead before a cut are those of the whole string."""
    merges = bpe_stream.Merges()
    assert merges.lookahead == 123
    tokens = [t for t in merges.bytes_of.values() if t.isalpha()]
    rng = random.Random(11)
    for _ in range(300):
        data = b"".join(rng.choice(tokens) for _ in range(60))
        cut = rng.randrange(len(data))
        ends = [set(), set()]
        for side, part in enumerate((data, data[:cut])):
            end = 0
            for i in merges.encode(part):
                end += len(merges.bytes_of[i])
                ends[side].add(end)
        sure = range(cut - merges.lookahead)
        assert {e for e in ends[0] if e in sure} == {e for e in ends[1] if e in sure}


def test_small_merge_lists():
    """Reach by hand: a rule alone reaches one byte less than its right part; a chain adds up."""
    assert bpe_stream.sufficient_lookahead([]) == 0
    assert bpe_stream.sufficient_lookahead([(b"a", b"b")]) == 0
    assert bpe_stream.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 1
    assert bpe_stream.sufficient_lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 2


def test_decoding_any_ids():
    rng = random.Random(7)
    merges = bpe_stream.worker_encoder().merges
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(9))]
        at = rng.randrange(len(ids) + 1)
        machine = bpe_stream.Decoder(merges)
        got = machine.feed(ids[:at]) + machine.feed(ids[at:], final=True)
        assert got == LIBRARY.decode(ids, skip_special_tokens=False)


def test_tables_and_digests(spark, monkeypatch):
    texts = [None, "", "Hello  world\n", "x<|endoftext|>y", "日" * 300, "same text", "same text"]
    rows = [(i if i != 3 else None, t, "own", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, row int")
    got = {r.ids_sha256: r for r in bpe_stream.round_trip(docs).collect()}
    assert bpe_stream.round_trip(docs).count() == len(texts)
    for text in texts:
        ids = wanted(text or "")
        row = got[hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    blocks = bpe_stream.encode(docs)
    by_row = {}
    for r in bpe_stream.decode(blocks).orderBy("row", "block").collect():
        by_row[r.row] = by_row.get(r.row, "") + r.text
    assert sorted(by_row.values()) == sorted(t or "" for t in texts)
    assert bpe_stream.round_trip(docs.limit(0)).count() == 0
    assert bpe_stream.decode(bpe_stream.encode(docs.limit(0))).count() == 0


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op11_bpe_round_trip(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = wanted(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
