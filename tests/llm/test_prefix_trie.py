"""The prefix trie against a brute force over all prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest

from verilens.llm import prefix_trie
from verilens.llm.queries import SQL, op13_prefix_trie

TURNS = [("user", "a"), ("user", "bb"), ("assistant", "ccc"), ("assistant", ""), ("", "ééé"), ("user", "a b")]


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node."""
    members, nodes = {}, set()
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    nodes = set(members)
    kids = {p: [x for x in nodes if x and x[:-1] == p] for p in nodes}

    def inside(p):
        return [p] + [y for k in kids[p] for y in inside(k)]

    rows = []
    for p in nodes:
        subtree = inside(p)
        ended = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        rows.append((
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]),
            sum(not kids[x] for x in subtree),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in subtree if x),
            hashlib.sha256(ended.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def rows_of(spark, convs):
    rows = [(c, t, *turn, "clash") for c, turns in convs.items() for t, turn in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, keys string")


def found(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def random_conversations(rng, n):
    shared = [[rng.choice(TURNS) for _ in range(6)] for _ in range(3)]
    out = {}
    for _ in range(n):
        head = rng.choice(shared)[: rng.randrange(7)]
        out[rng.choice([-250, 0, 100, 300]) + rng.randrange(70)] = head + [rng.choice(TURNS) for _ in range(rng.randrange(4))]
    return {c: t for c, t in out.items() if t}


@pytest.mark.parametrize(("seed", "items"), [(1, 3), (2, 9), (3, 1000)])
def test_against_brute_force(spark, seed, items):
    """Partitions of few items: most nodes go on across boundaries."""
    convs = random_conversations(random.Random(seed), 60)
    rows = rows_of(spark, convs)
    plain = prefix_trie.sequences(rows)
    assert found(prefix_trie.trie(plain, items)) == brute(convs)
    assert found(prefix_trie.trie(prefix_trie.grafted(plain), items)) == brute(rebuilt(convs))


def test_long_common_prefix_over_partitions(spark):
    line = [("user", str(i % 7)) for i in range(120)]
    convs = {c: line[: 20 + c] + [("assistant", str(c))] * (c % 3) for c in range(60)} | {99: line[:100], 98: line[:100]}
    assert found(prefix_trie.trie(prefix_trie.sequences(rows_of(spark, convs)), 7)) == brute(convs)


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 5)
    convs = {c: TURNS[:2] for c in range(40)} | {50: TURNS[:1], 51: TURNS[2:4]}
    assert found(prefix_trie.trie(prefix_trie.sequences(rows_of(spark, convs)), 2)) == brute(convs)


def test_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(7, None, "user", "first"), (7, 0, None, None), (7, 1, "user", "x"), (7, 1, "user", "x"), (None, 0, "user", "y")]
    got = found(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(rows, schema))))
    assert got == brute({7: [("user", "first"), ("", ""), ("user", "x"), ("user", "x")]})
    assert found(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame([], schema)))) == []
    # no own turn is left and there is no base: only the root
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    one = spark.createDataFrame([(alone, 0, "user", "x")], schema)
    assert found(prefix_trie.trie(prefix_trie.grafted(prefix_trie.sequences(one)))) == brute({alone: []})


def test_common_turns():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice(b"ab") for _ in range(rng.randrange(30))]
        b = a[: rng.randrange(31)] + [rng.choice(b"ab") for _ in range(rng.randrange(4))]
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        a, b = (b"".join(bytes([x]) * prefix_trie.WIDTH for x in s) for s in (a, b))
        assert prefix_trie.common_turns(a, b) == want


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
        wanted = db.execute(SQL["op13_prefix_trie"]).fetchall()
    assert found(op13_prefix_trie(spark, sf)) == sorted(wanted, key=str)
