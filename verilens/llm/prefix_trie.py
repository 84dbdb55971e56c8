"""The prefix trie of conversations by union-find over sorted-neighbour edges (operator 13).

A node of depth d is a distinct sequence of first d turns; its members are the
conversations that start with it.

1. Turns become 128-bit digests of role and text, a conversation the string of its
   digests; equal conversations are one item with a count and the smallest id.
2. Items are range-partitioned by that string, so a subtree is a stretch of
   neighbours.  The longest common prefix (LCP) of two neighbours is an edge.
3. Inside a partition, union-find takes the edges by descending LCP: joining two
   components at depth d makes a branching node (or adds a child to the one that the
   left component has at d).  The forest's unary nodes lie between the depths of a
   component and of its parent.
4. Partitions are joined without moving items: the LCP over each boundary says which
   nodes of a partition's outer spines go on in the next one.  These open nodes are
   contracted to (depth, digest) and partial sums, which are merged by key; all sums
   are additive, as each partition counts a node, a child or a leaf only where it
   starts.  A boundary has no more open nodes than its LCP, so the root and other
   hot nodes are one partial row per partition, never all their members.
5. Ids of the members that end at a node are joined to texts in range partitions
   and hashed in order from these chunks, one stream per node.

Texts are read once and never shuffled.  A conversation's turns travel as 20 bytes
each in one row; a task holds one partition of items (``ITEMS`` distinct ones).

Cases: null roles and texts count as empty; rows of one turn number are ordered by
role, then by digest; null turn numbers come first; rows without ``conv_id`` belong to
no conversation; repeated rows are repeated turns; very long texts only lengthen
their digest's input; other columns are not read; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import write_table

#: Distinct conversations of one partition's forest.
ITEMS = 50_000
#: Ids of one chunk of a member list.
IDS = 4096
WIDTH = 16
HEADS = 5


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits as 32 hexadecimal digits; the role's length keeps both parts apart."""
    joined = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(joined, 256), 1, 2 * WIDTH)


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, turns: the ordered (key, chars) of each conversation."""
    plain = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    digested = plain.select(
        "conv_id", "turn", "role", turn_digest(F.col("role"), F.col("text")).alias("key"), F.length("text").alias("chars")
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "key", "chars")))
    return (
        digested.groupBy("conv_id")
        .agg(ordered.alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))
    )


def grafted(found: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the hundred's first conversation.

    h is the unsigned checksum of the decimal id modulo 6; ids are taken modulo 100
    with the sign of the id.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (HEADS + 1)
    heads = found.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS).alias("head"))
    own = found.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h.cast("int"))
    empty = F.array().cast(found.schema["turns"].dataType)
    joined = own.join(heads.filter(F.col("base") % 100 == 0), "base", "left")
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return joined.select(
        "conv_id", F.concat(F.coalesce(F.expr("slice(head, 1, h)"), empty), rest).alias("turns")
    )


def common_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two strings of digests share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    step = 1
    while low < high:
        upto = min(low + step, high)
        if a[low * WIDTH : upto * WIDTH] == b[low * WIDTH : upto * WIDTH]:
            low, step = upto, step * 2
        elif step == 1 or upto - low == 1:
            return low
        else:
            high, step = upto, 1
    return low


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def branch(depths: list[int], lcps: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The forest of sorted items: depth, parent (-1: none), first and last item of each node.

    The first nodes are the items; ``lcps[i]`` joins items i and i + 1.
    """
    n = len(depths)
    depth, up = list(depths), [-1] * n
    first, last = list(range(n)), list(range(n))
    component, top = list(range(n)), list(range(n))
    for i in np.argsort(-np.array(lcps, np.int64), kind="stable").tolist():
        d = lcps[i]
        a, b = find(component, i), find(component, i + 1)
        left, right = top[a], top[b]
        if depth[left] != d:  # a new branching node over both
            up[left] = node = len(depth)
            depth.append(d)
            up.append(-1)
            first.append(first[left])
            last.append(last[left])
            left = node
        up[right] = left
        last[left] = last[right]
        component[b] = a
        top[a] = left
    return depth, up, first, last


NODES = (
    "part long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, seq string, node string, parent string"
)


NODE_SCHEMA = pa.schema(
    [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODES.split(", ")]
)


def forest(items: pa.Table) -> pa.Table:
    """All nodes of one partition of items, with the sums that start in it.

    ``node`` names a node that goes on in a neighbour partition, ``parent`` such a
    parent, whose ``parent_conv_id`` is not final then.  ``before`` and ``behind`` are
    the turns shared with the neighbours' next items, -1 without one.
    """
    items = items.sort_by("keys")
    part, before, behind = (items[c][0].as_py() for c in ("part", "before", "behind"))
    keys, chars, seqs, weights, ids = (items[c].to_pylist() for c in ("keys", "chars", "seq", "n", "conv_id"))
    lcps = [common_turns(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    left, right = [before, *lcps], [*lcps, behind]
    depth, up, first, last = branch([len(k) // WIDTH for k in keys], lcps)
    end, n = len(keys) - 1, len(depth)
    convs = weights + [0] * (n - end - 1)
    least = ids + [max(ids)] * (n - end - 1)
    leaves = [int(right[i] < depth[i]) for i in range(end + 1)] + [0] * (n - end - 1)
    children, below = [0] * n, [0] * n
    digests: dict[tuple[int, int], str] = {}

    def prefix(item: int, d: int) -> str:
        if (item, d) not in digests:
            running = hashlib.sha256()
            for k in range(d + 1):
                digests[item, k] = running.hexdigest()[: 2 * WIDTH]
                running.update(keys[item][k * WIDTH : (k + 1) * WIDTH])
        return digests[item, d]

    def goes_on(node: int, d: int) -> str | None:
        if first[node] == 0 and before >= d:
            return prefix(0, d)
        return prefix(end, d) if last[node] == end and behind >= d else None

    out, parents = [], []
    for node in sorted(range(n), key=lambda x: -depth[x]):
        over, start = up[node], left[first[node]]
        top = depth[over] if over >= 0 else -1
        saved, grown = below[node], children[node]
        for d in range(depth[node], top, -1):
            saved += (convs[node] - (start < d)) * (chars[first[node]][d - 1] if d else 0)
            above = node if d - 1 > top else over
            parents.append(above if d else None)
            ends = seqs[node] if node <= end and d == depth[node] else None
            out.append(
                (part, d, least[node], convs[node], grown, leaves[node], saved, ends)
                + (goes_on(node, d), goes_on(above, d - 1) if d else None)
            )
            grown = int(start < d)  # the parent counts this child where it starts
        if over >= 0:
            convs[over] += convs[node]
            least[over] = min(least[over], least[node])
            leaves[over] += leaves[node]
            below[over] += saved
            children[over] += grown
    columns = [list(c) for c in zip(*out, strict=True)]
    columns.insert(3, [least[p] if p is not None else None for p in parents])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_SCHEMA, strict=True)], schema=NODE_SCHEMA)


def boundaries(items: DataFrame) -> DataFrame:
    """part, before, behind: turns shared by the outer items of neighbouring partitions; -1 at both ends."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            pairs = zip(rows["high"].to_pylist(), rows["low"].to_pylist(), strict=True)
            lcp = [-1 if a is None or b is None else common_turns(a, b) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([rows["at"], pa.array(lcp, pa.int64())], ["at", "lcp"])

    outer = items.groupBy("part").agg(F.min("keys").alias("low"), F.max("keys").alias("high"))
    # numbers of the partitions that hold items; one row each, without their keys
    numbers = outer.select("part", F.row_number().over(W.orderBy("part")).cast("long").alias("at"))
    outer = outer.join(numbers, "part")
    gaps = (
        outer.select("at", "low")
        .join(outer.select((F.col("at") + 1).alias("at"), "high"), "at", "full")
        .mapInArrow(shared, "at long, lcp long")
    )
    return (
        numbers.join(gaps.withColumnRenamed("lcp", "before"), "at")
        .join(gaps.select((F.col("at") - 1).alias("at"), F.col("lcp").alias("behind")), "at")
        .select("part", "before", "behind")
    )


def member_digests(ended: DataFrame) -> DataFrame:
    """seq, ends_sha256: SHA-256 of the rising decimal ids of each sequence, joined by commas."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held = None, []

        def out():
            return pa.RecordBatch.from_pydict({"seq": [seq], "low": [held[0]], "ids": [",".join(map(str, held))]})

        for rows in batches:
            for s, c in zip(rows["seq"].to_pylist(), rows["conv_id"].to_pylist(), strict=True):
                if held and (s != seq or len(held) >= IDS):
                    yield out()
                    held = []
                seq = s
                held.append(c)
        if held:
            yield out()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, running = None, None
        for rows in batches:
            done = []
            for s, ids in zip(rows["seq"].to_pylist(), rows["ids"].to_pylist(), strict=True):
                if s != seq:
                    if running:
                        done.append((seq, running.hexdigest()))
                    seq, running = s, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"seq": [a for a, _ in done], "ends_sha256": [b for _, b in done]}, MEMBERS)
        if running:
            yield pa.RecordBatch.from_pydict({"seq": [seq], "ends_sha256": [running.hexdigest()]}, MEMBERS)

    ordered = ended.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    texts = ordered.mapInArrow(chunks, "seq string, low long, ids string")
    return texts.repartition("seq").sortWithinPartitions("seq", "low").mapInArrow(hashes, "seq string, ends_sha256 string")


MEMBERS = pa.schema([("seq", pa.string()), ("ends_sha256", pa.string())])


def trie(found: DataFrame, items: int = ITEMS) -> DataFrame:
    """One row per node of the trie over (conv_id, turns); see the module for the columns' making."""
    strings = found.select(
        "conv_id",
        F.unhex(F.array_join(F.col("turns.key"), "")).alias("keys"),
        F.col("turns.chars").alias("chars"),
    ).withColumn("seq", F.substring(F.sha2("keys", 256), 1, 2 * WIDTH))
    strings = write_table(strings, "trie-conversations")
    distinct = strings.groupBy("keys", "seq").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.any_value("chars").alias("chars")
    )
    parts = max(1, -(-strings.count() // items))
    placed = write_table(
        distinct.repartitionByRange(parts, "keys").withColumn("part", F.spark_partition_id().cast("long")), "trie-items"
    )
    nodes = placed.join(boundaries(placed), "part").groupBy("part").applyInArrow(forest, NODES)
    nodes = write_table(nodes, "trie-nodes")

    merged = (
        nodes.filter(F.col("node").isNotNull())
        .groupBy("depth", "node")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in SUMS),
            F.max("seq").alias("seq"),
            F.max("parent").alias("parent"),
        )
    )
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    across = merged.join(above, "parent", "left").select(*COLUMNS, "seq")
    by_part = (
        nodes.filter(F.col("node").isNotNull())
        .select("part", F.col("node").alias("parent"))
        .distinct()
        .join(above.withColumnRenamed("parent_conv_id", "_final"), "parent")
    )
    inside = (
        nodes.filter(F.col("node").isNull())
        .join(by_part, ["part", "parent"], "left")
        .withColumn("parent_conv_id", F.coalesce("_final", "parent_conv_id"))
        .select(*COLUMNS, "seq")
    )
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return (
        inside.unionByName(across)
        .join(member_digests(strings), "seq", "left")
        .select(*COLUMNS, ends.alias("ends_sha256"))
    )


SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
COLUMNS = ("conv_id", "depth", "parent_conv_id", *SUMS)
