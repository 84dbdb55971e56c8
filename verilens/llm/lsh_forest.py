"""Near-duplicate detection with an LSH forest (operator 4).

A document's set holds its distinct 5-word shingles; equal sets are one node.  A
min-hash signature of ``HASHES`` values gives ``TREES`` orders: tree t sorts all
nodes by ``DEPTH`` values chosen for it.  Candidates are neighbours in these orders
with a common prefix of at least one value.  Depth adapts to the region: where few
nodes share a value all of them are neighbours at depth 1; in dense regions the
sorted neighbours are those with the longest common prefix, so one order of a large
group of copies never gives more than ``NEIGHBOURS`` pairs a node.

What the forest leaves over is found by an exact second pass, a prefix filter on full
sets.  All sets are ordered alike, rarest shingles first, as far as a sample tells
(any order is exact, the sample only saves work): two sets that reach the threshold
share a shingle at the start of both, where what follows it can still hold enough
of both.  Only nodes of different groups are paired; a frequent shingle is dealt out
in blocks.

Candidates of the forest whose sketches and set sizes allow the threshold, and those of
the second pass that an exact bound leaves, are confirmed on full sets: first the best candidate of each group
that leads out of it, then all that still lead from one group to another.  What joins
rows of one group is never asked, so a large group of copies costs about one question
a copy.  Groups are connected components of confirmed links.

Scale: texts are read twice (a sample once more) and never grouped; orders are range sorts, whose ranges
also split equal labels, so a value that a third of all nodes share spans many
tasks (a pair cut by a border meets in other trees or in the second pass).  Exact
copies meet in a map-side combined aggregate.

Cases: null, empty and wordless texts have an empty set and stay alone; repeated
rows share their group; a null id has a group but never is its representative,
unless the group has no id at all (``component_id`` null, ``kept`` true); extra
columns are left aside; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.ranks import attach_group_values
from .shared import TEXT_ROWS, write_table

SHINGLE = 5
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
HASHES = 128
TREES = 32
DEPTH = 8
#: Decides, with BEST_ROUNDS, how much is left to the exact second pass, not what is found.
NEIGHBOURS = 2
#: Estimated similarity from which a candidate is confirmed: four standard errors below the threshold.
CONFIRM_FROM = 0.6
#: Rounds in which only the best candidates are confirmed, before all that still lead between groups.
BEST_ROUNDS = 1
SEED = 41
#: One of so many documents is counted for the order of shingles, in 2**BIN_BITS bins.
SAMPLED = 16
BIN_BITS = 20
#: Members of a shingle from which it is dealt out in blocks, and of a batch of found pairs.
BLOCK = 4096
FOUND = 200_000
CACHED_WORDS = 200_000
#: Bits of the filter that texts pass before they are shuffled to the ids that are wanted.
FILTER_BITS = 1 << 22
SALTS = 64

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
#: The signature values of each tree's labels.
LABELS = np.stack([np.random.default_rng([SEED, t]).permutation(HASHES)[:DEPTH] for t in range(TREES)])
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; ``bytes.lower`` and ``split`` know ASCII only, as words do."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return mixed((h * POWERS[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    return np.unique(mixed(sum(h[k : k + n] * POWERS[k] for k in range(SHINGLE))))


def signature(found: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] * FACTORS + TERMS
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(">u4")


def bins(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def parity(found: np.ndarray) -> bytes:
    """Whether an odd number of the shingles falls into each of as many bins as there are shingles, or up to twice as many."""
    width = max(64, 1 << (len(found) - 1).bit_length())
    at = (found & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(bool)).tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Shingles that are in one of two sets only, at least: bins of different parity, in the bins of the smaller map."""
    if len(x) < len(y):
        x, y = y, x
    width = 8 * len(x)
    x, y, smaller = int.from_bytes(x), int.from_bytes(y), 8 * len(y)
    while width > smaller:
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    return (x ^ y).bit_count()


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each bin occur in a sample of the documents."""
    width = 1 << (BIN_BITS - 6)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(1 << BIN_BITS, np.int32)
        for rows in batches:
            for text in rows["text"]:
                np.add.at(out, bins(shingles(text)), 1)
        WORDS.clear()
        parts = out.reshape(-1, width)
        used = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"part": used, "counts": [parts[k].tobytes() for k in used]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in rows["counts"])
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [total.tobytes()]})

    sample = _texts(docs).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLED)) == 0).select("text")
    kind = "part long, counts binary"
    out = np.zeros(1 << BIN_BITS, np.int32).reshape(-1, width)
    for row in sample.mapInPandas(count, kind).groupBy("part").applyInPandas(add, kind).collect():
        out[row.part] = np.frombuffer(row.counts, np.int32)
    return out.ravel()


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The start of the ordered set: sets that reach the threshold share one of these."""
    size = len(found) - -(-SIMILAR * len(found) // 100) + 1
    return found[np.lexsort((found, counts[bins(found)]))[:size]]


def features(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, row (a hash of id and text), n_shingles, node (16-byte digest of the set, null if empty), signature,
    sketch (its values' low bytes), parity (of the set) and prefix (the start of the ordered set)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["text"]:
                found = shingles(text)
                if len(found):
                    values = signature(found)
                    sketch = (values & 255).astype(np.uint8).tobytes()
                    node = xxhash.xxh3_128_digest(found.tobytes())
                    start = prefix(found, counts)
                    out.append((len(found), node, values.tobytes(), sketch, parity(found), start.view(np.int64)))
                else:
                    out.append((0, None, None, None, None, None))
            made = pd.DataFrame(out, columns=["n_shingles", "node", "signature", "sketch", "parity", "prefix"])
            made.insert(0, "doc_id", rows["doc_id"].astype("Int64").array)
            made.insert(1, "row", rows["row"].array)
            yield made
        WORDS.clear()  # workers live on for other steps

    texts = _texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    return texts.mapInPandas(
        make,
        "doc_id long, row long, n_shingles long, node binary, signature binary, sketch binary, parity binary, prefix array<long>",
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def placed(nodes: DataFrame, *columns: str) -> DataFrame:
    """A row per node and tree with the node's label; its first 4 bytes are the first value."""
    label = lambda tree: F.concat(*[F.substring("signature", int(4 * c) + 1, 4) for c in LABELS[tree]])
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), label(t).alias("label")) for t in range(TREES)]))
    return nodes.select("node", *columns, trees.alias("t")).select("t.tree", "t.label", "node", *columns)


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of neighbours in the orders of the forest, for ``nodes(node, signature)``."""
    order = ["tree", "label", "node"]

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            new = len(rows)
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            old = len(rows) - new
            tree, node = rows["tree"].to_numpy(), rows["node"].to_numpy()
            first = np.frombuffer(b"".join(rows["label"].str[:4]), ">u4")
            for step in range(1, NEIGHBOURS + 1):
                left = np.arange(max(0, old - step), len(rows) - step)
                left = left[left + step >= old]
                near = left[(tree[left] == tree[left + step]) & (first[left] == first[left + step])]
                x, y = node[near], node[near + step]
                swap = np.array([a > b for a, b in zip(x, y, strict=True)], bool)
                yield pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)})
            held = rows.tail(NEIGHBOURS).reset_index(drop=True)

    sorted_ = placed(nodes).repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.mapInPandas(neighbours, "a binary, b binary").distinct()


def _sided(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Pairs whose set sizes allow the threshold, with the sizes ``n_`` and the ``column`` as ``s_`` of both."""
    plain = nodes.select("node", F.col("n_shingles").alias("n"), F.col(column).alias("s"))
    side = lambda c: plain.select(F.col("node").alias(c), F.col("n").alias("n_" + c), F.col("s").alias("s_" + c))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b"))


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose set sizes and sketches allow the threshold, with their estimated similarity."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        values = [np.frombuffer(b"".join(s), np.uint8).reshape(len(s), HASHES) for s in (x, y)]
        return pd.Series((values[0] == values[1]).mean(axis=1))

    estimated = _sided(pairs, nodes, "sketch").select("a", "b", "n_a", "n_b", alike("s_a", "s_b").alias("alike"))
    return estimated.filter(F.col("alike") >= CONFIRM_FROM)


def reachable(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs that reach the threshold and few others, with the most that their parities leave of similarity.

    What two sets do not share makes bins differ, so the bound is exact: it drops only
    pairs whose full sets would fail.
    """

    @F.pandas_udf("long")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([least_apart(p, q) for p, q in zip(x, y, strict=True)], dtype="int64")

    total = F.col("n_a") + F.col("n_b")
    shared = F.floor((total - F.col("apart")) / 2)
    bounded = _sided(pairs, nodes, "parity").withColumn("apart", apart("s_a", "s_b"))
    return bounded.filter((100 + SIMILAR) * shared >= SIMILAR * total).select(
        "a", "b", "n_a", "n_b", (shared / (total - shared)).alias("alike")
    )


def prefix_candidates(made: DataFrame, nodes: DataFrame, known: DataFrame, counts: np.ndarray) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that share a shingle of their prefixes and can reach the threshold.

    All pairs of different groups that reach it are among them.
    """
    usual = np.median(counts)
    hands = 1 + (SAMPLED * np.maximum(counts - usual - 8 * np.sqrt(usual), 0) // BLOCK).astype(np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sizes = np.array([len(p) for p in rows["prefix"]], np.int64)
            shingle = np.concatenate(rows["prefix"].to_numpy()) if len(rows) else np.zeros(0, np.int64)
            own = np.repeat(np.arange(len(rows)), sizes)
            at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = rows["n_shingles"].to_numpy()[own]
            node, group = rows["id"].to_numpy()[own], rows["group"].to_numpy()[own]
            # a frequent shingle's members are dealt to k hands; each pair of hands is a block
            k = hands[bins(shingle.view(np.uint64))]
            hand = (node >> 7) % k
            other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            row, hand = np.repeat(np.arange(len(k)), k), np.repeat(hand, k)
            block = np.minimum(hand, other) * np.repeat(k, k) + np.maximum(hand, other)
            place = (n << 32 | at)[row]
            yield pd.DataFrame(
                {"shingle": shingle[row], "block": block, "group": group[row], "id": node[row], "place": place}
            )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, found, waiting = None, [], 0
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            new = starts(rows, ["shingle", "block"])
            # the last run may go on in the next batch
            last = np.flatnonzero(new)[-1] if len(rows) else 0
            held = rows.iloc[last:].reset_index(drop=True)
            for pairs in runs(rows.iloc[:last]):
                found.append(pairs)
                waiting += len(pairs)
                if waiting > FOUND:
                    yield once(found)
                    found, waiting = [], 0
        if held is not None:
            found.extend(runs(held))
        if found:
            yield once(found)

    def starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
        new = np.ones(len(rows), bool)
        if len(rows):
            new[1:] = np.any([rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1] for c in keys], axis=0)
        return new

    def reach(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the run of each row starts and ends."""
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        return first[number], np.append(first[1:], len(new))[number]

    def runs(rows: pd.DataFrame) -> Iterator[np.ndarray]:
        if not len(rows):
            return
        first, end = reach(starts(rows, ["shingle", "block"]))
        own, after = reach(starts(rows, ["shingle", "block", "group"]))
        node, place = rows["id"].to_numpy(), rows["place"].to_numpy()
        n, at = place >> 32, place & 0xFFFFFFFF
        # the smaller set of a pair; in a run that is late in all sets there is none
        left = np.flatnonzero((100 + SIMILAR) * (n - at) >= 2 * SIMILAR * n)
        right = first[left]
        while True:
            right = np.where(right == own[left], after[left], right)
            more = right < end[left]
            left, right = left[more], right[more]
            if not len(left):
                return
            both = np.minimum(n[left] - at[left], n[right] - at[right])
            near = (n[left] <= n[right]) & ((100 + SIMILAR) * both >= SIMILAR * (n[left] + n[right]))
            x, y = node[left[near]], node[right[near]]
            yield np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)
            right = right + 1

    def once(found: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame(np.concatenate(found), columns=["x", "y"]).drop_duplicates()

    group = F.xxhash64(F.coalesce("component", "node")).alias("group")
    named = nodes.select("node", "id", "row").join(known, "node", "left").select("node", "row", "id", group)
    firsts = made.filter("node is not null").select("node", "row", "n_shingles", "prefix")
    firsts = firsts.join(named, ["node", "row"]).dropDuplicates(["node", "row"])
    order = ["shingle", "block", "group"]
    dealt = firsts.select("id", "group", "n_shingles", "prefix").mapInPandas(deal, "shingle long, block long, group long, id long, place long")
    pairs = dealt.repartition("shingle", "block").sortWithinPartitions(*order).mapInPandas(meet, "x long, y long")
    name = lambda c, x: nodes.select(F.col("node").alias(c), F.col("id").alias(x))
    return pairs.distinct().join(name("a", "x"), "x").join(name("b", "y"), "y").select("a", "b")


def likely(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` (or sets) without most of the rows whose ``_id`` is not in ``ids``, and with all others.

    A bitmap of hashed ids, of bounded size, is looked up before any text is shuffled.
    """
    place = F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    one = F.expr("shiftleft(1L, _bit)")
    bitmap = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    marked = texts.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(bitmap), "_word")
    return marked.filter(F.expr("(_bits & shiftleft(1L, _bit)) <> 0")).drop("_word", "_bit", "_bits")


def asked_sets(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """``sets`` without most of those that no pair asks for."""
    ids = ends_of(asked).select(F.col("node").alias("_id"))
    return likely(sets.withColumnRenamed("node", "_id"), ids).withColumnRenamed("_id", "node")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted(node, doc_id)``, read from their documents."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = [shingles(t) for t in rows["text"]]
            yield pd.DataFrame(
                {
                    "node": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "shingles": [s.view(np.int64) for s in sets],
                }
            )
        WORDS.clear()

    ids = wanted.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")).distinct()
    texts = _texts(docs).withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # a semi join would be pushed below the filter
    found = likely(texts, ids).join(ids, "_id").select("text").mapInPandas(make, "node binary, shingles array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that reach the threshold on full sets, as links (u, v) between their groups."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias("set_" + c))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .withColumn("both", both)
        .filter(100 * F.col("both") >= SIMILAR * (F.col("n_a") + F.col("n_b") - F.col("both")))
        .select(F.col("c_a").alias("u"), F.col("c_b").alias("v"))
    )


def joined_groups(asked: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """``known(node, component)`` after confirming the asked pairs, which carry their groups c_a and c_b."""
    links = write_table(confirmed(asked, asked_sets(sets, asked)), "near-links")
    joined = connected_components(links.select(F.col("u").alias("node")).union(links.select("v")), links)
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    known = known.join(joined, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return write_table(known, "near-known")


def between_groups(pairs: DataFrame, known: DataFrame) -> DataFrame:
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias("c_" + c))
    plain = pairs.select("a", "b", "n_a", "n_b", "alike")
    return write_table(plain.join(side("a"), "a").join(side("b"), "b").filter("c_a <> c_b"), "near-open")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def confirmed_groups(pairs: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """``known`` after confirming the pairs: the best of each group first, then what still leads between groups."""
    for number in range(BEST_ROUNDS + 1):
        asked = pairs = between_groups(pairs, known)
        if number < BEST_ROUNDS:
            row = F.struct(*pairs.columns)
            best = lambda c, p=pairs, r=row: p.groupBy(c).agg(F.max_by(r, F.struct("alike", "a", "b")).alias("p"))
            asked = write_table(best("c_a").select("p.*").union(best("c_b").select("p.*")).distinct(), "near-asked")
            pairs = pairs.join(asked.select("a", "b"), ["a", "b"], "left_anti")
        known = joined_groups(asked, known, sets)
    return known


def groups_of(docs: DataFrame, made: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, component) of the nodes that have confirmed links."""
    columns = ("n_shingles", "signature", "sketch", "parity")
    nodes = made.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in columns]
    )
    nodes = write_table(nodes.withColumn("id", F.xxhash64("node")), "near-nodes")
    named = nodes.select("node", "doc_id")
    pairs = write_table(plausible(candidates(nodes), nodes), "near-pairs")
    ends = write_table(ends_of(pairs), "near-ends")
    sets = write_table(full_sets(docs, named.join(ends, "node")), "near-sets", TEXT_ROWS)
    known = write_table(ends.select("node", F.col("node").alias("component")), "near-known")
    known = confirmed_groups(pairs, known, sets)
    # what the forest has left over; the bound also tells which to ask first
    more = write_table(reachable(prefix_candidates(made, nodes, known, counts), nodes), "near-more")
    new = write_table(ends_of(more).join(ends, "node", "left_anti"), "near-new-ends")
    known = known.unionByName(new.select("node", F.col("node").alias("component")))
    sets = sets.unionByName(write_table(full_sets(docs, named.join(new, "node")), "near-new-sets", TEXT_ROWS))
    return confirmed_groups(more, known, sets)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, component (null for an empty set) and component_id of every document."""
    counts = shingle_counts(docs)
    made = write_table(features(docs, counts), "near-features", TEXT_ROWS)
    groups = groups_of(docs, made, counts)
    rows = made.select("doc_id", "row", "n_shingles", "node")
    members = rows.filter("node is not null").withColumn("_chunk", F.pmod(F.col("row"), F.lit(SALTS)))
    ids = made.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    groups = ids.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = write_table(groups, "near-groups")
    smallest = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = groups.join(smallest, "component").select("node", "component", "component_id")
    linked = attach_group_values(members, by_node, ["node"]).drop("_chunk", "node")
    alone = rows.filter("node is null").select(
        "doc_id", "row", "n_shingles", F.col("node").alias("component"), F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return grouped(docs).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of its smallest id stays.

    Of repeated rows one stays; texts without words stay all.
    """
    found = write_table(grouped(docs), "near-rows")
    own = F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row"))
    chosen = found.filter("component is not null").groupBy("component").agg(F.min(own).alias("row")).select("row")
    times = found.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    kept = chosen.join(times, "row").select("row", (F.col("times") == 1).alias("single")).unionByName(
        found.filter("component is null").select("row", F.lit(True).alias("single")).distinct()
    )
    kept = write_table(kept, "near-kept")
    numbered = docs.withColumn(
        "_row", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    )
    joined = numbered.join(kept.select(F.col("row").alias("_row"), "single"), "_row")
    # only rows that are there more than once need to be told apart
    once = joined.filter("not single").dropDuplicates(["_row"])
    return joined.filter("single").unionByName(once).select(*docs.columns)
