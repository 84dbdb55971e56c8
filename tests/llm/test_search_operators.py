"""Operators that compare rows with each other, against brute force, and the pipeline."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verilens.llm import collision_search, lsh_forest, suffix_merge
from verilens.llm.packing import pack

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC)


def phrase(rnd, n):
    return " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(n))


def brute_removed(texts, length):
    starts = defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for k, d in enumerate(data):
        for i in range(len(d) - length + 1):
            starts[d[i : i + length]].append((k, i))
    covered = [bytearray(len(d)) for d in data]
    for places in starts.values():
        if len(places) > 1:
            for k, i in places:
                covered[k][i : i + length] = b"\x01" * length
    return data, covered


def repeat_texts(rnd):
    passage, base = phrase(rnd, 120), phrase(rnd, 300)
    texts = [None, "", "short", base, base, base[:900] + "X" + base[901:], "a" * 1000, phrase(rnd, 30) + "a" * 450]
    texts += [phrase(rnd, rnd.randint(1, 90)) + passage + phrase(rnd, 60) for _ in range(9)]
    texts += [passage[:399], passage[:400], passage[3:], phrase(rnd, 40) + passage[:450] + phrase(rnd, 30) + passage[100:600]]
    texts += ["ü" * 300, "xü" + "ü" * 250 + phrase(rnd, 20), ("abc" * 400), ("bca" * 150) + "z"]
    return texts


@pytest.mark.parametrize("wide", [False, True])
def test_repeats_match_brute_force(spark, monkeypatch, wide):
    if wide:  # all classes by counting
        monkeypatch.setattr(suffix_merge, "CLASS", 0)
    texts = repeat_texts(random.Random(8))
    rows = docs_of(spark, texts).withColumnRenamed("lang", "spans")
    found = {r.doc_id: r for r in suffix_merge.digests(suffix_merge.without_repeats(rows)).collect()}
    for k, (d, c) in enumerate(zip(*brute_removed(texts, suffix_merge.LENGTH), strict=True)):
        kept = bytes(b for b, gone in zip(d, c, strict=True) if not gone)
        spans = sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1]))
        want = (len(d), sum(c), spans, hashlib.sha256(kept).hexdigest())
        assert (found[k].n_bytes, found[k].n_removed, found[k].n_spans, found[k].kept_sha256) == want, k


def test_merged_transforms_find_the_same_as_comparing(monkeypatch):
    monkeypatch.setattr(suffix_merge, "SHARD", 3)
    rnd = random.Random(1)
    core = bytes(rnd.choices(b"ab", k=suffix_merge.WIDTH))
    contexts, left = [], []
    for _ in range(17):
        data = bytearray(core)
        data[rnd.randrange(0, 199)] = ord("x")
        data[rnd.randrange(400, suffix_merge.WIDTH)] = ord("y")
        l = rnd.randint(120, 199)
        contexts.append(bytes(data[199 - l : rnd.randint(500, suffix_merge.WIDTH)]))
        left.append(l)
    left = np.array(left)
    least, most = suffix_merge.repeated_starts(contexts, left, np.ones(len(contexts)))
    strings = defaultdict(list)
    for k, (c, l) in enumerate(zip(contexts, left, strict=True)):
        for d in range(200):
            if d <= l and len(c) - l >= 400 - d:
                strings[d, c[l - d : l - d + 400]].append(k)
    for k in range(len(contexts)):
        hits = [d for (d, _), ks in strings.items() if k in ks and len(ks) > 1]
        assert (least[k], most[k]) == ((min(hits), max(hits)) if hits else (-1, -1))


def test_cleaned_documents_keep_rows(spark):
    texts = repeat_texts(random.Random(9))
    docs = docs_of(spark, [*texts, "x"])
    out = suffix_merge.cleaned_documents(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and len(rows) == len(texts) + 1
    assert rows[0].text is None and rows[3].text == "" and rows[3].n_chars == 0
    assert suffix_merge.cleaned_documents(docs.limit(0)).count() == 0


def near_texts(rnd):
    texts = [None, "", " \t", "one two", "One TWO", "É a b c d e", "é a b c d e"]
    for _ in range(12):
        base = phrase(rnd, rnd.randint(30, 120)).split()
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = phrase(rnd, 1)
            texts.append(" ".join(copy).upper() if rnd.random() < 0.2 else " ".join(copy))
    return texts


def test_groups_match_brute_force(spark):
    texts = near_texts(random.Random(6))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    docs = docs_of(spark, texts).withColumnRenamed("lang", "node")
    found = lsh_forest.near_duplicates(docs).collect()
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert len(found) == len(texts)


def test_links_in_dense_regions(spark):
    """Pairs above the threshold among thousands of documents of one template that are just below it."""
    rnd = random.Random(8)
    words = lambda n: [f"{rnd.getrandbits(40):x}" for _ in range(n)]
    template, texts = words(400), []
    for _ in range(1500):
        shared = words(22)
        texts += [" ".join(template + shared + words(60)) for _ in range(2)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    similar = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    assert all(similar(i, j) == (i // 2 == j // 2) for i in range(60) for j in range(i))
    found = lsh_forest.near_duplicates(docs_of(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 2 for i in range(len(texts))}


def test_second_pass_finds_all(spark, monkeypatch):
    """Nothing is missed where the forest gives no candidate at all and shingles are dealt out in blocks."""
    monkeypatch.setattr(lsh_forest, "BLOCK", 1)
    monkeypatch.setattr(lsh_forest, "SAMPLED", 2)
    none = lambda nodes: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    monkeypatch.setattr(lsh_forest, "candidates", none)
    test_groups_match_brute_force(spark)


def test_only_wanted_texts_are_shuffled(spark):
    texts = spark.range(20_000).select((F.col("id") * 7 - 3_500).alias("_id"), F.lit("t").alias("text"))
    wanted = texts.filter("_id % 35 = 0").select("_id").unionByName(spark.createDataFrame([(-(1 << 63),)], "_id long"))
    kept = {r._id for r in lsh_forest.likely(texts, wanted).collect()}
    need = {r._id for r in texts.join(wanted, "_id", "left_semi").collect()}
    assert need <= kept and len(need) == 4_000 and len(kept) < 4_200
    assert lsh_forest.likely(texts, wanted.limit(0)).count() == 0


def test_text_batches_are_bounded_while_a_table_is_written(spark):
    from verilens.llm import shared

    before = spark.conf.get(shared.BATCH)

    def sizes(batches):
        for rows in batches:
            yield rows.head(1).assign(id=len(rows))

    made = shared.write_table(spark.range(0, 5_000, 1, 1).mapInPandas(sizes, "id long"), "sizes", shared.TEXT_ROWS)
    assert [r.id for r in made.collect()] == [1_000] * 5 and spark.conf.get(shared.BATCH) == before


def test_one_per_group(spark):
    text = phrase(random.Random(3), 60)
    rows = [(5, text), (5, text), (3, text + " end"), (None, text), (7, None), (7, None), (8, "a b c"), (None, "d e f")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    kept = lsh_forest.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == sorted(
        [(3, text[:5]), (7, ""), (7, ""), (8, "a b c"), (0, "d e f")]
    )
    assert lsh_forest.near_duplicates(docs.limit(0)).count() == 0


def test_neighbours_have_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 24))
    v = (centres[rng.integers(0, 20, 900)] + 0.6 * rng.standard_normal((900, 24))) * rng.uniform(0.5, 2, (900, 1))
    v[5] = v[40] = v[41]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(900)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (None, rows[0][1], 1)]
    rows += [(1000, [1.0, 2.0], 1), (1020, [2.0, 1.0], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = defaultdict(list)
    for r in collision_search.search(vectors).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 20):
        exact = [((v[i] * v[q]).sum(), -i) for i in range(900) if i != q]
        best = [-i for _, i in sorted(exact, reverse=True)[:20]]
        got = found[q]
        hits += len({i for _, i, _ in got} & set(best))
        assert [k for k, _, _ in got] == list(range(1, 21))
        assert all(s == pytest.approx((v[i] * v[q]).sum(), abs=1e-12) for _, i, s in got)
        assert got == [(k + 1, i, s) for k, (s, i) in enumerate(sorted(((s, i) for _, i, s in got), key=lambda x: (-x[0], x[1])))]
    assert hits >= 0.95 * 20 * 45
    assert found[1000] == [(1, 1020, 4.0)] and not {900, 901, 902, 903} & set(found)
    assert collision_search.search(vectors.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(5)
    base, passage = phrase(rnd, 90), phrase(rnd, 140)
    texts = [base, base + " end", *[phrase(rnd, 80) for _ in range(40)]]
    texts += [phrase(rnd, 60) + passage, phrase(rnd, 60) + passage]
    toxic = [phrase(rnd, 30) + " gorbol snerv" for _ in range(24)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate([*texts, *toxic])]
    docs = spark.createDataFrame(rows, DOC)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, 1, int(i >= len(texts))) for i in range(len(rows))]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = spark.createDataFrame(stage(spark, seen, str(tmp_path)).collect(), DOC)
        ids = {r.doc_id for r in seen.collect()}
        if name == "toxicity":
            assert ids == set(range(len(texts)))
        elif name == "near duplicates":
            assert ids == set(range(len(texts))) - {1}
        elif name == "repeated passages":
            cut = {r.doc_id: r.text for r in seen.collect()}
            assert all(passage[50:300] not in t for t in cut.values()) and cut[5] == texts[5]
    assert pack(seen).count() >= seen.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_parities_never_deny_a_pair_that_reaches_the_threshold():
    rng = np.random.default_rng(5)
    dropped = 0
    for _ in range(400):
        n = int(rng.integers(1, 700))
        base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        kept = base[: max(1, int(len(base) * rng.uniform(0.3, 1)))]
        other = np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, int(rng.integers(0, 60)), dtype=np.uint64)]))
        shared = len(np.intersect1d(base, other))
        apart = lsh_forest.least_apart(lsh_forest.parity(base), lsh_forest.parity(other))
        assert apart <= len(base) + len(other) - 2 * shared
        assert apart == lsh_forest.least_apart(lsh_forest.parity(other), lsh_forest.parity(base))
        dropped += 100 * (len(base) + len(other) - apart) // 2 < 75 * ((len(base) + len(other) + apart) // 2)
    assert dropped > 100


def test_pairs_out_of_reach_are_not_asked(spark):
    """Of candidates without an estimate only those are confirmed on full sets whose parities allow it."""
    texts = [" ".join(f"w{(7 * i + d * k) % 4001}" for i in range(300)) for d, k in ((0, 0), (0, 0), (1, 2000))]
    texts[1] += " and a few words more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = lsh_forest.features(docs, np.zeros(1 << lsh_forest.BIN_BITS, np.int32))
    nodes = nodes.select("doc_id", "node", "n_shingles", "parity").cache()
    ends = {r.doc_id: r.node for r in nodes.collect()}
    pairs = spark.createDataFrame([(bytes(ends[0]), bytes(ends[1])), (bytes(ends[0]), bytes(ends[2]))], "a binary, b binary")
    found = lsh_forest.reachable(pairs, nodes).collect()
    assert [(r.a, r.b) for r in found] == [(ends[0], ends[1])] and 0.75 <= found[0].alike <= 1
    sets = nodes.select("node")
    asked = lsh_forest.asked_sets(sets, pairs.limit(1))
    assert {r.node for r in asked.collect()} == {ends[0], ends[1]}
