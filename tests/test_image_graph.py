"""Class-level image matches, expanded, against plain image pairs."""

import random

import pytest

from verilens.operators import image_graph as M

TURNS = ("identity", "hflip", "rot90")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def bits(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def near(rng, base, most):
    for bit in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << bit
    return signed(base & ((1 << 64) - 1))


def album(seed, n=36):
    """Images whose hashes are shared, symmetric (a turn equals the plain form) or a few bits apart."""
    rng = random.Random(seed)
    pool = [rng.getrandbits(64) for _ in range(5)]
    pick = lambda most: None if rng.random() < 0.1 else near(rng, rng.choice(pool), most)
    images = {}
    for i in range(n):
        if i and rng.random() < 0.3:
            images[i] = images[rng.randrange(i)]
            continue
        plain = pick(9)
        turns = {"identity": plain} | {t: plain if rng.random() < 0.3 else pick(12) for t in TURNS[1:]}
        parts = [(k, pick(2), rng.choice([5.0, 13.0, 25.0])) for k in range(3)]
        images[i] = {
            "doc": rng.randrange(2),
            "hashes": (plain, pick(10), pick(10)),
            "turns": {t: h for t, h in turns.items() if h is not None},
            "parts": [p for p in parts if p[1] is not None],
            "size": rng.choice([(300, 200, 20_000), (300, 200, 20_000), (70, 70, 6_000), (20, 20, 90_000)]),
        }
    return images


def plain(images):
    """(doc, pass, i, j, distance) in the order of the passes."""
    out = set()
    usable = [i for i, m in images.items() if min(m["size"][:2]) >= 64 and m["size"][2] >= 5 * 1024]
    for i in usable:
        for j in usable:
            a, b = images[i], images[j]
            if i >= j or a["doc"] != b["doc"]:
                continue

            def best(pairs):
                return min((bits(x, y) for x, y in pairs if x is not None and y is not None), default=99)

            whole = False
            for name, radius, pairs in (
                ("primary", 8, [(a["hashes"][0], b["hashes"][0])]),
                ("secondary", 12, [(a["hashes"][k], b["hashes"][k]) for k in (1, 2)]),
                (
                    "geometric",
                    10,
                    [(h, y["turns"].get("identity")) for x, y in ((a, b), (b, a)) for t, h in x["turns"].items() if t != "identity"],
                ),
            ):
                d = best(pairs)
                if not whole and d <= radius:
                    out.add((a["doc"], name, i, j, d))
                    whole = True
            if whole:
                continue
            for name, radius, std, wide in (("region", 2, 18, (0, 0, 0)), ("loading_control", 5, 12, (80, 60, 8 * 1024))):
                if all(s >= w for m in (a, b) for s, w in zip(m["size"], wide, strict=True)):
                    d = best((x[1], y[1]) for x in a["parts"] for y in b["parts"] if min(x[2], y[2]) >= std)
                    if d <= radius:
                        out.add((a["doc"], name, i, j, d))
    return out


def tables(spark, images):
    rows = [(m["doc"], i, *m["hashes"], *m["size"]) for i, m in images.items()]
    made = spark.createDataFrame(
        rows, "doc_id long, image_id long, phash long, ahash long, dhash long, width int, height int, bytes_size long"
    )
    turns = [(m["doc"], i, t, h) for i, m in images.items() for t, h in m["turns"].items()]
    parts = [(m["doc"], i, *p) for i, m in images.items() for p in m["parts"]]
    return (
        made,
        spark.createDataFrame(turns, "doc_id long, image_id long, transform string, hash long"),
        spark.createDataFrame(parts, "doc_id long, image_id long, part int, hash long, std double"),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passes_equal_plain_pairs(spark, seed):
    images = album(seed)
    made, turns, parts = tables(spark, images)
    matches, named = M.duplicate_classes(made, turns, parts, parts)
    matches = matches.cache()
    got = [tuple(r) for r in M.expanded(matches, named).select("doc_id", "pass", "image_a", "image_b", "distance").collect()]
    wanted = plain(images)
    assert len(got) == len(set(got)) == matches.groupBy().sum("pairs").first()[0]
    assert set(got) == wanted
    assert {p for _, p, *_ in wanted} >= {"primary", "secondary", "geometric"}


def test_copies_are_one_row(spark):
    """A thousand copies of one image are one class that matches itself once."""
    h = signed(0xF0F0F0F0F0F0F0F0)
    rows = [(1, i, h, h, h, 300, 200, 20_000) for i in range(1000)]
    made = spark.createDataFrame(
        rows, "doc_id long, image_id long, phash long, ahash long, dhash long, width int, height int, bytes_size long"
    )
    none = spark.createDataFrame([], "doc_id long, image_id long, transform string, hash long")
    parts = spark.createDataFrame([], "doc_id long, image_id long, part int, hash long, std double")
    matches, named = M.duplicate_classes(made, none, parts, parts)
    assert [tuple(r) for r in matches.collect()] == [(1, "primary", 0, 0, 0, "low", 1000 * 999 // 2)]
    assert named.count() == 1000


def test_pages_equal_plain_pairs(spark):
    rng = random.Random(9)
    pool = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for page in range(30):
        if page > 3 and rng.random() < 0.3:
            copied = rng.randrange(page)
            rows += [(d, a, k, page, h) for d, a, k, p, h in list(rows) if p == copied]
            continue
        for _ in range(3):
            rows.append((page % 2, rng.choice(["phash", "ahash"]), rng.choice(["region", "tile"]), page, near(rng, rng.choice(pool), 6)))
    units = spark.createDataFrame(rows, "doc_id long, algo string, kind string, page long, hash long")
    merged = {}
    for d, a, k, p, h in rows:
        merged[d, a, p, h] = max(merged.get((d, a, p, h), 0), int(k == "region"))
    wanted = {}
    for (d, a, p, h), r in merged.items():
        for (d2, a2, p2, h2), r2 in merged.items():
            if (d, a) == (d2, a2) and p < p2:
                x = bits(h, h2)
                primary = int(r and r2 and a == "phash" and x <= 8)
                if primary or x <= (4 if a == "ahash" else 10):
                    old = wanted.get((d, a, p, p2), (99, 0))
                    wanted[d, a, p, p2] = (min(old[0], x), max(old[1], primary))
    matches = M.page_class_matches(units)
    pages = M.page_classes(units)
    of = {}
    for r in pages.collect():
        for (d, a, p, _h) in merged:
            key = sorted((h, r2) for (d2, a2, p2, h), r2 in merged.items() if (d2, a2, p2) == (d, a, p))
            if (d, a) == (r.doc_id, r.algo) and key == [(u.hash, u.region) for u in r.units]:
                of.setdefault((d, a, r.class_id), set()).add(p)
    got, total = {}, 0
    for r in matches.collect():
        total += r.pairs
        for p in of[r.doc_id, r.algo, r.page_a]:
            for q in of[r.doc_id, r.algo, r.page_b]:
                if p != q:
                    got[r.doc_id, r.algo, min(p, q), max(p, q)] = (r.distance, r.primary)
    assert got == wanted
    assert total == len(wanted)


def test_classes_of_one_hash_match_once(spark):
    images = spark.createDataFrame(
        [(1, 1, 77, 1, 5), (1, 2, 77, 2, 6)], "doc_id long, image_id long, phash long, ahash long, dhash long"
    )
    found = M.classes(M.signatures(images))
    assert [(r.class_a, r.class_b, r.pairs) for r in M.primary_classes(found, images).collect()] == [(1, 2, 1)]


def test_pixels_are_cut_in_floats(spark, tmp_path):
    from verilens.registry import corpus

    edge = -1e-9  # adds up to 4 in floats only
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([(0, [edge] * 64, 0)], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert corpus.images(spark, str(tmp_path)).first().pixels == [128] * 64
