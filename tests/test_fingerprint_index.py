"""The banded index against brute force, and what of it a batch reads."""

import random

from pyspark.sql import functions as F

from verilens.operators import fingerprint_index as index

SCHEMA = "doc_id long, page long, image_id long, phash long, width int, height int"


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def near_copies(seed, papers):
    """Random hashes with copies and changes of up to seven bits, some images too small or without hash."""
    rng, rows, shared = random.Random(seed), [], random.Random(0)
    seeds = [shared.getrandbits(64) for _ in range(12)]
    for i in range(90):
        value = rng.choice(seeds)
        for b in rng.sample(range(64), rng.randrange(8)):
            value ^= 1 << b
        width = 63 if i % 30 == 0 else 64
        rows.append((rng.choice(papers), 0, seed * 1000 + i, None if i % 40 == 7 else signed(value), width, 64))
    return rows


def brute(batch, known):
    good = lambda rows: {(r[0], r[3]) for r in rows if r[4] >= 64 and r[3] is not None}
    out = {}
    for a in {h for _, h in good(batch)}:
        for paper, b in good(known):
            d = ((a ^ b) & (1 << 64) - 1).bit_count()
            if d <= 6:
                out[a, paper] = min(d, out.get((a, paper), 9))
    return out


def test_batches_equal_brute_force(spark, tmp_path):
    path, known = str(tmp_path / "index"), []
    for batch_id, papers in enumerate(([1, 2, 3], [2, 4], [5, 6, 7])):
        rows = near_copies(batch_id, papers) + [(9 + batch_id, 0, 7, -1, 64, 64), (8, 0, 8, signed(1 << 63), 64, 64)]
        known += rows
        batch = spark.createDataFrame(rows, SCHEMA)
        for _ in range(1 + (batch_id == 1)):  # a replay finds the same
            found = index.batch_edges(batch, path, batch_id).collect()
            assert {(r.hash_a, r.paper_id): r.distance for r in found} == brute(rows, known)
            assert len(found) == len({(r.hash_a, r.paper_id) for r in found})
            index.append(batch, path, batch_id)
    assert spark.read.parquet(f"{path}/papers").count() == sum(r[4] >= 64 and r[3] is not None for r in known)


def test_a_batch_reads_only_its_slots(spark, tmp_path):
    path = str(tmp_path / "index")
    many = spark.range(400).select(
        "id", F.lit(0).cast("long").alias("page"), F.col("id").alias("image_id"), F.xxhash64("id").alias("phash"),
        F.lit(64).alias("width"), F.lit(64).alias("height"),
    ).withColumnRenamed("id", "doc_id")
    index.append(many, path, 0)
    stored = index.read_index(spark, path, "bands", 1)
    asked = index.banded(index.entries(many.filter("image_id = 5")))
    part = index.in_slots(stored, asked)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "slot" in plan.split("PushedFilters: [")[1].split("]")[0]
    slots = {r.slot for r in asked.collect()}
    folders = {f.split("folder=")[1].split("/")[0] for f in part.inputFiles()}
    assert {r.slot for r in part.select("slot").collect()} == slots and len(slots) == 7
    scanned = spark.read.parquet(f"{path}/bands").filter(F.col("folder").isin([s >> index.FOLDER_BITS for s in slots]))
    assert part.count() < stored.count() / 50 and scanned.count() < stored.count() / 8
    assert len(folders) > 100  # what the table holds; the filters above choose 7 of them


def test_empty_and_unusable_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    nothing = spark.createDataFrame([(1, 0, 1, None, 64, 64), (2, 0, 2, 5, 10, 64)], SCHEMA)
    assert index.batch_edges(nothing, path, 0).count() == 0
    index.append(nothing, path, 0)
    one = spark.createDataFrame([(3, 0, 3, 5, 64, 64)], SCHEMA)
    assert [tuple(r) for r in index.batch_edges(one, path, 1).collect()] == [(5, 3, 0)]


def test_index_keys_are_not_broadcast(spark):
    banded = index.banded(spark.range(40).selectExpr("id * 7919 AS phash"))
    plan = index.near_hashes(banded, banded)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
