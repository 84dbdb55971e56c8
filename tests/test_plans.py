import random

import pytest
from pyspark.sql import functions as F

from verilens.plans import ranks as R
from verilens.plans.components import connected_components
from verilens.plans.hamming import hash_pairs


def test_positions_and_lags_cross_chunks(spark):
    rng = random.Random(3)
    rows = [("hot", i * 3, float(rng.randint(0, 9))) for i in range(500)] + [("b", i, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    placed = R.with_positions(df, ["k"], "o", chunk_size=64)
    out = R.lagged(placed, ["k"], "pos", {"v": "prev"}, block=16).collect()
    assert len(out) == len(rows)
    for key in ("hot", "b"):
        mine = sorted((r.pos, r.v, r.prev, r.n) for r in out if r.k == key)
        values = [v for k, _, v in rows if k == key]
        assert [m[0] for m in mine] == list(range(len(values)))
        assert [m[1] for m in mine] == values
        assert [m[2] for m in mine] == [None, *values[:-1]]
        assert {m[3] for m in mine} == {len(values)}


def test_value_distribution_matches_sorted_order(spark):
    rng = random.Random(5)
    values = [rng.choice([-2.5, 0.0, 0.001, 3.0]) if rng.random() < 0.4 else rng.uniform(-50, 9000) for _ in range(400)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    dist = sorted(R.value_distribution(df, ["k"], "v").collect(), key=lambda r: r.v)
    ordered = sorted(values)
    distinct = sorted(set(values))
    assert [r.v for r in dist] == distinct
    assert [r.before for r in dist] == [ordered.index(v) for v in distinct]
    assert [r.prev for r in dist] == [None, *distinct[:-1]]
    median = R.value_distribution(df, ["k"], "v").groupBy("k").agg(R.upper_median("v").alias("m")).first().m
    assert median == ordered[len(ordered) // 2]


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize(("radius", "hot_key"), [(2, 4096), (4, 4096), (8, 4096), (8, 3), (10, 4096), (12, 3)])
def test_hash_pairs_equal_brute_force(spark, radius, hot_key):
    rng = random.Random(radius)
    hashes = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(8):
            flips = rng.sample(range(64), rng.randint(0, 14))
            value = base
            for bit in flips:
                value ^= 1 << bit
            hashes.add(value)
    # A crowd sharing its low bits makes one key hot.
    hashes |= {(rng.getrandbits(30) << 34) | 5 for _ in range(40)}
    df = spark.createDataFrame([(_signed(h),) for h in hashes], "hash long")
    got = {(r.hash_a, r.hash_b, r.distance) for r in hash_pairs(df, None, radius, hot_key=hot_key).collect()}
    signed = sorted(_signed(h) for h in hashes)
    want = set()
    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            d = bin((a ^ b) & ((1 << 64) - 1)).count("1")
            if d <= radius:
                want.add((a, b, d))
    assert got == want


def test_components_with_hub_and_chain(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = spark.createDataFrame([(i,) for i in {*range(61), *range(100, 131)}], "node long")
    out = {
        r.node: r.component
        for r in connected_components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()
    }
    assert all(out[i] == 0 for i in range(60))
    assert out[60] == 60
    assert all(out[i] == 100 for i in range(100, 131))


def test_group_values_reach_every_row(spark):
    df = spark.range(50).select(F.lit("h").alias("k"), (F.col("id") % 5).alias("_chunk"), "id")
    out = R.attach_group_values(df, spark.createDataFrame([("h", 7)], "k string, m int"), ["k"])
    assert out.count() == 50 and out.filter("m = 7").count() == 50


@pytest.mark.parametrize("kind", ["double", "decimal(38,10)"])
def test_narrow_columns_are_split_at_quantiles(spark, kind):
    """Values of one magnitude bucket, skewed inside it, are ranked in small parts and equal sorted order."""
    rng = random.Random(8)
    values = [1000 + round(rng.random() ** 6, 6) for _ in range(3000)] + [1000.5] * 500 + [float(v) for v in range(-40, 40)]
    rows = [(g, v) for g in ("a", "b") for v in values]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("v", F.col("v").cast(kind))
    dist = R.value_distribution(df, ["k"], "v", full=100)
    got = sorted((float(r.v), r.cnt, r.before, float("nan") if r.prev is None else float(r.prev), r.n) for r in dist.filter("k = 'a'").collect())
    ordered, distinct = sorted(values), sorted(set(values))
    first = {}
    for i, v in enumerate(ordered):
        first.setdefault(v, i)
    assert [g[0] for g in got] == distinct
    assert [g[1] for g in got] == [values.count(v) for v in distinct]
    assert [g[2] for g in got] == [first[v] for v in distinct]
    assert [g[3] for g in got[1:]] == distinct[:-1]
    assert {g[4] for g in got} == {len(values)}
    sizes = dist.groupBy("k", "_bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 100
    assert len(sizes) > 64


def test_a_million_values_in_one_power_of_two(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), (1024 + F.col("id") * 1e-6).alias("v"))
    dist = R.value_distribution(df, ["k"], "v", full=1 << 14)
    parts = dist.groupBy("_bucket").count().agg(F.max("count"), F.count(F.lit(1)), F.sum("count")).first()
    assert parts[0] <= 1 << 14
    assert parts[1] >= 64
    assert parts[2] == 1_000_000
    assert dist.filter(F.col("before") != F.round((F.col("v") - 1024) * 1e6)).count() == 0


def test_exploded_keys_are_not_broadcast(spark):
    hashes = spark.range(300).selectExpr("id * 1234567 AS hash")
    plan = hash_pairs(hashes, None, 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_positions_do_not_broadcast_cells(spark):
    df = spark.range(50).selectExpr("1 AS k", "id AS o")
    plan = R.with_positions(df, ["k"], "o")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_written_steps_leave_no_shuffle_files(spark):
    """Disks hold the tables of a query, not the shuffles that made them."""
    import time

    from verilens.llm.shared import write_table
    from verilens.session import CLEANUP, cut_lineage, written

    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    before = spark.conf.get(CLEANUP)
    for keep in (written, cut_lineage, lambda df: write_table(df, "shuffled")):
        start = names(files())
        made = keep(spark.range(20_000).withColumn("k", F.xxhash64("id")).repartition(3, "k").groupBy("k").count())
        deadline = time.time() + 20
        while (left := names(files()) - start) and time.time() < deadline:
            time.sleep(0.2)
        assert not left and made.count() == 20_000
        assert spark.conf.get(CLEANUP) == before


def names(files) -> set[str]:
    found = (files.apply(i).getName() for i in range(files.size()))
    return {f for f in found if f.startswith("shuffle_") and f.endswith(".data")}
