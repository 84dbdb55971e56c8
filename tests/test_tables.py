import functools
import itertools
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.operators import audit as A
from verilens.operators import columns as C
from verilens.operators import relations as L


def table(spark, columns, table_id=1, doc_id=1):
    rows = [
        (doc_id, table_id, r, c, name, str(text))
        for c, (name, values) in enumerate(columns.items())
        for r, text in enumerate(values)
    ]
    return spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")


def checks(df):
    return {r.check: r.severity for r in df.collect() if r.check}


def test_fixed_offset_tails_and_ratio(spark):
    a = ["1.37", "2.48", "3.91", "5.02", "7.66", "9.15", "11.29", "12.83"]
    cells = table(spark, {"a": a, "b": [f"{float(x) + 3:.2f}" for x in a], "c": [f"{float(x) * 2:.2f}" for x in a]})
    numeric = C.decimal_cells(cells)
    pairs = L.pair_profile(numeric)
    found = {(r.col_a, r.col_b, r.check): r.severity for r in L.pair_checks(pairs).collect()}
    assert found[(0, 1, "fixed_offset")] == "high"
    assert found[(0, 2, "fixed_ratio")] == "high"
    tails = {(r.col_a, r.col_b, r.check) for r in L.tail_checks(L.tail_profile(L.text_cells(cells)), pairs).collect()}
    assert (0, 1, "integer_shift_decimal_tail_reuse") in tails


def test_quiet_columns(spark):
    rng = random.Random(1)
    cells = table(spark, {"a": [f"{rng.uniform(1, 90):.3f}" for _ in range(30)], "b": [f"{rng.uniform(1, 90):.3f}" for _ in range(30)]})
    numeric = C.decimal_cells(cells)
    assert L.pair_checks(L.pair_profile(numeric)).count() == 0
    assert L.column_triples(numeric).count() == 0
    assert checks(C.progressions(numeric)) == {}


def test_progressions_and_guards(spark):
    exact = table(spark, {"x": [3 + 2.5 * i for i in range(9)]})
    assert checks(C.progressions(C.decimal_cells(exact))) == {"arithmetic_progression": "medium"}
    near = table(spark, {"x": [0, 2, 4, 6, 8, 10, 12, 14, 16, 19, 21]})
    assert checks(C.progressions(C.decimal_cells(near))) == {"near_perfect_arithmetic_progression": "medium"}
    shuffled = [1.5 * i + 0.3 for i in range(12)]
    random.Random(2).shuffle(shuffled)
    found = checks(C.sorted_sequences(C.decimal_cells(table(spark, {"x": [f"{v:.1f}" for v in shuffled]}))))
    assert found == {"arithmetic_sequence_sorted": "medium"}
    index = list(range(1, 13))
    random.Random(4).shuffle(index)
    assert checks(C.sorted_sequences(C.decimal_cells(table(spark, {"x": index})))) == {}


def test_repeated_sweep_is_axis_like(spark):
    sweep = [1.0, 2.5, 2.7, 9.9, 3.1, 4.4]
    row = C.axis_like(C.decimal_cells(table(spark, {"x": sweep * 2}))).first()
    assert row.axis_like
    row = C.axis_like(C.decimal_cells(table(spark, {"x": sweep + list(reversed(sweep))}))).first()
    assert not row.axis_like


def test_triples(spark):
    a, b = [1.5, 2.25, 7, 9.5], [3, 4.75, 1, 2]
    cells = table(spark, {"a": a, "b": b, "sum": [x + y for x, y in zip(a, b)]})
    found = {(r.check, r.col_a, r.col_b, r.col_c) for r in L.column_triples(C.decimal_cells(cells)).collect()}
    assert found == {
        ("three_column_additive_relationship", 0, 1, 2),
        ("three_column_subtractive_relationship", 2, 0, 1),
        ("three_column_subtractive_relationship", 2, 1, 0),
    }


def test_near_duplicate_counts_equal_brute_force(spark):
    rng = random.Random(9)
    width, rows = 5, [tuple(str(rng.randint(0, 3)) for _ in range(5)) for _ in range(120)]
    cells = table(spark, {f"c{i}": [r[i] for r in rows] for i in range(width)})
    distinct = sorted(set(rows))
    counts = {1: 0, 2: 0}
    for x, y in itertools.combinations(distinct, 2):
        d = sum(p != q for p, q in zip(x, y))
        if d in counts:
            counts[d] += 1
    row = L.near_duplicate_rows(L.table_rows(cells)).first()
    assert (row.one_cell, row.two_cells) == (counts[1], counts[2])


def test_replicates_and_sequence_reuse(spark):
    values = [1.2, 3.4, 5.6, 2.2, 8.1, 9.9]
    cells = table(spark, {"a": values, "b": values, "c": values, "d": [9, 1, 2, 5, 7, 3]})
    numeric = C.decimal_cells(cells)
    row = L.identical_replicates(L.pair_profile(numeric), numeric).first()
    assert (row.layout, row.columns, row.severity) == ("consecutive", 3, "high")
    other = cells.unionByName(table(spark, {"z": [7, *values]}, table_id=2))
    reuse = L.sequence_reuse(C.decimal_cells(other), block=8).collect()
    assert any(r.table_a == 1 and r.table_b == 1 for r in reuse)


def test_scattered_replicates(spark):
    values = [1.2, 3.4, 5.6]
    numeric = C.decimal_cells(table(spark, {"a": values, "x": [5, 6, 1], "b": values, "y": [2, 9, 4], "c": values}))
    row = L.identical_replicates(L.pair_profile(numeric), numeric).first()
    assert (row.layout, row.columns) == ("non_consecutive", 3)


def test_bh_adjustment(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(p)], "t string, i int, p double")
    q = [r.q for r in C.bh_adjust(df, ["t"], order=["i"]).orderBy("i").collect()]
    assert [round(x, 6) for x in q] == [0.02, 0.04, 0.04, 0.02]


def test_zero_spread_and_profile(spark):
    cells = table(spark, {"group SD": ["0", "1.2", "0.4", "0"], "label": ["x", "y", "", "x"]})
    row = C.spread_columns(C.decimal_values(cells)).first()
    assert (row.zero_entries, row.severity) == (2, "high")
    profile = {r.header: r for r in A.column_profile(cells).collect()}
    assert profile["label"].dtype == "string" and profile["label"].missing == 1
    assert profile["group SD"].dtype == "float" and profile["group SD"].duplicates == 1


def test_votes_equal_the_full_profile(spark):
    """The vote and its second pass give the checks of the profile by difference, in and across tables."""
    rng = random.Random(12)
    rows = []
    series = [[rng.randrange(1000) for _ in range(40)] for _ in range(4)]
    for table in range(7):
        base = series[table % 4]
        shares = [1.0, 0.95, 0.9, 0.89, 0.5]
        columns = [base] + [[v + 7 if rng.random() < s else rng.randrange(999) for v in base] for s in shares]
        exact = [v + 3 for v in base]
        for i in rng.sample(range(40), 4):  # 36 of 40: the share is just reached
            exact[i] += rng.randrange(1, 50)
        for c, values in enumerate([*columns, exact]):
            rows += [(1, table, r, c, f"h{c}", f"{v}.25") for r, v in enumerate(values)]
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    numeric = C.decimal_cells(cells).cache()
    texts = L.text_cells(cells)
    for across in (False, True):
        full = L.pair_profile(numeric, across=across)
        votes = L.pair_votes(numeric, across=across)
        wanted = sorted(map(tuple, L.pair_checks(full).collect()), key=str)
        assert sorted(map(tuple, L.pair_checks(votes).collect()), key=str) == wanted
        assert any("partial_fixed_offset" in str(r) for r in wanted)
        tails = L.tail_checks(L.tail_profile(texts, across=across), full)
        got = L.tail_findings(texts, numeric, across=across)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, tails.collect()), key=str)


def test_blocks_pair_every_two_tables_once(spark):
    rows = [(1, t, 0, 0, "h", str(t)) for t in range(13)]
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    numeric = C.decimal_cells(cells, min_values=1)
    got = [(r.table_a, r.table_b) for r in L._positional_pairs(numeric, True).collect()]
    assert sorted(got) == [(a, b) for a in range(13) for b in range(a + 1, 13)]
    items = L.table_blocks(numeric).groupBy("_low", "_high", "pos").count().agg({"count": "max"}).first()[0]
    assert items <= 2 * L.TABLE_BLOCK


def test_highlight_offsets_and_constant_grid_columns(spark):
    rows = [(1, 1, r, c, str(v), "yellow" if r != 2 else None) for r in range(6) for c, v in enumerate((r * r, r * r + 5, r, r * r))]
    marked = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, value string, fill string")
    got = {(r.col_a, r.col_b, float(r.offset), r.n, r.severity) for r in A.highlight_offsets(marked).collect()}
    assert got == {(0, 1, 5.0, 5, "medium"), (0, 3, 0.0, 5, "high"), (1, 3, -5.0, 5, "medium")}
    cells = [(1, 0, r, 0, "7.10") for r in range(4)] + [(1, 0, r, 1, str(r)) for r in range(4)] + [(1, 0, r, 2, "3") for r in range(3)]
    grid = spark.createDataFrame(cells, "doc_id long, page long, grid_row long, grid_col int, text string")
    assert [tuple(r) for r in A.constant_grid_columns(grid).collect()] == [(1, 0, 1, 4, 7.1)]


def test_pairs_of_a_table_stay_in_one_task(spark):
    tables = [table(spark, {c: list(range(40)) for c in "abc"}, table_id=t, doc_id=t // 2) for t in range(4)]
    numeric = C.decimal_cells(functools.reduce(DataFrame.unionByName, tables))
    texts = L.text_cells(functools.reduce(DataFrame.unionByName, tables))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for across in (False, True):
            pairs = L._positional_pairs(numeric, across).select("table_a", "table_b", F.spark_partition_id().alias("p")).collect()
            assert len({(r.table_a, r.table_b, r.p) for r in pairs}) == len({(r.table_a, r.table_b) for r in pairs}) > 0
        tails = L._tail_rows(texts, ["doc_id", "table_id"]).select("table_id", F.spark_partition_id().alias("p")).collect()
        assert len({(r.table_id, r.p) for r in tails}) == 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_profiles_of_columns_longer_than_a_block(spark, monkeypatch):
    rng = random.Random(9)
    values = lambda n: [rng.choice([1, 2, 2, 5, 7.5]) for _ in range(n)]
    numeric = C.decimal_cells(table(spark, {"a": values(10), "b": values(40), "c": values(40)}))
    want = {tuple(r) for r in L.pair_profile(numeric).collect()}
    monkeypatch.setattr(L.R, "BLOCK", 16)
    assert {tuple(r) for r in L.pair_profile(numeric).collect()} == want and len(want) == 3


def test_profiles_shuffle_no_differences_of_short_columns(spark):
    numeric = C.decimal_cells(table(spark, {c: list(range(20)) for c in "abc"}))
    plan = L.pair_profile(numeric)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rows_that_lie_together_pair_like_others(spark):
    """Firm tables are put together without a shuffle of their own; gaps shift columns over chunks in loose ones."""
    rng = random.Random(5)
    rows = []
    for t in range(6):
        for r in range(40):
            for c in range(4):
                gap = t >= 3 and c == t - 3 and r < 9
                rows.append((t // 3, t, r, c, f"h{c}", "" if gap else f"{rng.randrange(9) + (c == 3) * 2}.25"))
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    plain = C.decimal_cells(cells, chunk_size=8)
    dealt = C.decimal_cells(cells, chunk_size=8, together=True)
    columns = ["doc_id", "table_id", "row_idx", "col_idx", "header", "text", "num", "pos", "n"]
    assert sorted(map(str, dealt.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))
    assert {r.table_id for r in dealt.filter("_loose").select("table_id").distinct().collect()} == {3, 4, 5}
    packed = dealt.groupBy("doc_id", "table_id", "_chunk", "_loose", "pos").agg(F.collect_list("num"))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and ", pos" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    texts = [L.text_cells(cells, chunk_size=8, together=x) for x in (False, True)]
    for across in (False, True):
        for run in (L.pair_profile, L.pair_votes):
            want, got = (sorted(map(str, run(x, across=across).collect())) for x in (plain, dealt))
            assert got == want and want
        want, got = (sorted(map(str, L.tail_findings(t, n, across=across).collect())) for t, n in zip(texts, (plain, dealt)))
        assert got == want and want


def test_packed_rows_are_shuffled_whole_and_pair_like_cells(spark):
    """Rows with their cells in ``items`` are not dealt out cell by cell; gaps, odd and missing texts change nothing."""
    from pyspark.sql import functions as F

    odd = ["", None, 'a"b\\', " 7.25\n", "\u2028{[1,2]}", "1e3", "-0.0000000001"]
    rng = random.Random(6)
    rows = []
    for t in range(6):
        for r in range(40):
            for c in range(4):
                gap = t >= 3 and c == t - 3 and r < 9
                text = odd[(r + c) % len(odd)] if gap or t == 1 and r % 11 == 0 else f"{rng.randrange(9) + (c == 3) * 2}.25"
                rows.append((t // 3, t, r, c, f"h{c}", text))
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    packed = cells.groupBy("doc_id", "table_id", "row_idx").agg(F.collect_list(F.struct("col_idx", "header", "text")).alias("items"))
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    view = lambda df, *c: sorted(map(str, df.select("doc_id", "table_id", "row_idx", "col_idx", "header", "_loose", *c).collect()))
    numbers = [C.decimal_cells(x, chunk_size=8, together=True) for x in (cells, packed)]
    texts = [L.text_cells(x, chunk_size=8, together=True) for x in (cells, packed)]
    assert view(numbers[0], "text", "num", "pos", "n") == view(numbers[1], "text", "num", "pos", "n")
    assert view(texts[0], "text", "tpos", "tn") == view(texts[1], "text", "tpos", "tn")
    for run in (lambda n, t: L.pair_profile(n), lambda n, t: L.pair_votes(n), lambda n, t: L.tail_findings(t, n)):
        want, got = (sorted(map(str, run(n, t).collect())) for n, t in zip(numbers, texts))
        assert got == want and want
    # what is dealt out holds a text a row, not a row a cell
    plan = numbers[1]._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(doc_id" in x and "REPARTITION" in x]
    assert len(dealt) == 1 and plan.index("Generate explode(") < plan.index("REPARTITION_BY_COL")


def test_dealt_rows_keep_every_number(spark):
    """Numbers survive the text form they are dealt out in, whatever their size and their zeros."""
    from decimal import Decimal

    numbers = [Decimal(x) for x in ("0", "100", "-0.5", "1E-10", "-0.0000000120", "9999999999999999999999999999.9999999999", "30.10")]
    items = [(i, f"h{i}", n, 7) for i, n in enumerate(numbers)]
    kind = "doc_id long, table_id long, _block long, pos long, items array<struct<col_idx:int, header:string, num:decimal(38,10), n:long>>"
    rows = spark.createDataFrame([(0, 1, 0, p, items) for p in range(3)], kind)
    dealt = L._dealt_flat(rows, 3, "pos")
    assert dealt.schema["items"].dataType.simpleString() == rows.schema["items"].dataType.simpleString()
    assert sorted(dealt.collect()) == sorted(rows.collect())


def test_digit_tests_parse_each_text_once(spark):
    """Last digits do not repeat the parsing of a text for every scale, terminal digits are counted in one pass."""
    cells = table(spark, {"a": [f"{i * 7 % 50}.{i % 10}5" for i in range(60)], "b": ["x", *range(59)]})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(C.round_bias(cells)).count("translate(") <= 8
    assert plan(C.terminal_digit_tests(cells)).count("translate(") == 0
    rows = {r.col_idx: r for r in C.round_bias(cells).collect()}
    assert (rows[0].n, rows[0].c5, rows[1].n, rows[1].c0) == (60, 60, 59, 6)


def test_rows_of_roles_need_no_sort_and_one_scan(spark):
    from verilens.operators import consistency as S

    cells = table(spark, {"n": [10, 20, "x", 30], "mean score": ["2.35", "2.5", "1", "3.333"], "sd": ["9.99", "1.0", "1", "0.9"], "percent": ["50", "33.3", "7", "12.5"]})
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    physical = S.debit_rows(cells)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in physical and "Join" not in plan(S.percent_rows(cells))
    row = S.role_rows(cells).filter("row_idx = 0").first()
    assert (row.n.num, row.mean.places, row.sd.num, row.percent.places, row.t) == (10.0, 2, 9.99, 0, None)
    got = {(r.row_idx, r.role, r.num, r.places, r.n) for r in S.sized_cells(cells, "mean", "percent").collect()}
    assert got == {
        (0, "mean", 2.35, 2, 10), (0, "percent", 50.0, 0, 10), (1, "mean", 2.5, 1, 20),
        (1, "percent", 33.3, 1, 20), (3, "mean", 3.333, 3, 30), (3, "percent", 12.5, 1, 30),
    }
    assert {r.row_idx for r in S.debit_rows(cells).collect()} == {0, 1, 3}


def test_rows_without_gaps_are_numbered_whole(spark):
    """Rows of tables without gaps get positions as they are, cells of the others one by one; pairs are those of cells."""
    rng = random.Random(8)
    rows = []
    for t in range(6):
        for r in range(40):
            for c in range(4):
                gap = t >= 3 and c == t - 3 and r < 9
                rows.append((t // 3, t, r, c, f"h{c}", "x" if gap else f"{rng.randrange(9) + (c == 3) * 2}.25"))
    rows += [(0, 0, r, c, f"h{c}", " ") for r in (40, 41) for c in range(4)]  # rows without any cell that counts
    rows += [(2, 6, r, 0, "twice", f"{r + k}.5") for r in range(9) for k in range(2)]  # a column twice in a row
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    packed = cells.groupBy("doc_id", "table_id", "row_idx").agg(F.shuffle(F.collect_list(F.struct("col_idx", "header", "text"))).alias("items"))
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    once = "table_id < 6"
    plain, dealt = C.decimal_cells(cells, chunk_size=8), L.number_rows(packed, chunk_size=8)
    texts = [L.text_cells(cells, chunk_size=8), L.text_rows(packed, chunk_size=8)]
    single = dealt.filter(once).select("doc_id", "table_id", "pos", F.explode("items").alias("c")).select("*", "c.*")
    columns = ["doc_id", "table_id", "col_idx", "header", "num", "pos", "n"]
    assert sorted(map(str, single.select(*columns).collect())) == sorted(map(str, plain.filter(once).select(*columns).collect()))
    assert dealt.filter("table_id = 6").select(F.explode("items")).count() == 18
    for run in (L.pair_profile, L.pair_votes, L.column_triples):
        want, got = (sorted(map(str, run(x.filter(once)).collect())) for x in (plain, dealt))
        assert got == want and (want or run is L.column_triples)
    want, got = (sorted(map(str, L.tail_findings(t.filter(once), n.filter(once)).collect())) for t, n in zip(texts, (plain, dealt)))
    assert got == want and want
    # tables without gaps: no row a cell is sorted or put together again
    firm = L.number_rows(packed.filter("table_id < 3 AND row_idx < 40"), chunk_size=8)
    plan = firm._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan


def test_near_rows_of_whole_and_long_tables(spark, monkeypatch):
    """Keys of tables that fit into a task are not shuffled; long tables and rows in two parts count the same."""
    rng = random.Random(9)
    rows = [(0, t, r, c, f"h{c}", str(rng.randrange(3))) for t, n in ((0, 30), (1, 70)) for r in range(n) for c in range(4)]
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    items = F.collect_list(F.struct("col_idx", "header", "text")).alias("items")
    packed = cells.groupBy("doc_id", "table_id", "row_idx", F.expr("row_idx = 3 AND col_idx > 1").alias("part")).agg(items)
    packed = spark.createDataFrame(packed.collect(), packed.schema).drop("part")  # row 3 comes in two parts
    want = {}
    for t in (0, 1):
        distinct = {tuple(x[5] for x in rows if x[1] == t and x[2] == r) for r in range(70)} - {()}
        apart = [sum(x != y for x, y in zip(a, b)) for a, b in itertools.combinations(distinct, 2)]
        want[t] = (apart.count(1), apart.count(2))
    found = lambda: {r.table_id: (r.one_cell, r.two_cells) for r in L.near_duplicate_rows(L.table_rows(packed)).collect()}
    assert found() == want
    plan = L.near_duplicate_rows(L.table_rows(packed))._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in x and "k1" in x for x in plan.splitlines())
    monkeypatch.setattr(L, "ROWS_OF_A_TASK", 50)
    assert found() == want


def test_rows_across_tables_are_grouped_by_hashes(spark):
    """What C14 shuffles and groups are hashes, not the texts of rows."""
    rows = [(0, t, r, c, "h", f"{r % (t + 2)} {c}") for t in range(3) for r in range(12) for c in range(3)]
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    out = L.cross_table_rows(L.table_rows(cells))
    assert [tuple(r) for r in out.collect()] == [(0, 3, 3, "high")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("cells" not in x for x in plan.splitlines() if x.strip(" +-:").startswith("Aggregate [doc_id"))


def test_table_chunk_shuffles_rows_as_one_text(spark):
    """Packed rows give the chunk of cells; odd and missing texts stay, rows behind the chunk are left out early."""
    odd = ["", None, 'a"b\\', " 7.25\n", "[1,2]"]
    rows = [(0, t, r << 42, c, f"h{c}", odd[(r + c) % 5]) for t in range(3) for r in range(20) for c in range(3)]
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    items = F.collect_list(F.struct("col_idx", "header", "text")).alias("items")
    packed = cells.groupBy("doc_id", "table_id", "row_idx", F.expr("row_idx = 0 AND col_idx > 1").alias("part")).agg(items)
    packed = spark.createDataFrame(packed.collect(), packed.schema).drop("part")  # the first row comes in two parts
    got = {(r.table_id, r.pos): (r["values"], r.has_more) for r in A.table_chunk(packed, 5, 9).collect()}
    assert got == {(t, p): ([odd[(p + c) % 5] for c in range(3)], True) for t in range(3) for p in range(5, 14)}
    assert sorted(map(str, A.table_chunk(packed, 5, 9).collect())) == sorted(map(str, A.table_chunk(cells, 5, 9).collect()))
    plan = A.table_chunk(packed.filter("row_idx > 0"), 5, 9)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_list" not in plan


def test_values_of_packed_rows_are_counted_where_their_table_lies(spark, monkeypatch):
    rows = [(0, t, r, c, f"h{c}", ["7", "x", f"{r % 3}.50", None][(c + (t > 1) * r // 9) % 4]) for t in range(3) for r in range(30) for c in range(4)]
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    packed = cells.groupBy("doc_id", "table_id", "row_idx").agg(F.collect_list(F.struct("col_idx", "header", "text")).alias("items"))
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    view = lambda df: sorted(map(str, df.collect()))
    want = view(C.repeated_values(C.decimal_values(cells)))
    assert view(C.repeated_values(packed)) == want and want
    plan = C.repeated_values(packed)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in x and "num" in x for x in plan.splitlines())
    monkeypatch.setattr(C, "ROWS_OF_A_TASK", 20)
    assert view(C.repeated_values(packed)) == want


def test_table_audit_of_packed_rows_needs_one_pass(spark, monkeypatch):
    rows = [(0, t, r, c, f"h{c}", ["7", "x", f"{r % 3}.50", None][(c + (t > 1) * r // 9) % 4]) for t in range(3) for r in range(30) for c in range(4)]
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    packed = cells.groupBy("doc_id", "table_id", "row_idx").agg(F.collect_list(F.struct("col_idx", "header", "text")).alias("items"))
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    view = lambda df: sorted(map(str, A.table_audit(df).collect()))
    want = view(A.column_profile(cells))
    profile = A.column_profile(packed, outliers=False)
    assert view(profile) == want and want
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and sum("Exchange" in x for x in plan.splitlines()) == 1
    monkeypatch.setattr(A, "ROWS_OF_A_TASK", 20)
    assert view(A.column_profile(packed, outliers=False)) == want


def odd_tables(spark, docs=2, tables=3, rows=24):
    """Packed rows and their cells, with gaps, long and large numbers, odd texts and rows in two parts."""
    rng = random.Random(14)
    odd = ["", None, 'a"b\\', " 7.25\n", " {[1,2]}", "1e3", "-0.0000000001", "n/a", "1,234.50", "5%", "3.éx", "4.5", "12.34\n"]
    made = []
    for t in range(docs * tables):
        kinds = ["money", "long", "large", "money", "odd", "money"]
        if t % tables != 1:
            base = [round(rng.uniform(-50, 50), 2) for _ in range(rows)]
        for r in range(rows):
            for c, kind in enumerate(kinds[: 3 + t % 4]):
                if kind == "money":
                    text = f"{base[r] + (3 if c else 0) * (r % 24 > 0 or t < 3):.2f}"
                elif kind == "long":
                    text = f"{base[r] / 7 * (10 if t % 2 else 1e4):.{rng.choice([10, 10, 9, 12])}f}"
                elif kind == "large":
                    text = str(rng.choice([10**20, 10**19, 5, 0, -(10**21), 7]) + (t % 2) * r)
                else:
                    text = odd[rng.randrange(len(odd))]
                if rng.random() < 0.05 and t > 2:
                    text = odd[rng.randrange(len(odd))]
                if not (t == 5 and c == 0 and r < 9):
                    made.append((t // tables, t, r, c, "other" if t == 4 and c == 1 and r % 2 else f"h{c}", text))
        made += [(t // tables, t, r, 7, "sum", f"{2 * base[r] + 3:.2f}") for r in range(rows)]
        made += [(t // tables, t, r, 8 + k, f"copy {k}", f"{base[r]:.2f}") for r in range(rows) for k in range(3) if t % 2]
    kind = "doc_id long, table_id long, row_idx long, col_idx int, header string, text string"
    cells = spark.createDataFrame(made, kind)
    part = F.when((F.col("table_id") == 3) & (F.col("col_idx") > 2), 1).otherwise(0)
    packed = cells.groupBy("doc_id", "table_id", "row_idx", part).agg(F.shuffle(F.collect_list(F.struct("col_idx", "header", "text"))).alias("items"))
    packed = packed.select("doc_id", "table_id", "row_idx", "items")
    return spark.createDataFrame(made, kind), spark.createDataFrame(packed.collect(), packed.schema)


def ordered(df, *dropped):
    return sorted(map(str, df.drop(*dropped).collect()))


def test_whole_tables_pair_like_cells(spark, monkeypatch):
    """Columns of tables that fit into a task are compared there, with the rows of the general way; long ones go it."""
    cells, packed = odd_tables(spark)
    numeric, texts = C.decimal_cells(cells).cache(), L.text_cells(cells).cache()
    for limit in (1 << 16, 23):
        monkeypatch.setattr(L, "ROWS_OF_A_TASK", limit)
        for across in (False, True):
            want = L.pair_profile(numeric, across=across)
            got = L.pair_profile(packed, across=across)
            assert got.columns == want.columns and ordered(got) == ordered(want) != []
            assert ordered(L.pair_checks(L.pair_votes(packed, across=across))) == ordered(L.pair_checks(want)) != []
        triples = ordered(L.column_triples(packed).select(*sorted(L.column_triples(numeric).columns)))
        assert triples == ordered(L.column_triples(numeric).select(*sorted(L.column_triples(numeric).columns))) != []
        assert {"plus", "minus", "same"} <= {"plus" if "additive" in t else "minus" if "subtractive" in t else "same" for t in triples}
        assert ordered(L.packed_tail_findings(packed)) == ordered(L.tail_findings(texts, numeric)) != []
        want = L.identical_replicates(L.pair_votes(numeric), numeric)
        assert ordered(L.packed_replicates(packed)) == ordered(want) != []
    short, long = L.dealt_whole(packed, ["doc_id"])
    assert long is not None and short.count() == 0


def test_whole_documents_pair_like_cells(spark):
    cells, packed = odd_tables(spark)
    numeric, texts = C.decimal_cells(cells).cache(), L.text_cells(cells).cache()
    short, long = L.dealt_whole(packed, ["doc_id"])
    assert long is None
    assert ordered(L.whole_tail_findings(short, across=True)) == ordered(L.tail_findings(texts, numeric, across=True))
    want = L.sequence_reuse(numeric, block=8)
    got = L.whole_sequence_reuse(short).select(*want.columns)
    assert ordered(got) == ordered(want) != []


def test_whole_tables_are_shuffled_once(spark):
    """No pair, cell or position is shuffled: a plan of pairs deals out rows, once."""
    _, packed = odd_tables(spark)
    for found in (L.pair_votes(packed), L.pair_profile(packed, across=True), L.column_triples(packed)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


def test_kernels_hold_long_tables_over_batches(spark, monkeypatch):
    from verilens.functions import whole_kernels as K

    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc_id": [0] * 7, "table_id": [b // 3] * 7}) for b in range(9)]
    monkeypatch.setattr(K, "ROWS", 5)
    got = [t["table_id"].to_pylist() for t in K._grouped(iter(batches), ["doc_id", "table_id"])]
    assert sum(got, []) == [t for t in range(3) for _ in range(21)]
    assert sum(len(set(g)) for g in got) == 3  # no table is cut
    texts = ["1.25", ".75", "1.2", "x", "3.456", "12.éx", "7.1\n", "7.12\n", "a.b.c", "9.99", ""]
    codes = K.tail_codes(pa.array(["pad", *texts])[1:])
    tails = [K._tail(t) for t in texts]
    assert [c < 0 for c in codes] == [t is None for t in tails]
    assert len(set(codes[codes >= 0])) == len({t for t in tails if t})
