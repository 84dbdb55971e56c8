from itertools import combinations

import pytest
from pyspark.sql import functions as F

from verilens.operators import consistency as S
from verilens.operators import text as T


def blocks(spark, *lines):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, block_no int, text string")


def test_patterns_are_case_sensitive_where_needed(spark):
    found = {r.label: r.matches for r in T.labelled_matches(blocks(spark, "todo el mundo", "TODO: fix [?] TODO"), T.PLACEHOLDERS).collect()}
    assert found == {"TODO": 2, "[?]": 1}


def test_longest_phrase_wins(spark):
    phrases = spark.createDataFrame([("deep learning",), ("deep learning model",), ("深学习",)], "phrase string")
    text = blocks(spark, "A deep learning model, then Deep  learning; deeper learning 深学习")
    found = {r.phrase: r.matches for r in T.phrase_matches(text, phrases).collect()}
    assert found == {"deep learning model": 1, "deep learning": 1, "深学习": 1}


def test_reference_conflicts(spark):
    refs = T.references(
        blocks(
            spark,
            "[1] Smith J. A title. 2019. 10.1000/abc",
            "[2] Smith J. A title. 2019. 10.1000/abc.",
            "[3] Smith J. A title. 2021. 10.1000/abc",
            "plain prose",
        )
    )
    rows = T.conflicting_references(refs).collect()
    assert [(r.id, r.conflict, r.severity) for r in rows] == [("doi:10.1000/abc", "year", "high")]


def test_redaction(spark):
    row = spark.range(1).select(
        T.redacted(F.lit("key sk-abcdefghijklmnop1234 at /home/ann/x --token s3cr3t Bearer abcdefgh1")).alias("t"),
        T.redacted_map(F.create_map(F.lit("password"), F.lit("x"), F.lit("note"), F.lit("fine"))).alias("m"),
    ).first()
    assert row.t == "key <redacted:api_key> at /<redacted:user_home>/x --token <redacted:password> <redacted:bearer_token>"
    assert row.m == {"password": "<redacted:api_key>", "note": "fine"}


def test_duplicate_passages_equal_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [
        " ".join(base),
        " ".join(base),
        " ".join(base[:59] + ["other"]),
        " ".join(["start", *base]),
        " ".join(f"z{i}" for i in range(60)),
        " ".join(base[::-1]),
    ]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.9:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {}
    for i in range(len(texts)):
        want[find(i)] = want.get(find(i), 0) + 1
    got = {r.first_block: r.members for r in T.duplicate_passages(blocks(spark, *texts)).collect()}
    assert got == {k: v for k, v in want.items() if v >= 2}


def test_copy_loop(spark):
    unit = "alpha beta gamma delta epsilon"
    filler = " ".join(f"f{i}" for i in range(30))
    row = T.copy_loops(blocks(spark, f"{unit} {filler} {unit}")).first()
    assert (row.repetitions, row.severity) == (2, "low") and row.span >= 30


def test_statcheck(spark):
    rows = S.statcheck(
        blocks(
            spark,
            "We found t(28) = 2.20, p = .04.",
            "We found t(28) = 2.20, p = .30.",
            "A one-tailed test gave t(28) = 1.75, p = .045.",
            "And z = 1.96, p = .05; F(2, 45) = 3.10, p = .001; t(10) = 9.1, p = .000.",
        )
    ).collect()
    by = {(r.block_no, r.stat): r for r in rows}
    assert not by[(0, "t")].inconsistent
    assert by[(1, "t")].inconsistent and by[(1, "t")].decision_error
    assert by[(2, "t")].one_tailed_exempt and not by[(2, "t")].inconsistent
    assert not by[(3, "z")].inconsistent and by[(3, "F")].inconsistent and by[(3, "t")].p_zero


@pytest.mark.parametrize(("mean", "n", "ok"), [(5.19, 28, False), (5.18, 28, True), (3.45, 20, True), (3.47, 20, False)])
def test_grim(spark, mean, n, ok):
    row = spark.range(1).select(S.grim_consistent(F.lit(mean), F.lit(n), F.lit(2)).alias("g")).first()
    assert row.g is ok


def test_debit_and_grimmer(spark):
    row = spark.range(1).select(
        S.debit(F.lit(0.5), F.lit(0.51), F.lit(20), F.lit(2), F.lit(2)).alias("good"),
        S.debit(F.lit(0.5), F.lit(0.20), F.lit(20), F.lit(2), F.lit(2)).alias("bad"),
        S.sd_possible(F.lit(2.0), F.lit(9.0), F.lit(20), F.lit(2), F.lit(2)).alias("wild"),
        S.sd_possible(F.lit(3.0), F.lit(1.2), F.lit(20), F.lit(2), F.lit(2)).alias("fine"),
    ).first()
    assert row.good.consistent and not row.bad.consistent
    assert row.wild is False and row.fine is True


def test_plain_names_start_behind_accented_letters(spark):
    df = spark.createDataFrame([("ÉONLE POUR, Anna Berg",)], "text string")
    assert df.select(T.plain_authors(F.col("text"))).first()[0] == 2


def test_contexts_are_sought_only_where_statements_stand(spark):
    docs = spark.createDataFrame(
        [(1, "Funding: none.\nNo conflicts. " + "x" * 40 + " funded by us"), (2, "plain"), (3, None)], "doc_id long, text string"
    )
    found = {(r.doc_id, r.category): (r.present, r.contexts) for r in T.compliance(docs).collect()}
    assert found[1, "funding"] == (True, 2) and found[1, "conflict_of_interest"] == (True, 1)
    assert found[2, "funding"] == (False, 0) and found[3, "funding"][0] is None
    missing = T.missing_statements(docs)
    assert {r.doc_id: len(r.missing) for r in missing.collect()} == {1: 3, 2: 5}
    assert "regexp_extract_all" not in missing._jdf.queryExecution().optimizedPlan().toString()


def test_shingles_of_passages_are_shuffled_once(spark):
    sets = spark.createDataFrame([("a", 1, [1, 2, 3]), ("a", 2, [3, 4]), ("b", 3, [3, 5]), ("b", 4, [5])], "doc_id string, first_block long, s array<long>")
    found = T._shared_shingles(sets)
    assert {tuple(r) for r in found.collect()} == {("a", 1, 3, 3, 2), ("a", 2, 2, 3, 2), ("b", 3, 2, 5, 2), ("b", 4, 1, 5, 2)}
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # the adaptive plan's name and one
