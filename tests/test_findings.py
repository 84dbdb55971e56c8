from pyspark.sql import functions as F

from verilens.model import FINDINGS
from verilens.operators import findings as A
from verilens.operators import lookups as L


def findings(spark, *rows):
    full = [
        (str(i), "d1", r["detector"], r.get("check", ""), r["severity"], r.get("title", "t"), r.get("location", "Table 1, columns 1 and 2"), r.get("raw", {}))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, FINDINGS)


def test_recalibration_rules(spark):
    rel = "table_relationships"
    df = findings(
        spark,
        {"detector": rel, "check": "matching_decimal_tails", "severity": "medium", "raw": {"n": "9", "match_fraction": "1.0"}},
        {"detector": rel, "check": "matching_decimal_tails", "severity": "high", "raw": {"n": "9", "match_fraction": "0.8"}},
        {"detector": rel, "check": "fixed_offset", "severity": "high", "raw": {"n": "9", "offset": "0.37"}},
        {"detector": rel, "check": "fixed_offset", "severity": "medium", "raw": {"n": "9", "offset": "1.5"}},
        {"detector": "image_noise_inconsistency", "severity": "high"},
        {"detector": "compliance", "severity": "high"},
    )
    out = {r.finding_id: (r.severity, r.reasons) for r in A.recalibrate(df).collect()}
    assert out["0"] == ("high", ["perfect_decimal_tail_boost_high"])
    assert out["1"][0] == "medium"
    assert out["2"] == ("medium", ["nonzero_offset_cap_medium"])
    assert out["3"] == ("high", ["clean_nonzero_offset_boost_high"])
    assert out["4"][0] == "low" and out["5"][0] == "medium"


def test_satellites_and_bridge(spark):
    one = {"detector": "table_relationships", "check": "fixed_offset", "severity": "high"}
    df = findings(spark, *[{**one, "raw": {"n": str(50 - i), "offset": "0"}} for i in range(5)])
    out = [r.severity for r in A.demote_satellites(A.recalibrate(df)).orderBy("finding_id").collect()]
    assert out == ["high", "high", "medium", "medium", "medium"]
    ends = {"page_a": "1", "index_a": "0", "page_b": "2", "index_b": "1"}
    hit = {"detector": "image_forensics", "check": "texture_overlap", "severity": "low", "raw": ends}
    bridged = A.bridge(findings(spark, hit, {**hit})).filter("detector = 'image_dup'").collect()
    assert [b.severity for b in bridged] == ["medium"]


def test_image_findings_merge_by_shared_and_near_ends(spark):
    raw = lambda a, b, h: {"page_a": str(a), "index_a": "0", "page_b": str(b), "index_b": "0", "phash_a": h}
    df = findings(
        spark,
        {"detector": "image_dup", "severity": "high", "raw": raw(1, 2, "ffffffffffffffff")},
        {"detector": "image_dup", "severity": "low", "raw": raw(2, 3, "0000000000000000")},
        {"detector": "image_dup", "severity": "low", "raw": raw(7, 8, "fffffffffffffff0")},
        {"detector": "image_dup", "severity": "low", "raw": raw(5, 6, "00000000ffffffff")},
    )
    keys = {r.finding_id: r.group_key for r in A.image_issue_keys(df).collect()}
    assert keys["0"] == keys["1"] == keys["2"] != keys["3"]
    issues = A.issues(df, A.image_issue_keys(df)).collect()
    assert sorted(i.member_count for i in issues) == [1, 3]


def test_verdicts(spark):
    df = findings(spark, *[{"detector": d, "severity": "medium"} for d in ("pdf_metadata", "compliance", "supplementary", "paper_mill_template")])
    row = A.verdicts(A.issues(df)).first()
    assert (row.verdict, row.medium, row.score) == ("suspect", 4, round(1.6 / 3, 4))


def test_citation_scores(spark):
    cites = spark.createDataFrame(
        [(1, "[Smith 2019]", "Smith", "2019"), (1, "(Jones, 2020)", "Jones", "2020"), (1, "(WHO, 2020)", "WHO", "2020"), (1, "(Brown 2011)", "Brown", "2011")],
        "doc_id long, raw string, author string, year string",
    )
    works = spark.createDataFrame(
        [("smith 2019", "Any", 2018, ["Smith"]), ("brown 2011", "Any", 2001, ["Other"])],
        "key string, title string, year int, authors array<string>",
    )
    out = {r.author: r.status for r in L.verify_citations(cites, works).collect()}
    assert out == {"Smith": "match", "Jones": "not_found", "WHO": "grey_literature", "Brown": "mismatch"}


def test_multiset_missing_uses_three_precisions(spark):
    q = spark.createDataFrame([("f", v) for v in (1.2345, 1.2345, 2.5, 7.0)], "k string, num double")
    r = spark.createDataFrame([("f", v) for v in (1.2345, 1.2349, 2.501)], "k string, num double")
    row = L.multiset_missing(q, r, ["k"]).first()
    assert (row.n, row.missing) == (4, 1)


def test_nearest_caption(spark):
    captions = spark.createDataFrame([(1, 0, "far", 10, 0, 50), (1, 0, "near", 80, 0, 50), (1, 0, "aside", 90, 500, 600)], "doc_id long, page int, caption string, bottom int, left int, right int")
    tables = spark.createDataFrame([(1, 0, 9, 100, 0, 60)], "doc_id long, page int, table_id int, top int, left int, right int")
    assert L.nearest_caption(captions, tables).first().caption == "near"
    assert L.figure_key(F.lit("x")) is not None
