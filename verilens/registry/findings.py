"""Findings algebra over findings derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import cap_severity, downgrade_severity, severity_rank, short_id
from ..operators import findings as A
from . import corpus as X
from .columns import with_sql

QUERIES = {}


def add(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


_WEAK = "\"check\" IN ('matching_decimal_tails', 'arithmetic_progression')"
_TAIL = "(\"check\" = 'matching_decimal_tails' AND n >= 6 AND match_fraction >= 0.95)"
_OFF = "\"check\" IN ('fixed_offset', 'cross_table_fixed_offset') AND \"offset\" <> 0"
_CLEAN = "round(abs(\"offset\") * 100) % 5 = 0"
_RULES = [
    (f"slot = 0 AND {_WEAK} AND NOT {_TAIL} AND rank > 2", "2"),
    (f"slot = 0 AND {_TAIL} AND prior >= 2 AND rank < 3", "3"),
    (f"slot = 0 AND {_OFF} AND n >= 8 AND {_CLEAN} AND prior >= 2 AND rank < 3", "3"),
    (f"slot = 0 AND {_OFF} AND NOT (n >= 8 AND {_CLEAN}) AND rank > 2", "2"),
    ("slot = 0 AND n > 0 AND n < 5 AND rank > 1", "1"),
    (f"slot = 0 AND n >= 5 AND n < 12 AND rank > 2 AND {_WEAK} AND NOT {_TAIL}", "2"),
    (
        "slot = 0 AND blanks AND rank > 1 AND NOT (\"check\" <> 'arithmetic_progression' AND n >= 5)",
        "greatest(rank - 1, 1)",
    ),
    (
        "slot = 0 AND \"check\" = 'cross_table_fixed_offset' AND n >= 50 AND \"offset\" = 0 AND prior = 3 AND rank < 3",
        "3",
    ),
    ("slot = 0 AND \"check\" = 'excel_fabrication_span' AND high_members >= 5 AND n >= 8 AND rank < 3 AND prior >= 2", "3"),
    ("slot = 0 AND \"check\" = 'excel_fabrication_span' AND rank > 2 AND NOT (high_members >= 5 AND n >= 8)", "2"),
    ("slot = 0 AND \"check\" = 'high_duplicate_rate' AND rank > 2", "2"),
    ("slot = 7 AND rank > 1", "1"),
    ("slot = 1 AND \"check\" = 'ela' AND rank > 1", "1"),
    ("slot = 1 AND \"check\" = 'copy_move' AND secondary AND rank > 1", "1"),
    ("slot = 3 AND rank > 2 AND ratio < 0.85", "2"),
    ("generic AND rank > 1", "1"),
    ("small AND rank > 2", "2"),
    ("slot IN (4, 5) AND rank > 2", "2"),
]


def _recalibrated() -> str:
    parts = ["r0 AS (SELECT *, rank AS prior FROM f)"]
    for i, (gate, value) in enumerate(_RULES):
        parts.append(
            f"r{i + 1} AS (SELECT * REPLACE (CASE WHEN {gate} THEN {value} ELSE rank END AS rank) FROM r{i})"
        )
    parts.append(f"cal AS (SELECT * FROM r{len(_RULES)})")
    return ", ".join(parts)


CAL = _recalibrated()
NAME = "['info','low','medium','high','critical'][{} + 1]"


@add(
    "f1_recalibrated",
    with_sql(
        X.FINDINGS_SQL, CAL,
        select=f"SELECT finding_id, {NAME.format('prior')} AS prior, {NAME.format('rank')} AS severity FROM cal",
    ),
)
def f1(spark, sf_dir):
    return A.recalibrate(X.findings(spark, sf_dir)).select("finding_id", "prior", "severity")


KEY = """keyed AS (SELECT *, CASE WHEN slot = 7 THEN 'image_noise_inconsistency|soft|x'
 WHEN slot = 1 AND "check" IN ('ela', 'copy_move') THEN 'image_forensics|soft|x'
 WHEN "check" = '' THEN NULL
 WHEN left_table IS NOT NULL THEN detector || '|' || "check" || '|' || least(left_table, right_table) || '|' || greatest(left_table, right_table)
 WHEN "check" IN ('fixed_offset', 'matching_decimal_tails', 'high_duplicate_rate') THEN detector || '|' || "check" || '|table ' || (e % 5) || '|self'
 WHEN page_a IS NOT NULL THEN detector || '|' || "check" || '|' || least(page_a || ':' || index_a, page_b || ':' || index_b) || '|' ||
 greatest(page_a || ':' || index_a, page_b || ':' || index_b) END AS cluster_key FROM cal)"""


@add(
    "f2_pair_cluster_keys",
    with_sql(X.FINDINGS_SQL, CAL, KEY, select="SELECT finding_id, cluster_key FROM keyed"),
)
def f2(spark, sf_dir):
    return X.findings(spark, sf_dir).select("finding_id", A.pair_cluster_key().alias("cluster_key"))


SATELLITES = """rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster_key ORDER BY n DESC, rank DESC, finding_id) AS place FROM keyed),
dem AS (SELECT *, CASE WHEN cluster_key IS NOT NULL AND place > 3 AND rank > 1 THEN rank - 1 ELSE rank END AS rank1 FROM rk),
hi AS (SELECT *, count(*) FILTER (rank = 3 AND place <= 3) OVER (PARTITION BY doc_id, cluster_key ORDER BY place) AS h FROM dem),
final AS (SELECT *, CASE WHEN cluster_key IS NOT NULL AND place <= 3 AND rank1 = 3 AND h > 2 THEN 2 ELSE rank1 END AS rank2 FROM hi)"""


@add(
    "w6_cluster_satellites",
    with_sql(
        X.FINDINGS_SQL, CAL, KEY, SATELLITES,
        select=f"SELECT finding_id, {NAME.format('rank2')} AS severity FROM final",
    ),
)
def w6(spark, sf_dir):
    out = A.demote_satellites(A.recalibrate(X.findings(spark, sf_dir)))
    return out.select("finding_id", "severity")


@add(
    "j30_j31_bridges",
    with_sql(
        X.FINDINGS_SQL,
        """ends AS (SELECT *, CASE WHEN (page_a, index_a) <= (page_b, index_b) THEN [page_a, index_a, page_b, index_b]
 ELSE [page_b, index_b, page_a, index_a] END AS k FROM f WHERE page_a IS NOT NULL),
img AS (SELECT doc_id, k, min(finding_id) AS src FROM ends x WHERE detector = 'image_forensics' AND "check" = 'texture_overlap'
 AND (page_a, index_a) <> (page_b, index_b) AND NOT EXISTS (SELECT 1 FROM ends y WHERE y.detector = 'image_dup' AND y.doc_id = x.doc_id AND y.k = x.k) GROUP BY ALL),
pan AS (SELECT doc_id, octet % 6 AS p, panel_a, min(finding_id) AS src FROM f WHERE "check" = 'panel_sift_match' GROUP BY ALL)""",
        select=f"""SELECT doc_id, 'image_dup' AS detector, src AS source, {NAME.format('greatest(2, f.rank)')} AS severity FROM img JOIN f USING (doc_id) WHERE f.finding_id = src
 UNION ALL SELECT doc_id, 'panel_duplicate', src, {NAME.format('greatest(2, f.rank)')} FROM pan JOIN f USING (doc_id) WHERE f.finding_id = src""",
    ),
)
def j30(spark, sf_dir):
    out = A.bridge(X.findings(spark, sf_dir)).filter(A.raw("pass") == "forensics_bridge")
    return out.select("doc_id", "detector", A.raw("source_finding_id").alias("source"), "severity")


RULE_ROWS = [
    (0, "forensics_production_image_reuse", "image_forensics", None, ["full_image_duplicate"], None),
    (1, "forensics_texture_overlap_cells", "image_forensics", None,
     ["texture_overlap", "near_texture_overlap", "rotated_texture_overlap"], None),
    (2, "forensics_panel_sift_within_figure", "image_forensics", None, ["panel_sift_match"], None),
    (3, "title_ends_in_seven", "image_dup", None, None, "signal \\d?7 in"),
]
RULE_SCHEMA = (
    "rule_no int, rule_id string, detector string, publisher string, kinds array<string>, title_regex string"
)


@add(
    "j32_publisher_baselines",
    with_sql(
        X.FINDINGS_SQL,
        select="""SELECT finding_id, CASE WHEN rank < 3 THEN NULL WHEN detector = 'image_forensics' AND "check" = 'full_image_duplicate' THEN 'forensics_production_image_reuse'
 WHEN "check" = 'texture_overlap' THEN 'forensics_texture_overlap_cells' WHEN "check" = 'panel_sift_match' THEN 'forensics_panel_sift_within_figure'
 WHEN detector = 'image_dup' AND regexp_matches(lower(title), 'signal \\d?7 in') THEN 'title_ends_in_seven' END AS baseline_rule FROM f""",
    ),
)
def j32(spark, sf_dir):
    rules = spark.createDataFrame(RULE_ROWS, RULE_SCHEMA)
    return A.apply_baselines(X.findings(spark, sf_dir), rules).select("finding_id", "baseline_rule")


@add(
    "f3_calibration_stats",
    with_sql(
        X.FINDINGS_SQL, CAL, KEY, SATELLITES,
        select=f"SELECT {NAME.format('prior')} AS prior, {NAME.format('rank2')} AS severity, count(*) AS findings, count(*) FILTER (prior <> rank2) AS changed "
        "FROM final GROUP BY prior, rank2",
    ),
)
def f3(spark, sf_dir):
    return A.calibration_stats(A.demote_satellites(A.recalibrate(X.findings(spark, sf_dir))))


@add("f3_calibrated")
def f3_full(spark, sf_dir):
    rules = spark.createDataFrame(RULE_ROWS, RULE_SCHEMA)
    return A.calibrate(X.findings(spark, sf_dir), rules).select(
        "finding_id", "detector", "prior", "severity", "baseline_rule"
    )


GROUPS = """kinds AS (SELECT *, CASE WHEN detector IN ('image_forensics', 'image_dup', 'image_noise_inconsistency') THEN 'image'
 WHEN detector IN ('table_relationships', 'table_round_bias') THEN 'table' WHEN detector = 'pdf_metadata' THEN 'metadata' ELSE 'text' END AS kind FROM f),
grp AS (SELECT *, CASE WHEN kind = 'image' THEN 'image|detector:' || detector WHEN kind = 'table' THEN 'table|' ||
 coalesce(least(left_table, right_table) || ' <-> ' || greatest(left_table, right_table), 'table ' || (e % 5)) || '|' ||
 CASE WHEN "check" = '' THEN 'general' ELSE regexp_replace("check", '^cross_table_', '') END
 WHEN detector = 'pdf_metadata' THEN 'metadata|family:metadata' WHEN detector = 'text_patterns' THEN 'text|family:text'
 ELSE kind || '|family:' || detector END AS group_key FROM kinds),
iss AS (SELECT 'ISS-' || left(sha1(kind || '|' || group_key), 12) AS issue_id, doc_id, kind, group_key, max(rank) AS rank,
 list_sort(list(DISTINCT detector)) AS detectors, count(*) AS member_count FROM grp GROUP BY ALL)"""


@add(
    "f6_f8_issues",
    with_sql(
        X.FINDINGS_SQL, GROUPS,
        select=f"SELECT * EXCLUDE (rank), {NAME.format('rank')} AS severity FROM iss",
    ),
)
def f8(spark, sf_dir):
    return A.issues(X.findings(spark, sf_dir))


@add("f5_image_issue_keys")
def f5_keys(spark, sf_dir):
    images = X.findings(spark, sf_dir).filter(F.col("detector").isin(*A.IMAGE_DETECTORS))
    keys = A.image_issue_keys(images)
    return keys.groupBy("doc_id", "group_key").agg(F.count(F.lit(1)).alias("findings"))


VERDICT = """ver AS (SELECT doc_id, count(*) FILTER (rank >= 3) AS high, count(*) FILTER (rank = 2) AS medium, count(*) FILTER (rank = 1) AS low,
 count(*) AS issues FROM iss GROUP BY ALL)"""


@add(
    "f9_verdicts",
    with_sql(
        X.FINDINGS_SQL, GROUPS, VERDICT,
        select="SELECT *, round(least(1.0, (high + medium * 0.4 + low * 0.1) / 3), 4) AS score, CASE WHEN high >= 1 THEN 'flagged' "
        "WHEN medium >= 3 THEN 'suspect' ELSE 'clean' END AS verdict FROM ver",
    ),
)
def f9(spark, sf_dir):
    return A.verdicts(A.issues(X.findings(spark, sf_dir)))


@add(
    "k2_ordered_issues",
    with_sql(
        X.FINDINGS_SQL, GROUPS,
        select=f"SELECT issue_id, doc_id, {NAME.format('rank')} AS severity, member_count FROM iss ORDER BY rank DESC, member_count DESC, issue_id",
    ),
)
def k2(spark, sf_dir):
    return A.ordered_issues(A.issues(X.findings(spark, sf_dir))).select(
        "issue_id", "doc_id", "severity", "member_count"
    )


@add(
    "k3_top_issues",
    with_sql(
        X.FINDINGS_SQL, GROUPS,
        "t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, member_count DESC, issue_id) AS place FROM iss)",
        select="SELECT doc_id, issue_id, place FROM t WHERE place <= 5",
    ),
)
def k3(spark, sf_dir):
    return A.top_issues(A.issues(X.findings(spark, sf_dir))).select("doc_id", "issue_id", "place")


ITEMS = """items AS (SELECT *, CASE WHEN left_table IS NOT NULL AND left_table <> right_table THEN 'cross_table' WHEN slot = 0 THEN 'column_pair'
 WHEN page_a IS NOT NULL THEN 'image_pair' WHEN slot = 7 THEN 'image' WHEN slot = 3 THEN 'table' ELSE 'text' END AS kind,
 CASE WHEN slot = 0 THEN 'Table ' || (e % 5) || CASE WHEN e % 9 = 0 THEN ' / col_1' ELSE ' / dose' END WHEN page_a IS NOT NULL THEN 'page ' || page_a || ' image ' || index_a END AS side_a,
 CASE WHEN slot = 0 THEN 'Table ' || CASE WHEN left_table IS NOT NULL THEN e % 7 ELSE e % 5 END || ' / dose b' WHEN page_a IS NOT NULL THEN 'page ' || page_b || ' image ' || index_b END AS side_b FROM f)"""


@add(
    "f11_pair_items",
    with_sql(X.FINDINGS_SQL, ITEMS, select="SELECT finding_id, kind, side_a, side_b, true AS locatable FROM items"),
)
def f11(spark, sf_dir):
    return A.pair_items(X.findings(spark, sf_dir)).select(
        "finding_id", "kind", "side_a", "side_b", "locatable"
    )


@add(
    "k4_ordered_cases",
    with_sql(
        X.FINDINGS_SQL, ITEMS,
        select="SELECT doc_id, finding_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, side_a IS NULL, finding_id) AS case_no FROM items",
    ),
)
def k4(spark, sf_dir):
    return A.ordered_cases(A.pair_items(X.findings(spark, sf_dir))).select(
        "doc_id", "finding_id", "case_no"
    )


@add(
    "f12_pair_summary",
    with_sql(
        X.FINDINGS_SQL, ITEMS,
        select="""SELECT doc_id, count(*) AS items, count(*) FILTER (rank = 3) AS high, count(*) FILTER (rank = 2) AS medium, count(*) FILTER (rank = 1) AS low,
 count(*) FILTER (rank = 0) AS info, count(*) FILTER (kind IN ('cross_table', 'column_pair')) AS table_pairs, count(*) FILTER (kind = 'image_pair') AS image_pairs,
 0 AS insufficient, CASE WHEN count(*) FILTER (rank = 3) > 0 THEN 'red' WHEN count(*) FILTER (rank = 2) > 0 THEN 'yellow' ELSE 'green' END AS light FROM items GROUP BY doc_id""",
    ),
)
def f12(spark, sf_dir):
    return A.pair_summary(A.pair_items(X.findings(spark, sf_dir)))


@add(
    "f17_pair_locations",
    with_sql(
        X.FINDINGS_SQL, ITEMS,
        """g AS (SELECT doc_id, least(side_a, side_b) AS side_a, greatest(side_a, side_b) AS side_b, count(*) AS findings, count(DISTINCT title) AS titles
 FROM items WHERE side_a IS NOT NULL GROUP BY doc_id, least(side_a, side_b), greatest(side_a, side_b)),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY findings DESC, side_a, side_b) AS place FROM g)""",
        select="SELECT * FROM r",
    ),
)
def f17(spark, sf_dir):
    return A.pair_locations(A.pair_items(X.findings(spark, sf_dir)))


@add(
    "f10_pattern_groups",
    with_sql(
        X.FINDINGS_SQL,
        select=f"SELECT doc_id, pattern, count(*) AS findings, {NAME.format('max(rank)')} AS severity, arg_min(title, finding_id) AS sample FROM f WHERE pattern IS NOT NULL GROUP BY doc_id, pattern",
    ),
)
def f10(spark, sf_dir):
    return A.pattern_groups(X.findings(spark, sf_dir))


NORM = "trim(regexp_replace(regexp_replace(lower({}), '\\d+', 'N', 'g'), '\\s+', ' ', 'g'))"


@add(
    "f13_finding_clusters",
    with_sql(
        X.FINDINGS_SQL,
        f"g AS (SELECT doc_id, left(sha1(detector || '|' || severity || '|' || {NORM.format('title')} || '|' || {NORM.format('location')}), 16) AS fingerprint, "
        "count(*) AS members, min(finding_id) AS representative FROM f GROUP BY ALL)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY members DESC, fingerprint) AS place FROM g)",
        select="SELECT *, (place - 1) // 12 AS batch FROM r",
    ),
)
def f13(spark, sf_dir):
    return A.finding_clusters(X.findings(spark, sf_dir))


COLOUR = "CASE WHEN rank >= 3 THEN 'red' WHEN rank = 2 THEN 'yellow' ELSE 'green' END"


@add(
    "f16_merged_patterns",
    with_sql(
        X.FINDINGS_SQL,
        select=f"SELECT doc_id, detector, {COLOUR} AS colour, {NORM.format('title')} AS pattern, count(*) AS findings, count(DISTINCT location) AS locations, "
        f"arg_min(title, finding_id) AS sample FROM f GROUP BY doc_id, detector, {COLOUR}, {NORM.format('title')}",
    ),
)
def f16(spark, sf_dir):
    return A.merged_patterns(X.findings(spark, sf_dir))


@add(
    "f18_evidence_index",
    with_sql(
        X.FINDINGS_SQL,
        select=f"SELECT finding_id, CASE WHEN slot = 0 THEN 'tables' WHEN slot = 2 THEN 'images' ELSE 'other' END AS category, severity, rank / 4.0 AS confidence FROM f",
    ),
)
def f18(spark, sf_dir):
    categories = spark.createDataFrame(
        [("table_relationships", "tables"), ("image_dup", "images")], "detector string, category string"
    )
    return A.evidence_index(X.findings(spark, sf_dir), categories).drop("doc_id")


@add(
    "f19_promoted_severity",
    with_sql(
        X.FINDINGS_SQL,
        select=f"SELECT finding_id, {NAME.format('greatest(rank, CASE WHEN e % 50 = 0 THEN 4 ELSE 0 END, CASE WHEN e % 7 = 0 THEN 3 ELSE 0 END, CASE WHEN e % 64 <= 2 THEN 3 ELSE 0 END)')} AS severity FROM f",
    ),
)
def f19(spark, sf_dir):
    e = F.col("finding_id").cast("long")
    return X.findings(spark, sf_dir).select(
        "finding_id", A.promote_severity(F.col("severity"), e % 64, e % 7 == 0, e % 50 == 0).alias("severity")
    )


@add(
    "f20_overall_light",
    with_sql(
        X.FINDINGS_SQL,
        "c AS (SELECT doc_id, count(*) FILTER (rank >= 3) AS red, count(*) FILTER (rank = 2) AS yellow, count(*) FILTER (rank < 2) AS green FROM f GROUP BY ALL)",
        select="SELECT *, CASE WHEN red >= 30 THEN 'red' WHEN red >= 1 OR yellow >= 10 THEN 'yellow' ELSE 'green' END AS light FROM c",
    ),
)
def f20(spark, sf_dir):
    return A.overall_light(X.findings(spark, sf_dir))


@add(
    "f14_run_rollup",
    with_sql(
        "r AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'skipped' ELSE 'ok' END AS status, "
        "event_id % 5 AS n_findings, CAST(floor(value) AS BIGINT) AS duration_ms FROM events)",
        select="SELECT doc_id, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, "
        "count(*) FILTER (status = 'error') AS error, sum(n_findings) AS findings, sum(duration_ms) AS duration_ms, max(duration_ms) AS slowest_ms FROM r GROUP BY doc_id",
    ),
)
def f14(spark, sf_dir):
    runs = X.read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("doc_id"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "view", "skipped")
        .otherwise("ok")
        .alias("status"),
        (F.col("event_id") % 5).alias("n_findings"),
        F.floor("value").alias("duration_ms"),
    )
    return A.run_rollup(runs)


@add(
    "p12_selected_findings",
    with_sql(
        X.FINDINGS_SQL,
        select="SELECT finding_id, doc_id, \"check\" FROM f WHERE detector = 'table_relationships' AND severity = 'high'",
    ),
)
def p12(spark, sf_dir):
    out = A.select_findings(X.findings(spark, sf_dir), "table_relationships", "high")
    return out.select("finding_id", "doc_id", "check")


@add(
    "h27_severity_algebra",
    with_sql(
        X.FINDINGS_SQL,
        select=f"SELECT finding_id, rank, {NAME.format('least(rank, 2)')} AS capped, {NAME.format('greatest(rank - 1, 0)')} AS lowered FROM f",
    ),
)
def h27(spark, sf_dir):
    return X.findings(spark, sf_dir).select(
        "finding_id",
        severity_rank("severity").alias("rank"),
        cap_severity("severity", "medium").alias("capped"),
        downgrade_severity("severity").alias("lowered"),
    )


@add(
    "h24_short_ids",
    with_sql(
        X.FINDINGS_SQL,
        select="SELECT finding_id, left(sha1(detector || '|' || title), 12) AS id FROM f",
    ),
)
def h24(spark, sf_dir):
    return X.findings(spark, sf_dir).select(
        "finding_id", short_id(F.col("detector"), F.col("title")).alias("id")
    )


@add(
    "h28_template_explanations",
    with_sql(
        X.FINDINGS_SQL,
        select="""SELECT finding_id, CASE WHEN contains("check", 'fixed_offset') THEN 'Two columns differ by a constant over ' || n || ' rows.'
 WHEN contains("check", 'decimal_tail') THEN 'Decimal digits repeat between columns in ' || n || ' rows.' WHEN contains("check", 'duplicate') THEN
 'Values repeat more often than expected in ' || n || ' values.' WHEN contains("check", 'progression') THEN 'Values form a regular series of ' || n || ' steps.'
 ELSE 'Signal ''' || "check" || ''' needs manual review.' END AS explanation FROM f""",
    ),
)
def h28(spark, sf_dir):
    return X.findings(spark, sf_dir).select(
        "finding_id", A.template_explanation().alias("explanation")
    )


@add(
    "h30_normalized_titles",
    with_sql(X.FINDINGS_SQL, select=f"SELECT finding_id, {NORM.format('title')} AS title FROM f"),
)
def h30(spark, sf_dir):
    return X.findings(spark, sf_dir).select(
        "finding_id", A.normalized_title(F.col("title")).alias("title")
    )
