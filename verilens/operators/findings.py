"""Findings algebra: calibration, clustering, issues, verdicts, reports (F*, J30-J34, W6, K2-K5, P12).

Findings carry their evidence as ``raw`` MAP<STRING, STRING>.  Image ends are
the keys ``page_a``, ``index_a``, ``phash_a`` and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import hex_to_long
from ..model import severity_name, severity_rank, short_id
from ..plans.components import connected_components
from ..plans.hamming import hash_pairs
from ..session import cut_lineage

# Check and detector classes.
WEAK_CHECKS = (
    "cross_table_matching_decimal_tails",
    "matching_decimal_tails",
    "terminal_digit_concentration",
    "terminal_digit_pair_concentration",
    "cross_table_terminal_digit_concentration",
    "ones_decimal_mirror",
    "near_perfect_arithmetic_progression",
    "arithmetic_progression",
)
STRONG_CHECKS = (
    "cross_table_fixed_offset",
    "cross_table_partial_fixed_offset",
    "cross_table_repeated_values",
    "fixed_offset",
    "partial_fixed_offset",
    "high_duplicate_rate",
    "improbable_repeated_values",
    "multi_column_high_duplicate_rate",
    "zero_variance",
    "zero_standard_deviation_entries",
    "integer_shift_decimal_tail_reuse",
    "three_column_additive_relationship",
    "three_column_subtractive_relationship",
    "excel_fabrication_span",
    "sequence_reuse",
    "identical_parallel_replicates",
    "fixed_ratio",
)
HEADER_IMMUNE_CHECKS = (
    "fixed_offset",
    "partial_fixed_offset",
    "cross_table_fixed_offset",
    "cross_table_partial_fixed_offset",
    "cross_table_repeated_values",
    "high_duplicate_rate",
    "multi_column_high_duplicate_rate",
    "matching_decimal_tails",
    "cross_table_matching_decimal_tails",
    "integer_shift_decimal_tail_reuse",
    "integer_part_digit_change_decimal_tail_reuse",
    "three_column_additive_relationship",
    "three_column_subtractive_relationship",
    "excel_fabrication_span",
    "sequence_reuse",
    "identical_parallel_replicates",
    "fixed_ratio",
)
HOST_CLUSTER_CHECKS = (
    "fixed_offset",
    "partial_fixed_offset",
    "high_duplicate_rate",
    "mirror_symmetry",
    "matching_decimal_tails",
    "integer_shift_decimal_tail_reuse",
    "integer_part_digit_change_decimal_tail_reuse",
    "cross_table_partial_fixed_offset",
    "identical_parallel_replicates",
    "sequence_reuse",
)
OFFSET_CHECKS = (
    "fixed_offset",
    "partial_fixed_offset",
    "cross_table_fixed_offset",
    "cross_table_partial_fixed_offset",
)
IMAGE_DETECTORS = (
    "image_dup",
    "image_forensics",
    "image_sift_copymove",
    "sift_copymove",
    "panel_duplicate",
    "panel_dup",
    "page_raster_dup",
    "image_noise_inconsistency",
    "image_statistics",
    "imagehash_phash",
    "imagehash_ahash",
    "imagehash_dhash",
    "imagehash_whash",
    "image_ssim",
    "ai_generated_figure",
    "photoholmes",
)
TABLE_DETECTORS = (
    "table_relationships",
    "table_benford",
    "table_duplicate_row",
    "table_near_duplicate_row",
    "table_outlier",
    "table_round_bias",
    "table_cross_copy",
    "table_forensics",
    "table_file_metadata",
    "table_highlight_focus",
    "stat_grim",
    "stat_percent",
    "stat_pvalue",
    "figure_grim",
    "figure_table_ocr",
    "figure_table_consistency",
    "chart_data_extract",
    "source_data_consistency",
)
METADATA_DETECTORS = (
    "metadata",
    "pdf_metadata",
    "compliance",
    "supplementary",
    "author_emails",
    "data_availability_concern",
    "paper_mill_template",
    "paper_mill_authorship",
)
FAMILIES = {
    "metadata": "metadata",
    "pdf_metadata": "metadata",
    "author_emails": "metadata",
    "compliance": "compliance",
    "supplementary": "supplementary",
    "data_availability_concern": "compliance",
    "paper_mill_template": "paper_mill",
    "paper_mill_authorship": "paper_mill",
    "text_patterns": "text",
    "text_tortured_phrases": "text",
    "figure_stat_text": "text",
    "ref_duplicate": "references",
    "ref_format_anomaly": "references",
}
CROSS_IMAGE_KINDS = (
    "cross_image_sift",
    "texture_overlap",
    "near_texture_overlap",
    "rotated_texture_overlap",
)
DOI_PUBLISHERS = {
    "10.1371": "plos",
    "10.3389": "frontiers",
    "10.1038": "springer_nature",
    "10.1007": "springer",
    "10.1136": "bmj",
    "10.7759": "cureus",
}
SOFT_KINDS = ("ela", "jpeg_ghost", "copy_move", "image_forensics_summary", "")


def raw(name: str) -> Column:
    return F.try_element_at(F.col("raw"), F.lit(name))


def number(name: str) -> Column:
    return raw(name).try_cast("double")


def check_of() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("check"), raw("check"), raw("kind"), F.lit(""))))


def count_of() -> Column:
    keys = ("n", "matching_pairs", "match_count", "inlier_count", "repeat_count")
    return F.coalesce(*[number(k).cast("long") for k in keys], F.lit(0).cast("long"))


def match_fraction() -> Column:
    n = count_of()
    matched = F.coalesce(number("matching_pairs"), number("matching_rows"), number("match_count"))
    return F.coalesce(
        number("match_fraction"),
        F.when(n > 0, matched / n),
        F.when((n > 0) & check_of().isin("fixed_offset", "cross_table_fixed_offset"), 1.0),
        F.lit(0.0),
    )


def _on_grid(x: Column, steps: float, tolerance: float) -> Column:
    return F.abs(x * steps - F.rint(x * steps)) < tolerance


def recalibrate(findings: DataFrame) -> DataFrame:
    """Evidence rules on severity, each leaving a reason (F1)."""
    # Shared inputs become columns first, so that they are computed once per row.
    findings = findings.withColumns(
        {
            "_det": F.lower("detector"),
            "_check": check_of(),
            "_n": count_of(),
            "_frac": match_fraction(),
            "_offset": number("offset"),
            "_members": F.coalesce(number("high_member_count"), F.lit(0.0)),
            "_repeats": F.coalesce(number("repeat_count"), F.lit(0.0)),
        }
    )
    detector, check, n = F.col("_det"), F.col("_check"), F.col("_n")
    prior = F.lower("severity")
    serious = prior.isin("medium", "high")
    table = (
        (detector == "table_relationships")
        | check.startswith("cross_table")
        | check.isin(*STRONG_CHECKS, *WEAK_CHECKS)
    )
    tail = (
        check.isin(
            "matching_decimal_tails",
            "cross_table_matching_decimal_tails",
            "integer_shift_decimal_tail_reuse",
        )
        & (n >= 6)
        & (F.col("_frac") >= 0.95)
    )
    weak = check.isin(*WEAK_CHECKS) & ~tail
    offset = F.col("_offset")
    size = F.abs(offset)
    clean = _on_grid(size, 10.0, 1e-9) | (
        _on_grid(size, 100.0, 1e-6) & (F.pmod(F.rint(size * 100), F.lit(5)) == 0)
    )
    shifted = check.isin(*OFFSET_CHECKS) & offset.isNotNull() & (offset != 0)
    blank = lambda c: c.isNotNull() & (
        F.lower(F.trim(c)).isin("", "none", "null", "nan") | F.trim(c).rlike(r"(?i)^col[_\s]?\d+$")
    )
    blanks = blank(raw("left_column")) | blank(raw("right_column")) | blank(raw("column"))
    immune = check.isin(*HEADER_IMMUNE_CHECKS) & (n >= 5)
    high_members = F.col("_members")
    rate = F.coalesce(
        F.nullif(number("duplicate_rate"), F.lit(0.0)),
        F.nullif(number("rate"), F.lit(0.0)),
        number("repeat_fraction"),
        F.lit(0.0),
    )
    repeats = F.col("_repeats")
    full_copy = (rate >= 0.85) | ((n > 0) & (repeats / F.greatest(n, F.lit(1)) >= 0.85))
    span = check == "excel_fabrication_span"
    generic = F.lower(F.trim(F.coalesce(raw("matched_paper_id"), F.lit(""))))
    round_ratio = F.coalesce(number("ratio"), number("zero_five_ratio"), F.lit(0.0))
    secondary = F.coalesce(raw("secondary").isin("true", "1", "True"), F.lit(False))
    duplicates = check.isin(
        "high_duplicate_rate",
        "improbable_repeated_values",
        "multi_column_high_duplicate_rate",
        "duplicate_excess",
    )
    exact_reuse = check.isin(
        "cross_table_repeated_values", "cross_table_fixed_offset", "cross_table_partial_fixed_offset"
    )
    forensics = detector.isin("image_forensics", "imagehash_dup")
    cross_paper = detector == "cross_paper_image"
    generic_id = generic.isin("original", "paper", "main", "document", "file", "image", "") | generic.rlike(
        "^[0-9a-f]{10,40}$"
    )
    solid = (high_members >= 5) & (n >= 8)
    # (gate, rank must be above, rank must be below, new rank or None to lower by one, reason)
    rules = [
        (table & weak, 2, 9, 2, "weak_check_cap_medium"),
        (table & tail & serious, -1, 3, 3, "perfect_decimal_tail_boost_high"),
        (table & shifted & (n >= 8) & clean & serious, -1, 3, 3, "clean_nonzero_offset_boost_high"),
        (table & shifted & ~((n >= 8) & clean), 2, 9, 2, "nonzero_offset_cap_medium"),
        (table & (n > 0) & (n < 5), 1, 9, 1, "small_n"),
        (table & (n >= 5) & (n < 12) & weak, 2, 9, 2, "modest_n_weak_check"),
        (table & blanks & ~immune, 1, 9, None, "empty_or_placeholder_column"),
        (table & blanks & immune, -1, -1, 0, "empty_header_immune_fabrication_check"),
        (
            table & exact_reuse & (n >= 50) & (F.coalesce(offset, F.lit(0.0)) == 0) & (prior == "high"),
            -1, 3, 3, "large_n_strong_cross_table",
        ),
        (table & span & solid & serious, -1, 3, 3, "excel_span_boost_high_members"),
        (table & span & ~solid, 2, 9, 2, "excel_span_cap_medium"),
        (
            table & duplicates & (~full_copy | ((n > 0) & (n < 20))),
            2, 9, 2, "duplicate_excess_cap_medium",
        ),
        (detector == "image_noise_inconsistency", 1, 9, 1, "noise_inconsistency_low"),
        (forensics & (check == "vertical_gel_seam"), 2, 9, 2, "gel_seam_cap_medium"),
        (
            (detector == "image_forensics") & check.isin("ela", "jpeg_ghost", "image_forensics_summary"),
            1, 9, 1, "forensics_soft_signal_cap_low",
        ),
        (forensics & (check == "copy_move") & secondary, 1, 9, 1, "secondary_copy_move"),
        ((detector == "table_round_bias") & (round_ratio < 0.85), 2, 9, 2, "round_bias_cap_medium"),
        (cross_paper & generic_id, 1, 9, 1, "cross_paper_generic_id_demote"),
        (
            cross_paper & raw("substantial_image").isin("false", "False", "0"),
            2, 9, 2, "cross_paper_small_asset_cap_medium",
        ),
        (
            (detector == "figure_table_ocr") & (check == "ocr_table_recovered"),
            1, 9, 1, "ocr_recovery_info_cap",
        ),
        (
            (detector == "figure_table_ocr") & (check == "ocr_column_zero_variance"),
            2, 9, 2, "ocr_zero_var_cap_medium",
        ),
        (
            detector.isin("pdf_metadata", "compliance", "supplementary", "text_patterns"),
            2, 9, 2, "meta_compliance_cap_medium",
        ),
    ]
    steps = F.array_compact(
        F.array(
            *[
                F.when(
                    gate,
                    F.struct(
                        F.lit(above).alias("above"),
                        F.lit(below).alias("below"),
                        F.lit(-1 if value is None else value).alias("value"),
                        F.lit(reason).alias("reason"),
                    ),
                )
                for gate, above, below, value, reason in rules
            ]
        )
    )

    def apply_rule(state: Column, step: Column) -> Column:
        noted = step["below"] < 0
        fires = (state["rank"] > step["above"]) & (state["rank"] < step["below"])
        changed = F.when(step["value"] < 0, state["rank"] - 1).otherwise(step["value"])
        return F.struct(
            F.when(fires, changed).otherwise(state["rank"]).alias("rank"),
            F.when(fires | noted, F.array_append(state["reasons"], step["reason"]))
            .otherwise(state["reasons"])
            .alias("reasons"),
        )

    start = F.struct(
        F.least(severity_rank("severity"), F.lit(3)).alias("rank"),
        F.expr("array()").cast("array<string>").alias("reasons"),
    )
    folded = findings.withColumn("prior", prior).withColumn(
        "_state", F.aggregate(steps, start, apply_rule)
    )
    return (
        folded.withColumn("severity", severity_name(F.col("_state.rank")))
        .withColumn("reasons", F.col("_state.reasons"))
        .drop("_state", "_det", "_check", "_n", "_frac", "_offset", "_members", "_repeats")
    )


def _table_key(label: Column) -> Column:
    s = F.regexp_replace(F.trim(F.lower(F.coalesce(label, F.lit("")))), r"\s+", " ")
    s = F.regexp_replace(s, r"\bin\s+sfig\.?\s*\d+\b", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def host_of(location: Column) -> Column:
    """The table part of a location, before its columns."""
    return F.regexp_extract(location, r"(?is)^(.*?)(?:,\s*columns?\b.*)?$", 1)


def pair_cluster_key() -> Column:
    """Key of findings about one relation; NULL outside clusters (F2)."""
    detector, check = F.lower("detector"), check_of()
    page = F.coalesce(
        raw("page"), F.nullif(F.regexp_extract("location", r"(?i)page\s+(\d+)", 1), F.lit("")), F.lit("x")
    )
    soft = (detector == "image_noise_inconsistency") | (
        (detector == "image_forensics") & check.isin(*SOFT_KINDS)
    )
    left, right = _table_key(raw("left_table")), _table_key(raw("right_table"))
    host = _table_key(host_of(F.col("location")))
    end_a = F.concat_ws(":", raw("page_a"), raw("index_a"))
    end_b = F.concat_ws(":", raw("page_b"), raw("index_b"))
    images = raw("page_a").isNotNull() & raw("page_b").isNotNull()
    return (
        F.when(soft, F.concat_ws("|", detector, F.lit("soft"), page))
        .when(check == "", F.lit(None).cast("string"))
        .when(
            (left != "") | (right != ""),
            F.concat_ws("|", detector, check, F.least(left, right), F.greatest(left, right)),
        )
        .when(
            check.isin(*HOST_CLUSTER_CHECKS) & (host != ""),
            F.concat_ws("|", detector, check, host, F.lit("self")),
        )
        .when(
            images, F.concat_ws("|", detector, check, F.least(end_a, end_b), F.greatest(end_a, end_b))
        )
    )


def demote_satellites(findings: DataFrame, top_k: int = 3, max_high: int = 2) -> DataFrame:
    """Keep the top of each cluster, lower the rest, keep at most two highs.

    Only members that can still be high or kept need an order, so a hot cluster
    is cut to its leading members per part before the ranking window.
    """
    keyed = findings.withColumn("cluster_key", pair_cluster_key()).withColumn("_n", count_of())
    order = [F.col("_n").desc(), severity_rank("severity").desc(), F.col("finding_id")]
    lone = keyed.filter("cluster_key IS NULL")
    member = keyed.filter("cluster_key IS NOT NULL").withColumn(
        "_part", F.pmod(F.xxhash64("finding_id"), F.lit(64))
    )
    by_part = W.partitionBy("doc_id", "cluster_key", "_part").orderBy(*order)
    local = member.withColumn("_lr", F.row_number().over(by_part))
    leaders = local.filter(F.col("_lr") <= top_k)
    ranked = leaders.withColumn(
        "_r", F.row_number().over(W.partitionBy("doc_id", "cluster_key").orderBy(*order))
    )
    in_top = ranked.filter(F.col("_r") <= top_k)
    highs = F.count_if(F.col("severity") == "high").over(
        W.partitionBy("doc_id", "cluster_key").orderBy("_r").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    top = in_top.withColumn("_h", highs).select(
        "finding_id",
        "doc_id",
        F.when((F.col("severity") == "high") & (F.col("_h") > max_high), F.lit("cluster_max_high")).alias("_why"),
        F.lit(True).alias("_kept"),
    )
    joined = member.drop("_part").join(top, ["finding_id", "doc_id"], "left")
    kept = F.coalesce("_kept", F.lit(False))
    rank = severity_rank("severity")
    lowered = F.when(~kept & (rank > 1), rank - 1).when(F.col("_why").isNotNull(), 2).otherwise(rank)
    reason = F.when(~kept & (rank > 1), F.lit("cluster_satellite")).otherwise(F.col("_why"))
    out = joined.withColumn("_reason", reason).withColumn("severity", severity_name(lowered))
    out = out.withColumn(
        "reasons",
        F.when(F.col("_reason").isNotNull(), F.array_append("reasons", F.col("_reason"))).otherwise(
            F.col("reasons")
        ),
    ).drop("_why", "_kept", "_reason")
    return lone.unionByName(out.select(*lone.columns)).drop("_n")


def bridge(findings: DataFrame) -> DataFrame:
    """Mirror cross-image forensics hits as image and panel duplicates."""
    ends = F.array_sort(
        F.array(
            F.struct(raw("page_a").try_cast("int").alias("p"), raw("index_a").try_cast("int").alias("i")),
            F.struct(raw("page_b").try_cast("int").alias("p"), raw("index_b").try_cast("int").alias("i")),
        )
    )
    panel = F.concat_ws(":", raw("page"), raw("index"), raw("panel_a"), raw("panel_b"))

    def mirrored(kinds: tuple[str, ...], target: str, key: Column, usable: Column, title: str):
        have = (
            findings.filter((F.col("detector") == target) & usable)
            .select("doc_id", key.alias("_key"))
            .distinct()
        )
        sources = findings.filter(
            (F.col("detector") == "image_forensics") & check_of().isin(*kinds) & usable
        ).withColumn("_key", key)
        first = (
            sources.join(have, ["doc_id", "_key"], "left_anti")
            .groupBy("doc_id", "_key")
            .agg(F.min_by(F.struct("finding_id", "severity", "location", "raw", check_of().alias("k")), "finding_id").alias("s"))
        )
        return first.select(
            short_id(F.col("doc_id"), F.lit(target), F.col("s.finding_id")).alias("finding_id"),
            "doc_id",
            F.lit(target).alias("detector"),
            F.col("s.k").alias("check"),
            severity_name(F.greatest(severity_rank(F.col("s.severity")), F.lit(2))).alias("severity"),
            F.lit(title).alias("title"),
            F.col("s.location").alias("location"),
            F.map_concat(
                F.map_filter("s.raw", lambda k, v: ~k.isin("pass", "source_finding_id")),
                F.create_map(
                    F.lit("pass"), F.lit("forensics_bridge"), F.lit("source_finding_id"), F.col("s.finding_id")
                ),
            ).alias("raw"),
        )

    two_ends = raw("page_a").isNotNull() & raw("page_b").isNotNull() & (ends[0] != ends[1])
    panels = raw("panel_a").isNotNull() & raw("panel_b").isNotNull()
    return (
        findings.unionByName(
            mirrored(
                CROSS_IMAGE_KINDS, "image_dup", ends.cast("string"), two_ends,
                "Near-duplicate image / region (forensics bridge)",
            )
        ).unionByName(
            mirrored(
                ("panel_sift_match",), "panel_duplicate", panel, panels,
                "Near-duplicate panels (forensics bridge)",
            )
        )
    )


def resolve_publisher(docs: DataFrame) -> DataFrame:
    """Publisher from argument, DOI prefix, metadata or text.

    ``docs(doc_id, publisher, doi, metadata, text)``.
    """
    pairs = [F.lit(v) for item in DOI_PUBLISHERS.items() for v in item]
    table = F.create_map(*pairs)
    prefix = lambda c: F.regexp_extract(c, r"(10\.\d{4,9})/", 1)
    norm = lambda c: F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), F.lit(""))
    return docs.select(
        "doc_id",
        F.coalesce(
            norm(F.col("publisher")),
            F.try_element_at(table, prefix(F.col("doi"))),
            F.try_element_at(table, prefix(F.col("metadata"))),
            F.try_element_at(table, prefix(F.col("text"))),
        ).alias("publisher"),
    )


def apply_baselines(findings: DataFrame, rules: DataFrame, publishers: DataFrame | None = None) -> DataFrame:
    """High findings of known benign classes become medium; the first rule wins.

    ``rules(rule_no, rule_id, detector, publisher, kinds ARRAY, title_regex)`` is
    a short configuration table; Spark broadcasts it by its size.
    """
    high = findings.filter("severity = 'high'")
    if publishers is not None:
        high = high.join(publishers.select(F.col("doc_id"), F.col("publisher").alias("_pub")), "doc_id", "left")
    else:
        high = high.withColumn("_pub", F.lit(None).cast("string"))
    r = rules.select(
        "rule_no",
        "rule_id",
        F.col("detector").alias("_det"),
        F.col("publisher").alias("_rp"),
        "kinds",
        "title_regex",
    )
    fits = (
        (F.col("_rp").isNull() | (F.coalesce("_pub", F.lit("")).contains(F.col("_rp"))))
        & (F.col("kinds").isNull() | F.array_contains(F.coalesce("kinds", F.array(F.lit(""))), check_of()))
        & (
            F.col("title_regex").isNull()
            | F.regexp_like(F.col("title"), F.concat(F.lit("(?i)"), F.coalesce("title_regex", F.lit(""))))
        )
    )
    first = (
        high.join(r, high["detector"] == r["_det"])
        .filter(fits)
        .groupBy("doc_id", "finding_id")
        .agg(F.min_by("rule_id", "rule_no").alias("baseline_rule"))
    )
    return findings.join(first, ["doc_id", "finding_id"], "left").withColumn(
        "severity",
        F.when(F.col("baseline_rule").isNotNull(), F.lit("medium")).otherwise(F.col("severity")),
    )


def calibrate(
    findings: DataFrame, rules: DataFrame | None = None, publishers: DataFrame | None = None
) -> DataFrame:
    """Bridges, evidence rules, cluster demotion, publisher rules, in this order.

    Later steps read the recalibrated findings several times, so they are
    written once.
    """
    scored = cut_lineage(recalibrate(bridge(findings)))
    out = demote_satellites(scored)
    return apply_baselines(out, rules, publishers) if rules is not None else out


def calibration_stats(calibrated: DataFrame) -> DataFrame:
    """Findings per severity before and after, and how many changed."""
    return calibrated.groupBy("prior", "severity").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("prior") != F.col("severity")).alias("changed"),
    )


# --------------------------------------------------------------------------- issues


def kind_of(detector: Column) -> Column:
    return (
        F.when(detector.isin(*IMAGE_DETECTORS), "image")
        .when(detector.isin(*TABLE_DETECTORS), "table")
        .when(detector.isin(*METADATA_DETECTORS), "metadata")
        .otherwise("text")
    )


def family_of(detector: Column) -> Column:
    """Detectors that share one issue."""
    pairs = [F.lit(v) for item in FAMILIES.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), detector), detector)


def table_group_key() -> Column:
    """Table identity and check cluster of a table finding."""
    norm = lambda c: F.nullif(
        F.regexp_replace(F.trim(F.lower(c)), r"\s+", " "), F.lit("")
    )
    left, right = norm(raw("left_table")), norm(raw("right_table"))
    sides = F.when(
        left.isNotNull() | right.isNotNull(),
        F.concat_ws(
            " <-> ",
            F.array_sort(F.array(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))),
        ),
    )
    host = host_of(F.col("location"))
    label = norm(F.regexp_extract(host, r"(?i)^\s*((?:table|fig(?:ure)?)\s*\.?\s*[^,;]*)", 1))
    identity = F.coalesce(norm(raw("fig_name")), norm(raw("table_id")), sides, label, norm(host))
    cluster = F.coalesce(
        F.nullif(F.regexp_replace(check_of(), "^cross_table_", ""), F.lit("")), F.lit("general")
    )
    return F.when(
        identity.isNotNull(), F.concat_ws("|", F.lit("table"), identity, cluster)
    ).otherwise(
        F.concat_ws("|", F.lit("table"), F.concat(F.lit("detector:"), F.col("detector")), cluster)
    )


def image_nodes(findings: DataFrame) -> DataFrame:
    """(doc, finding, node, phash) of every image, page or panel a finding touches."""
    img = lambda page, index, phash: F.when(
        page.isNotNull(),
        F.struct(
            F.when(index.isNotNull(), F.concat_ws(":", F.lit("img"), page, index))
            .otherwise(F.concat_ws(":", F.lit("page"), page))
            .alias("node"),
            phash.alias("phash"),
        ),
    )
    panel = lambda page, p: F.when(
        p.isNotNull(),
        F.struct(
            F.concat_ws(":", F.lit("panel"), page, p).alias("node"),
            F.lit(None).cast("string").alias("phash"),
        ),
    )
    is_panel = raw("panel_a").isNotNull() & raw("panel_b").isNotNull()
    nodes = F.when(
        is_panel,
        F.array(
            panel(F.coalesce(raw("page_a"), raw("page")), raw("panel_a")),
            panel(F.coalesce(raw("page_b"), raw("page")), raw("panel_b")),
        ),
    ).otherwise(
        F.array(
            img(raw("page_a"), raw("index_a"), raw("phash_a")),
            img(raw("page_b"), raw("index_b"), raw("phash_b")),
            img(raw("page"), F.coalesce(raw("index"), raw("image_index")), raw("phash")),
        )
    )
    return findings.select("doc_id", "finding_id", F.explode(F.array_compact(nodes)).alias("n")).select(
        "doc_id",
        "finding_id",
        F.concat_ws("/", "doc_id", "n.node").alias("node"),
        F.col("n.phash").alias("phash"),
    )


def image_issue_keys(findings: DataFrame, radius: int = 4) -> DataFrame:
    """Cluster of each image finding: shared ends, bridged by near hashes."""
    nodes = cut_lineage(image_nodes(findings))
    # Ends of one finding are linked to its first; near hashes link their first nodes.
    first = nodes.groupBy("doc_id", "finding_id").agg(F.min("node").alias("first"))
    hashed = nodes.filter("phash IS NOT NULL").withColumn("hash", hex_to_long(F.col("phash")))
    groups = hashed.groupBy("doc_id", "hash").agg(F.min("node").alias("first"))
    near = hash_pairs(groups.select("doc_id", "hash"), None, radius, scope=["doc_id"])
    a = groups.select("doc_id", F.col("hash").alias("hash_a"), F.col("first").alias("u"))
    b = groups.select("doc_id", F.col("hash").alias("hash_b"), F.col("first").alias("v"))
    bridged = near.join(a, ["doc_id", "hash_a"]).join(b, ["doc_id", "hash_b"]).select("u", "v")
    # One short array per row instead of a union keeps an empty side harmless.
    linked = hashed.join(groups.withColumnRenamed("first", "peer"), ["doc_id", "hash"])
    both = nodes.join(first, ["doc_id", "finding_id"]).join(
        linked.select("doc_id", "finding_id", "node", "peer").distinct(),
        ["doc_id", "finding_id", "node"],
        "left",
    )
    ends = F.array_compact(F.array("first", "peer"))
    own = both.select(F.explode(ends).alias("u"), F.col("node").alias("v"))
    edges = cut_lineage(own.unionByName(bridged))
    labels = connected_components(nodes.select("node"), edges)
    return (
        first.withColumnRenamed("first", "node")
        .join(labels, "node")
        .select("doc_id", "finding_id", F.concat(F.lit("image|"), "component").alias("group_key"))
    )


def issues(findings: DataFrame, image_keys: DataFrame | None = None) -> DataFrame:
    """Every finding in exactly one issue (F8); ids are content hashes, order is K2."""
    kind = kind_of(F.col("detector"))
    keyed = findings.withColumn("kind", kind).withColumn(
        "_key",
        F.when(F.col("kind") == "table", table_group_key())
        .when(F.col("kind") == "image", F.concat(F.lit("image|detector:"), "detector"))
        .otherwise(F.concat(F.col("kind"), F.lit("|family:"), family_of(F.col("detector")))),
    )
    if image_keys is not None:
        keyed = keyed.join(image_keys, ["doc_id", "finding_id"], "left").withColumn(
            "_key", F.coalesce("group_key", "_key")
        )
    return (
        keyed.groupBy("doc_id", "kind", F.col("_key").alias("group_key"))
        .agg(
            F.max(severity_rank("severity")).alias("rank"),
            F.array_sort(F.collect_set("detector")).alias("detectors"),
            F.count(F.lit(1)).alias("member_count"),
        )
        .select(
            F.concat(F.lit("ISS-"), short_id(F.col("kind"), F.col("group_key"))).alias("issue_id"),
            "doc_id",
            "kind",
            "group_key",
            severity_name(F.col("rank")).alias("severity"),
            "detectors",
            "member_count",
        )
    )


def ordered_issues(df: DataFrame) -> DataFrame:
    """Severity, members, id (K2)."""
    return df.orderBy(severity_rank("severity").desc(), F.col("member_count").desc(), "issue_id")


def top_issues(df: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` issues of each document (K3); parts are cut before the final ranking."""
    order = [severity_rank("severity").desc(), F.col("member_count").desc(), F.col("issue_id")]
    part = df.withColumn("_part", F.pmod(F.xxhash64("issue_id"), F.lit(32)))
    local = part.withColumn(
        "_r", F.row_number().over(W.partitionBy("doc_id", "_part").orderBy(*order))
    ).filter(F.col("_r") <= k)
    return (
        local.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
        .filter(F.col("place") <= k)
        .drop("_part", "_r")
    )


def verdicts(issue_rows: DataFrame) -> DataFrame:
    """Label and score per document from its issues."""
    of = lambda s: F.count_if(F.col("severity") == s)
    counts = issue_rows.groupBy("doc_id").agg(
        (of("high") + of("critical")).alias("high"),
        of("medium").alias("medium"),
        of("low").alias("low"),
        F.count(F.lit(1)).alias("issues"),
    )
    score = F.least(
        F.lit(1.0), (F.col("high") + F.col("medium") * 0.4 + F.col("low") * 0.1) / 3
    )
    return counts.withColumn("score", F.round(score, 4)).withColumn(
        "verdict",
        F.when(F.col("high") >= 1, "flagged").when(F.col("medium") >= 3, "suspect").otherwise("clean"),
    )


# --------------------------------------------------------------------------- selections and reports


def select_findings(
    df: DataFrame,
    detector: str | None = None,
    severity: str | None = None,
    finding_id: str | None = None,
) -> DataFrame:
    """Findings by detector, severity or id."""
    for name, value in (("detector", detector), ("severity", severity), ("finding_id", finding_id)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def normalized_title(text: Column) -> Column:
    """Lower case with numbers replaced."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "N"), r"\s+", " "))


def finding_clusters(df: DataFrame, batch: int = 12) -> DataFrame:
    """Findings with one fingerprint, their representative and batch number."""
    key = short_id(
        F.col("detector"), F.col("severity"), normalized_title(F.col("title")),
        normalized_title(F.col("location")), length=16,
    )
    groups = (
        df.groupBy("doc_id", key.alias("fingerprint"))
        .agg(F.count(F.lit(1)).alias("members"), F.min("finding_id").alias("representative"))
    )
    order = W.partitionBy("doc_id").orderBy(F.col("members").desc(), "fingerprint")
    return (
        groups.withColumn("place", F.row_number().over(order))
        .withColumn("batch", F.floor((F.col("place") - 1) / batch))
    )


def merged_patterns(df: DataFrame, top: int | None = None) -> DataFrame:
    """Findings merged over detector, severity class and numberless title (F16)."""
    colour = (
        F.when(severity_rank("severity") >= 3, "red")
        .when(severity_rank("severity") == 2, "yellow")
        .otherwise("green")
    )
    merged = df.groupBy(
        "doc_id", "detector", colour.alias("colour"), normalized_title(F.col("title")).alias("pattern")
    ).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_distinct("location").alias("locations"),
        F.min_by("title", "finding_id").alias("sample"),
    )
    if top is None:
        return merged
    return merged.orderBy(
        (F.col("colour") == "red").desc(), F.col("findings").desc(), "detector", "pattern"
    ).limit(top)


def pattern_groups(df: DataFrame) -> DataFrame:
    """Findings per pattern tag with worst severity and a sample."""
    tag = raw("pubpeer_pattern")
    return (
        df.withColumn("pattern", tag)
        .filter("pattern IS NOT NULL")
        .groupBy("doc_id", "pattern")
        .agg(
            F.count(F.lit(1)).alias("findings"),
            severity_name(F.max(severity_rank("severity"))).alias("severity"),
            F.min_by("title", "finding_id").alias("sample"),
        )
    )


def pair_items(df: DataFrame) -> DataFrame:
    """Pair view of findings: kind, two sides, whether the place can be found."""
    detector = F.col("detector")
    kind = (
        F.when(raw("left_table").isNotNull() & (raw("left_table") != F.coalesce(raw("right_table"), F.lit(""))), "cross_table")
        .when(raw("left_column").isNotNull(), "column_pair")
        .when(raw("page_a").isNotNull() & raw("page_b").isNotNull(), "image_pair")
        .when(detector.isin(*IMAGE_DETECTORS), "image")
        .when(detector.isin(*TABLE_DETECTORS), "table")
        .otherwise("text")
    )
    image_end = lambda s: F.when(
        raw(f"page_{s}").isNotNull(),
        F.concat(F.lit("page "), raw(f"page_{s}"), F.coalesce(F.concat(F.lit(" image "), raw(f"index_{s}")), F.lit(""))),
    )
    table_end = lambda s: F.nullif(
        F.concat_ws(" / ", F.coalesce(raw(f"{s}_table"), host_of(F.col("location"))), raw(f"{s}_column")),
        F.lit(""),
    )
    paired = F.col("kind").isin("cross_table", "column_pair")
    return (
        df.withColumn("kind", kind)
        .withColumn("side_a", F.when(paired, table_end("left")).otherwise(image_end("a")))
        .withColumn("side_b", F.when(paired, table_end("right")).otherwise(image_end("b")))
        .withColumn(
            "locatable",
            F.when(
                F.col("kind").isin("cross_table", "column_pair", "image_pair"),
                F.col("side_a").isNotNull() & F.col("side_b").isNotNull(),
            ).otherwise(F.length(F.trim(F.coalesce("location", F.lit("")))) > 0),
        )
        .select(
            "doc_id", "finding_id", "detector", "severity", "title", "kind", "side_a", "side_b", "locatable"
        )
    )


def ordered_cases(items: DataFrame) -> DataFrame:
    """Severity, pairs first, locatable first, then id (K4); index by position in the sort.

    The index runs inside a document; its cases are cut by class and by the
    first characters of the id, so that no window holds all of them.
    """
    paired = F.col("side_a").isNotNull() & F.col("side_b").isNotNull()
    rank = severity_rank("severity")
    keyed = items.withColumn("_class", (3 - rank) * 4 + F.when(paired, 0).otherwise(2) + F.when(F.col("locatable"), 0).otherwise(1))
    keyed = keyed.withColumn("_head", F.substring("finding_id", 1, 2))
    part = ["doc_id", "_class", "_head"]
    sizes = keyed.groupBy(*part).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.partitionBy("doc_id").orderBy("_class", "_head")) - F.col("_c")
    offsets = sizes.select(*part, before.alias("_before"))
    inside = W.partitionBy(*part).orderBy("finding_id")
    return (
        keyed.withColumn("_r", F.row_number().over(inside))
        .join(offsets, part)
        .withColumn("case_no", F.col("_before") + F.col("_r"))
        .drop("_class", "_head", "_r", "_before")
    )


def pair_summary(items: DataFrame) -> DataFrame:
    """Counts by severity and kind, traffic light."""
    counts = items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("items"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low", "info")],
        F.count_if(F.col("kind").isin("cross_table", "column_pair")).alias("table_pairs"),
        F.count_if(F.col("kind") == "image_pair").alias("image_pairs"),
        F.count_if(~F.col("locatable")).alias("insufficient"),
    )
    return counts.withColumn(
        "light",
        F.when(F.col("high") > 0, "red").when(F.col("medium") > 0, "yellow").otherwise("green"),
    )


def pair_locations(items: DataFrame) -> DataFrame:
    """Side pairs of each document, most frequent first."""
    groups = (
        items.filter("side_a IS NOT NULL AND side_b IS NOT NULL")
        .groupBy("doc_id", F.least("side_a", "side_b").alias("side_a"), F.greatest("side_a", "side_b").alias("side_b"))
        .agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("title").alias("titles"))
    )
    order = [F.col("findings").desc(), F.col("side_a"), F.col("side_b")]
    return groups.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))


def evidence_index(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Findings with category and confidence (F18): ``categories(detector, category)`` is short."""
    return df.join(categories, "detector", "left").select(
        "doc_id",
        "finding_id",
        F.coalesce("category", F.lit("other")).alias("category"),
        "severity",
        F.coalesce(number("confidence"), severity_rank("severity") / 4.0).alias("confidence"),
    )


def promote_severity(severity: Column, hamming: Column, impossible: Column, confirmed: Column) -> Column:
    """Impossible values and near-identical hashes are high, confirmed cases critical."""
    return severity_name(
        F.greatest(
            severity_rank(severity),
            F.when(F.coalesce(confirmed, F.lit(False)), 4).otherwise(0),
            F.when(F.coalesce(impossible, F.lit(False)), 3).otherwise(0),
            F.when(F.coalesce(hamming <= 2, F.lit(False)), 3).otherwise(0),
        )
    )


def overall_light(df: DataFrame) -> DataFrame:
    """Red, yellow or green per document from its findings."""
    rank = severity_rank("severity")
    counts = df.groupBy("doc_id").agg(
        F.count_if(rank >= 3).alias("red"),
        F.count_if(rank == 2).alias("yellow"),
        F.count_if(rank < 2).alias("green"),
    )
    return counts.withColumn(
        "light",
        F.when(F.col("red") >= 30, "red")
        .when((F.col("red") >= 1) | (F.col("yellow") >= 10), "yellow")
        .otherwise("green"),
    )


def run_rollup(runs: DataFrame) -> DataFrame:
    """Detector runs of a document: by status, findings, time."""
    return runs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "error")],
        F.sum("n_findings").alias("findings"),
        F.sum("duration_ms").alias("duration_ms"),
        F.max("duration_ms").alias("slowest_ms"),
    )


def template_explanation() -> Column:
    """Fixed explanation per check family."""
    check = check_of()
    n = count_of().cast("string")
    return (
        F.when(check.contains("fixed_offset"), F.concat(F.lit("Two columns differ by a constant over "), n, F.lit(" rows.")))
        .when(check.contains("decimal_tail"), F.concat(F.lit("Decimal digits repeat between columns in "), n, F.lit(" rows.")))
        .when(check.contains("terminal_digit"), F.concat(F.lit("Last digits are unevenly used in "), n, F.lit(" values.")))
        .when(check.contains("duplicate"), F.concat(F.lit("Values repeat more often than expected in "), n, F.lit(" values.")))
        .when(check.contains("progression"), F.concat(F.lit("Values form a regular series of "), n, F.lit(" steps.")))
        .otherwise(F.concat(F.lit("Signal '"), check, F.lit("' needs manual review.")))
    )
