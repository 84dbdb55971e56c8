"""Single-column operators: digit tests, outliers, repeats, sequences (A*, W1-W3, P*)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import numbers as N
from ..model import cap_severity
from ..plans import ranks as R
from ..session import written

COLUMN = ["doc_id", "table_id", "col_idx", "header"]
TABLE = ["doc_id", "table_id"]

#: Rows of one task that groups what its tables hold, and of the longest table that lies whole in one.
ROWS_OF_A_TASK = 1 << 16


@dataclass(frozen=True)
class Thresholds:
    """Screening profile."""

    min_column: int = 3
    min_digit: int = 5
    duplicate: float = 0.70
    pair_digit: float = 0.85
    concentration: float = 0.70


PROFILES = {
    "strict": Thresholds(4, 6, 0.75, 0.90, 0.75),
    "default": Thresholds(),
    "sensitive": Thresholds(3, 4, 0.60, 0.80, 0.60),
}


def double_cells(
    cells: DataFrame, *, min_values: int = 2, chunk_size: int = R.ROW_CHUNK
) -> DataFrame:
    """Numeric cells with ``num``, position among numeric cells and column size."""
    numeric = cells.withColumn("num", N.coerce_number(F.col("text"))).filter("num IS NOT NULL")
    return R.with_positions(numeric, COLUMN, "row_idx", chunk_size=chunk_size).filter(
        F.col("n") >= min_values
    )


def decimal_cells(
    cells: DataFrame,
    *,
    min_values: int = Thresholds().min_column,
    chunk_size: int = R.ROW_CHUNK,
    together: bool = False,
) -> DataFrame:
    """Exact-decimal cells with ``num`` DECIMAL(38,10), position and column size.

    ``together`` deals out whole rows of a table, for operators that pair its columns; rows
    may then come packed, their cells (col_idx, header, text) in ``items``.
    """
    if "items" in cells.columns:

        def numbers(single: DataFrame, always: Column = F.lit(False)) -> DataFrame:
            return single.withColumn("num", N.exact_decimal(F.col("text"))).filter(F.col("num").isNotNull() | always)

        placed = R.row_positions(cells, COLUMN, "row_idx", numbers, chunk_size=chunk_size, deal=TABLE)
        return placed.filter(F.col("n") >= min_values)
    numeric = cells.withColumn("num", N.exact_decimal(F.col("text"))).filter("num IS NOT NULL")
    deal = TABLE if together else ()
    return R.with_positions(numeric, COLUMN, "row_idx", chunk_size=chunk_size, deal=deal).filter(
        F.col("n") >= min_values
    )


def decimal_values(cells: DataFrame) -> DataFrame:
    """Exact-decimal cells without positions, for operators that ignore row order."""
    return cells.withColumn("num", N.exact_decimal(F.col("text"))).filter("num IS NOT NULL")


def numeric_columns(cells: DataFrame) -> DataFrame:
    """Columns with at least two numeric values (P1): one aggregation, no positions."""
    num = N.coerce_number(F.col("text"))
    return (
        cells.filter(num.isNotNull())
        .groupBy(*COLUMN)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(num).alias("min_value"),
            F.max(num).alias("max_value"),
        )
        .filter("n >= 2")
    )


# --------------------------------------------------------------------------- Benford

BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]

# Excess-MAD constant, severity gates and instrument-label patterns.
EXCESS_MAD_C = 21.27
BENFORD_MIN_N = 50
BENFORD_RELIABLE_N = 100
INSTRUMENT_LABEL = (
    r"(?i)\b(dls|nta|nanoparticle\s*track|dynamic\s*light\s*scatter|size\s*distrib"
    r"|particle\s*size|diameter|zeta\s*potential|histogram|bin(ned|ning)?|wavelength"
    r"|flow\s*cytom|fcs|fluorescence\s*intens|mass\s*spectrom|mz|retention\s*time|chromatog)\b"
)
CHANNEL_LABEL = (
    r"(?i)(\bintensity\b|\bintens\.?\b|\bnumber\b|\bnum\.?\b|\bcount\b|\bvolume\b|\bvol\.?\b"
    r"|%\s*(intensity|number|volume)|(intensity|number|volume)\s*%|size\s*\(?\s*nm\s*\)?"
    r"|diameter\s*\(?\s*nm\s*\)?|\bd\.?\s*nm\b|\bdh\b|\bz[-\s]?average\b)"
)
SIZE_PANEL_LABEL = (
    r"(?i)(fig\.?\s*s0*1[a-f]\b|figure\s*s0*1[a-f]\b|sfig\.?\s*2\b"
    r"|supp(lementary)?\.?\s*fig\.?\s*2\b|particle\s*size|size\s*distrib|psd\b)"
)


def first_digits(cells: DataFrame) -> DataFrame:
    """First-digit histogram per column in one aggregation (A1)."""
    num = N.coerce_number(F.col("text"))
    counted = cells.select(*COLUMN, num.alias("num")).withColumn(
        "digit", N.leading_digit(F.col("num"))
    )
    positive = F.when(F.col("num") > 0, F.log10("num"))
    return counted.groupBy(*COLUMN).agg(
        F.count("num").alias("n_values"),
        F.count("digit").alias("n"),
        *[F.count_if(F.col("digit") == d).alias(f"d{d}") for d in range(1, 10)],
        F.count(positive).alias("n_positive"),
        (F.max(positive) - F.min(positive)).alias("log_span"),
    ).filter("n_values > 0")


def benford(cells: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """First-digit test with applicability gate.

    ``labels(table_id, label)`` optionally carries figure and sheet names.
    """
    counts = first_digits(cells).filter((F.col("n_values") >= 2) & (F.col("n") >= 1))
    if labels is not None:
        counts = counts.join(labels.select("table_id", "label"), "table_id", "left")
        context = F.concat_ws(" ", "label", "header")
    else:
        context = F.col("header")
    n = F.col("n").cast("double")
    chi2, mad = F.lit(0.0), F.lit(0.0)
    for d, p in enumerate(BENFORD, start=1):
        seen = F.col(f"d{d}")
        chi2 = chi2 + F.pow(seen - n * F.lit(p), 2) / (n * F.lit(p))
        mad = mad + F.abs(seen / n - F.lit(p))
    mid = F.array(*[F.col(f"d{d}").cast("double") for d in range(2, 10)])
    total = F.aggregate(mid, F.lit(0.0), lambda s, x: s + x)
    mean = total / 8
    spread = F.sqrt(F.aggregate(mid, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / 8)
    flat = (F.array_min(mid) > 0) & (spread < mean * 0.08) & (F.col("n_values") >= 200)
    narrow = (F.col("n_positive") >= BENFORD_MIN_N) & (F.col("log_span") < 1.0)
    panel = context.rlike(SIZE_PANEL_LABEL)
    capped = (
        context.rlike(INSTRUMENT_LABEL)
        | panel
        | F.col("header").rlike(CHANNEL_LABEL)
        | flat
        | narrow
    )
    limit = (
        F.when(capped, F.lit("low"))
        .when(F.col("n_values") < BENFORD_RELIABLE_N, F.lit("medium"))
        .otherwise(F.lit("high"))
    )
    scored = (
        counts.withColumn("chi2", chi2)
        .withColumn("p_value", K.chi2_tail_even(F.col("chi2"), 8))
        .withColumn("mad", mad / 9)
        .withColumn("excess_mad", F.col("mad") - 1 / F.sqrt(F.lit(EXCESS_MAD_C) * n))
        .withColumn(
            "conformity",
            F.when(F.col("excess_mad") < 0, "close")
            .when(F.col("excess_mad") < 0.002, "acceptable")
            .when(F.col("excess_mad") < 0.004, "marginal")
            .otherwise("nonconforming"),
        )
        .withColumn("applicable", F.col("n_values") >= BENFORD_MIN_N)
        .withColumn("severity_limit", limit)
    )
    strong = (F.col("p_value") < 0.001) | (F.col("excess_mad") > 0.008)
    fires = (F.col("p_value") < 0.01) | (F.col("conformity") == "nonconforming")
    severity = F.when(
        F.col("applicable") & fires,
        cap_severity(F.when(strong, "high").otherwise("medium"), F.col("severity_limit")),
    )
    return scored.withColumn("severity", severity)


def size_bin_axis(numeric: DataFrame) -> DataFrame:
    """Columns that look like instrument size bins: mostly rising, small steps."""
    kept = numeric.filter("num >= 0").drop("pos", "n", "_chunk")
    kept = R.with_positions(kept, COLUMN, "row_idx").filter(F.col("n") >= BENFORD_MIN_N)
    steps = R.lagged(kept, COLUMN, "pos", {"num": "prev"}).withColumn(
        "step", F.col("num") - F.col("prev")
    )
    shape = steps.groupBy(*COLUMN).agg(
        F.max("n").alias("n"),
        F.count_if(F.col("step") >= -1e-12).alias("rises"),
        F.min_by("num", "pos").alias("first_value"),
        F.max_by("num", "pos").alias("last_value"),
        F.percentile_approx(F.when(F.col("step") >= 0, F.col("step")), 0.5, 10_000).alias("middle"),
    )
    middle = F.col("middle")
    span = F.col("last_value") - F.col("first_value")
    return shape.filter(
        (F.col("rises") / (F.col("n") - 1) >= 0.95)
        & (F.col("first_value") <= 50)
        & (span > 0)
        & (span < 1e6)
        & (middle <= F.greatest(span * 0.05, F.lit(5.0)))
    ).select(*COLUMN, "n", "rises")


# --------------------------------------------------------------------------- digits


def digit_counts(
    cells: DataFrame, *, exact: bool = False, sparse: bool = False, numeric_only: bool = True
) -> DataFrame:
    """Terminal digits and two-digit pairs of numeric texts, counted per column."""
    text = F.trim(F.col("text"))
    if numeric_only:
        ok = (N.exact_decimal(text) if exact else N.coerce_number(text)).isNotNull()
        cells = cells.filter(ok)
    return (
        cells.select(
            *COLUMN,
            N.terminal_digit(text).alias("digit"),
            N.terminal_pair(text).alias("pair"),
        )
        .groupBy(*COLUMN, "digit", "pair")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def terminal_digit_tests(cells: DataFrame) -> DataFrame:
    """Uniformity, five, round and pair tests per column and pooled per table (A10).

    Columns are grouped once; the pooled scope reuses the per-column counts.
    """
    # A window, not a join, whose two sides would read and count the cells apart; read by both scopes' sums.
    texts = F.sum("cnt").over(W.partitionBy(*COLUMN))
    columns = written(digit_counts(cells).withColumn("texts", texts).filter("texts >= 2"))
    scoped = columns.withColumn(
        "scope", F.explode(F.array(F.lit("column"), F.lit("table")))
    ).select(
        *TABLE,
        "scope",
        F.when(F.col("scope") == "column", F.col("col_idx")).otherwise(-1).alias("scope_col"),
        F.col("col_idx").alias("source_col"),
        "digit",
        "pair",
        "cnt",
    )
    scope = [*TABLE, "scope", "scope_col"]
    pairs = (
        scoped.groupBy(*scope, "pair")
        .agg(F.sum("cnt").alias("k"))
        .filter("pair IS NOT NULL")
        .groupBy(*scope)
        .agg(F.sum("k").alias("pair_n"), F.max("k").alias("pair_k"))
    )
    digits = scoped.groupBy(*scope).agg(
        F.sum("cnt").alias("texts"),
        F.count_distinct("source_col").alias("cols"),
        F.sum(F.when(F.col("digit").isNotNull(), F.col("cnt")).otherwise(0)).alias("n"),
        *[
            F.sum(F.when(F.col("digit") == str(d), F.col("cnt")).otherwise(0)).alias(f"c{d}")
            for d in range(10)
        ],
    )
    both = (
        digits.filter((F.col("scope") == "column") | (F.col("cols") >= 2))
        .filter("texts >= 30")
        .join(pairs, scope, "left")
    )
    counts = [F.col(f"c{d}") for d in range(10)]
    n = F.col("n").cast("double")
    chi2 = F.lit(0.0)
    for c in counts:
        chi2 = chi2 + F.pow(c - n / 10, 2) / (n / 10)
    top = F.greatest(*counts)
    five, round_ = F.col("c5"), F.col("c0") + F.col("c5")
    enough = F.col("n") >= 30
    null = F.lit(None)

    def test(name: str, gate: Column, k: Column, size: Column, p: float | None, stat: Column):
        return F.when(
            gate,
            F.struct(
                F.lit(name).alias("check"),
                k.cast("double").alias("k"),
                size.cast("double").alias("size"),
                (F.lit(p) if p is not None else null).cast("double").alias("p0"),
                stat.cast("double").alias("chi2"),
            ),
        )

    tests = F.array_compact(
        F.array(
            test("terminal_digit_uniformity", enough & (top >= n * 0.15), top, n, None, chi2),
            test("terminal_digit_five_bias", enough & (five / n >= 0.15), five, n, 0.1, null),
            test("terminal_digit_round_bias", enough & (round_ / n >= 0.30), round_, n, 0.2, null),
            test(
                "terminal_digit_pair_binomial",
                (F.col("pair_n") >= 30)
                & (F.col("pair_k") >= 5)
                & (F.col("pair_k") >= F.col("pair_n") * 0.03),
                F.col("pair_k"),
                F.col("pair_n"),
                0.01,
                null,
            ),
        )
    )
    rows = both.select(*scope, F.explode(tests).alias("t")).select(*scope, "t.*")
    uniform = K.chi2_tail(F.col("chi2"), F.when(F.col("chi2").isNotNull(), F.lit(9.0)))
    tail = K.binomial_tail(F.col("k"), F.col("size"), F.col("p0"))
    factor = F.when(F.col("check") == "terminal_digit_pair_binomial", 100.0).otherwise(1.0)
    return rows.select(
        *TABLE,
        "scope",
        F.when(F.col("scope") == "column", F.col("scope_col")).alias("col_idx"),
        "check",
        "k",
        "size",
        F.least(F.lit(1.0), F.coalesce(uniform, tail * factor)).alias("p"),
    )


def bh_adjust(tests: DataFrame, family: list[str], p: str = "p", order: list[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q values inside each family of tests.

    A family is the handful of tests run on one table, never the corpus.
    """
    up = W.partitionBy(*family).orderBy(p, *order)
    ranked = tests.withColumn("_rank", F.row_number().over(up)).withColumn(
        "family_size", F.count(F.lit(1)).over(W.partitionBy(*family))
    )
    rest = W.partitionBy(*family).orderBy("_rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    scaled = F.min(F.col(p) * F.col("family_size") / F.col("_rank")).over(rest)
    return ranked.withColumn("q", F.least(F.lit(1.0), scaled)).drop("_rank")


def severity_for_q(q: Column) -> Column:
    return F.when(q < 0.001, "high").when(q < 0.01, "medium").when(q < 0.05, "low")


def terminal_digit_report(cells: DataFrame) -> DataFrame:
    """Adjusted terminal-digit findings, one per scope."""
    adjusted = bh_adjust(
        terminal_digit_tests(cells), TABLE, order=["scope", "col_idx", "check"]
    ).withColumn("severity", severity_for_q(F.col("q")))
    return (
        adjusted.filter("severity IS NOT NULL")
        .groupBy(*TABLE, "scope", "col_idx")
        .agg(
            F.min("q").alias("q"),
            F.array_sort(F.collect_list("check")).alias("checks"),
            F.max("family_size").alias("family_size"),
        )
        .withColumn("severity", severity_for_q(F.col("q")))
    )


def round_bias(cells: DataFrame, min_values: int = 10) -> DataFrame:
    """Last-digit histogram, 0/5 share and chi-square of float values."""
    # The number is a column of its own and nulls are left to the counts: a filter would parse each text many times.
    numbers = cells.select(*COLUMN, N.coerce_number(F.col("text")).alias("num"))
    counts = (
        numbers.select(*COLUMN, N.last_integer_digit(F.col("num")).alias("digit"))
        .groupBy(*COLUMN)
        .agg(
            F.count("digit").alias("n"),
            *[F.count_if(F.col("digit") == d).alias(f"c{d}") for d in range(10)],
        )
        .filter(F.col("n") >= min_values)
    )
    chi2 = F.lit(0.0)
    for d in range(10):
        chi2 = chi2 + F.pow(F.col(f"c{d}") - F.col("n") / 10, 2) / (F.col("n") / 10)
    scored = (
        counts.withColumn("round_ratio", (F.col("c0") + F.col("c5")) / F.col("n"))
        .withColumn("chi2", chi2)
        .withColumn("p_value", K.chi2_tail(F.col("chi2"), F.lit(9.0)))
    )
    ratio = F.col("round_ratio")
    severity = (
        F.when(ratio > 0.6, "high")
        .when(ratio > 0.35, "medium")
        .when(F.col("p_value") < 0.01, "low")
    )
    return scored.withColumn("severity", severity)


def digit_concentration(
    cells: DataFrame, numeric: DataFrame, profile: Thresholds = Thresholds()
) -> DataFrame:
    """One or two terminal digits dominate a column.

    Digits come from all non-empty texts of decimal columns.
    """
    wanted = numeric.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= profile.min_column
    )
    counted = (
        digit_counts(cells.filter(F.trim("text") != ""), numeric_only=False)
        .join(wanted.drop("_n"), COLUMN, "left_semi")
        .filter("digit IS NOT NULL")
        .groupBy(*COLUMN)
        .agg(
            F.sum("cnt").alias("n"),
            *[
                F.sum(F.when(F.col("digit") == str(d), F.col("cnt")).otherwise(0)).alias(f"c{d}")
                for d in range(10)
            ],
        )
        .filter(F.col("n") >= profile.min_digit)
    )
    ordered = F.sort_array(F.array(*[F.col(f"c{d}") for d in range(10)]), asc=False)
    first, second = ordered[0], ordered[1]
    check = F.when(
        first / F.col("n") >= profile.concentration, "terminal_digit_concentration"
    ).when(
        (second > 0) & ((first + second) / F.col("n") >= profile.pair_digit),
        "terminal_digit_pair_concentration",
    )
    return (
        counted.withColumn("top_count", first)
        .withColumn("second_count", second)
        .withColumn("check", check)
        .withColumn("severity", F.when(F.col("check").isNotNull(), "medium"))
    )


def ones_mirror(
    cells: DataFrame, numeric: DataFrame, profile: Thresholds = Thresholds()
) -> DataFrame:
    """Units digit repeats the first decimal in most texts."""
    wanted = numeric.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= profile.min_column
    )
    text = F.trim("text")
    return (
        cells.filter(text != "")
        .groupBy(*COLUMN)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(N.ones_mirrors_decimal(text)).alias("matches"),
        )
        .join(wanted, COLUMN, "left_semi")
        .withColumn(
            "severity",
            F.when(
                (F.col("matches") >= profile.min_digit)
                & (F.col("matches") / F.col("n") >= profile.concentration),
                "medium",
            ),
        )
    )


def mixed_precision(cells: DataFrame) -> DataFrame:
    """Columns mixing decimal-place levels."""
    text = F.trim("text")
    levels = (
        cells.filter(N.exact_decimal(text).isNotNull())
        .select(*COLUMN, N.fraction_digits(text).alias("places"))
        .groupBy(*COLUMN, "places")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    known = F.col("places").isNotNull()
    per_column = levels.groupBy(*COLUMN).agg(
        F.sum("cnt").alias("n_texts"),
        F.sum(F.when(known, F.col("cnt")).otherwise(0)).alias("n"),
        F.count_if(known & (F.col("cnt") >= 2)).alias("levels"),
        F.max(F.when(known, F.col("cnt"))).alias("mode_count"),
    )
    flagged = (
        (F.col("n_texts") >= 8)
        & (F.col("n") >= 8)
        & (F.col("levels") >= 2)
        & (F.col("mode_count") / F.col("n") < 0.95)
    )
    return per_column.withColumn("severity", F.when(flagged, "low"))


def cross_table_digits(cells: DataFrame, profile: Thresholds = Thresholds()) -> DataFrame:
    """Two terminal digits dominate all tables of a document together."""
    text = F.trim("text")
    sized = (
        cells.filter(N.exact_decimal(text).isNotNull())
        .select(*COLUMN, N.terminal_digit(text).alias("digit"))
        .groupBy(*COLUMN, "digit")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    columns = sized.groupBy(*COLUMN).agg(
        F.sum("cnt").alias("n_values"),
        *[
            F.sum(F.when(F.col("digit") == str(d), F.col("cnt")).otherwise(0)).alias(f"c{d}")
            for d in range(10)
        ],
    )
    docs = (
        columns.filter(F.col("n_values") >= profile.min_column)
        .groupBy("doc_id")
        .agg(
            F.count_distinct("table_id").alias("tables"),
            *[F.sum(f"c{d}").alias(f"c{d}") for d in range(10)],
        )
    )
    ordered = F.sort_array(F.array(*[F.col(f"c{d}") for d in range(10)]), asc=False)
    total = sum((F.col(f"c{d}") for d in range(1, 10)), F.col("c0"))
    limit = F.when(ordered[1] == 0, profile.concentration).otherwise(profile.pair_digit)
    share = F.try_divide(ordered[0] + ordered[1], total)
    fires = (F.col("tables") >= 2) & (total >= profile.min_digit) & (share >= limit)
    return docs.select(
        "doc_id",
        "tables",
        total.alias("n"),
        (ordered[0] + ordered[1]).alias("top_two"),
        F.when(fires, "medium").alias("severity"),
    )


# --------------------------------------------------------------------------- outliers


def outlier_profile(cells: DataFrame, min_values: int = 30) -> DataFrame:
    """z, robust z and IQR tails of a column and the too-clean flag.

    Works on distinct values with counts; medians and quartiles are the
    ``n//2``, ``n//4`` and ``3n//4`` order statistics, not interpolated.
    """
    num = N.coerce_number(F.col("text"))
    values = cells.select(*COLUMN, num.alias("num")).filter("num IS NOT NULL")
    dist = R.value_distribution(values, COLUMN, "num")
    w = F.col("cnt")
    stats = dist.groupBy(*COLUMN).agg(
        F.max("n").alias("n"),
        (F.sum(F.col("num") * w) / F.sum(w)).alias("mean"),
        R.upper_median("num").alias("median"),
        R.at_rank("num", F.floor(F.col("n") / 4)).alias("q1"),
        R.at_rank("num", F.floor(F.col("n") * 3 / 4)).alias("q3"),
    ).filter(F.col("n") >= min_values)
    centred = R.attach_group_values(dist.drop("n"), stats, COLUMN, chunk="_bucket")
    deviations = centred.withColumn("dev", F.abs(F.col("num") - F.col("median")))
    mad = (
        R.value_distribution(deviations, COLUMN, "dev", weight="cnt")
        .groupBy(*COLUMN)
        .agg(R.upper_median("dev").alias("mad"))
    )
    spread = centred.groupBy(*COLUMN).agg(
        F.sqrt(F.sum(F.pow(F.col("num") - F.col("mean"), 2) * w) / F.sum(w)).alias("stdev")
    )
    full = R.attach_group_values(centred, mad.join(spread, COLUMN), COLUMN, chunk="_bucket")
    iqr = F.col("q3") - F.col("q1")
    z = F.when(F.col("stdev") > 0, F.abs(F.col("num") - F.col("mean")) / F.col("stdev"))
    robust = F.when(
        F.col("mad") >= 1e-12, F.abs(F.col("num") - F.col("median")) * 0.6745 / F.col("mad")
    ).otherwise(0.0)
    fenced = (iqr > 0) & (
        (F.col("num") < F.col("q1") - iqr * 1.5) | (F.col("num") > F.col("q3") + iqr * 1.5)
    )
    out = full.groupBy(*COLUMN).agg(
        F.max("n").alias("n"),
        F.max("mean").alias("mean"),
        F.max("stdev").alias("stdev"),
        F.max("median").alias("median"),
        F.max("mad").alias("mad"),
        F.sum(F.when(z > 3, w).otherwise(0)).alias("z_extreme"),
        F.sum(F.when(robust > 3.5, w).otherwise(0)).alias("mad_extreme"),
        F.sum(F.when(fenced, w).otherwise(0)).alias("iqr_outliers"),
    )
    ratio, mad_ratio = F.col("z_extreme") / F.col("n"), F.col("mad_extreme") / F.col("n")
    clean = ((ratio <= 0.001) & (mad_ratio <= 0.001)) | (
        (F.col("n") >= 80) & (F.col("iqr_outliers") == 0) & (ratio <= 0.002)
    )
    return out.withColumn("severity", F.when((F.col("stdev") > 0) & clean, "low"))


# --------------------------------------------------------------------------- repeats


def whole_tables(packed: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(cells of tables of at most ``limit`` rows, whole tables in one task; cells of the other tables or None)."""
    flat = packed.select(*TABLE, "items.col_idx", F.to_json("items.header").alias("header"), F.to_json("items.text").alias("text"))
    parts = ["col_idx", *[F.from_json(c, "array<string>").alias(c) for c in ("header", "text")]]

    def cells(rows: DataFrame) -> DataFrame:
        return rows.select(*TABLE, F.explode(F.arrays_zip(*parts)).alias("c")).select(*TABLE, "c.*")

    short, long = R.whole_groups(flat, TABLE, limit)
    return cells(short), None if long is None else cells(long)


def repeated_values(numeric: DataFrame, profile: Thresholds = Thresholds()) -> DataFrame:
    """Zero variance, or one value fills most of a column.

    Rows may come packed, their cells in ``items``: values of a table that fits into a
    task are then counted there, and each row is shuffled as one text.
    """
    if "items" in numeric.columns:
        short, long = whole_tables(numeric, ROWS_OF_A_TASK)
        found = repeated_values(decimal_values(short), profile)
        return found if long is None else found.unionByName(repeated_values(decimal_values(long), profile))
    counts = numeric.groupBy(*COLUMN, "num").agg(F.count(F.lit(1)).alias("cnt"))
    per_column = counts.groupBy(*COLUMN).agg(
        F.sum("cnt").alias("n"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.max("cnt").alias("top_count"),
    )
    per_column = per_column.filter(F.col("n") >= profile.min_column)
    check = F.when(F.col("distinct_values") == 1, "zero_variance").when(
        F.col("top_count") / F.col("n") >= profile.duplicate, "improbable_repeated_values"
    )
    return per_column.withColumn("check", check).withColumn(
        "severity",
        F.when(F.col("check") == "zero_variance", "medium").when(
            F.col("check").isNotNull(), "high"
        ),
    )


VARIABILITY_TOKENS = ("sd", "std", "stdev", "sem")


def is_variability_header(header: Column) -> Column:
    """Header names a spread measure."""
    words = F.split(F.trim(F.regexp_replace(F.lower(header), r"[^\p{L}\p{N}]+", " ")), " +")
    compact = F.regexp_replace(F.lower(header), r"[^\p{L}\p{N}]+", "")
    tokens = F.array(*[F.lit(t) for t in VARIABILITY_TOKENS])
    return F.arrays_overlap(words, tokens) | compact.contains("standarddeviation")


def spread_columns(numeric: DataFrame, profile: Thresholds = Thresholds()) -> DataFrame:
    """Zero or constant entries in SD columns."""
    return (
        numeric.filter(is_variability_header(F.col("header")))
        .groupBy(*COLUMN)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("num") == 0).alias("zero_entries"),
            (F.min("num") == F.max("num")).alias("constant"),
            F.min("num").alias("low"),
        )
        .filter(F.col("n") >= profile.min_column)
        .withColumn(
            "severity",
            F.when(F.col("zero_entries") > 0, "high").when(F.col("constant"), "medium"),
        )
    )


def axis_like(numeric: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Index, axis and repeated-sweep columns that regularity checks must skip."""
    steps = column_steps(numeric) if steps is None else steps
    folds = numeric.filter("n >= 6").select(
        *COLUMN, "pos", "num", "n", F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("k")
    )
    folds = folds.filter((F.col("n") % F.col("k") == 0) & (F.col("n") / F.col("k") >= 3))
    chunk = (F.col("n") / F.col("k")).cast("long")
    part = F.floor(F.col("pos") / chunk)
    sums = folds.groupBy(*COLUMN, "k").agg(
        *[F.sum(F.when(part == i, F.col("num"))).alias(f"s{i}") for i in range(4)]
    )
    even = (F.col("s0") == F.col("s1")) & (
        (F.col("k") < 3) | (F.col("s1") == F.col("s2"))
    ) & ((F.col("k") < 4) | (F.col("s2") == F.col("s3")))
    likely = sums.filter(even).select(*COLUMN, "k")
    repeated = (
        folds.join(likely, [*COLUMN, "k"])
        .groupBy(*COLUMN, "k", F.pmod("pos", chunk).alias("slot"))
        .agg((F.min("num") == F.max("num")).alias("same"))
        .groupBy(*COLUMN, "k")
        .agg(F.every("same").alias("same"))
        .filter("same")
        .groupBy(*COLUMN)
        .agg(F.lit(True).alias("repeated"))
    )
    regular = (
        (F.col("min_step") >= 0)
        & (F.col("nonzero_steps") >= 2)
        & (F.col("step_cv") < 0.05)
    )
    return steps.join(repeated, COLUMN, "left").withColumn(
        "axis_like",
        F.coalesce("repeated", F.lit(False))
        | F.coalesce((F.col("n") >= 3) & regular, F.lit(False)),
    )


def _mode_order(count: str, first: str) -> Column:
    """Orders modes by count, then by the earliest position; one number keeps the aggregate hashed."""
    big = F.lit(10**18).cast("decimal(19,0)")
    return F.col(count).cast("decimal(18,0)") * big - F.col(first).cast("decimal(19,0)")


def column_steps(numeric: DataFrame) -> DataFrame:
    """Raw-order differences of each column, reduced to a profile."""
    lags = R.lagged(numeric, COLUMN, "pos", {"num": "prev"})
    step = F.round(F.col("num") - F.col("prev"), 6)
    by_step = (
        lags.withColumn("step", step)
        .groupBy(*COLUMN, "step")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.min("pos").alias("first_pos"),
            F.min("num").alias("lo"),
            F.max("num").alias("hi"),
            F.every(F.col("num") == F.floor("num")).alias("ints"),
        )
    )
    real = F.col("step").isNotNull()
    moved = real & (F.col("step") != 0)
    value = F.col("step").cast("double")
    weight = F.when(moved, F.col("cnt"))
    profile = by_step.groupBy(*COLUMN).agg(
        F.sum("cnt").alias("n"),
        F.count_if(real).alias("distinct_steps"),
        F.min("step").alias("min_step"),
        F.max_by("step", F.when(real, _mode_order("cnt", "first_pos"))).alias("mode_step"),
        F.max(F.when(real, F.col("cnt"))).alias("mode_count"),
        F.sum(weight).alias("nonzero_steps"),
        (F.sum(value * weight) / F.sum(weight)).alias("_m"),
        (F.sum(value * value * weight) / F.sum(weight)).alias("_m2"),
        F.every("ints").alias("all_integer"),
        F.min("lo").alias("min_value"),
        F.max("hi").alias("max_value"),
    )
    variance = F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0))
    return profile.select(
        *COLUMN,
        "n",
        "distinct_steps",
        "min_step",
        "mode_step",
        "mode_count",
        F.coalesce("nonzero_steps", F.lit(0)).alias("nonzero_steps"),
        F.when(F.col("_m") > 0, F.sqrt(variance) / F.col("_m")).alias("step_cv"),
        "all_integer",
        (F.col("max_value") - F.col("min_value") == F.col("n") - 1).alias("spans_n"),
        "min_value",
        "max_value",
    )


def progressions(numeric: DataFrame) -> DataFrame:
    """Arithmetic progressions, exact and near-perfect, in row order."""
    steps = column_steps(numeric).filter("n >= 6")
    check = F.when(
        (F.col("distinct_steps") == 1) & (F.col("mode_step") != 0), "arithmetic_progression"
    ).when(
        (F.col("distinct_steps") > 1)
        & (F.col("mode_step") != 0)
        & (F.col("mode_count") / (F.col("n") - 1) >= 0.8),
        "near_perfect_arithmetic_progression",
    )
    return steps.select(
        *COLUMN,
        "n",
        "distinct_steps",
        "mode_step",
        "mode_count",
        check.alias("check"),
        F.when(check.isNotNull(), "medium").alias("severity"),
    )


def sorted_sequences(numeric: DataFrame) -> DataFrame:
    """Regular spacing of the sorted values and dominant gaps."""
    eligible = numeric.filter("n >= 8")
    places = eligible.groupBy(*COLUMN).agg(
        F.max(N.fraction_digits(F.col("text"))).alias("places")
    )
    dist = R.value_distribution(eligible, COLUMN, "num")
    v, c = F.col("num").cast("double"), F.col("cnt").cast("double")
    rank_sum = c * F.col("before") + c * (c - 1) / 2
    by_gap = (
        dist.withColumn("gap", F.col("num") - F.col("prev"))
        .groupBy(*COLUMN, "gap")
        .agg(
            F.count(F.lit(1)).alias("gaps"),
            F.min("num").alias("at"),
            F.sum(c).alias("w"),
            F.sum(v * c).alias("sv"),
            F.sum(v * v * c).alias("svv"),
            F.sum(v * rank_sum).alias("svr"),
        )
    )
    g = F.col("gap").cast("double")
    k = F.when(F.col("gap").isNotNull(), F.col("gaps"))
    agg = by_gap.groupBy(*COLUMN).agg(
        F.sum("w").alias("n"),
        F.coalesce(F.sum(k), F.lit(0)).alias("nonzero_gaps"),
        F.count("gap").alias("gap_levels"),
        (F.sum(g * k) / F.sum(k)).alias("gm"),
        (F.sum(g * g * k) / F.sum(k)).alias("gm2"),
        F.max_by("gap", F.when(F.col("gap").isNotNull(), F.col("gaps").cast("double") - F.col("at").cast("double") / 1e30)).alias("modal_gap"),
        F.max(k).alias("modal_count"),
        F.sum("sv").alias("sv"),
        F.sum("svv").alias("svv"),
        F.sum("svr").alias("svr"),
    )
    n = F.col("n")
    sxy = F.col("svr") - F.col("sv") * (n - 1) / 2
    sxx = n * (n * n - 1) / 12
    syy = F.col("svv") - F.col("sv") * F.col("sv") / n
    sorted_profile = agg.select(
        *COLUMN,
        "nonzero_gaps",
        "gap_levels",
        (F.sqrt(F.greatest(F.col("gm2") - F.col("gm") * F.col("gm"), F.lit(0.0))) / F.col("gm")).alias(
            "gap_cv"
        ),
        F.when(syy > 0, sxy * sxy / (sxx * syy)).otherwise(0.0).alias("rank_r2"),
        "modal_gap",
        "modal_count",
    )
    guarded = axis_like(eligible)
    distinct = dist.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("distinct_values"))
    joined = (
        guarded.join(sorted_profile, COLUMN).join(distinct, COLUMN).join(places, COLUMN)
    )
    covered = (F.col("distinct_steps") == 1) | (
        (F.col("mode_step") != 0) & (F.col("mode_count") / (F.col("n") - 1) >= 0.8)
    )
    index = F.col("all_integer") & (
        ((F.col("distinct_values") == F.col("n")) & F.col("spans_n")) | (F.col("min_step") > 0)
    )
    open_ = (
        (F.col("distinct_values") > 1)
        & ~covered
        & ~index
        & ~F.col("axis_like")
        & (F.col("nonzero_gaps") >= 2)
    )
    regular = (F.col("gap_cv") < 0.05) | (F.col("rank_r2") > 0.999)
    modal = (
        (F.col("modal_count") >= 5)
        & (F.col("modal_count") / F.col("nonzero_gaps") >= 0.5)
        & (F.col("gap_levels") >= 2)
    )
    unit = F.pow(F.lit(10.0), -F.col("places").cast("double"))
    lattice = F.abs(F.col("modal_gap").cast("double") - unit) < unit / 2
    check = F.when(open_ & regular, "arithmetic_sequence_sorted").when(
        open_ & modal, "modal_gap_sequence"
    )
    return joined.select(
        *COLUMN,
        "n",
        "gap_cv",
        "rank_r2",
        "modal_gap",
        "modal_count",
        "nonzero_gaps",
        "axis_like",
        check.alias("check"),
        F.when(check == "arithmetic_sequence_sorted", "medium")
        .when((check == "modal_gap_sequence") & lattice, "low")
        .when(check == "modal_gap_sequence", "medium")
        .alias("severity"),
    )


def duplicate_excess(numeric: DataFrame, profile: Thresholds = Thresholds()) -> DataFrame:
    """Poisson test for too many tied pairs, per column and pooled per table."""
    axis = axis_like(numeric).select(*COLUMN, "axis_like")
    header = F.lower("header")
    counts = (
        numeric.groupBy(*COLUMN, "num")
        .agg(F.count(F.lit(1)).alias("cnt"), F.max(N.fraction_digits(F.col("text"))).alias("places"))
        .join(axis.filter("NOT axis_like"), COLUMN, "left_semi")
        .filter(~header.contains("p-value") & ~header.contains("p value"))
    )
    widths = counts.groupBy(*TABLE).agg(F.count_distinct("col_idx").alias("width"))
    scoped = counts.withColumn(
        "scope", F.explode(F.array(F.lit("column"), F.lit("table")))
    ).withColumn("scope_col", F.when(F.col("scope") == "column", F.col("col_idx")).otherwise(-1))
    scope = [*TABLE, "scope", "scope_col"]
    places = scoped.groupBy(*scope).agg(F.max("places").alias("places"))
    dist = R.value_distribution(scoped, scope, "num", weight="cnt")
    stats = dist.groupBy(*scope).agg(
        F.max("n").alias("n"),
        F.max("cnt").alias("top_count"),
        F.min("num").alias("lo"),
        F.max("num").alias("hi"),
        R.at_rank("num", F.floor(F.col("n") / 4)).alias("q1"),
        R.at_rank("num", F.floor(F.col("n") * 3 / 4)).alias("q3"),
        F.sum(F.col("cnt") * (F.col("cnt") - 1) / 2).alias("all_pairs"),
        F.sum(
            F.when(F.col("num") == 0, F.col("cnt") * (F.col("cnt") - 1) / 2).otherwise(0)
        ).alias("zero_pairs"),
        F.max_by("cnt", "num").alias("hi_cnt"),
        F.min_by("cnt", "num").alias("lo_cnt"),
    )

    def tied(side: str) -> Column:
        c = F.col(f"{side}_cnt")
        return F.when(F.col(side) != 0, c * (c - 1) / 2).otherwise(0)

    pairs = F.col("all_pairs") - F.col("zero_pairs") - tied("lo") - tied("hi")
    unit = F.pow(F.lit(10.0), -F.least(F.col("places"), F.lit(8)).cast("double"))
    span = (F.col("hi") - F.col("lo")).cast("double")
    effective = F.least(
        F.greatest((F.col("q3") - F.col("q1")).cast("double") * 3, unit), span
    )
    tested = (
        stats.join(places, scope)
        .join(widths, TABLE)
        .filter((F.col("scope") == "column") | (F.col("width") >= 2))
        .withColumn("duplicate_pairs", pairs.cast("long"))
        .withColumn("representable", (F.round(effective / unit) + 1).cast("long"))
        .filter(
            (F.col("n") >= 8)
            & (F.col("top_count") / F.col("n") < profile.duplicate)
            & (F.col("lo") != F.col("hi"))
            & (F.col("representable") >= 2)
            & (F.col("duplicate_pairs") >= 3)
        )
        .withColumn(
            "expected_pairs", F.col("n") * (F.col("n") - 1) / 2.0 / F.col("representable")
        )
        .withColumn("p", K.poisson_tail(F.col("duplicate_pairs").cast("double"), F.col("expected_pairs")))
    )
    adjusted = bh_adjust(tested, TABLE, order=["scope", "scope_col"])
    return adjusted.select(
        *TABLE,
        "scope",
        F.when(F.col("scope") == "column", F.col("scope_col")).alias("col_idx"),
        "n",
        "duplicate_pairs",
        "representable",
        "expected_pairs",
        "p",
        "q",
        "family_size",
        severity_for_q(F.col("q")).alias("severity"),
    )
