"""Single-column operators over supplier and priority tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import columns as C
from ..operators import relations as L
from ..plans import ranks as R
from . import corpus as X

QUERIES = {}


def add(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


LINE = X.line_cells_sql()
LINE4 = X.line_cells_sql(4)
ORDERS = X.ORDER_CELLS_SQL


def line_numeric(spark, sf_dir, columns=8, decimal=True):
    view = C.decimal_cells if decimal else C.double_cells
    return view(X.line_cells(spark, sf_dir, columns), chunk_size=X.LINE_CHUNK)


def line_rows(spark, sf_dir):
    """The numbers of the order lines, whole rows together, for pairs of columns."""
    return L.number_rows(X.packed_lines(spark, sf_dir), chunk_size=X.LINE_CHUNK)


def line_values(spark, sf_dir):
    return C.decimal_values(X.line_cells(spark, sf_dir))


def rounded(df, **columns):
    for name, places in columns.items():
        df = df.withColumn(name, F.round(F.col(name).cast("double"), places))
    return df


FIRST_DIGITS = """digits AS (SELECT doc_id, table_id, col_idx, header, num,
 CASE WHEN num > 0 THEN greatest(1, least(9, CAST(floor(num / pow(10.0, floor(log10(num)))) AS INT))) END AS d
 FROM (SELECT *, CAST(text AS DOUBLE) AS num FROM cells)),
counts AS (SELECT doc_id, table_id, col_idx, header, count(num) AS n_values, count(d) AS n,
 count(*) FILTER (num > 0) AS n_positive, max(log10(num)) FILTER (num > 0) - min(log10(num)) FILTER (num > 0) AS log_span,
 """ + ", ".join(f"count(*) FILTER (d = {d}) AS d{d}" for d in range(1, 10)) + """
 FROM digits GROUP BY ALL)"""

_P = [f"log10(1 + 1.0 / {d})" for d in range(1, 10)]
_CHI2 = " + ".join(f"pow(d{d} - n * {p}, 2) / (n * {p})" for d, p in enumerate(_P, 1))
_MAD = " + ".join(f"abs(d{d} * 1.0 / n - {p})" for d, p in enumerate(_P, 1))
_MID = "[" + ", ".join(f"d{d}" for d in range(2, 10)) + "]"
BENFORD = f"""scored AS (SELECT *, {_CHI2} AS chi2, ({_MAD}) / 9 AS mad,
 ({_MAD}) / 9 - 1 / sqrt(21.27 * n) AS excess, list_min({_MID}) AS lo, list_avg({_MID}) AS m,
 list_stddev_pop({_MID}) AS s FROM counts WHERE n_values >= 2 AND n >= 1),
tested AS (SELECT *, least(1, exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6)) AS p,
 CASE WHEN excess < 0 THEN 'close' WHEN excess < 0.002 THEN 'acceptable' WHEN excess < 0.004 THEN 'marginal'
 ELSE 'nonconforming' END AS conformity,
 CASE WHEN (lo > 0 AND s < m * 0.08 AND n_values >= 200) OR (n_positive >= 50 AND log_span < 1) THEN 1
 WHEN n_values < 100 THEN 2 ELSE 3 END AS cap FROM scored),
judged AS (SELECT *, CASE WHEN n_values >= 50 AND (p < 0.01 OR conformity = 'nonconforming') THEN
 least(cap, CASE WHEN p < 0.001 OR excess > 0.008 THEN 3 ELSE 2 END) END AS rank FROM tested)"""


@add(
    "a1_first_digits",
    with_sql(
        LINE4,
        FIRST_DIGITS,
        select="SELECT * EXCLUDE (log_span), round(log_span, 6) AS log_span FROM counts",
    ),
)
def a1(spark, sf_dir):
    return rounded(C.first_digits(X.line_cells(spark, sf_dir, 4)), log_span=6)


@add(
    "a2_benford",
    with_sql(
        LINE,
        FIRST_DIGITS,
        BENFORD,
        select="SELECT doc_id, table_id, col_idx, n, round(chi2, 6) AS chi2, round(p, 6) AS p_value, "
        "round(mad, 6) AS mad, round(excess, 6) AS excess_mad, conformity, "
        "['low','medium','high'][rank] AS severity FROM judged",
    ),
)
def a2(spark, sf_dir):
    out = C.benford(X.line_cells(spark, sf_dir))
    return rounded(out, chi2=6, p_value=6, mad=6, excess_mad=6).select(
        "doc_id", "table_id", "col_idx", "n", "chi2", "p_value", "mad", "excess_mad",
        "conformity", "severity",
    )


@add(
    "p1_numeric_columns",
    with_sql(
        ORDERS,
        select="SELECT doc_id, table_id, col_idx, header, count(*) AS n, min(CAST(text AS DOUBLE)) AS min_value, "
        "max(CAST(text AS DOUBLE)) AS max_value FROM cells GROUP BY ALL HAVING count(*) >= 2",
    ),
)
def p1(spark, sf_dir):
    return C.numeric_columns(X.order_cells(spark, sf_dir))


@add(
    "p2_decimal_positions",
    with_sql(
        ORDERS,
        X.NUMERIC_SQL,
        select="SELECT table_id, col_idx, row_idx, pos, n FROM numeric WHERE n >= 3",
    ),
)
def p2(spark, sf_dir):
    out = C.decimal_cells(X.order_cells(spark, sf_dir), chunk_size=1 << 10)
    return out.select("table_id", "col_idx", "row_idx", "pos", "n")


@add(
    "a9_round_bias",
    with_sql(
        LINE,
        """digits AS (SELECT doc_id, table_id, col_idx, CAST(right(CAST(CAST(round(CASE
 WHEN abs(x - round(x)) < 1e-9 THEN x WHEN abs(x * 10 - round(x * 10)) < 1e-9 THEN x * 10
 WHEN abs(x * 100 - round(x * 100)) < 1e-9 THEN x * 100 WHEN abs(x * 1000 - round(x * 1000)) < 1e-9 THEN x * 1000
 WHEN abs(x * 10000 - round(x * 10000)) < 1e-9 THEN x * 10000
 WHEN abs(x * 100000 - round(x * 100000)) < 1e-9 THEN x * 100000 ELSE x * 1000000 END) AS BIGINT) AS VARCHAR), 1) AS INT) AS d
 FROM (SELECT *, abs(CAST(text AS DOUBLE)) AS x FROM cells))""",
        "counts AS (SELECT doc_id, table_id, col_idx, count(*) AS n, "
        + ", ".join(f"count(*) FILTER (d = {d}) AS c{d}" for d in range(10))
        + " FROM digits GROUP BY ALL HAVING count(*) >= 10)",
        "scored AS (SELECT *, (c0 + c5) * 1.0 / n AS ratio, "
        + " + ".join(f"pow(c{d} - n / 10.0, 2) / (n / 10.0)" for d in range(10))
        + " AS chi2 FROM counts)",
        "tail AS (SELECT *, CASE WHEN chi2 <= 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 3000), "
        "lambda k: exp((4.5 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(5.5 + k)))) END AS p FROM scored)",
        select="SELECT doc_id, table_id, col_idx, n, c0, c5, round(ratio, 6) AS round_ratio, round(chi2, 4) AS chi2, "
        "CASE WHEN ratio > 0.6 THEN 'high' WHEN ratio > 0.35 THEN 'medium' WHEN p < 0.01 THEN 'low' END AS severity FROM tail",
    ),
)
def a9(spark, sf_dir):
    out = rounded(C.round_bias(X.line_cells(spark, sf_dir)), round_ratio=6, chi2=4)
    return out.select(
        "doc_id", "table_id", "col_idx", "n", "c0", "c5", "round_ratio", "chi2", "severity"
    )


TERMINAL = """digits AS (SELECT *, right(regexp_replace(text, '\\D+$', ''), 1) AS digit,
 CASE WHEN length(split_part(text, '.', 2)) >= 2 THEN right(text, 2) END AS pair FROM cells),
scoped AS (SELECT doc_id, table_id, 'column' AS scope, col_idx AS c, col_idx, digit, pair FROM digits
 UNION ALL SELECT doc_id, table_id, 'table', -1, col_idx, digit, pair FROM digits),
pairs AS (SELECT table_id, scope, c, sum(k) AS pair_n, max(k) AS pair_k FROM (SELECT table_id, scope, c, pair,
 count(*) AS k FROM scoped WHERE pair IS NOT NULL GROUP BY ALL) GROUP BY ALL),
dig AS (SELECT doc_id, table_id, scope, c, count(*) AS n, count(DISTINCT col_idx) AS cols, """ + ", ".join(
    f"count(*) FILTER (digit = '{d}') AS c{d}" for d in range(10)
) + """ FROM scoped GROUP BY ALL),
wide AS (SELECT d.*, pair_n, pair_k, greatest(""" + ", ".join(f"c{d}" for d in range(10)) + """) AS top, """ + " + ".join(
    f"pow(c{d} - n / 10.0, 2) / (n / 10.0)" for d in range(10)
) + """ AS chi FROM dig d LEFT JOIN pairs p ON d.table_id = p.table_id AND d.scope = p.scope AND d.c = p.c
 WHERE n >= 30),
tests AS (
 SELECT doc_id, table_id, scope, c, 'terminal_digit_uniformity' AS "check", top AS k, n AS size, NULL AS p0, chi FROM wide WHERE top >= n * 0.15
 UNION ALL SELECT doc_id, table_id, scope, c, 'terminal_digit_five_bias', c5, n, 0.1, NULL FROM wide WHERE c5 * 1.0 / n >= 0.15
 UNION ALL SELECT doc_id, table_id, scope, c, 'terminal_digit_round_bias', c0 + c5, n, 0.2, NULL FROM wide WHERE (c0 + c5) * 1.0 / n >= 0.30
 UNION ALL SELECT doc_id, table_id, scope, c, 'terminal_digit_pair_binomial', pair_k, pair_n, 0.01, NULL FROM wide
 WHERE pair_n >= 30 AND pair_k >= 5 AND pair_k >= pair_n * 0.03)"""

TAILS = """tailed AS (SELECT *, least(1.0, CASE WHEN p0 IS NULL THEN
 greatest(0, 1 - list_sum(list_transform(range(0, 3000), lambda j: exp((4.5 + j) * ln(chi / 2) - chi / 2 - lgamma(5.5 + j)))))
 ELSE list_sum(list_transform(range(CAST(k AS BIGINT), CAST(size AS BIGINT) + 1), lambda i: exp(lgamma(size + 1) - lgamma(i + 1)
 - lgamma(size - i + 1) + i * ln(p0) + (size - i) * ln(1 - p0)))) * CASE WHEN "check" = 'terminal_digit_pair_binomial'
 THEN 100 ELSE 1 END END) AS p FROM tests)"""


@add(
    "a10_terminal_digit_tests",
    with_sql(
        LINE,
        TERMINAL,
        TAILS,
        select="SELECT doc_id, table_id, scope, nullif(c, -1) AS col_idx, \"check\", k, size, "
        "round(p, 6) AS p FROM tailed",
    ),
)
def a10(spark, sf_dir):
    out = rounded(C.terminal_digit_tests(X.line_cells(spark, sf_dir)), p=6)
    return out.select("doc_id", "table_id", "scope", "col_idx", "check", "k", "size", "p")


BH = """ranked AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY p, scope, c, "check") AS r,
 count(*) OVER (PARTITION BY table_id) AS m FROM tailed),
adjusted AS (SELECT *, least(1.0, min(p * m / r) OVER (PARTITION BY table_id ORDER BY r
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ranked)"""


@add(
    "a11_bh_terminal_report",
    with_sql(
        LINE,
        TERMINAL,
        TAILS,
        BH,
        select="SELECT doc_id, table_id, scope, nullif(c, -1) AS col_idx, round(min(q), 6) AS q, "
        "list_sort(list(\"check\")) AS checks, max(m) AS family_size, CASE WHEN min(q) < 0.001 THEN 'high' "
        "WHEN min(q) < 0.01 THEN 'medium' ELSE 'low' END AS severity FROM adjusted WHERE q < 0.05 "
        "GROUP BY doc_id, table_id, scope, c",
    ),
)
def a11(spark, sf_dir):
    return rounded(C.terminal_digit_report(X.line_cells(spark, sf_dir)), q=6)


@add(
    "a14_digit_concentration",
    with_sql(
        LINE,
        "d AS (SELECT doc_id, table_id, col_idx, header, right(regexp_replace(text, '\\D+$', ''), 1) AS digit FROM cells)",
        "k AS (SELECT doc_id, table_id, col_idx, header, digit, count(*) AS cnt FROM d GROUP BY ALL)",
        "s AS (SELECT doc_id, table_id, col_idx, header, sum(cnt) AS n, list_reverse_sort(list(cnt)) AS o FROM k GROUP BY ALL)",
        "f AS (SELECT *, o[1] AS top_count, coalesce(o[2], 0) AS second_count FROM s WHERE n >= 5)",
        select="SELECT doc_id, table_id, col_idx, n, top_count, second_count, CASE WHEN top_count / n >= 0.7 "
        "THEN 'terminal_digit_concentration' WHEN second_count > 0 AND (top_count + second_count) / n >= 0.85 "
        "THEN 'terminal_digit_pair_concentration' END AS \"check\" FROM f",
    ),
)
def a14(spark, sf_dir):
    cells = X.line_cells(spark, sf_dir)
    out = C.digit_concentration(cells, C.decimal_values(cells))
    return out.select(
        "doc_id", "table_id", "col_idx", "n", "top_count", "second_count", "check"
    )


@add(
    "a15_ones_mirror",
    with_sql(
        LINE,
        select="SELECT doc_id, table_id, col_idx, count(*) AS n, count(*) FILTER (contains(text, '.') AND "
        "right(split_part(text, '.', 1), 1) = left(split_part(text, '.', 2), 1)) AS matches FROM cells "
        "GROUP BY ALL HAVING count(*) >= 3",
    ),
)
def a15(spark, sf_dir):
    cells = X.line_cells(spark, sf_dir)
    return C.ones_mirror(cells, C.decimal_values(cells)).select(
        "doc_id", "table_id", "col_idx", "n", "matches"
    )


MIXED = X.line_cells_sql().replace("cells AS (", "raw AS (", 1) + (
    ", cells AS (SELECT * REPLACE (CASE WHEN col_idx = 1 THEN rtrim(rtrim(text, '0'), '.') ELSE text END AS text) FROM raw)"
)


def trimmed_cells(spark, sf_dir):
    """Prices as a spreadsheet shows them, without trailing zeros."""
    text = F.when(
        F.col("col_idx") == 1, F.regexp_replace(F.regexp_replace("text", "0+$", ""), r"\.$", "")
    ).otherwise(F.col("text"))
    return X.line_cells(spark, sf_dir).withColumn("text", text)


@add(
    "a16_mixed_precision",
    with_sql(
        MIXED,
        "l AS (SELECT doc_id, table_id, col_idx, length(split_part(text, '.', 2)) AS places, count(*) AS cnt FROM cells GROUP BY ALL)",
        "s AS (SELECT doc_id, table_id, col_idx, sum(cnt) AS n, count(*) FILTER (cnt >= 2) AS levels, max(cnt) AS mode_count FROM l GROUP BY ALL)",
        select="SELECT *, CASE WHEN n >= 8 AND levels >= 2 AND mode_count / n < 0.95 THEN 'low' END AS severity FROM s",
    ),
)
def a16(spark, sf_dir):
    return C.mixed_precision(trimmed_cells(spark, sf_dir)).select(
        "doc_id", "table_id", "col_idx", "n", "levels", "mode_count", "severity"
    )


@add(
    "a18_cross_table_digits",
    with_sql(
        LINE,
        "d AS (SELECT doc_id, table_id, right(text, 1) AS digit FROM cells)",
        "k AS (SELECT doc_id, digit, count(*) AS cnt FROM d GROUP BY ALL)",
        "t AS (SELECT doc_id, count(DISTINCT table_id) AS tables FROM d GROUP BY ALL)",
        "s AS (SELECT doc_id, sum(cnt) AS n, list_reverse_sort(list(cnt)) AS o FROM k GROUP BY ALL)",
        select="SELECT doc_id, tables, n, o[1] + coalesce(o[2], 0) AS top_two, CASE WHEN tables >= 2 AND n >= 5 AND "
        "(o[1] + coalesce(o[2], 0)) / n >= CASE WHEN len(o) = 1 THEN 0.7 ELSE 0.85 END THEN 'medium' END AS severity "
        "FROM s JOIN t USING (doc_id)",
    ),
)
def a18(spark, sf_dir):
    return C.cross_table_digits(X.line_cells(spark, sf_dir))


OUTLIERS = """ordered AS (SELECT *, row_number() OVER (PARTITION BY table_id, col_idx ORDER BY num) - 1 AS r FROM numeric),
q AS (SELECT table_id, col_idx, avg(num) AS mean, stddev_pop(num) AS sd, max(num) FILTER (r = n // 2) AS med,
 max(num) FILTER (r = n // 4) AS q1, max(num) FILTER (r = 3 * n // 4) AS q3 FROM ordered GROUP BY ALL),
dev AS (SELECT o.*, mean, sd, med, q1, q3, abs(num - med) AS dev, row_number() OVER (PARTITION BY table_id, col_idx
 ORDER BY abs(num - med)) - 1 AS dr FROM ordered o JOIN q USING (table_id, col_idx)),
mad AS (SELECT table_id, col_idx, max(dev) FILTER (dr = n // 2) AS mad FROM dev GROUP BY ALL),
prof AS (SELECT doc_id, table_id, col_idx, max(n) AS n, max(mean) AS mean, max(sd) AS stdev, max(med) AS median, max(mad) AS mad,
 count(*) FILTER (abs(num - mean) / sd > 3) AS z_extreme,
 count(*) FILTER (mad >= 1e-12 AND abs(num - med) * 0.6745 / mad > 3.5) AS mad_extreme,
 count(*) FILTER (q3 > q1 AND (num < q1 - (q3 - q1) * 1.5 OR num > q3 + (q3 - q1) * 1.5)) AS iqr_outliers
 FROM dev JOIN mad USING (table_id, col_idx) WHERE n >= 30 GROUP BY ALL)"""


def outlier_sql(cells: str) -> str:
    return with_sql(
        cells,
        X.NUMERIC_SQL,
        OUTLIERS,
        select="SELECT doc_id, table_id, col_idx, n, round(mean, 4) AS mean, round(stdev, 4) AS stdev, median, round(mad, 6) AS mad, "
        "z_extreme, mad_extreme, iqr_outliers, CASE WHEN stdev > 0 AND ((z_extreme * 1.0 / n <= 0.001 AND "
        "mad_extreme * 1.0 / n <= 0.001) OR (n >= 80 AND iqr_outliers = 0 AND z_extreme * 1.0 / n <= 0.002)) "
        "THEN 'low' END AS severity FROM prof",
    )


def outlier_columns(cells):
    return rounded(C.outlier_profile(cells), mean=4, stdev=4, mad=6).drop("header")


@add("a6_a8_outlier_profile", outlier_sql(LINE4))
def a6(spark, sf_dir):
    return outlier_columns(X.line_cells(spark, sf_dir, 4))


@add("a6_outlier_profile_big_tables", outlier_sql(ORDERS))
def a6_big(spark, sf_dir):
    return outlier_columns(X.order_cells(spark, sf_dir))


@add(
    "a7_robust_z",
    with_sql(
        ORDERS,
        X.NUMERIC_SQL,
        OUTLIERS,
        select="SELECT table_id, col_idx, row_idx, round(CASE WHEN mad < 1e-12 THEN 0 ELSE 0.6745 * (num - med) / mad END, 9) "
        "AS robust_z FROM dev JOIN mad USING (table_id, col_idx)",
    ),
)
def a7(spark, sf_dir):
    numeric = C.double_cells(X.order_cells(spark, sf_dir))
    stats = C.outlier_profile(X.order_cells(spark, sf_dir), min_values=2)
    joined = R.attach_group_values(
        numeric.drop("n"), stats.select(*C.COLUMN, "median", "mad"), C.COLUMN
    )
    z = F.when(F.col("mad") < 1e-12, F.lit(0.0)).otherwise(
        F.lit(0.6745) * (F.col("num") - F.col("median")) / F.col("mad")
    )
    return joined.select("table_id", "col_idx", "row_idx", F.round(z, 9).alias("robust_z"))


@add(
    "a12_repeated_values",
    with_sql(
        LINE,
        "k AS (SELECT doc_id, table_id, col_idx, CAST(text AS DECIMAL(28,10)) AS v, count(*) AS cnt FROM cells GROUP BY ALL)",
        "s AS (SELECT doc_id, table_id, col_idx, sum(cnt) AS n, count(*) AS distinct_values, max(cnt) AS top_count FROM k GROUP BY ALL HAVING sum(cnt) >= 3)",
        select="SELECT *, CASE WHEN distinct_values = 1 THEN 'zero_variance' WHEN top_count / n >= 0.7 THEN "
        "'improbable_repeated_values' END AS \"check\" FROM s",
    ),
)
def a12(spark, sf_dir):
    return C.repeated_values(X.packed_lines(spark, sf_dir)).drop("header", "severity")


@add(
    "a13_spread_columns",
    with_sql(
        LINE,
        select="SELECT doc_id, table_id, col_idx, header, count(*) AS n, count(*) FILTER (CAST(text AS INT) = 0) AS zero_entries, "
        "min(CAST(text AS INT)) = max(CAST(text AS INT)) AS constant, CASE WHEN count(*) FILTER (CAST(text AS INT) = 0) > 0 "
        "THEN 'high' WHEN min(CAST(text AS INT)) = max(CAST(text AS INT)) THEN 'medium' END AS severity "
        "FROM cells WHERE header = 'group sd' GROUP BY ALL HAVING count(*) >= 3",
    ),
)
def a13(spark, sf_dir):
    return C.spread_columns(line_values(spark, sf_dir)).drop("low")


STEPS = """lagged AS (SELECT *, round(dec - lag(dec) OVER (PARTITION BY table_id, col_idx ORDER BY row_idx), 6) AS step FROM numeric WHERE n >= 3),
by_step AS (SELECT doc_id, table_id, col_idx, step, count(*) AS cnt, min(pos) AS fp FROM lagged GROUP BY ALL),
steps AS (SELECT doc_id, table_id, col_idx, sum(cnt) AS n, count(step) AS distinct_steps, min(step) AS min_step,
 arg_max(step, (cnt, -fp)) FILTER (step IS NOT NULL) AS mode_step,
 max(cnt) FILTER (step IS NOT NULL) AS mode_count FROM by_step GROUP BY ALL)"""


@add(
    "w1_progressions",
    with_sql(
        ORDERS,
        X.NUMERIC_SQL,
        STEPS,
        select="SELECT doc_id, table_id, col_idx, n, distinct_steps, CAST(mode_step AS DOUBLE) AS mode_step, mode_count, "
        "CASE WHEN distinct_steps = 1 AND mode_step <> 0 THEN 'arithmetic_progression' WHEN distinct_steps > 1 AND mode_step <> 0 "
        "AND mode_count / (n - 1) >= 0.8 THEN 'near_perfect_arithmetic_progression' END AS \"check\" FROM steps WHERE n >= 6",
    ),
)
def w1(spark, sf_dir):
    out = C.progressions(C.decimal_cells(X.order_cells(spark, sf_dir), chunk_size=1 << 12))
    return out.drop("header", "severity").withColumn("mode_step", F.col("mode_step").cast("double"))


@add(
    "w2_w3_sorted_sequences",
    with_sql(
        ORDERS,
        X.NUMERIC_SQL,
        "srt AS (SELECT *, dec - lag(dec) OVER (PARTITION BY table_id, col_idx ORDER BY dec, row_idx) AS gap, "
        "row_number() OVER (PARTITION BY table_id, col_idx ORDER BY dec, row_idx) - 1 AS r FROM numeric WHERE n >= 8)",
        "nz AS (SELECT table_id, col_idx, count(*) AS nonzero_gaps, stddev_pop(CAST(gap AS DOUBLE)) / avg(CAST(gap AS DOUBLE)) AS cv "
        "FROM srt WHERE gap > 0 GROUP BY ALL)",
        "r2 AS (SELECT doc_id, table_id, col_idx, count(*) AS n, pow(corr(r, num), 2) AS r2 FROM srt GROUP BY ALL)",
        "gc AS (SELECT table_id, col_idx, gap, count(*) AS c FROM srt WHERE gap > 0 GROUP BY ALL)",
        "gm AS (SELECT table_id, col_idx, max(c) AS modal_count FROM gc GROUP BY ALL)",
        select="SELECT doc_id, table_id, col_idx, n, round(cv, 4) AS gap_cv, round(r2, 4) AS rank_r2, modal_count, nonzero_gaps "
        "FROM r2 JOIN nz USING (table_id, col_idx) JOIN gm USING (table_id, col_idx)",
    ),
)
def w2(spark, sf_dir):
    out = C.sorted_sequences(C.decimal_cells(X.order_cells(spark, sf_dir)))
    return rounded(out, gap_cv=4, rank_r2=4).select(
        "doc_id", "table_id", "col_idx", "n", "gap_cv", "rank_r2", "modal_count", "nonzero_gaps"
    )


@add(
    "a17_duplicate_excess",
    with_sql(
        ORDERS,
        X.NUMERIC_SQL,
        """scoped AS (SELECT doc_id, table_id, col_idx AS c, dec, text FROM numeric WHERE n >= 3
 UNION ALL SELECT doc_id, table_id, -1, dec, text FROM numeric WHERE n >= 3),
srt AS (SELECT *, row_number() OVER (PARTITION BY table_id, c ORDER BY dec) - 1 AS r, count(*) OVER (PARTITION BY table_id, c) AS n FROM scoped),
st AS (SELECT doc_id, table_id, c, max(n) AS n, min(dec) AS lo, max(dec) AS hi, max(dec) FILTER (r = n // 4) AS q1,
 max(dec) FILTER (r = 3 * n // 4) AS q3, max(length(split_part(text, '.', 2))) AS places FROM srt GROUP BY ALL),
vc AS (SELECT table_id, c, dec, count(*) AS cnt FROM scoped GROUP BY ALL),
dp AS (SELECT table_id, c, max(cnt) AS top, coalesce(sum(cnt * (cnt - 1) // 2) FILTER (dec <> 0 AND dec <> lo AND dec <> hi), 0) AS pairs
 FROM vc JOIN st USING (table_id, c) GROUP BY ALL),
rep AS (SELECT *, CAST(round(least(greatest(CAST(q3 - q1 AS DOUBLE) * 3, pow(10.0, -places)), CAST(hi - lo AS DOUBLE)) / pow(10.0, -places)) + 1 AS BIGINT) AS representable
 FROM st JOIN dp USING (table_id, c))""",
        select="SELECT doc_id, table_id, CASE WHEN c < 0 THEN 'table' ELSE 'column' END AS scope, nullif(c, -1) AS col_idx, n, "
        "CAST(pairs AS BIGINT) AS duplicate_pairs, representable, round(n * (n - 1) / 2.0 / representable, 4) AS expected_pairs FROM rep "
        "WHERE n >= 8 AND top * 1.0 / n < 0.7 AND lo <> hi AND representable >= 2 AND pairs >= 3",
    ),
)
def a17(spark, sf_dir):
    out = C.duplicate_excess(C.decimal_cells(X.order_cells(spark, sf_dir)))
    return rounded(out, expected_pairs=4).select(
        "doc_id", "table_id", "scope", "col_idx", "n", "duplicate_pairs", "representable",
        "expected_pairs",
    )


@add("p15_axis_guard")
def p15(spark, sf_dir):
    numeric = C.decimal_cells(X.order_cells(spark, sf_dir))
    return C.axis_like(numeric).select("table_id", "col_idx", "n", "axis_like")


@add("p18_size_bin_axis")
def p18(spark, sf_dir):
    return C.size_bin_axis(C.double_cells(X.order_cells(spark, sf_dir)))
