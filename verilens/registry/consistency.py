"""Consistency checks over tables and sentences derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import numbers as N
from ..operators import consistency as S
from ..operators import text as T
from . import corpus as X
from .columns import rounded, with_sql

QUERIES = {}


def add(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


# One summary row per order line: n, mean, sd, percent, t and p columns.
STAT_HEADERS = ("n", "mean score", "sd", "percent", "t value", "p value")


def stat_cells(spark, sf_dir):
    dec = lambda c, s: c.cast(f"decimal(18,{s})").cast("string")
    q, tax = F.col("l_quantity").cast("int"), F.col("l_tax")
    k = F.col("l_orderkey") % 700
    texts = [
        q.cast("string"),
        dec(k / 100.0, 2),
        dec(k % 300 / 100.0, 2),
        dec(F.col("l_discount") * 1000.0, 1),
        dec((k % 400) / 100.0, 2),
        dec(tax * 5, 2),
    ]
    cells = [
        F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), t.alias("text"))
        for i, (h, t) in enumerate(zip(STAT_HEADERS, texts))
    ]
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * (1 << 24) + F.col("l_partkey")
    return (
        X.read(spark, sf_dir, "lineitem")
        .select(
            F.floor(F.col("l_suppkey") / 4).alias("doc_id"),
            F.col("l_suppkey").alias("table_id"),
            row.alias("row_idx"),
            F.explode(F.array(*cells)).alias("c"),
        )
        .select("doc_id", "table_id", "row_idx", "c.*")
    )


STAT = """s AS (SELECT l_suppkey // 4 AS doc_id, l_suppkey AS table_id, (l_orderkey * 8 + l_linenumber) * 16777216 + l_partkey AS row_idx,
 CAST(l_quantity AS INT) AS n, CAST(CAST((l_orderkey % 700) / 100.0 AS DECIMAL(18,2)) AS DOUBLE) AS mean,
 CAST(CAST((l_orderkey % 700 % 300) / 100.0 AS DECIMAL(18,2)) AS DOUBLE) AS sd, CAST(CAST(l_discount * 1000.0 AS DECIMAL(18,1)) AS DOUBLE) AS pct,
 CAST(CAST((l_orderkey % 700 % 400) / 100.0 AS DECIMAL(18,2)) AS DOUBLE) AS t, CAST(CAST(l_tax * 5 AS DECIMAL(18,2)) AS DOUBLE) AS p FROM lineitem)"""


def grim(v: str, d: int) -> str:
    h = 0.5 * 10**-d
    return (
        f"(ceil(({v} - {h}) * n + 1e-12) <= floor(({v} + {h}) * n + 1e-12) OR ceil(({v} - {h}) * n - 1e-12) <= floor(({v} + {h}) * n - 1e-12))"
    )


@add(
    "x1_grim_rows",
    with_sql(
        STAT,
        select=f"SELECT doc_id, table_id, row_idx, 'mean' AS role, mean AS value, n, 'low' AS severity FROM s WHERE n BETWEEN 2 AND 200 AND NOT {grim('mean', 2)} "
        f"UNION ALL SELECT doc_id, table_id, row_idx, 'percent', pct, n, 'high' FROM s WHERE n BETWEEN 2 AND 200 AND NOT {grim('pct', 1)}",
    ),
)
def x1(spark, sf_dir):
    return S.grim_rows(stat_cells(spark, sf_dir)).drop("col_idx")


@add(
    "x2_debit_rows",
    with_sql(
        STAT,
        "d AS (SELECT *, CASE WHEN pct > 1 THEN pct / 100 ELSE pct END AS pr, CASE WHEN pct > 1 THEN 0.0005 ELSE 0.05 END AS h FROM s WHERE n >= 2)",
        "e AS (SELECT *, sqrt(pr * (1 - pr) * n / (n - 1)) AS ex, greatest(pr - h, 0) AS lo, least(pr + h, 1) AS hi FROM d WHERE pr BETWEEN 0 AND 1)",
        "f AS (SELECT *, abs(sd - ex) AS delta, 0.005 + greatest(abs(sqrt(lo * (1 - lo) * n / (n - 1)) - ex), abs(sqrt(hi * (1 - hi) * n / (n - 1)) - ex)) AS tol FROM e)",
        select="SELECT doc_id, table_id, row_idx, round(ex, 6) AS expected, round(delta, 6) AS delta, 'high' AS severity FROM f WHERE delta > tol + 1e-12",
    ),
)
def x2(spark, sf_dir):
    return rounded(S.debit_rows(stat_cells(spark, sf_dir)), expected=6, delta=6)


@add(
    "x3_grimmer_rows",
    with_sql(
        STAT,
        f"g AS (SELECT *, ceil((mean - 0.005) * n + 1e-12) / n AS mlo, floor((mean + 0.005) * n + 1e-12) / n AS mhi, CASE WHEN mean BETWEEN 1 AND 7 THEN 1 ELSE 0 END AS lo, "
        f"CASE WHEN mean BETWEEN 1 AND 7 THEN 7 ELSE 10 END AS hi FROM s WHERE mean BETWEEN 0 AND 10 AND n >= 2 AND {grim('mean', 2)})",
        "c AS (SELECT *, least(greatest(mlo, lo), hi) AS a, least(greatest(mhi, lo), hi) AS b FROM g)",
        select="SELECT doc_id, table_id, row_idx, mean, sd, n, 'high' AS severity FROM c WHERE mlo > mhi OR sd > greatest(sqrt((a - lo) * (hi - a) * n / (n - 1)), "
        "sqrt((b - lo) * (hi - b) * n / (n - 1))) + 0.01",
    ),
)
def x3(spark, sf_dir):
    return S.grimmer_rows(stat_cells(spark, sf_dir)).drop("col_idx")


@add(
    "x4_percent_rows",
    with_sql(
        STAT,
        select="SELECT doc_id, table_id, row_idx, pct AS percent, n, 'high' AS severity FROM s WHERE n >= 2 AND pct BETWEEN 0 AND 100 AND abs(pct * n / 100 - round_even(pct * n / 100, 0)) >= 1e-9",
    ),
)
def x4(spark, sf_dir):
    return S.percent_rows(stat_cells(spark, sf_dir)).drop("col_idx")


@add("x7_tp_rows")
def x7(spark, sf_dir):
    return rounded(S.tp_rows(stat_cells(spark, sf_dir)), max_delta=6)


def summary_groups(spark, sf_dir):
    """Supplier groups per nation: every third supplier opens a block."""
    dec = X.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("l_quantity"), 2).alias("mean"),
        F.round(F.stddev_samp("l_quantity"), 2).alias("sd"),
    )
    return dec.select(
        F.floor(F.col("l_suppkey") / 60).alias("doc_id"),
        F.floor(F.col("l_suppkey") / 12).alias("table_id"),
        F.col("l_suppkey").alias("row_idx"),
        F.when(F.col("l_suppkey") % 3 == 0, "group").otherwise("").alias("label"),
        F.col("n").cast("double").alias("n"),
        "mean",
        "sd",
        F.lit(0.5).alias("t"),
        F.when(F.col("l_suppkey") % 3 == 0, 3.0).alias("f"),
        F.lit(0.05).alias("p"),
    )


GROUPS = """g0 AS (SELECT l_suppkey AS k, CAST(count(*) AS DOUBLE) AS n, round(avg(l_quantity), 2) AS mean, round(stddev_samp(l_quantity), 2) AS sd FROM lineitem GROUP BY ALL),
g1 AS (SELECT k // 60 AS doc_id, k // 12 AS table_id, k AS row_idx, n, mean, sd, sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k // 12 ORDER BY k) AS block FROM g0)"""


@add(
    "w5_group_blocks",
    with_sql(GROUPS, select="SELECT doc_id, table_id, row_idx, CAST(block AS BIGINT) AS block FROM g1"),
)
def w5(spark, sf_dir):
    return S.group_blocks(summary_groups(spark, sf_dir)).select(
        "doc_id", "table_id", "row_idx", "block"
    )


@add(
    "x8_summary_tests",
    with_sql(
        GROUPS,
        """a AS (SELECT doc_id, table_id, block, count(*) AS k, sum(n) AS tot, sum(n * mean) / sum(n) AS grand, sum(n * mean * mean) AS nmm, sum((n - 1) * sd * sd) AS wit,
 arg_min(mean, row_idx) AS m1, arg_max(mean, row_idx) AS m2, sum(sd * sd / n) AS se2 FROM g1 GROUP BY ALL HAVING count(*) >= 2)""",
        select="SELECT doc_id, table_id, CAST(block AS BIGINT) AS block, k AS groups, round(CASE WHEN k = 2 THEN abs(m1 - m2) / sqrt(se2) END, 4) AS welch, "
        "round(((nmm - tot * grand * grand) / (k - 1)) / (wit / (tot - k)), 4) AS anova FROM a",
    ),
)
def x8(spark, sf_dir):
    out = S.summary_tests(S.group_blocks(summary_groups(spark, sf_dir)))
    return rounded(out, welch=4, anova=4).select(
        "doc_id", "table_id", "block", "groups", "welch", "anova"
    )


@add("x8_summary_severity")
def x8_severity(spark, sf_dir):
    out = S.summary_tests(S.group_blocks(summary_groups(spark, sf_dir)))
    return rounded(out, p_of_f=6).select("table_id", "block", "p_of_f", "hits", "severity")


@add("x5_statcheck")
def x5(spark, sf_dir):
    return rounded(S.statcheck(X.paper_blocks(spark, sf_dir)), p_computed=6, p_low=6, p_up=6)


@add("x6_correlation_p")
def x6(spark, sf_dir):
    return rounded(S.correlation_p(X.paper_blocks(spark, sf_dir)), p_computed=6)


@add(
    "x5_reported_statistics",
    with_sql(
        X.PAPERS_SQL,
        """v AS (SELECT * FROM (VALUES (2, 't', 28.0, NULL, 2.20, 0.04), (2, 'F', 2.0, 45.0, 3.10, 0.001)) AS x(slot, stat, d1, d2, value, p)),
w AS (SELECT * FROM (VALUES ('z', NULL, NULL, 1.96, 0.05), ('chi2', 2.0, NULL, 5.99, 0.05)) AS x(stat, d1, d2, value, p))""",
        select="SELECT doc_id, stat, d1, d2, value, p FROM papers JOIN v ON doc_id % 12 = slot UNION ALL SELECT doc_id, stat, d1, d2, value, p FROM papers, w WHERE doc_id % 7 = 4",
    ),
)
def x5_rows(spark, sf_dir):
    return S.statistics_in_text(X.paper_blocks(spark, sf_dir)).select(
        "doc_id", "stat", "d1", "d2", "value", "p"
    )


@add(
    "a22_p_value_pileup",
    with_sql(
        X.PAPERS_SQL,
        "p AS (SELECT doc_id % 50 AS doc_id, CAST(unnest(regexp_extract_all(text, '(?i)\\bp\\s*=\\s*(0?\\.\\d+)', 1)) AS DOUBLE) AS p FROM blocks)",
        "c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (p > 0.04 AND p <= 0.05) AS in_band FROM p WHERE p > 0.001 AND p <= 0.1 GROUP BY ALL)",
        select="SELECT *, (total >= 8 AND in_band >= 4 AND in_band * 1.0 / total >= 0.35) OR in_band >= 6 AS fires FROM c",
    ),
)
def a22(spark, sf_dir):
    blocks = X.paper_blocks(spark, sf_dir).withColumn("doc_id", F.col("doc_id") % 50)
    return S.p_value_pileup(blocks)


@add(
    "x9_sprite_lite",
    with_sql(
        X.PAPERS_SQL,
        select="SELECT doc_id, 3.45 AS mean, 1.2 AS sd, 20 AS n, round(sqrt((3.45 - 1) * (5 - 3.45) * 20 / 19.0), 6) AS max_sd, false AS impossible FROM papers WHERE doc_id % 12 = 6",
    ),
)
def x9(spark, sf_dir):
    return rounded(S.sprite_lite(X.paper_blocks(spark, sf_dir)), max_sd=6).drop("block_no")


@add("h21_stat_sentences")
def h21(spark, sf_dir):
    return S.stat_sentences(X.paper_blocks(spark, sf_dir))


@add("w4_carried_n")
def w4(spark, sf_dir):
    blocks = X.papers(spark, sf_dir).select(
        "doc_id", F.lit(0).alias("block_no"), F.regexp_replace("text", "\n", ". ").alias("text")
    )
    return S.carried_n(S.stat_sentences(blocks)).select("doc_id", "sentence_no", "n", "n_carried")


@add("z5_stat_cells")
def z5(spark, sf_dir):
    return S.stat_cells(S.stat_sentences(X.paper_blocks(spark, sf_dir)))


def ocr_rows(spark, sf_dir):
    """Figure text: a percentage per order line and an n on every fourth."""
    return X.read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_suppkey") / 4).alias("doc_id"),
        (F.col("l_orderkey") % 40).alias("page"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("region"),
        F.when(
            F.col("l_linenumber") % 4 == 0,
            F.concat(F.lit("n = "), F.col("l_quantity").cast("int").cast("string")),
        )
        .otherwise(
            F.concat((F.col("l_extendedprice") % 100).cast("decimal(8,1)").cast("string"), F.lit("%"))
        )
        .alias("text"),
        (F.col("l_discount") * 10).alias("conf"),
    )


@add("x10_j28_figure_percents")
def x10(spark, sf_dir):
    ocr = ocr_rows(spark, sf_dir)
    distinct_first = ocr.groupBy("doc_id", "page", "region").agg(
        F.min("text").alias("text"), F.max("conf").alias("conf")
    )
    return S.figure_percents(distinct_first)


@add(
    "h10_percent_grim",
    with_sql(
        "p AS (SELECT DISTINCT CAST(CAST(l_extendedprice % 100 AS DECIMAL(8,1)) AS DOUBLE) AS pct FROM lineitem)",
        "s AS (SELECT pct, unnest(range(3, 101)) AS n FROM p)",
        "f AS (SELECT pct, min(n) FILTER (abs(round_even(pct * n / 100, 0) / n * 100 - pct) > 0.05) AS failing_n FROM s GROUP BY ALL)",
        select="SELECT pct, CAST(failing_n AS INT) AS failing_n FROM f",
    ),
)
def h10(spark, sf_dir):
    pct = (F.col("l_extendedprice") % 100).cast("decimal(8,1)").cast("double")
    rows = X.read(spark, sf_dir, "lineitem").select(pct.alias("pct")).distinct()
    return rows.select("pct", S.percent_grim(F.col("pct"), F.lit(None).cast("int")).alias("failing_n"))


@add(
    "x11_h23_interval_rows",
    with_sql(
        """i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS est, l_quantity - CAST(l_discount * 100 AS INT) AS lo, l_quantity + CAST(l_tax * 100 AS INT) AS hi, l_linenumber % 2 = 0 AS log_axis FROM lineitem),
j AS (SELECT *, log_axis AND lo > 0 AS lg FROM i),
k AS (SELECT *, CASE WHEN lg THEN ln(est) - ln(CASE WHEN lo > 0 THEN lo ELSE 1 END) ELSE est - lo END AS l, CASE WHEN lg THEN ln(hi) - ln(est) ELSE hi - est END AS r FROM j)""",
        select="SELECT log_axis, count(*) AS intervals, count(*) FILTER (greatest(l, r) > 0 AND abs(l - r) / greatest(l, r) > CASE WHEN lg THEN 0.2 ELSE 0.1 END) AS asymmetric FROM k GROUP BY log_axis",
    ),
)
def x11(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    text = F.concat(
        F.when(F.col("l_linenumber") % 2 == 0, "odds ratio ").otherwise("mean difference "),
        q.cast("string"), F.lit(" ("),
        (q - F.round(F.col("l_discount") * 100).cast("int")).cast("string"), F.lit(", "),
        (q + F.round(F.col("l_tax") * 100).cast("int")).cast("string"), F.lit(")"),
    )
    blocks = X.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_no"), text.alias("text")
    )
    rows = S.interval_rows(blocks)
    return rows.groupBy("log_axis").agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if("asymmetric").alias("asymmetric")
    )


def square_numeric(spark, sf_dir):
    """Correlation-like 4x4 tables from the vectors: unit diagonal, rounded products."""
    e = lambda k: F.element_at("embedding", k)
    cell = lambda i, j: F.round(
        F.lit(1.0) if i == j else F.least(F.lit(1.0), F.greatest(F.lit(-1.0), e(min(i, j) * 4 + max(i, j) + 1).cast("double") * 2)), 2
    )
    cells = [
        F.struct(F.lit(i).cast("long").alias("row_idx"), F.lit(j).alias("col_idx"), cell(i, j).alias("num"))
        for i in range(4) for j in range(4)
    ]
    return (
        X.read(spark, sf_dir, "embeddings")
        .select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("table_id"), F.explode(F.array(*cells)).alias("c"))
        .select("doc_id", "table_id", "c.*")
    )


@add("a23_correlation_matrices")
def a23(spark, sf_dir):
    return rounded(S.correlation_matrices(square_numeric(spark, sf_dir)), min_eigenvalue=6)


@add(
    "p6_column_roles",
    with_sql(
        X.line_cells_sql(),
        select="SELECT header, CASE header WHEN 'discount' THEN 'value' WHEN 'group sd' THEN 'value' ELSE 'value' END AS role, count(*) AS cells FROM cells GROUP BY header",
    ),
)
def p6(spark, sf_dir):
    cells = X.line_cells(spark, sf_dir)
    return cells.groupBy("header", S.column_role(F.col("header")).alias("role")).agg(
        F.count(F.lit(1)).alias("cells")
    )


@add(
    "h12_chi2_tail_even",
    "SELECT event_id, round(least(1, exp(-value / 20) * (1 + value / 20 + pow(value / 20, 2) / 2 + pow(value / 20, 3) / 6)), 8) AS p FROM events",
)
def h12(spark, sf_dir):
    return X.read(spark, sf_dir, "events").select(
        "event_id", F.round(K.chi2_tail_even(F.col("value") / 10, 8), 8).alias("p")
    )


@add(
    "h12_h13_kernels",
    """SELECT event_id, round(list_sum(list_transform(range(CAST(event_id % 12 AS BIGINT), 21), lambda i: exp(lgamma(21) - lgamma(i + 1) - lgamma(21 - i) + i * ln(0.2) + (20 - i) * ln(0.8)))), 8) AS binomial,
 round(1 - coalesce(list_sum(list_transform(range(0, CAST(event_id % 12 AS BIGINT)), lambda i: exp(-3 + i * ln(3) - lgamma(i + 1)))), 0), 8) AS poisson,
 round(1 - list_sum(list_transform(range(0, 400), lambda k: exp((4.5 + k) * ln(value / 40) - value / 40 - lgamma(5.5 + k)))), 6) AS chi2 FROM events""",
)
def h13(spark, sf_dir):
    k = (F.col("event_id") % 12).cast("double")
    return X.read(spark, sf_dir, "events").select(
        "event_id",
        F.round(K.binomial_tail(k, F.lit(20.0), F.lit(0.2)), 8).alias("binomial"),
        F.round(K.poisson_tail(k, F.lit(3.0)), 8).alias("poisson"),
        F.round(K.chi2_tail(F.col("value") / 20, F.lit(9.0)), 6).alias("chi2"),
    )


@add("h14_tail_kernels")
def h14(spark, sf_dir):
    v = F.col("value") / 100
    return X.read(spark, sf_dir, "events").select(
        "event_id",
        F.round(K.t_tail(v, F.lit(10.0)), 8).alias("t"),
        F.round(K.f_tail(v, F.lit(3.0), F.lit(20.0)), 8).alias("f"),
        F.round(K.normal_tail(v), 8).alias("z"),
        F.round(K.pearson_tail(v / 10, F.lit(30.0)), 8).alias("r"),
    )


@add(
    "h1_h5_number_functions",
    with_sql(
        X.line_cells_sql(4),
        "b AS (SELECT row_idx, table_id, col_idx, CAST(text AS DOUBLE) AS num, text FROM cells)",
        select="""SELECT table_id, row_idx, col_idx, num, length(split_part(text, '.', 2)) AS places, right(text, 1) AS last_digit,
 CASE WHEN length(split_part(text, '.', 2)) >= 2 THEN left(split_part(text, '.', 2), 2) END AS tail,
 CASE WHEN num > 0 THEN CAST(left(ltrim(replace(text, '.', ''), '0'), 1) AS INT) END AS first_digit FROM b""",
    ),
)
def h1(spark, sf_dir):
    text = F.concat(F.lit("$"), F.col("text"), F.lit("%"))
    return X.line_cells(spark, sf_dir, 4).select(
        "table_id",
        "row_idx",
        "col_idx",
        N.coerce_number(text).alias("num"),
        N.fraction_digits(F.col("text")).alias("places"),
        N.terminal_digit(F.col("text")).alias("last_digit"),
        N.decimal_tail(F.col("text")).alias("tail"),
        N.leading_digit(N.coerce_number(F.col("text"))).alias("first_digit"),
    )
