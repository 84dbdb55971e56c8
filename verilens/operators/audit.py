"""Table audits, highlights, OCR grids and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..model import schema_hash
from ..plans import ranks as R
from .columns import COLUMN, ROWS_OF_A_TASK, TABLE, whole_tables
from .relations import fixed_offsets, whole_rows


def column_profile(cells: DataFrame, *, outliers: bool = True) -> DataFrame:
    """Type, counts, range, mean and 3-sigma outliers of every column.

    Distinct values are counted after merging equal cells, so no group holds a
    set; outliers need only the sums of the first pass and may be left out.  Rows may
    come packed, their cells in ``items``: tables that fit into a task are counted there.
    """
    if "items" in cells.columns:
        short, long = whole_tables(cells, ROWS_OF_A_TASK)
        found = column_profile(short, outliers=outliers)
        return found if long is None else found.unionByName(column_profile(long, outliers=outliers))
    text = F.trim(F.coalesce("text", F.lit("")))
    counts = (
        cells.select(*COLUMN, text.alias("t"))
        .groupBy(*COLUMN, "t")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("num", N.coerce_number(F.col("t")))
        .withColumn("_bucket", F.pmod(F.xxhash64("t"), F.lit(64)))
    )
    blank = F.col("t") == ""
    missing = blank | F.lower("t").isin(*N.MISSING_TOKENS, "nan")
    filled = ~missing
    w = F.col("cnt")
    stats = counts.groupBy(*COLUMN).agg(
        F.sum(w).alias("count"),
        F.sum(F.when(blank, w).otherwise(0)).alias("missing"),
        F.count_if(~blank).alias("distinct_values"),
        F.sum(F.when(~blank, w - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(filled, w).otherwise(0)).alias("typed"),
        F.sum(F.when(filled & F.col("t").rlike(r"^[+-]?\d+$"), w).otherwise(0)).alias("ints"),
        F.sum(F.when(filled & F.col("num").isNotNull(), w).otherwise(0)).alias("nums"),
        F.sum(F.when(filled & F.lower("t").isin("true", "false", "yes", "no"), w).otherwise(0)).alias("bools"),
        F.min("num").alias("min_value"),
        F.max("num").alias("max_value"),
        (F.sum(F.col("num") * w) / F.sum(F.when(F.col("num").isNotNull(), w))).alias("mean"),
    )
    dtype = (
        F.when(F.col("typed") == 0, "empty")
        .when(F.col("ints") == F.col("typed"), "int")
        .when(F.col("nums") == F.col("typed"), "float")
        .when(F.col("bools") == F.col("typed"), "bool")
        .otherwise("string")
    )
    stats = stats.withColumn("dtype", dtype)
    n = F.col("count")
    flags = F.array_compact(
        F.array(
            F.when(F.col("missing") / n > 0.05, F.lit("missing")),
            F.when(F.col("duplicates") / n > 0.10, F.lit("duplicates")),
            F.when(
                F.col("max_value") - F.col("min_value") > F.greatest(F.lit(1.0), F.abs("mean")) * 10,
                F.lit("range"),
            ),
        )
    )
    names = ["dtype", "count", "missing", "distinct_values", "duplicates", "min_value", "max_value", "mean"]
    if not outliers:
        return stats.select(*COLUMN, *names, flags.alias("flags"))
    centred = R.attach_group_values(
        counts.filter("num IS NOT NULL").select(*COLUMN, "_bucket", "num", "cnt"),
        stats.select(*COLUMN, "mean"),
        COLUMN,
        chunk="_bucket",
    )
    spread = centred.groupBy(*COLUMN).agg(
        F.sqrt(F.sum(F.pow(F.col("num") - F.col("mean"), 2) * w) / F.sum(w)).alias("pstdev")
    )
    far = R.attach_group_values(centred, spread, COLUMN, chunk="_bucket")
    beyond = far.groupBy(*COLUMN).agg(
        F.max("pstdev").alias("pstdev"),
        F.sum(
            F.when((F.col("pstdev") > 0) & (F.abs(F.col("num") - F.col("mean")) > F.col("pstdev") * 3), w).otherwise(0)
        ).alias("outliers"),
    )
    return stats.join(beyond, COLUMN, "left").select(
        *COLUMN, *names, "pstdev", F.coalesce("outliers", F.lit(0)).alias("outliers"), flags.alias("flags")
    )


def table_audit(profile: DataFrame) -> DataFrame:
    """Table rows of the audit plus one grand total per document."""
    tables = profile.groupBy(*TABLE).agg(
        F.max("count").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sum("duplicates").alias("duplicates"),
        F.sum("missing").alias("missing"),
        F.sum("count").alias("cells"),
        F.sum(F.size("flags")).alias("flags"),
        F.sha2(
            F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header", "dtype"))),
                                  lambda s: F.struct(s["header"].alias("name"), s["dtype"].alias("dtype")))), 256
        ).alias("schema_hash"),
    )
    total = tables.groupBy("doc_id").agg(
        F.lit(None).cast("long").alias("table_id"),
        *[F.sum(c).alias(c) for c in ("rows", "columns", "duplicates", "missing", "cells", "flags")],
        F.lit(None).cast("string").alias("schema_hash"),
    )
    return tables.unionByName(total).withColumn("missing_pct", F.round(F.col("missing") * 100 / F.col("cells"), 4))


def table_inventory(cells: DataFrame) -> DataFrame:
    """One row per table: rows, columns, headers."""
    headers = cells.groupBy(*TABLE, "col_idx").agg(
        F.min("header").alias("header"), F.count(F.lit(1)).alias("c")
    )
    return headers.groupBy(*TABLE).agg(
        F.max("c").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda s: s["header"]).alias("headers"),
    )


def read_table(cells: DataFrame, table_id: int, columns: list[int]) -> DataFrame:
    """One table back as rows and columns."""
    return (
        cells.filter(F.col("table_id") == table_id)
        .groupBy("row_idx")
        .pivot("col_idx", columns)
        .agg(F.first("text"))
    )


def table_chunk(cells: DataFrame, offset: int, limit: int) -> DataFrame:
    """A chunk of rows of every table with ``has_more`` and the header hash.

    Rows are numbered by distributed positions; they may come packed, their cells in
    ``items``.  A row is shuffled as one text.
    """
    cell = lambda c: F.struct(c["col_idx"].alias("col_idx"), c["header"].alias("header"), c["text"].alias("text"))
    if "items" in cells.columns:
        rows = whole_rows(cells).withColumn("c", F.array_sort(F.transform("items", cell)))
    else:
        rows = cells.groupBy(*TABLE, "row_idx").agg(
            F.array_sort(F.collect_list(F.struct("col_idx", "header", "text"))).alias("c")
        )
    texts = rows.select(*TABLE, "row_idx", F.to_json("c.text").alias("_texts"), schema_hash(F.col("c.header")).alias("schema_hash"))
    placed = R.with_positions(texts, TABLE, "row_idx", chunk_size=1 << 44, below=offset + limit)
    return placed.filter(F.col("pos") >= offset).select(
        *TABLE,
        "pos",
        F.from_json("_texts", "array<string>").alias("values"),
        (F.col("n") > offset + limit).alias("has_more"),
        "schema_hash",
    )


def table_label(tables: DataFrame) -> DataFrame:
    """Display label: figure in sheet, or table with sheet and number (P5).

    ``tables(doc_id, table_id, source_kind, sheet_name, fig_name)``.
    """
    number = F.dense_rank().over(W.partitionBy("doc_id").orderBy("table_id"))
    fig, sheet = F.nullif(F.trim("fig_name"), F.lit("")), F.nullif(F.trim("sheet_name"), F.lit(""))
    return tables.withColumn("_no", number).select(
        *TABLE,
        F.when(fig.isNotNull() & sheet.isNotNull(), F.concat(fig, F.lit(" in "), sheet))
        .when(fig.isNotNull(), fig)
        .when(sheet.isNotNull(), F.concat(F.lit("Table "), sheet, F.lit(" #"), F.col("_no")))
        .otherwise(F.concat(F.lit("Table "), F.col("_no")))
        .alias("label"),
    )


# --------------------------------------------------------------------------- highlights

YELLOW = ("yellow", "ffff00", "ffffff00", "fff2cc", "ffff99", "ffeb9c")


def yellow_like(fill: Column) -> Column:
    """Named yellow or r,g high and b low."""
    f = F.lower(F.regexp_replace(fill, "^#", ""))
    rgb = F.right(f, F.lit(6))
    part = lambda i: F.conv(F.substring(rgb, i, 2), 16, 10).cast("int")
    return f.isin(*YELLOW) | (
        rgb.rlike("^[0-9a-f]{6}$") & (part(1) >= 200) & (part(3) >= 180) & (part(5) <= 160)
    )


def highlight_rollup(highlights: DataFrame) -> DataFrame:
    """Highlighted and yellow cells per table (A25); cells without ``fill`` are not highlighted."""
    yellow = yellow_like(F.col("fill"))
    out = highlights.filter("fill IS NOT NULL").groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(yellow).alias("yellow"),
        F.count_distinct("fill").alias("fills"),
    )
    return out.withColumn(
        "severity", F.when((F.col("yellow") > 0) | (F.col("cells") >= 5), "medium").otherwise("low")
    )


def highlight_checks(highlights: DataFrame) -> DataFrame:
    """Repeats, zero variance and arithmetic progression of highlighted cells."""
    filled = highlights.filter("fill IS NOT NULL")
    numeric = filled.withColumn("num", N.exact_decimal(F.col("value"))).filter("num IS NOT NULL")
    column = [*TABLE, "col_idx"]
    placed = R.with_positions(numeric, column, "row_idx", chunk_size=1 << 44)
    counts = placed.groupBy(*column, "num").agg(F.count(F.lit(1)).alias("c"))
    repeats = counts.groupBy(*column).agg(
        F.sum("c").alias("n"), F.max("c").alias("top"), F.count(F.lit(1)).alias("distinct_values")
    )
    steps = (
        R.lagged(placed, column, "pos", {"num": "prev"})
        .withColumn("step", F.round(F.col("num") - F.col("prev"), 6))
        .groupBy(*column)
        .agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    )
    check = (
        F.when((F.col("distinct_values") == 1) & (F.col("n") >= 3), "highlight_zero_variance")
        .when((F.col("n") >= 3) & (F.col("top") / F.col("n") >= 0.75), "highlight_repeated")
        .when(
            (F.col("n") >= 4) & (F.col("lo") == F.col("hi")) & (F.col("lo") != 0),
            "highlight_progression",
        )
    )
    return repeats.join(steps, column).withColumn("check", check).select(
        *column, "n", "top", "distinct_values", "check"
    )


def highlight_offsets(highlights: DataFrame) -> DataFrame:
    """Two highlighted columns of a table with one fixed offset over at least three cells.

    Cells pair by their position among the highlighted numbers of their column.
    """
    filled = highlights.filter("fill IS NOT NULL").withColumn("num", N.exact_decimal(F.col("value")))
    column = [*TABLE, "col_idx"]
    placed = R.with_positions(filled.filter("num IS NOT NULL"), column, "row_idx", chunk_size=1 << 44)
    found = fixed_offsets(placed.withColumn("header", F.concat(F.lit("col_"), F.col("col_idx") + 1)))
    return found.select(
        "doc_id",
        F.col("table_a").alias("table_id"),
        "col_a",
        "col_b",
        "n",
        "offset",
        F.when(F.col("offset") == 0, "high").otherwise("medium").alias("severity"),
    )


# --------------------------------------------------------------------------- OCR grids


def ocr_grid(detections: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """Rows by vertical proximity, columns by x (A31): ``detections(doc_id, page, x, y, text)``.

    A page holds a bounded number of detections, so windows run per page.
    """
    page = ["doc_id", "page"]
    by_y = W.partitionBy(*page).orderBy("y", "x")
    jump = (F.col("y") - F.lag("y").over(by_y) > tolerance).cast("int")
    rows = detections.withColumn("_j", F.coalesce(jump, F.lit(0))).withColumn(
        "grid_row", F.sum("_j").over(by_y.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    return rows.withColumn(
        "grid_col", F.row_number().over(W.partitionBy(*page, "grid_row").orderBy("x")) - 1
    ).drop("_j")


def grid_stats(grid: DataFrame) -> DataFrame:
    """Numeric share and table-likeness of recovered grids."""
    num = N.strict_number(F.col("text"))
    stats = grid.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count(num).alias("numeric_cells"),
        (F.max("grid_row") + 1).alias("rows"),
        (F.max("grid_col") + 1).alias("cols"),
    )
    return stats.withColumn(
        "table_like",
        (F.col("rows") >= 3) & (F.col("cols") >= 2) & (F.col("numeric_cells") / F.col("cells") >= 0.3),
    )


def constant_grid_columns(grid: DataFrame) -> DataFrame:
    """Columns of recovered grids with at least four numbers, all equal to six places."""
    num = F.round(N.strict_number(F.col("text")), 6)
    return (
        grid.groupBy("doc_id", "page", (F.col("grid_col") + 1).alias("column"))
        .agg(F.count(num).alias("n"), F.min(num).alias("value"), F.max(num).alias("_hi"))
        .filter((F.col("n") >= 4) & (F.col("value") == F.col("_hi")))
        .drop("_hi")
    )


# --------------------------------------------------------------------------- scores

# Finding weights, higher for local-feature kinds.
STRONG_KINDS = ("sift_copy_move", "cross_image_sift", "panel_sift_match", "jpeg_ghost")


def forensics_score(findings: DataFrame) -> DataFrame:
    """Weighted score per document, capped at one, with risk class."""
    kind, severity = F.col("check"), F.col("severity")
    weight = (
        F.when((severity == "high") & kind.isin(*STRONG_KINDS, "full_image_duplicate"), 0.24)
        .when(severity == "high", 0.20)
        .when((severity == "medium") & kind.isin(*STRONG_KINDS), 0.12)
        .when(severity == "medium", 0.09)
        .otherwise(0.03)
    )
    summary = findings.groupBy("doc_id").agg(
        F.least(F.lit(1.0), F.round(F.sum(weight), 6)).alias("score"),
        F.count_if(severity == "high").alias("high"),
        F.count_if(severity == "medium").alias("medium"),
    )
    return summary.withColumn(
        "risk",
        F.when((F.col("score") >= 0.55) | (F.col("high") >= 2), "high")
        .when((F.col("score") >= 0.25) | (F.col("medium") >= 2), "medium")
        .otherwise("low"),
    )
