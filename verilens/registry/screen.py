"""The whole chain on the supplier tables: checks, findings, calibration, issues, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import to_findings
from ..operators import columns as C
from ..operators import findings as A
from ..operators import relations as L
from . import corpus as X

QUERIES = {}


def table_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the first-digit, repeated-value, spread and column-pair checks."""
    rows = X.packed_lines(spark, sf_dir)
    # one row a column leaves the task that holds a table, not one a column and scanned file
    short, long = C.whole_tables(rows, C.ROWS_OF_A_TASK)

    def of_columns(check):
        return check(short) if long is None else check(short).unionByName(check(long))

    column = F.concat(F.lit("Table "), "table_id", F.lit(", column "), F.col("col_idx") + 1)
    parts = [
        to_findings(
            of_columns(C.benford).filter("severity IS NOT NULL"),
            "table_benford",
            check="benford_first_digit",
            severity=F.col("severity"),
            title=F.concat(F.lit("First digits of '"), "header", F.lit("' depart from Benford's law")),
            location=column,
            raw=("table_id", "n", "chi2", "excess_mad"),
        ),
        to_findings(
            of_columns(lambda cells: C.repeated_values(C.decimal_values(cells))).filter("severity IS NOT NULL"),
            "table_relationships",
            check=F.col("check"),
            severity=F.col("severity"),
            title=F.concat(F.lit("Values of '"), "header", F.lit("' repeat")),
            location=column,
            raw=("table_id", "n", "top_count"),
        ),
        to_findings(
            of_columns(lambda cells: C.spread_columns(C.decimal_values(cells))).filter("severity IS NOT NULL"),
            "table_relationships",
            check="zero_standard_deviation_entries",
            severity=F.col("severity"),
            title=F.concat(F.lit("Spread column '"), "header", F.lit("' holds zeros")),
            location=column,
            raw=("table_id", "n", "zero_entries"),
        ),
    ]
    pairs = L.pair_checks(L.pair_votes(rows, chunk_size=X.LINE_CHUNK)).withColumns(
        {
            "table_id": F.col("table_a"),
            "left_column": F.col("header_a"),
            "right_column": F.col("header_b"),
            "matching_pairs": F.col("matched"),
            "offset": F.col("value"),
        }
    )
    parts.append(
        to_findings(
            pairs,
            "table_relationships",
            check=F.col("check"),
            severity=F.col("severity"),
            title=F.concat(F.lit("Columns '"), "header_a", F.lit("' and '"), "header_b", F.lit("' are related")),
            location=F.concat(
                F.lit("Table "), "table_id", F.lit(", columns "), F.col("col_a") + 1, F.lit(" and "), F.col("col_b") + 1
            ),
            raw=("table_id", "n", "left_column", "right_column", "matching_pairs", "offset"),
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.verdicts(A.issues(A.recalibrate(table_findings(spark, sf_dir))))


def union_of_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table_findings(spark, sf_dir)
    return found.select("finding_id", "doc_id", "detector", "check", "severity", "title", "location")


QUERIES["f8_screen"] = (screen, None)
QUERIES["u1_table_findings"] = (union_of_findings, None)
