"""Shared schemas, severity order and deterministic ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("info", "low", "medium", "high", "critical")

CELLS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("table_id", T.LongType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("col_idx", T.IntegerType()),
        T.StructField("header", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

FINDINGS = T.StructType(
    [
        T.StructField("finding_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("detector", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("raw", T.MapType(T.StringType(), T.StringType())),
    ]
)


def severity_rank(column: Column | str) -> Column:
    """info 0 … critical 4; unknown values rank as info."""
    column = F.col(column) if isinstance(column, str) else column
    labels = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.greatest(F.array_position(labels, F.lower(column)).cast("int") - 1, F.lit(0))


def severity_name(rank: Column) -> Column:
    labels = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.element_at(labels, (rank + 1).cast("int"))


def cap_severity(column: Column | str, limit: Column | str) -> Column:
    """The lower of a severity and its cap."""
    limit = F.lit(limit) if isinstance(limit, str) else limit
    return severity_name(F.least(severity_rank(column), severity_rank(limit)))


def downgrade_severity(column: Column | str, steps: int = 1) -> Column:
    return severity_name(F.greatest(severity_rank(column) - steps, F.lit(0)))


def short_id(*parts: Column, length: int = 12) -> Column:
    """Leading hex digits of sha1 over the joined parts."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *text)), 1, length)


def schema_hash(headers: Column) -> Column:
    """sha256 of a header array as JSON."""
    return F.sha2(F.to_json(headers), 256)


def to_findings(
    df: DataFrame,
    detector: str,
    *,
    check: Column | str,
    severity: Column | str,
    title: Column,
    location: Column,
    raw: Sequence[str] = (),
) -> DataFrame:
    """Project any operator output onto the findings schema with a reproducible id."""
    check = F.lit(check) if isinstance(check, str) else check
    severity = F.lit(severity) if isinstance(severity, str) else severity
    pairs: list[Column] = []
    for name in raw:
        pairs += [F.lit(name), F.col(name).cast("string")]
    evidence = F.create_map(*pairs) if pairs else F.expr("map()").cast("map<string,string>")
    return df.select(
        short_id(F.col("doc_id"), F.lit(detector), check, location).alias("finding_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit(detector).alias("detector"),
        check.alias("check"),
        severity.alias("severity"),
        title.alias("title"),
        location.alias("location"),
        evidence.alias("raw"),
    )
