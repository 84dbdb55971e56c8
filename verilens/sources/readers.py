"""Scans into normalized tables."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FINDINGS, short_id
from ..session import written
from . import records

cloudpickle.register_pickle_by_value(sys.modules[__name__])
csv.field_size_limit(sys.maxsize)

DATA_EXTENSIONS = ("csv", "tsv", "json", "jsonl", "parquet")


def infer_delimiters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Delimiter of each file, decided by its start (S2): (path, delimiter)."""
    return records.scan_blocks(spark, paths).filter("block = 0").select("path", "delimiter")


def read_csv_cells(spark: SparkSession, paths: str | list[str], delimiters: DataFrame | str | None = ",") -> DataFrame:
    """All-string cells of delimited files of any width; blank rows dropped, ragged rows kept.

    ``delimiters`` is one for all files, a table (path, delimiter), or None to decide by
    the start of each file.  The first row of a file gives the headers, cells and headers
    are trimmed, empty ones have no row.  Quoted fields may hold line breaks, also across
    blocks; ``row_idx`` orders rows inside a file.
    """
    found = records.read_records(spark, paths, delimiters)
    # Chosen before parsing: the optimizer moves no filter past the parser.
    rows = lambda kept: found.filter(kept).select("path", "row_idx", _fields("record", "delimiter").alias("values"))
    filled = rows("row_idx > 0").filter(F.exists("values", lambda v: v.isNotNull()))
    # The first record of a file starts at its line 0, so only its own lines are read for the headers.
    # Written, so that Spark knows how small they are: a join by path would shuffle a whole file to one task.
    heads = written(rows("row_idx = 0").select("path", F.col("values").alias("headers")))
    cells = filled.join(heads, "path").select(
        "path", "row_idx", "headers", F.posexplode("values").alias("col_idx", "text")
    )
    return cells.filter("text IS NOT NULL").select(
        F.xxhash64("path").alias("table_id"),
        "path",
        "row_idx",
        "col_idx",
        F.coalesce(
            F.try_element_at("headers", F.col("col_idx") + 1),
            F.concat(F.lit("col_"), (F.col("col_idx") + 1).cast("string")),
        ).alias("header"),
        "text",
    )


def _fields_of(found: pd.Series, delimiters: pd.Series) -> pd.Series:
    """Trimmed fields of single records, quotes respected; empty fields are null."""
    out = []
    for record, delimiter in zip(found, delimiters, strict=True):
        fields = next(csv.reader(io.StringIO(record), delimiter=delimiter), [])
        out.append([f.strip() or None for f in fields])
    return pd.Series(out, dtype=object)


#: Not deterministic for the optimizer only: it would parse every record once to filter and once more to project.
_fields = F.pandas_udf(_fields_of, T.ArrayType(T.StringType())).asNondeterministic()


def read_delimited(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cells of all files, each read with its own delimiter (S1 with S2)."""
    return read_csv_cells(spark, paths, None)


def read_json_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``{"headers": [], "rows": [[]]}`` documents as cells (S3)."""
    schema = "headers array<string>, rows array<array<string>>"
    docs = spark.read.schema(schema).option("multiLine", "true").json(paths).select(
        F.col("_metadata.file_path").alias("path"), "headers", F.posexplode("rows").alias("row_idx", "row")
    )
    return docs.select("path", "headers", "row_idx", F.posexplode("row").alias("col_idx", "text")).select(
        F.xxhash64("path").alias("table_id"),
        "path",
        F.col("row_idx").cast("long").alias("row_idx"),
        "col_idx",
        F.coalesce(
            F.try_element_at("headers", F.col("col_idx") + 1),
            F.concat(F.lit("col_"), (F.col("col_idx") + 1).cast("string")),
        ).alias("header"),
        "text",
    )


def read_json_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Arrays of records with the union of their keys as columns."""
    return spark.read.option("multiLine", "true").option("primitivesAsString", "true").json(paths)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines, plain or gzipped; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def discover_files(spark: SparkSession, root: str, max_depth: int = 3, extensions=DATA_EXTENSIONS) -> DataFrame:
    """Data files under a folder: depth limit, hidden folders skipped, extension filter."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "modificationTime", "length")
    )
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    parts = F.split(below, "/")
    name = F.element_at(parts, -1)
    return (
        files.withColumn("depth", F.size(parts) - 1)
        .withColumn("ext", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))
        .filter((F.col("depth") <= max_depth) & F.col("ext").isin(*extensions))
        .filter(~F.exists(parts, lambda p: p.startswith(".")))
    )


READERS: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {
    "csv": read_delimited,
    "tsv": read_delimited,
    "json": read_json_tables,
}


def read_data_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cells of mixed files by extension."""
    out = None
    for ext, reader in READERS.items():
        chosen = [p for p in paths if p.lower().endswith("." + ext)]
        if chosen:
            part = reader(spark, chosen)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no readable files")
    return out


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings written as JSON."""
    return spark.read.schema(FINDINGS).json(path)


def source_ids(cells: DataFrame) -> DataFrame:
    """Stable short table id from the path."""
    return cells.withColumn("source_id", short_id(F.col("path")))
