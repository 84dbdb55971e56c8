"""Result sinks, exports and resumable steps."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of an error message kept in the table of runs.
ERROR_CHARS = 2000
RUNS = "doc_id string, detector string, ok boolean, error string, duration_ms long, n_findings long"


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Findings partitioned by detector."""
    findings.write.mode("append").partitionBy("detector").format(fmt).save(path)


def export(df: DataFrame, path: str, fmt: str) -> None:
    """JSON or CSV export; maps and arrays become JSON text in CSV."""
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("map", "array", "struct")]
        for name in nested:
            df = df.withColumn(name, F.to_json(name))
    elif fmt != "json":
        raise ValueError(f"unknown format: {fmt}")
    df.write.mode("overwrite").option("header", "true").format(fmt).save(path)


def pending(work: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, detector) steps without a successful run."""
    done = runs.filter("ok").select("doc_id", "detector").distinct()
    return work.join(done, ["doc_id", "detector"], "left_anti")


def run_pending(
    spark: SparkSession,
    detector: str,
    inputs: dict[str, DataFrame],
    operator: Callable[[dict[str, DataFrame]], DataFrame],
    findings_path: str,
    runs_path: str,
) -> None:
    """Run one operator on the documents that still need it and record the outcome.

    A failure is recorded with its message and leaves the documents pending.
    ``inputs['docs']`` lists the documents; every input carries ``doc_id``.
    """
    docs = inputs["docs"].select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(detector).alias("detector"))
    try:
        runs = spark.read.schema(RUNS).parquet(runs_path)
    except Exception as error:  # first run: nothing recorded yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        runs = spark.createDataFrame([], RUNS)
    todo = pending(docs, runs).select("doc_id")
    chosen = {
        name: df.join(todo.withColumnRenamed("doc_id", "_d"), df["doc_id"].cast("string") == F.col("_d"), "left_semi")
        for name, df in inputs.items()
    }
    started, error = time.monotonic(), None
    try:
        write_findings(operator(chosen), findings_path)
    except Exception as failed:  # a failed step is an outcome too, and is tried again next time
        error = f"{type(failed).__name__}: {failed}"[:ERROR_CHARS]
    spent = int(1000 * (time.monotonic() - started))
    rows = todo.withColumn("n_findings", F.lit(0).cast("long"))
    if error is None:
        written = spark.read.parquet(findings_path).filter(F.col("detector") == detector)
        counts = written.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.join(counts, "doc_id", "left").withColumn("n_findings", F.coalesce("_n", F.lit(0)))
    rows.select(
        "doc_id",
        F.lit(detector).alias("detector"),
        F.lit(error is None).alias("ok"),
        F.lit(error).cast("string").alias("error"),
        F.lit(spent).cast("long").alias("duration_ms"),
        "n_findings",
    ).write.mode("append").parquet(runs_path)
