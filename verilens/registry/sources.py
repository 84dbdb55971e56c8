"""Readers over files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_folder
from ..sources import readers
from . import corpus as X

QUERIES = {}


def add(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


@add(
    "s1_quoted_documents",
    "SELECT doc_id, coalesce(lang, '') AS lang, coalesce(trim(source), '') AS source, length(t) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT *, "
    "regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM documents)",
)
def s1(spark, sf_dir):
    """Whole documents as delimited files and back: texts hold quotes, delimiters and line breaks."""
    folder = f"{checkpoint_folder(spark)}/delimited-{uuid.uuid4().hex}"
    docs = X.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    docs.write.option("header", True).option("sep", ";").option("escape", '"').option("nullValue", "").csv(folder)
    cells = readers.read_delimited(spark, folder)
    of = lambda name: F.coalesce(F.max(F.when(F.col("header") == name, F.col("text"))), F.lit(""))
    text = lambda f: F.max(F.when(F.col("header") == "text", f))
    # Texts are digested where they are parsed; rows are put together from the digests.
    return cells.groupBy("table_id", "row_idx").agg(
        of("doc_id").cast("long").alias("doc_id"),
        of("lang").alias("lang"),
        of("source").alias("source"),
        F.coalesce(text(F.length("text").cast("long")), F.lit(0).cast("long")).alias("n_chars"),
        F.coalesce(text(F.sha2("text", 256)), F.sha2(F.lit("").cast("binary"), 256)).alias("text_sha256"),
    ).drop("table_id", "row_idx")
