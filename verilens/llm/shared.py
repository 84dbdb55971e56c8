"""Small helpers of the training-data operators: scratch tables, words, column checks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, shuffles_dropped

#: A word is a run of characters other than the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch that brings whole texts to Python; the default is made for short rows.
TEXT_ROWS = 1_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def write_table(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    A lost executor loses no row of it, and later steps reread the table instead
    of repeating what made it.  ``batch`` bounds the rows of a batch that Python gets
    while the table is made; the session's setting is put back behind it.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(BATCH)
    if batch:
        spark.conf.set(BATCH, str(batch))
    try:
        with shuffles_dropped(spark):
            df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """A written copy of ``df`` with ``_row``, a number that no other row has.

    Rows of one id, or without one, stay apart; the number is part of the written
    table and so does not change when a task is repeated.
    """
    return write_table(df.withColumn("_row", F.monotonically_increasing_id()), name)


def count_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
