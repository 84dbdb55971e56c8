"""Queries over the given tables, each with its SQL equivalent where SQL can state it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("columns", "relations", "images", "findings", "text", "consistency", "reports", "screen", "sources", "streams")

Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        for key, value in module.QUERIES.items():
            if key in out:
                raise ValueError(f"query registered twice: {key}")
            out[key] = value
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries()["f8_screen"][0](spark, sf_dir)
