"""Operator protocol and user extensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import DataFrame

from ..model import FINDINGS

ENTRY_POINT_GROUP = "verilens.operators"
BACKEND_HITS = "doc_id string, image_id long, backend string, kind string, score double, error string"


@dataclass(frozen=True)
class Operator:
    """A detector: the tables it needs and a function from them to findings."""

    name: str
    inputs: tuple[str, ...]
    apply: Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class Registry:
    operators: dict[str, Operator] = field(default_factory=dict)

    def add(self, operator: Operator) -> None:
        if operator.name in self.operators:
            raise ValueError(f"operator registered twice: {operator.name}")
        self.operators[operator.name] = operator

    def load_entry_points(self) -> None:
        """Operators of installed packages, by entry-point group."""
        for point in entry_points(group=ENTRY_POINT_GROUP):
            self.add(point.load())

    def run(self, tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
        """Union of the findings of all operators whose inputs are present."""
        out = None
        for name, operator in self.operators.items():
            if (names and name not in names) or not all(t in tables for t in operator.inputs):
                continue
            part = operator.apply(tables).select(*FINDINGS.fieldNames())
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no operator applies to these tables")
        return out


def run_image_backend(images: DataFrame, name: str, analyze: Callable[[dict], list[dict]]) -> DataFrame:
    """Run a user function on every image row; a failing image yields an error row."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for image in part.to_dict("records"):
                key = (str(image["doc_id"]), int(image["image_id"]), name)
                try:
                    rows += [(*key, str(h.get("kind")), float(h.get("score", 0.0)), None) for h in analyze(image)]
                except Exception as error:  # one bad image must not stop the rest
                    rows.append((*key, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["doc_id", "image_id", "backend", "kind", "score", "error"])

    return images.mapInPandas(batches, BACKEND_HITS)
