"""Approximate nearest neighbours by collision counting (operator 9).

Every vector has its place in ``PROJECTIONS`` arrays, one for each random direction,
sorted by the projection on it.  A query opens a window around its own place in each
array; a vector in the windows of many arrays collides with the query that often.
Windows widen step by step (virtual rehashing: no other tables are needed for other
radii), and only what enters is counted.  Vectors with at least ``THRESHOLD`` of all
collisions are verified by their exact inner product.  Widening ends when a vector
as near as the k-th found so far would reach the threshold most likely.

Largest inner product is nearest Euclidean neighbour once every vector gets one
more component that brings all to the largest length.

Scale: the index is cut into blocks of a bounded number of vectors and the queries
into bounded chunks; a task holds one of each and gives at most k rows a query.
Equal vectors are spread over blocks by their number.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without id; vectors meet only those of their own length; repeated
ids are rows of their own; fewer than k candidates give fewer rows; extra columns
are left aside; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import number_rows

K = 20
EVERY = 20
PROJECTIONS = 32
#: Collisions, as a share of the arrays, from which a vector is verified.
THRESHOLD = 0.7
#: Standard deviations that a k-th neighbour's expected collisions lie above the threshold at the end.
CERTAINTY = 1.0
#: The first window half, in standard deviations of all projections.
FIRST = 0.8
WIDENING = 1.4
SEED = 9_173
BLOCK = 65_536
CHUNK = 512


def directions(size: int, number: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((number, size))


class Index:
    """Sorted projections of one block."""

    def __init__(self, vectors: np.ndarray, reach: float, number: int = PROJECTIONS):
        self.vectors = vectors
        rest = np.sqrt(np.maximum(0.0, reach * reach - (vectors * vectors).sum(axis=1)))
        self.squares = reach * reach
        self.axes = directions(vectors.shape[1] + 1, number)
        places = np.concatenate([vectors, rest[:, None]], axis=1) @ self.axes.T
        self.order = np.argsort(places, axis=0, kind="stable").T.astype(np.int32).copy()
        self.places = np.sort(places, axis=0).T.copy()
        self.spread = float(places.std()) or 1.0

    def search(self, query: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and inner products of the k nearest found; ``skip`` is the query's own position or -1."""
        number, size = self.places.shape
        needed = math.ceil(THRESHOLD * number)
        at = self.axes[:, :-1] @ query
        own = float(query @ query)
        counts = np.zeros(size, np.int16)
        score = np.full(size, -np.inf)
        checked = np.zeros(size, bool)
        if skip >= 0:
            checked[skip] = True
        half = FIRST * self.spread
        low = high = np.array([np.searchsorted(self.places[j], at[j]) for j in range(number)])
        while True:
            wider = [
                (np.searchsorted(self.places[j], at[j] - half), np.searchsorted(self.places[j], at[j] + half, "right"))
                for j in range(number)
            ]
            for j, (a, b) in enumerate(wider):
                counts[self.order[j, a : low[j]]] += 1
                counts[self.order[j, high[j] : b]] += 1
            low, high = [a for a, _ in wider], [b for _, b in wider]
            new = np.flatnonzero((counts >= needed) & ~checked)
            if len(new):
                checked[new] = True
                score[new] = (self.vectors[new] * query).sum(axis=1)
            if all(b - a == size for a, b in wider):
                break
            found = int(checked.sum()) - (skip >= 0)
            if found >= k:
                kth = float(np.partition(score, size - k)[size - k])
                distance = math.sqrt(max(0.0, self.squares + own - 2 * kth))
                likely = math.erf(half / (distance * math.sqrt(2))) if distance else 1.0
                if number * likely - needed >= CERTAINTY * math.sqrt(number * likely * (1 - likely)):
                    break
            half *= WIDENING
        hits = np.flatnonzero(np.isfinite(score))
        if len(hits) > k:  # all that tie with the k-th stay; ids decide later
            hits = hits[score[hits] >= np.partition(score[hits], len(hits) - k)[len(hits) - k]]
        return hits, score[hits]


def usable(vectors: DataFrame) -> DataFrame:
    """Numbered rows (_row, vec_id, v, size, squares) of the vectors that take part."""
    plain = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    numbered = number_rows(plain.filter("vec_id is not null and v is not null"), "near-vectors")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    whole = numbered.filter(finite)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return whole.select("_row", "vec_id", "v", F.size("v").alias("size"), squares.alias("squares")).filter("squares > 0")


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, nearest first.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates are
    all other rows.
    """
    rows = usable(vectors)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("squares").alias("most")).first()
    blocks = max(1, -(-facts["n"] // BLOCK))
    asked = rows.filter(F.col("vec_id") % every == 0)
    chunks = max(1, -(-asked.count() // CHUNK))
    reach = math.sqrt(facts["most"] or 1.0) * (1 + 1e-9)
    part = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select("_row", "vec_id", "v", "size", part(blocks).alias("block"), every_of(chunks).alias("chunk"))
    ask = asked.select("_row", "vec_id", "v", "size", part(chunks).alias("chunk"), every_of(blocks).alias("block"))

    def meet(held: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, group in asked_.groupby("size"):
            block = held[held["size"] == size].sort_values("_row", ignore_index=True)
            if not len(block):
                continue
            made = Index(np.stack(block["v"].to_numpy()).astype(np.float64), reach)
            row_numbers, ids = block["_row"].to_numpy(), block["vec_id"].to_numpy()
            for row, query_id, v in zip(group["_row"], group["vec_id"], group["v"], strict=True):
                place = int(np.searchsorted(row_numbers, row))
                own = place if place < len(block) and row_numbers[place] == row else -1
                hits, scores = made.search(np.asarray(v, np.float64), k, own)
                best = np.lexsort((row_numbers[hits], ids[hits], -scores))[:k]
                out.append(
                    pd.DataFrame(
                        {
                            "query_row": row,
                            "query_id": query_id,
                            "row": row_numbers[hits[best]],
                            "vec_id": ids[hits[best]],
                            "score": scores[best],
                        }
                    )
                )
        columns = ["query_row", "query_id", "row", "vec_id", "score"]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    found = (
        index.groupBy("block", "chunk")
        .cogroup(ask.groupBy("block", "chunk"))
        .applyInPandas(meet, "query_row long, query_id long, row long, vec_id long, score double")
    )
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
