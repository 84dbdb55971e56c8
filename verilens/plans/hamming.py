"""Exact Hamming-distance joins of 64-bit hashes by banded equi-joins.

A radius t is cut into m = ceil((t + 1) / 3) bands, so a pair within t differs
by at most two bits in some band.  Every hash is entered under its band value
and under each one-bit change of it; two such sets meet whenever the bands
differ by two bits or less.  That keeps bands wide (21 bits for t = 8) with 22
keys each, instead of nine narrow bands.

Keys that too many distinct hashes share (counted first, one aggregation) are
split again by bands of the remaining bits, which is exact for the same reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEY = 4096


def _bands(positions: Sequence[int], radius: int) -> list[list[int]]:
    """Cut bit positions into contiguous bands that a pair within ``radius`` must nearly share."""
    m = max(1, -(-(radius + 1) // 3))
    size, extra = divmod(len(positions), m)
    out, at = [], 0
    for i in range(m):
        width = size + (1 if i < extra else 0)
        out.append(list(positions[at : at + width]))
        at += width
    return out


def _mask(bits: Sequence[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _keys(hash_: Column, bands: list[list[int]], first: int, probing: bool) -> list[Column]:
    keys = []
    for number, bits in enumerate(bands, start=first):
        base = hash_.bitwiseAND(F.lit(_mask(bits)).cast("long"))
        values = [base]
        if probing:
            values += [base.bitwiseXOR(F.lit(_mask([b])).cast("long")) for b in bits]
        keys.append(
            F.array(*[F.struct(F.lit(number).alias("band"), v.alias("key")) for v in values])
        )
    return keys


def _keyed(df: DataFrame, hash_: str, positions: Sequence[int], radius: int) -> DataFrame:
    bands = _bands(positions, radius)
    probing = radius // len(bands) > 0
    return df.withColumn("_k", F.explode(F.concat(*_keys(F.col(hash_), bands, 0, probing)))).select(
        *df.columns, F.col("_k.band").alias("_band"), F.col("_k.key").alias("_key")
    )


def _hot_keys(left: DataFrame, scope: list[str], limit: int) -> DataFrame:
    key = [*scope, "_band", "_key"]
    return (
        left.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select(*key, F.lit(True).alias("_hot"))
    )


def _split_hot(
    left: DataFrame, right: DataFrame, hot: DataFrame, scope: list[str], radius: int
) -> tuple[DataFrame, DataFrame]:
    """Add a second band and key to rows under hot keys; other rows get a fixed one."""
    key = [*scope, "_band", "_key"]
    first = _bands(range(64), radius)

    def second(df: DataFrame, hash_: str) -> DataFrame:
        choice = None
        for band, bits in enumerate(first):
            rest = [b for b in range(64) if b not in set(bits)]
            if not rest:
                return df.withColumn("_band2", F.lit(-1)).withColumn("_key2", F.lit(0).cast("long"))
            inner = F.concat(*_keys(F.col(hash_), _bands(rest, radius), 0, radius > 0))
            choice = (
                F.when(F.col("_band") == band, inner)
                if choice is None
                else choice.when(F.col("_band") == band, inner)
            )
        one = F.array(F.struct(F.lit(-1).alias("band"), F.lit(0).cast("long").alias("key")))
        return (
            df.join(hot, key, "left")
            .withColumn("_k", F.explode(F.when(F.col("_hot"), choice).otherwise(one)))
            .withColumn("_band2", F.col("_k.band"))
            .withColumn("_key2", F.col("_k.key"))
            .drop("_k", "_hot")
        )

    return second(left, "hash_a"), second(right, "hash_b")


def hash_pairs(
    left: DataFrame,
    right: DataFrame | None,
    radius: int,
    *,
    scope: Sequence[str] = (),
    hash_: str = "hash",
    hot_key: int = HOT_KEY,
) -> DataFrame:
    """Distinct hashes within ``radius`` bits: (scope, hash_a, hash_b, distance).

    Both inputs hold one row per (scope, hash).  With ``right`` omitted the
    input is joined with itself and each unordered pair comes once.
    """
    scope = list(scope)
    own = right is None
    a = left.select(*scope, F.col(hash_).alias("hash_a"))
    b = (left if own else right).select(*scope, F.col(hash_).alias("hash_b"))
    ka, kb = _keyed(a, "hash_a", range(64), radius), _keyed(b, "hash_b", range(64), radius)
    keys = [*scope, "_band", "_key"]
    hot = _hot_keys(ka, scope, hot_key)
    if not hot.isEmpty():
        ka, kb = _split_hot(ka, kb, hot, scope, radius)
        keys += ["_band2", "_key2"]
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    # Many keys per hash: sizes known before planning are those of the hashes, far too small for a broadcast.
    met = ka.hint("merge").join(kb.hint("merge"), keys)
    if own:
        met = met.filter(F.col("hash_a") < F.col("hash_b"))
    return (
        met.withColumn("distance", distance)
        .filter(F.col("distance") <= radius)
        .select(*scope, "hash_a", "hash_b", "distance")
        .dropDuplicates()
    )
