"""Persistent banded index of image fingerprints.

Two hashes within six bits agree on one of seven bands of nine or ten bits.  The index
keeps every distinct hash of a batch under each of its seven (band, key) slots and the
papers of a hash under the slot of its first band.  A folder holds 32 neighbouring slots
in order, so a batch writes 128 folders at most.  A batch asks only for the slots that
its own hashes fall into, at most ``SLOTS`` small numbers: Spark reads their folders and
no others, and in their files skips what lies outside.  Inside a slot the remaining bits are cut into
four groups, one of which differs by one bit at most: the batch enters each group with
its one-bit changes, the stored hash once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

RADIUS = 6
GROUPS = 4
SLOTS = (RADIUS + 1) << 10
FOLDER_BITS = 5


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    size, extra = divmod(len(bits), parts)
    ends = [(i + 1) * size + min(i + 1, extra) for i in range(parts)]
    return [bits[a:b] for a, b in zip([0, *ends], ends, strict=False)]


BANDS = _cut(list(range(64)), RADIUS + 1)


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def band_slot(hash_: Column, band: int) -> Column:
    """Number of one (band, key) of a hash, below ``SLOTS``."""
    bits = BANDS[band]
    key = F.shiftrightunsigned(hash_, bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1))
    return (key + (band << 10)).cast("int")


def _slots(hash_: Column) -> Column:
    return F.array(*[band_slot(hash_, band) for band in range(len(BANDS))])


def _parts(probing: bool) -> Column:
    """For each band the groups of the other bits: mask, and the changes to enter (0: none)."""
    table = []
    for bits in BANDS:
        groups = _cut([b for b in range(64) if b not in bits], GROUPS)
        changes = [[0, *(_mask([b]) for b in part if probing)] for part in groups]
        as_longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
        pairs = [(F.lit(_mask(part)).cast("long"), as_longs(own)) for part, own in zip(groups, changes, strict=True)]
        table.append(F.array(*[F.struct(mask.alias("mask"), own.alias("changes")) for mask, own in pairs]))
    return F.array(*table)


def _rest(hash_: Column, probing: bool) -> Column:
    """Keys of the bits outside the slot's band, each with its one-bit changes if probing."""
    parts = F.element_at(_parts(probing), F.shiftright("slot", 10) + 1)
    return F.flatten(
        F.transform(
            parts,
            lambda part, group: F.transform(
                part["changes"],
                lambda change: F.struct(group.alias("group"), hash_.bitwiseAND(part["mask"]).bitwiseXOR(change).alias("key")),
            ),
        )
    )


def usable(images: DataFrame) -> DataFrame:
    """Images that take part: a hash, and 64 pixels or more each way."""
    return images.filter((F.col("width") >= 64) & (F.col("height") >= 64) & F.col("phash").isNotNull())


def entries(images: DataFrame) -> DataFrame:
    """Index rows of usable images (S11): (paper_id, page, image_id, phash)."""
    return usable(images).select(F.col("doc_id").alias("paper_id"), "page", "image_id", "phash")


def banded(hashes: DataFrame) -> DataFrame:
    """Every distinct hash under each of its slots: (phash, slot)."""
    return hashes.select("phash").distinct().select("phash", F.explode(_slots(F.col("phash"))).alias("slot"))


def append(images: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch to the index; the same batch again replaces itself."""
    rows = entries(images)
    tables = {"papers": rows.withColumn("slot", band_slot(F.col("phash"), 0)), "bands": banded(rows)}
    for name, table in tables.items():
        # Rebalanced: few files a folder, full folders are split.
        placed = table.withColumn("folder", F.shiftright("slot", FOLDER_BITS)).hint("rebalance", "folder")
        target = f"{path}/{name}/batch_id={batch_id}"
        placed.sortWithinPartitions("folder", "slot").write.mode("overwrite").partitionBy("folder").parquet(target)


def read_index(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame | None:
    """``papers`` or ``bands`` of the batches before one (S12), None while there is no row."""
    try:
        table = spark.read.parquet(f"{path}/{name}")
    except Exception as error:
        if not any(kind in str(error) for kind in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return None
    return table if before is None else table.filter(F.col("batch_id") < before)


def in_slots(table: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows of the slots that ``slots(slot)`` names, at most ``SLOTS`` numbers, from their folders."""
    named = [r.slot for r in slots.select("slot").distinct().collect()]
    return table.filter(F.col("folder").isin({s >> FOLDER_BITS for s in named}) & F.col("slot").isin(named))


def near_hashes(asked: DataFrame, stored: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs within ``radius`` of two banded tables: (hash_a, hash_b, distance)."""
    if radius > RADIUS:
        raise ValueError(f"the index finds pairs within {RADIUS} bits")

    def keyed(table: DataFrame, name: str, probing: bool) -> DataFrame:
        keys = F.explode(_rest(F.col("phash"), probing)).alias("k")
        return table.select("slot", F.col("phash").alias(name), keys).select("slot", name, "k.group", "k.key")

    # Planned by the size of the hashes, not of their keys, either side would be broadcast.
    met = keyed(asked, "hash_a", True).hint("merge").join(keyed(stored, "hash_b", False).hint("merge"), ["slot", "group", "key"])
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    return met.select("hash_a", "hash_b", distance.alias("distance")).filter(F.col("distance") <= radius).distinct()


def batch_edges(images: DataFrame, path: str, batch_id: int, radius: int = RADIUS) -> DataFrame:
    """Every paper of the index or of the batch itself near a hash of the batch.

    (hash_a, paper_id, distance): one row per hash and paper, papers of the hash
    themselves included; images of one hash share its rows.
    """
    spark = images.sparkSession
    own = written(entries(images))
    asked = written(banded(own))
    stored, papers = asked, own.select("paper_id", "phash")
    bands, known = (read_index(spark, path, name, batch_id) for name in ("bands", "papers"))
    if bands is not None:
        stored = stored.unionByName(in_slots(bands, asked).select("phash", "slot"))
    pairs = written(near_hashes(asked, stored.distinct(), radius))
    if known is not None:
        held = in_slots(known, pairs.select(band_slot(F.col("hash_b"), 0).alias("slot")))
        papers = papers.unionByName(held.select("paper_id", "phash"))
    holders = papers.distinct().withColumnRenamed("phash", "hash_b")
    return pairs.join(holders, "hash_b").groupBy("hash_a", "paper_id").agg(F.min("distance").alias("distance"))
