"""Mixing sources to target weights by capped water-filling (operator 10).

Each source gets a share of the total by weight.  Sources that would be read more
than ``max_epochs`` times are clamped there and their excess is shared again among
the others by weight, until no source is above its limit.  A source is then taken
as whole repetitions plus a fraction: rows in a seeded hash order until the
fraction's words are reached, of the last one only its first words.

Scale: words are counted once into a narrow written table.  Water-filling reads
only one row per source and two totals per round.  The place where a source's
fraction ends is found in sums over ``BINS`` ranges of the hash; only the rows of
the one range in which it falls are put in order, so a source with a third of all
rows is never sorted or held by one task.

Cases: a null text has no words and is kept with ``taken`` 0; a null source is a
source of its own and comes last; an empty table gives an empty mix; repeated rows
and null ids are rows of their own; extra columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import count_words, number_rows, write_table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20_250_601
#: Ranges of the seeded hash in which words are summed per source.
BINS = 1 << 14


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 50).cast("int")


def sized(numbered: DataFrame, seed: int) -> DataFrame:
    """One narrow written row per document: ``_row``, doc_id, source, size and the seeded place ``h``."""
    rows = numbered.select(
        "_row",
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        count_words(F.col("text").cast("string")).alias("size"),
    )
    return write_table(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size")), "mix-sizes")


def source_order(sizes: DataFrame) -> DataFrame:
    """Sources in code point order, null last, numbered from 0, with their words."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    spread = write_table(
        totals.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("_row", F.monotonically_increasing_id()),
        "mix-sources",
    )
    # the number's upper bits are the range, its lower 33 bits the place in it
    part = spread.withColumn("_part", F.shiftright("_row", 33))
    before = part.groupBy("_part").count().select(
        "_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before")
    )
    return part.join(before, "_part").select(
        "source", "source_size", (F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)).alias("place")
    )


def water_fill(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, source_size, target) for ``sources(source, source_size, place)``."""
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    known = write_table(
        sources.select(
            "source",
            "source_size",
            weight.cast("double").alias("weight"),
            (F.col("source_size") * max_epochs).cast("double").alias("limit"),
        ),
        "mix-weights",
    )
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        # sources that reach their limit below the present level stay clamped
        clamped = F.col("limit") <= F.col("weight") * level
        row = known.agg(
            F.sum(F.when(clamped, F.col("limit")).otherwise(0.0)).alias("held"),
            F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        raised = (total - row.held) / row.open if row.open else level
        if raised <= level:
            break
        level = raised
    return known.select(
        "source", "source_size", F.least("limit", F.col("weight") * level).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, whole, part, taken.

    ``whole`` full copies and, where ``part`` > 0, one more copy cut to its first
    ``part`` words (``part`` = size for a full further copy); ``taken`` is their
    number of words together.  Reruns agree: order comes from a seeded hash.
    """
    return mix_sized(sized(docs.withColumn("_row", F.monotonically_increasing_id()), seed), weights, max_epochs)


def mix_sized(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``mix`` of the table that ``sized`` writes."""
    plan = (
        water_fill(source_order(sizes), weights, max_epochs)
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("ratio"))
        .withColumn("quota", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    plan = write_table(plan, "mix-plan")
    binned = sizes.withColumn("bin", _bin(F.col("h")))
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("bin")) - F.col("words")
    bins = (
        sums.withColumn("before", running)
        .join(plan, sums["source"].eqNullSafe(plan["source"]))
        .select(
            sums["source"],
            "bin",
            "source_size",
            "target",
            "whole",
            (F.col("quota") - F.col("before")).alias("left"),
            ((F.col("before") < F.col("quota")) & (F.col("before") + F.col("words") > F.col("quota"))).alias("edge"),
        )
    )
    bins = write_table(bins, "mix-bins")
    rows = binned.join(
        bins.select(*[F.col(c).alias("b_" + c) for c in bins.columns]),
        F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")),
    ).select(
        "_row", "doc_id", "source", "size", "h", "bin",
        *[F.col("b_" + c).alias(c) for c in ("source_size", "target", "whole", "left", "edge")],
    )
    plain = rows.filter("not edge").withColumn(
        "part", F.when(F.col("left") > 0, F.col("size")).otherwise(F.lit(0))
    )
    inside = W.partitionBy("source", "bin").orderBy("h", "_row")
    edge = rows.filter("edge").withColumn(
        "part",
        F.greatest(
            F.lit(0), F.least(F.col("size"), F.col("left") - (F.sum("size").over(inside) - F.col("size")))
        ),
    )
    return plain.unionByName(edge).select(
        "_row",
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.col("whole").cast("long").alias("whole"),
        F.col("part").cast("long").alias("part"),
        (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, the last of a source cut.

    A cut text ends with the document's ``part``-th word; ``n_chars``, where there
    is one, is set to the length of the text returned.  Documents without words are
    never taken.
    """
    numbered = number_rows(docs, "mix-input")
    plan = mix_sized(sized(numbered, seed), weights, max_epochs)
    copies = F.concat(
        F.array_repeat(F.col("size"), F.col("whole").cast("int")),
        F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")),
    )
    taken = plan.filter("taken > 0").select(
        "_row", F.col("size").alias("_size"), F.explode(copies).alias("_words")
    )
    rows = numbered.join(taken, "_row")
    ends = F.split(F.col("text").cast("string"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(
        F.array_join(F.slice(ends, F.lit(1), F.col("_words").cast("int")), "")
    )
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
