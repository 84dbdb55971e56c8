"""Image matches as a graph of classes.

Two images of a document are interchangeable when all hashes that the passes look
at are equal; such images form one class, named by its first image.  Passes compare
classes: a match row stands for ``pairs`` image pairs, a class matches itself when it
has copies, and no pass lists pairs inside a class.  Whether an earlier pass already
reported a pair is decided from the hashes of its two classes, never from listed
edges, so nothing is lost behind a representative.

``members`` says which images a class stands for; ``expanded`` writes plain pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.hamming import hash_pairs
from ..plans.ranks import attach_group_values
from ..session import cut_lineage
from .images import (
    GEOMETRIC,
    HIGH_BITS,
    PRIMARY,
    REGION,
    REGION_MIN_STD,
    SECONDARY,
    STRIP,
    STRIP_HIGH_BITS,
    STRIP_MIN_STD,
    eligible,
    match_support,
    similar_images,
)

SPREAD = 64
HASHES = ("phash", "ahash", "dhash")


def blot_like() -> Column:
    """Wide and large enough to hold a gel or blot."""
    return (F.col("width") >= 80) & (F.col("height") >= 60) & (F.col("bytes_size") >= 8 * 1024)


def signatures(
    images: DataFrame,
    variants: DataFrame | None = None,
    cells: DataFrame | None = None,
    strips: DataFrame | None = None,
) -> DataFrame:
    """One row per image with everything the passes compare, and a digest of it.

    ``images(doc_id, image_id, phash, ahash, dhash)``, ``variants(doc_id, image_id,
    transform, hash)``, ``cells`` and ``strips(doc_id, image_id, part, hash, std)``;
    flat parts are left out here.
    """
    key = ["doc_id", "image_id"]
    out = images.select(*key, *HASHES)
    for name, parts in (
        ("variants", variants and variants.select(*key, F.col("transform").alias("part"), "hash")),
        ("cells", cells and cells.filter(F.col("std") >= REGION_MIN_STD)),
        ("strips", strips and strips.filter(F.col("std") >= STRIP_MIN_STD)),
    ):
        kind = F.struct(F.col("part").cast("string").alias("part"), "hash")
        if parts is not None:
            listed = parts.filter(F.col("hash").isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_set(kind)).alias(name))
            out = out.join(listed, key, "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("array<struct<part:string,hash:bigint>>"))
    facets = F.to_json(F.struct(*HASHES, "variants", "cells", "strips"))
    return out.withColumn("signature", F.sha2(facets, 256))


def classes(signed: DataFrame) -> DataFrame:
    """One row per class: ``class_id`` (its first image), ``copies`` and the hashes."""
    facets = ("variants", "cells", "strips")
    return signed.groupBy("doc_id", "signature").agg(
        F.min("image_id").alias("class_id"),
        F.count(F.lit(1)).alias("copies"),
        *(F.any_value(c).alias(c) for c in (*HASHES, *facets)),
    )


def members(signed: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, image_id, class_id) of every image."""
    chunked = signed.select("doc_id", "image_id", "signature", F.pmod(F.xxhash64("image_id"), F.lit(SPREAD)).alias("_chunk"))
    named = attach_group_values(chunked, found.select("doc_id", "signature", "class_id"), ["doc_id", "signature"])
    return named.select("doc_id", "image_id", "class_id")


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def met(left: DataFrame, right: DataFrame | None, radius: int, scope: list[str]) -> DataFrame:
    """Pairs of rows (scope, hash, side) whose hashes are within ``radius`` bits, equal ones included.

    Hashes are compared once per distinct value; rows of one hash meet through it.
    With ``right`` omitted the rows meet among themselves, a row with itself too.
    """
    distinct = lambda df: df.select(*scope, "hash").distinct()
    one, two = distinct(left), distinct(left if right is None else right)
    both = lambda df: df.select(
        *scope, F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("distance")
    )
    near = hash_pairs(one, None if right is None else two, radius, scope=scope).select(*scope, "hash_a", "hash_b", "distance")
    same = both(one) if right is None else both(one.join(two, [*scope, "hash"], "left_semi"))
    # Sides hold exploded parts and arrays, which size estimates leave out: they are merged, not broadcast.
    side = lambda df, s: df.select(*scope, F.col("hash").alias(f"hash_{s}"), F.col("side").alias(s)).hint("merge")
    return (
        near.filter("hash_a <> hash_b")
        .unionByName(same)
        .join(side(left, "a"), [*scope, "hash_a"])
        .join(side(left if right is None else right, "b"), [*scope, "hash_b"])
        .select(*scope, "a", "b", "distance")
    )


def ordered(pairs: DataFrame, *more: str) -> DataFrame:
    """Each pair with its smaller class first; a class meets itself only when it has copies."""
    swap = F.col("a.class_id") > F.col("b.class_id")
    return pairs.filter((F.col("a.class_id") != F.col("b.class_id")) | (F.col("a.copies") > 1)).select(
        "doc_id",
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        "distance",
        *more,
    )


def close(a: str, b: str, hashes: tuple[str, ...], radius: int) -> Column:
    """Whether any of the hashes of both classes is within ``radius``; no if none is known."""
    apart = [bits_apart(F.col(f"{a}.{h}"), F.col(f"{b}.{h}")) for h in hashes]
    return F.coalesce((F.least(*apart) if len(apart) > 1 else apart[0]) <= radius, F.lit(False))


def turned_distance(a: str, b: str) -> Column:
    """Bits between a turned hash of one class and the plain hash of the other, the best of both ways."""

    def one_way(turned: str, plain: str) -> Column:
        plain_hash = F.get(F.filter(f"{plain}.variants", lambda v: v["part"] == "identity"), 0)["hash"]
        turns = F.filter(f"{turned}.variants", lambda v: v["part"] != "identity")
        return F.array_min(F.transform(turns, lambda v: bits_apart(v["hash"], plain_hash)))

    return F.least(one_way(a, b), one_way(b, a))


def already(a: str, b: str, passes: tuple[str, ...]) -> Column:
    """Whether one of the named passes reports the pair of classes."""
    rules = {
        "primary": close(a, b, ("phash",), PRIMARY),
        "secondary": close(a, b, ("ahash", "dhash"), SECONDARY),
        "geometric": F.coalesce(turned_distance(a, b) <= GEOMETRIC, F.lit(False)),
    }
    out = F.lit(False)
    for name in passes:
        out = out | rules[name]
    return out


def _sides(found: DataFrame, hash_: Column, *more: str) -> DataFrame:
    side = F.struct("class_id", "copies", *HASHES, "variants", *more)
    return found.select("doc_id", hash_.alias("hash"), side.alias("side")).filter("hash IS NOT NULL")


def _parts(found: DataFrame, facet: str) -> DataFrame:
    """Sides of a class by the distinct hashes of a facet, with the first part of each."""
    exploded = found.select("*", F.explode(facet).alias("_p"))
    side = F.struct("class_id", "copies", *HASHES, "variants", F.col("_p.part").alias("part"))
    return exploded.select("doc_id", F.col("_p.hash").alias("hash"), side.alias("side"))


def _matches(pairs: DataFrame, high_bits: int | None, *best: str) -> DataFrame:
    """The best meeting of each pair of classes, its severity and how many image pairs it stands for."""
    same = F.col("class_a") == F.col("class_b")
    count = F.when(same, F.col("copies_a") * (F.col("copies_a") - 1) / 2).otherwise(F.col("copies_a") * F.col("copies_b"))
    severity = F.lit("medium") if high_bits is None else F.when(F.col("distance") <= high_bits, "high").otherwise("medium")
    return (
        pairs.groupBy(
            "doc_id",
            F.col("a.class_id").alias("class_a"),
            F.col("b.class_id").alias("class_b"),
            F.col("a.copies").alias("copies_a"),
            F.col("b.copies").alias("copies_b"),
        )
        .agg(F.min(F.struct("distance", *best)).alias("best"))
        .select("doc_id", "class_a", "class_b", "copies_a", "copies_b", "best.*")
        .withColumn("severity", severity)
        .withColumn("pairs", count.cast("long"))
    )


def primary_classes(found: DataFrame, images: DataFrame) -> DataFrame:
    """Perceptual hashes within 8 bits (J5), severity by how many images match either end."""
    pairs = ordered(met(_sides(found, F.col("phash")), None, PRIMARY, ["doc_id"]))
    rated = match_support(similar_images(images)).select(
        "doc_id",
        F.least("hash_a", "hash_b").alias("low"),
        F.greatest("hash_a", "hash_b").alias("high"),
        F.col("severity").alias("rated"),
    )
    hashes = pairs.select(
        "doc_id",
        F.col("a.class_id").alias("class_a"),
        F.col("b.class_id").alias("class_b"),
        F.least("a.phash", "b.phash").alias("low"),
        F.greatest("a.phash", "b.phash").alias("high"),
    )
    # two classes of one hash meet both ways round
    severities = hashes.distinct().join(rated.distinct(), ["doc_id", "low", "high"]).select("doc_id", "class_a", "class_b", "rated")
    matched = _matches(pairs, None).join(severities, ["doc_id", "class_a", "class_b"])
    return matched.withColumn("severity", F.col("rated")).drop("rated")


def secondary_classes(found: DataFrame) -> DataFrame:
    """Average or difference hash within 12 bits, the better of both (J6); no primary pair."""
    pairs = None
    for algo in ("ahash", "dhash"):
        one = ordered(met(_sides(found, F.col(algo)), None, SECONDARY, ["doc_id"]).withColumn("algo", F.lit(algo)), "algo")
        pairs = one if pairs is None else pairs.unionByName(one)
    return _matches(pairs.filter(~already("a", "b", ("primary",))), HIGH_BITS, "algo")


def geometric_classes(found: DataFrame, after: tuple[str, ...] = ("primary", "secondary")) -> DataFrame:
    """A flipped or rotated image within 10 bits of another one as it is."""
    facets = _parts(found, "variants")
    pairs = met(
        facets.filter("side.part <> 'identity'"), facets.filter("side.part = 'identity'"), GEOMETRIC, ["doc_id"]
    ).withColumn("transform", F.col("a.part"))
    return _matches(ordered(pairs, "transform").filter(~already("a", "b", after)), HIGH_BITS, "transform")


def part_classes(
    found: DataFrame,
    facet: str,
    radius: int,
    high_bits: int | None = None,
    after: tuple[str, ...] = ("primary", "secondary", "geometric"),
) -> DataFrame:
    """Similar cells (J8) or bottom strips (J9) of different images."""
    pairs = ordered(met(_parts(found, facet), None, radius, ["doc_id"]))
    named = pairs.withColumn("part_a", F.col("a.part")).withColumn("part_b", F.col("b.part"))
    return _matches(named.filter(~already("a", "b", after)), high_bits, "part_a", "part_b")


def duplicate_classes(
    images: DataFrame, variants: DataFrame, cells: DataFrame, strips: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """All passes over eligible images, each on the pairs left, and the members of the classes (G1).

    A part match does not keep a pair from the strip pass; strips count for images
    that may hold a blot.
    """
    usable = images.filter(eligible())
    blots = usable.filter(blot_like()).select("doc_id", "image_id")
    signed = cut_lineage(
        signatures(usable, variants, cells, strips.join(blots, ["doc_id", "image_id"], "left_semi"))
    )
    found = cut_lineage(classes(signed))
    out = None
    for name, df in (
        ("primary", primary_classes(found, usable)),
        ("secondary", secondary_classes(found)),
        ("geometric", geometric_classes(found)),
        ("region", part_classes(found, "cells", REGION)),
        ("loading_control", part_classes(found, "strips", STRIP, STRIP_HIGH_BITS)),
    ):
        part = df.select("doc_id", F.lit(name).alias("pass"), "class_a", "class_b", "distance", "severity", "pairs")
        out = part if out is None else out.unionByName(part)
    return out, members(signed, found)


def expanded(matches: DataFrame, named: DataFrame) -> DataFrame:
    """Plain image pairs of class matches (as many rows as ``pairs`` add up to)."""
    side = lambda s: named.select(
        "doc_id", F.col("class_id").alias(f"class_{s}"), F.col("image_id").alias(f"image_{s}")
    )
    pairs = matches.join(side("a"), ["doc_id", "class_a"]).join(side("b"), ["doc_id", "class_b"])
    swap = F.col("image_a") > F.col("image_b")
    return (
        pairs.filter((F.col("class_a") != F.col("class_b")) | (F.col("image_a") < F.col("image_b")))
        .withColumn("_low", F.when(swap, F.col("image_b")).otherwise(F.col("image_a")))
        .withColumn("image_b", F.when(swap, F.col("image_a")).otherwise(F.col("image_b")))
        .withColumn("image_a", F.col("_low"))
        .drop("_low")
    )


# --------------------------------------------------------------------------- page units


def page_classes(units: DataFrame) -> DataFrame:
    """Pages of a document with the same units of an algorithm: ``class_id`` (first page), ``copies``, ``units``.

    ``units(doc_id, algo, kind, page, hash)``; a unit of kind region outweighs another of its hash.
    """
    merged = (
        units.filter("hash IS NOT NULL")
        .groupBy("doc_id", "algo", "page", "hash")
        .agg(F.max((F.col("kind") == "region").cast("int")).alias("region"))
    )
    pages = (
        merged.groupBy("doc_id", "algo", "page")
        .agg(F.sort_array(F.collect_list(F.struct("hash", "region"))).alias("units"))
        .withColumn("signature", F.sha2(F.to_json(F.struct("units")), 256))
    )
    return pages.groupBy("doc_id", "algo", "signature").agg(
        F.min("page").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.any_value("units").alias("units")
    )


def page_class_matches(units: DataFrame, threshold: int = PRIMARY) -> DataFrame:
    """Best match of each pair of page classes per algorithm (J11, J12), standing for ``pairs`` page pairs."""
    soft = max(threshold, 10)
    found = page_classes(units).select("*", F.explode("units").alias("_u"))
    side = F.struct("class_id", "copies", F.col("_u.region").alias("region"))
    facets = cut_lineage(found.select("doc_id", "algo", F.col("_u.hash").alias("hash"), side.alias("side")))
    primary = (
        (F.col("a.region") == 1) & (F.col("b.region") == 1) & (F.col("algo") == "phash") & (F.col("distance") <= threshold)
    )
    keep = primary | F.when(F.col("algo") == "ahash", F.col("distance") <= 4).otherwise(F.col("distance") <= soft)
    pairs = ordered(met(facets, None, soft, ["doc_id", "algo"]).withColumn("primary", primary.cast("int")).filter(keep), "algo", "primary")
    same = F.col("page_a") == F.col("page_b")
    count = F.when(same, F.col("copies_a") * (F.col("copies_a") - 1) / 2).otherwise(F.col("copies_a") * F.col("copies_b"))
    return (
        pairs.groupBy(
            "doc_id",
            "algo",
            F.col("a.class_id").alias("page_a"),
            F.col("b.class_id").alias("page_b"),
            F.col("a.copies").alias("copies_a"),
            F.col("b.copies").alias("copies_b"),
        )
        .agg(F.min("distance").alias("distance"), F.max("primary").alias("primary"))
        .withColumn("pairs", count.cast("long"))
        .drop("copies_a", "copies_b")
    )
