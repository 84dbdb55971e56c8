"""Image fingerprint operators.

Similarity joins run on distinct hashes.  Images sharing a hash are linked to
one representative each, so a hash held by a third of all images adds one edge
per image and never all pairs.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..plans.components import connected_components
from ..plans.hamming import hash_pairs
from ..plans.ranks import attach_group_values
from ..model import severity_name
from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Thresholds of the passes.
PRIMARY, SECONDARY, GEOMETRIC, REGION, STRIP = 8, 12, 10, 2, 5
HIGH_BITS, STRIP_HIGH_BITS = 4, 2
REGION_MIN_STD, STRIP_MIN_STD, GRID_MIN_STD = 18.0, 12.0, 8.0
GRID_RADIUS, TEXTURE_RADIUS, BRIDGE_RADIUS = 6, 4, 4


def eligible(width="width", height="height", size="bytes_size") -> Column:
    """At least 64 pixels a side and 5 KiB."""
    return (F.col(width) >= 64) & (F.col(height) >= 64) & (F.col(size) >= 5 * 1024)


def size_classes(images: DataFrame) -> DataFrame:
    """Counts of eligible and skipped images per document and reason."""
    reason = (
        F.when((F.col("width") < 64) | (F.col("height") < 64), "dimensions")
        .when(F.col("bytes_size") < 5 * 1024, "bytes")
        .otherwise("eligible")
    )
    return images.groupBy("doc_id", reason.alias("size_class")).agg(
        F.count(F.lit(1)).alias("images")
    )


def decorative() -> Column:
    """Side below 48, area below 4096 or under 2 KiB."""
    return (
        (F.least("width", "height") < 48)
        | (F.col("width") * F.col("height") < 4096)
        | (F.col("bytes_size") < 2048)
    )


# Folder-like names that identify no paper.
GENERIC_PAPER_IDS = (
    "", "original", "paper", "main", "document", "file", "image", "inputs", "workspace", "materials",
)


def usable_paper_id(paper_id: Column) -> Column:
    """Neither a generic name nor a bare hex trace id."""
    text = F.lower(F.trim(paper_id.cast("string")))
    return ~text.isin(*GENERIC_PAPER_IDS) & ~text.rlike("^[0-9a-f]{10,40}$")


# --------------------------------------------------------------------------- whole images


def hash_groups(images: DataFrame, scope: list[str], hash_: str = "phash") -> DataFrame:
    """One row per (scope, hash): images under it and their representative."""
    return (
        images.filter(F.col(hash_).isNotNull())
        .groupBy(*scope, F.col(hash_).alias("hash"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("image_id").alias("image_id"))
    )


def similar_images(
    images: DataFrame, radius: int = PRIMARY, *, scope: list[str] = ("doc_id",), hash_: str = "phash"
) -> DataFrame:
    """Edges between similar images (J5): star edges among copies, pairs of distinct hashes.

    ``copies_a``/``copies_b`` say how many images each end stands for.
    """
    scope = list(scope)
    groups = hash_groups(images, scope, hash_)
    near = hash_pairs(groups.select(*scope, "hash"), None, radius, scope=scope)
    side = lambda s: groups.select(
        *scope,
        F.col("hash").alias(f"hash_{s}"),
        F.col("image_id").alias(f"image_{s}"),
        F.col("copies").alias(f"copies_{s}"),
    )
    pairs = near.join(side("a"), [*scope, "hash_a"]).join(side("b"), [*scope, "hash_b"])
    swap = F.col("image_a") > F.col("image_b")
    near_edges = pairs.select(
        *scope,
        F.least("image_a", "image_b").alias("image_a"),
        F.greatest("image_a", "image_b").alias("image_b"),
        F.when(swap, F.col("hash_b")).otherwise(F.col("hash_a")).alias("hash_a"),
        F.when(swap, F.col("hash_a")).otherwise(F.col("hash_b")).alias("hash_b"),
        F.when(swap, F.col("copies_b")).otherwise(F.col("copies_a")).alias("copies_a"),
        F.when(swap, F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_b"),
        "distance",
    )
    shared = groups.filter("copies > 1").withColumnRenamed("image_id", "image_a")
    members = images.filter(F.col(hash_).isNotNull()).select(
        *scope,
        F.col(hash_).alias("hash"),
        F.col("image_id").alias("image_b"),
        F.pmod(F.xxhash64("image_id"), F.lit(64)).alias("_chunk"),
    )
    copy_edges = (
        attach_group_values(members, shared, [*scope, "hash"])
        .filter("image_b <> image_a")
        .select(
            *scope,
            "image_a",
            "image_b",
            F.col("hash").alias("hash_a"),
            F.col("hash").alias("hash_b"),
            F.col("copies").alias("copies_a"),
            F.col("copies").alias("copies_b"),
            F.lit(0).alias("distance"),
        )
    )
    return near_edges.unionByName(copy_edges)


def match_support(edges: DataFrame, scope: list[str] = ("doc_id",)) -> DataFrame:
    """Severity of primary matches by distance and by how many images match either end.

    Spans matter only below five, so neighbour sets are gathered only for
    hashes with fewer than five matching images.
    """
    scope = list(scope)
    edges = cut_lineage(edges)
    near = edges.filter("hash_a <> hash_b").select(
        *scope, "hash_a", "hash_b", "copies_a", "copies_b"
    )
    both = near.unionByName(
        near.select(
            *scope,
            F.col("hash_b").alias("hash_a"),
            F.col("hash_a").alias("hash_b"),
            F.col("copies_b").alias("copies_a"),
            F.col("copies_a").alias("copies_b"),
        )
    )
    lone = edges.filter("hash_a = hash_b").select(*scope, "hash_a", "copies_a").distinct()
    totals = (
        both.groupBy(*scope, "hash_a")
        .agg((F.sum("copies_b") + F.max("copies_a")).alias("ball"))
        .unionByName(lone.select(*scope, "hash_a", F.col("copies_a").alias("ball")))
        .groupBy(*scope, "hash_a")
        .agg(F.max("ball").alias("ball"))
    )
    small = totals.filter("ball < 5").select(*scope, "hash_a")
    sets = (
        both.join(small, [*scope, "hash_a"], "left_semi")
        .groupBy(*scope, "hash_a")
        .agg(F.collect_set(F.struct(F.col("hash_b").alias("h"), F.col("copies_b").alias("c"))).alias("near"))
    )
    known = totals.join(sets, [*scope, "hash_a"], "left")

    def side(name: str) -> DataFrame:
        return known.select(
            *scope,
            F.col("hash_a").alias(f"hash_{name}"),
            F.col("ball").alias(f"ball_{name}"),
            F.col("near").alias(f"near_{name}"),
        )

    pairs = edges.groupBy(*scope, "hash_a", "hash_b").agg(
        F.max("copies_a").alias("copies_a"), F.max("copies_b").alias("copies_b")
    )
    joined = pairs.join(side("a"), [*scope, "hash_a"]).join(side("b"), [*scope, "hash_b"])
    own = F.array(
        F.struct(F.col("hash_a").alias("h"), F.col("copies_a").alias("c")),
        F.struct(F.col("hash_b").alias("h"), F.col("copies_b").alias("c")),
    )
    none = F.slice(own, 1, 0)
    united = F.array_distinct(
        F.concat(own, F.coalesce("near_a", none), F.coalesce("near_b", none))
    )
    total = F.aggregate(united, F.lit(0).cast("long"), lambda s, x: s + x["c"])
    wide = (F.col("ball_a") >= 5) | (F.col("ball_b") >= 5)
    spans = joined.select(
        *scope, "hash_a", "hash_b", F.when(wide, F.lit(5)).otherwise(F.least(total, F.lit(5))).alias("span")
    )
    severity = (
        F.when(F.col("span") >= 5, "low")
        .when(F.col("span") > 2, "medium")
        .when(F.col("distance") <= HIGH_BITS, "high")
        .otherwise("medium")
    )
    chunked = edges.withColumn("_chunk", F.pmod(F.xxhash64("image_b"), F.lit(64)))
    return (
        attach_group_values(chunked, spans, [*scope, "hash_a", "hash_b"])
        .drop("_chunk")
        .withColumn("severity", severity)
    )


def image_classes(images: DataFrame) -> DataFrame:
    """Images of a document with the same three hashes, by their first image: one class each."""
    return images.groupBy("doc_id", "phash", "ahash", "dhash").agg(
        F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("copies")
    )


def secondary_matches(images: DataFrame, radius: int = SECONDARY, primary_radius: int = PRIMARY) -> DataFrame:
    """Best of average and difference hash among images whose perceptual hashes do not match.

    Pairs are those of image classes, ``copies_a`` and ``copies_b`` say how many
    images each end stands for.  Whether two classes match already is decided by
    their perceptual hashes, never by listed edges.
    """
    classes = cut_lineage(image_classes(images))
    side = lambda s, algo: classes.filter(F.col(algo).isNotNull()).select(
        "doc_id",
        F.col(algo).alias(f"hash_{s}"),
        F.struct("image_id", "phash", "copies").alias(s),
    )
    found = None
    for algo in ("ahash", "dhash"):
        hashes = classes.filter(F.col(algo).isNotNull()).select("doc_id", F.col(algo).alias("hash")).distinct()
        same = hashes.select("doc_id", F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("distance"))
        near = hash_pairs(hashes, None, radius, scope=["doc_id"]).select("doc_id", "hash_a", "hash_b", "distance")
        pairs = (
            near.unionByName(same)
            .join(side("a", algo), ["doc_id", "hash_a"])
            .join(side("b", algo), ["doc_id", "hash_b"])
            .filter((F.col("hash_a") != F.col("hash_b")) | (F.col("a.image_id") < F.col("b.image_id")))
            .select("doc_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", F.lit(algo).alias("algo"))
        )
        found = pairs if found is None else found.unionByName(pairs)
    apart = F.bit_count(F.col("a.phash").bitwiseXOR(F.col("b.phash"))) > primary_radius
    return (
        found.filter(F.coalesce(apart, F.lit(True)))
        .groupBy("doc_id", "a", "b")
        .agg(F.min(F.struct("distance", "algo")).alias("best"))
        .select(
            "doc_id",
            F.col("a.image_id").alias("image_a"),
            F.col("b.image_id").alias("image_b"),
            F.col("a.copies").alias("copies_a"),
            F.col("b.copies").alias("copies_b"),
            F.col("best.distance").alias("distance"),
            F.col("best.algo").alias("algo"),
            F.when(F.col("best.distance") <= HIGH_BITS, "high").otherwise("medium").alias("severity"),
        )
    )


def algorithm_matches(hashes: DataFrame, radius: int = PRIMARY) -> DataFrame:
    """Pair scan per hash algorithm (J10): ``hashes(doc_id, algo, image_id, phash)``."""
    edges = similar_images(hashes, radius, scope=["doc_id", "algo"])
    return edges.withColumn(
        "severity",
        F.when(F.col("distance") <= 4, "high").when(F.col("distance") <= 8, "medium").otherwise("low"),
    )


def cross_paper_edges(images: DataFrame, index: DataFrame, radius: int = 6) -> DataFrame:
    """Every paper that holds a hash near one of the usable images: (hash_a, paper_id, distance).

    One row per image hash and paper; ``cross_paper_matches`` ranks them for each image.
    """
    usable = images.filter((F.col("width") >= 64) & (F.col("height") >= 64) & F.col("phash").isNotNull())
    queries = usable.select(F.col("phash").alias("hash")).distinct()
    entries = index.filter("phash IS NOT NULL").select("paper_id", F.col("phash").alias("hash")).distinct()
    near = hash_pairs(queries, entries.select("hash").distinct(), radius)
    same = queries.join(entries.select("hash").distinct(), "hash", "left_semi").select(
        F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("distance")
    )
    return (
        near.unionByName(same)
        .dropDuplicates(["hash_a", "hash_b"])
        .join(entries.withColumnRenamed("hash", "hash_b"), "hash_b")
        .groupBy("hash_a", "paper_id")
        .agg(F.min("distance").alias("distance"))
    )


def cross_paper_matches(
    images: DataFrame, index: DataFrame, radius: int = 6, limit: int = 8
) -> DataFrame:
    """Nearest papers of the fingerprint index for each image, a ranking over ``cross_paper_edges``.

    ``index(paper_id, phash)``.  ``hits`` counts the ``limit`` nearest other papers,
    ``papers`` all of them; the edges list them all.
    """
    return nearest_papers(images, cross_paper_edges(images, index, radius), limit)


def nearest_papers(images: DataFrame, papers: DataFrame, limit: int = 8) -> DataFrame:
    """Ranking of the other papers near each image over ``papers(hash_a, paper_id, distance)``."""
    usable = images.filter((F.col("width") >= 64) & (F.col("height") >= 64) & F.col("phash").isNotNull())
    # One query hash may sit in every paper: keep only the nearest of each part before ranking.
    part = F.pmod(F.xxhash64("paper_id"), F.lit(32))
    by_part = W.partitionBy("hash_a", "_part").orderBy("distance", "paper_id")
    nearest = (
        papers.withColumn("_part", part)
        .withColumn("_r", F.row_number().over(by_part))
        .filter(F.col("_r") <= limit + 1)
    )
    counts = papers.groupBy("hash_a").agg(F.count(F.lit(1)).alias("papers"))
    best = nearest.groupBy("hash_a").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "paper_id"))), 1, limit + 1).alias("hits")
    ).join(counts, "hash_a")
    chunked = usable.withColumn("hash_a", F.col("phash")).withColumn(
        "_chunk", F.pmod(F.xxhash64("image_id"), F.lit(64))
    )
    own = F.col("doc_id")
    joined = attach_group_values(chunked, best, ["hash_a"]).withColumn(
        "others",
        F.slice(F.filter("hits", lambda h: h["paper_id"] != own), 1, limit),
    )
    is_own = papers.select("hash_a", F.col("paper_id").alias("doc_id")).withColumn("_own", F.lit(1))
    joined = joined.join(is_own, ["hash_a", "doc_id"], "left").withColumn(
        "papers", F.col("papers") - F.coalesce("_own", F.lit(0))
    )
    substantial = (
        (F.col("width") >= 180) & (F.col("height") >= 120) & (F.col("bytes_size") >= 15 * 1024)
    )
    return joined.filter(F.size("others") > 0).select(
        "doc_id",
        "image_id",
        F.col("others")[0]["paper_id"].alias("matched_paper"),
        F.col("others")[0]["distance"].alias("distance"),
        "papers",
        F.size("others").alias("hits"),
        F.when((F.col("others")[0]["distance"] == 0) & substantial, "high")
        .otherwise("medium")
        .alias("severity"),
    )


def file_reuse(images: DataFrame) -> DataFrame:
    """The same file bytes on several pages or positions."""
    return (
        images.groupBy("doc_id", "sha1")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.count_distinct("page", "idx").alias("places"),
            F.min("page").alias("first_page"),
        )
        .filter("places > 1")
    )


def same_dimensions(images: DataFrame) -> DataFrame:
    """Three or more images of one size in a document."""
    return (
        images.groupBy("doc_id", "width", "height")
        .agg(F.count(F.lit(1)).alias("images"))
        .filter("images >= 3")
    )


# --------------------------------------------------------------------------- cells of one image


def texture_reuse(cells: DataFrame, radius: int = TEXTURE_RADIUS) -> DataFrame:
    """Equal, rotated or similar texture cells across the images of a document.

    ``cells(doc_id, image_id, cell, content, turns ARRAY, hash)`` where content
    is the hash of the bytes and turns those of the 90, 180 and 270 degree rotations.
    """
    exact = (
        cells.groupBy("doc_id", "content")
        .agg(F.count(F.lit(1)).alias("members"), F.count_distinct("image_id", "cell").alias("places"))
        .filter("places > 1")
        .groupBy("doc_id")
        .agg(F.sum("members").alias("matches"))
        .select("doc_id", F.lit("exact").alias("kind"), "matches")
    )
    contents = cells.groupBy("doc_id", "content").agg(F.min("image_id").alias("image_id"))
    turned = (
        cells.select("doc_id", "content", F.explode("turns").alias("turned"))
        .filter("turned <> content")
        .groupBy("doc_id", "content", "turned")
        .agg(F.count(F.lit(1)).alias("members"))
    )
    rotated = (
        turned.join(
            contents.select("doc_id", F.col("content").alias("turned")), ["doc_id", "turned"]
        )
        .groupBy("doc_id")
        .agg(F.sum("members").alias("matches"))
        .select("doc_id", F.lit("rotated").alias("kind"), "matches")
    )
    near = (
        hash_pairs(cells.select("doc_id", "hash").distinct(), None, radius, scope=["doc_id"])
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("matches"))
        .select("doc_id", F.lit("near").alias("kind"), "matches")
    )
    return exact.unionByName(rotated).unionByName(near)


def copy_move(cells: DataFrame, radius: int = GRID_RADIUS) -> DataFrame:
    """Similar, separated grid cells inside one image (J16), with layout flags.

    ``cells(doc_id, image_id, row, col, hash, std)``; an image has one fixed
    grid, so its cell pairs come out of one short array.
    """
    grid = (
        cells.filter(F.col("std") >= GRID_MIN_STD)
        .groupBy("doc_id", "image_id")
        .agg(F.array_sort(F.collect_list(F.struct("row", "col", "hash"))).alias("g"))
    )
    g = F.col("g")
    pairs = F.flatten(
        F.transform(
            g,
            lambda a, i: F.transform(
                F.filter(
                    F.slice(g, i + 2, F.size(g)),
                    lambda b: (
                        (a["row"] != b["row"]) | (F.abs(a["col"] - b["col"]) >= 2)
                    )
                    & (F.bit_count(a["hash"].bitwiseXOR(b["hash"])) <= radius),
                ),
                lambda b: F.struct(
                    F.abs(a["row"] - b["row"]).alias("dr"),
                    F.abs(a["col"] - b["col"]).alias("dc"),
                    F.bit_count(a["hash"].bitwiseXOR(b["hash"])).alias("d"),
                ),
            ),
        )
    )
    found = grid.withColumn("m", pairs).filter(F.size("m") > 0)
    n = F.size("m")

    def share(test) -> Column:
        return F.size(F.filter("m", test)) / n

    across = (n >= 8) & (share(lambda p: (p["dr"] == 0) & (p["dc"] >= 2)) >= 0.6)
    down = (n >= 8) & (share(lambda p: (p["dc"] == 0) & (p["dr"] >= 2)) >= 0.6)
    stride = (n >= 8) & (
        share(lambda p: (p["dr"] == 0) & (p["dc"] >= 2) & (p["dc"] % 2 == 0)) >= 0.5
    )
    flagged = across | down | stride
    best = F.array_min(F.transform("m", lambda p: p["d"]))
    rank = F.when(n >= 15, 3).when(n >= 5, 2).otherwise(1)
    once = rank - F.when(flagged & (rank == 3), 1).otherwise(0)
    final = once - F.when(flagged & (best > 0) & (once > 1), 1).otherwise(0)
    return found.select(
        "doc_id",
        "image_id",
        n.alias("matches"),
        best.alias("best"),
        across.alias("multipanel_horizontal"),
        down.alias("multipanel_vertical"),
        stride.alias("regular_stride"),
        severity_name(final).alias("severity"),
    )


def panel_pairs(panels: DataFrame) -> DataFrame:
    """Similar panels inside one image from panel hashes and an optional score.

    ``panels(doc_id, image_id, panel, hash)`` joined per image; ``ssim`` may be
    carried as MAP<INT, DOUBLE> from the other panel's number.
    """
    scored = "ssim" in panels.columns
    item = F.struct("panel", "hash", *(["ssim"] if scored else []))
    sets = panels.groupBy("doc_id", "image_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    p = F.col("p")
    pair = F.flatten(
        F.transform(
            p,
            lambda a, i: F.transform(
                F.slice(p, i + 2, F.size(p)),
                lambda b: F.struct(
                    a["panel"].alias("panel_a"),
                    b["panel"].alias("panel_b"),
                    F.bit_count(a["hash"].bitwiseXOR(b["hash"])).alias("distance"),
                    (a["ssim"][b["panel"]] if scored else F.lit(None).cast("double")).alias("score"),
                ),
            ),
        )
    )
    rows = sets.select("doc_id", "image_id", F.explode(pair).alias("x")).select(
        "doc_id", "image_id", "x.*"
    )
    score = F.coalesce("score", F.lit(0.0))
    hit = (score >= 0.78) | F.coalesce(F.col("distance") <= 10, F.lit(False))
    high = ((score >= 0.97) & F.coalesce(F.col("distance") <= 16, F.lit(True))) | F.coalesce(
        F.col("distance") <= 4, F.lit(False)
    )
    return rows.filter(hit).withColumn("severity", F.when(high, "high").otherwise("medium"))


# --------------------------------------------------------------------------- pixels


def average_hash(pixels: Column) -> Column:
    """64-bit average hash of 64 grayscale pixels."""
    total = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x)
    mean = total / F.size(pixels)
    return F.aggregate(
        pixels,
        F.lit(0).cast("long"),
        lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > mean, 1).otherwise(0).cast("long")),
    )


def pixel_entropy(images: DataFrame) -> DataFrame:
    """Histogram entropy in bits and number of 4-bit tones."""
    counts = (
        images.select("image_id", F.explode("pixels").alias("v"))
        .groupBy("image_id", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return counts.groupBy("image_id").agg(
        F.sum("c").alias("pixels"),
        (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"),
        F.count_distinct(F.floor(F.col("v") / 16)).alias("tones"),
    )


def _laplacian(gray: np.ndarray) -> np.ndarray:
    centre = gray[1:-1, 1:-1]
    around = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:]
    return 4 * centre - around


def _shaped(values, width: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(-1, int(width))


@pandas_udf(T.DoubleType())
def edge_density(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Share of pixels whose Laplacian exceeds twice its spread."""
    out = []
    for values, w in zip(pixels, width):
        gray = _shaped(values, w)
        if min(gray.shape) < 3:
            out.append(0.0)
            continue
        response = _laplacian(gray)
        out.append(float((np.abs(response) > max(8, 2 * int(response.std()))).mean()))
    return pd.Series(out)


@pandas_udf(T.ArrayType(T.DoubleType()))
def tile_noise(pixels: pd.Series, width: pd.Series, tile: pd.Series) -> pd.Series:
    """Laplacian variance of each whole tile, row by row."""
    out = []
    for values, w, size in zip(pixels, width, tile):
        gray, size = _shaped(values, w), int(size)
        rows, cols = gray.shape[0] // size, gray.shape[1] // size
        out.append(
            [
                float(_laplacian(gray[r * size : (r + 1) * size, c * size : (c + 1) * size]).var())
                for r in range(rows)
                for c in range(cols)
            ]
        )
    return pd.Series(out)


def noise_outliers(noise: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Tiles further than ``sigma`` MADs from the image's median noise.

    ``noise(image_id, noise ARRAY<DOUBLE>)``, one bounded array per image.
    """
    ordered = F.array_sort("noise")

    def middle(a: Column) -> Column:
        n = F.size(a)
        hi = F.try_element_at(a, (F.floor(n / 2) + 1).cast("int"))
        lo = F.try_element_at(a, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
        return (lo + hi) / 2

    scored = noise.filter(F.size("noise") > 0).withColumn("median", middle(ordered))
    scored = scored.withColumn(
        "mad",
        middle(F.array_sort(F.transform("noise", lambda x: F.abs(x - F.col("median"))))),
    )
    outliers = F.when(
        F.col("mad") > 0,
        F.size(F.filter("noise", lambda x: F.abs(x - F.col("median")) / F.col("mad") > sigma)),
    ).otherwise(0)
    counted = scored.withColumn("outliers", outliers)
    return counted.select(
        "image_id",
        F.size("noise").alias("tiles"),
        "median",
        "mad",
        "outliers",
        F.when(F.col("outliers") >= 200, "high")
        .when(F.col("outliers") >= 50, "medium")
        .when(F.col("outliers") > 0, "low")
        .alias("severity"),
    )


# --------------------------------------------------------------------------- reports, clusters


def most_similar(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` closest pairs with similarity 1 - d/64."""
    return (
        edges.withColumn("similarity", F.lit(1.0) - F.col("distance") / 64)
        .orderBy("distance", "image_a", "image_b")
        .limit(k)
    )


def similarity_matrix(edges: DataFrame, images: list[int]) -> DataFrame:
    """Normalized matrix over a short list of images (K1)."""
    chosen = edges.filter(F.col("image_a").isin(images) & F.col("image_b").isin(images))
    both = chosen.select("image_a", "image_b", "distance").unionByName(
        chosen.select(F.col("image_b").alias("image_a"), F.col("image_a").alias("image_b"), "distance")
    )
    return (
        both.groupBy("image_a")
        .pivot("image_b", images)
        .agg(F.round(F.lit(1.0) - F.min("distance") / 64, 4))
    )


def image_clusters(images: DataFrame, radius: int = BRIDGE_RADIUS) -> DataFrame:
    """Connected images of the whole corpus at a small radius: (image_id, component)."""
    edges = similar_images(images, radius, scope=[])
    return connected_components(
        images.select(F.col("image_id").alias("node")),
        edges.select(F.col("image_a").alias("u"), F.col("image_b").alias("v")),
    ).select(F.col("node").alias("image_id"), "component")


# --------------------------------------------------------------------------- fingerprint index


def append_fingerprints(images: DataFrame, path: str) -> None:
    """Add usable fingerprints to the index, partitioned by a hash prefix."""
    rows = images.filter((F.col("width") >= 64) & (F.col("height") >= 64) & F.col("phash").isNotNull())
    rows.select(
        F.col("doc_id").alias("paper_id"),
        "page",
        "image_id",
        "phash",
        F.shiftrightunsigned("phash", 60).cast("int").alias("band"),
    ).write.mode("append").partitionBy("band").parquet(path)


def read_fingerprints(spark, path: str) -> DataFrame:
    """Fingerprint index scan."""
    return spark.read.parquet(path)
