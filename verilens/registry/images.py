"""Fingerprint joins over image hashes derived from the vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import image_graph as M
from ..operators import fingerprint_index as I
from ..operators import images as G
from ..session import checkpoint_folder
from . import corpus as X
from .columns import rounded, with_sql

QUERIES = {}


def add(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def edges_sql(name: str, hash_: str, radius: int, scope: str = "doc_id", source: str = "images") -> str:
    """CTEs <name>_g (hash groups) and <name> (star edges and near pairs)."""
    keys = [k for k in scope.split(", ") if k]
    lead = "".join(f"{k}, " for k in keys)
    on = " AND ".join([f"a.{k} = b.{k}" for k in keys] or ["true"])
    picks = "".join(f"a.{k}, " for k in keys)
    return f"""{name}_g AS (SELECT {lead}{hash_} AS hash, count(*) AS copies, min(image_id) AS image_id FROM {source}
 WHERE {hash_} IS NOT NULL GROUP BY ALL),
{name} AS (SELECT {picks}least(a.image_id, b.image_id) AS image_a, greatest(a.image_id, b.image_id) AS image_b,
 CASE WHEN a.image_id < b.image_id THEN a.hash ELSE b.hash END AS hash_a, CASE WHEN a.image_id < b.image_id THEN b.hash ELSE a.hash END AS hash_b,
 bit_count(xor(a.hash, b.hash)) AS distance FROM {name}_g a JOIN {name}_g b ON {on} AND a.hash < b.hash
 AND bit_count(xor(a.hash, b.hash)) <= {radius}
 UNION ALL SELECT {picks}a.image_id, b.image_id, a.hash, a.hash, 0 FROM {name}_g a JOIN {source} b
 ON {on} AND a.hash = b.{hash_} AND a.image_id <> b.image_id)"""


PRIMARY = edges_sql("prim", "phash", 8)


@add(
    "j5_similar_images",
    with_sql(X.IMAGES_SQL, PRIMARY, select="SELECT doc_id, image_a, image_b, distance FROM prim"),
)
def j5(spark, sf_dir):
    return G.similar_images(X.images(spark, sf_dir)).select(
        "doc_id", "image_a", "image_b", "distance"
    )


@add(
    "h15_corpus_similar_images",
    with_sql(
        X.IMAGES_SQL,
        edges_sql("prim", "phash", 4, ""),
        select="SELECT image_a, image_b, distance FROM prim",
    ),
)
def h15(spark, sf_dir):
    edges = G.similar_images(X.images(spark, sf_dir), 4, scope=[])
    return edges.select("image_a", "image_b", "distance")


SUPPORT = """nb AS (SELECT a.doc_id, a.image_id AS i, b.image_id AS j FROM images a JOIN images b ON a.doc_id = b.doc_id
 AND a.image_id <> b.image_id AND bit_count(xor(a.phash, b.phash)) <= 8),
span AS (SELECT p.doc_id, image_a, image_b, distance, (SELECT count(DISTINCT m) FROM (SELECT p.image_a AS m UNION SELECT p.image_b
 UNION SELECT j FROM nb WHERE i = p.image_a UNION SELECT j FROM nb WHERE i = p.image_b)) AS span FROM prim p)"""


@add(
    "a28_match_support",
    with_sql(
        X.IMAGES_SQL,
        PRIMARY,
        """nb AS (SELECT a.image_id AS i, b.image_id AS j FROM images a JOIN images b ON a.doc_id = b.doc_id
 AND bit_count(xor(a.phash, b.phash)) <= 8)""",
        """span AS (SELECT p.doc_id, image_a, image_b, distance, count(DISTINCT nb.j) AS span FROM prim p
 JOIN nb ON nb.i = p.image_a OR nb.i = p.image_b GROUP BY ALL)""",
        select="SELECT doc_id, image_a, image_b, distance, least(span, 5) AS span, CASE WHEN span >= 5 THEN 'low' WHEN span > 2 THEN 'medium' "
        "WHEN distance <= 4 THEN 'high' ELSE 'medium' END AS severity FROM span",
    ),
)
def a28(spark, sf_dir):
    out = G.match_support(G.similar_images(X.images(spark, sf_dir)))
    return out.select("doc_id", "image_a", "image_b", "distance", "span", "severity")


# Plain pairs of image classes; whether a pair matches already is a question of its perceptual hashes.
SECOND = """cl AS (SELECT doc_id, phash, ahash, dhash, min(image_id) AS image_id, count(*) AS copies FROM images GROUP BY ALL),
sec AS (SELECT a.doc_id, a.image_id AS image_a, b.image_id AS image_b, a.copies AS copies_a, b.copies AS copies_b,
 least(bit_count(xor(a.ahash, b.ahash)), bit_count(xor(a.dhash, b.dhash))) AS distance,
 CASE WHEN bit_count(xor(a.ahash, b.ahash)) <= coalesce(bit_count(xor(a.dhash, b.dhash)), 99) THEN 'ahash' ELSE 'dhash' END AS algo
 FROM cl a JOIN cl b ON a.doc_id = b.doc_id AND a.image_id < b.image_id
 WHERE coalesce(bit_count(xor(a.phash, b.phash)), 99) > 8)"""


@add(
    "j6_secondary_matches",
    with_sql(
        X.IMAGES_SQL,
        SECOND,
        select="SELECT *, CASE WHEN distance <= 4 THEN 'high' ELSE 'medium' END AS severity FROM sec WHERE distance <= 12",
    ),
)
def j6(spark, sf_dir):
    return G.secondary_matches(X.images(spark, sf_dir))


# Plain pairs of images with the distances of every pass; results are counted per pair of image classes.
def plain_pairs_sql(source: str = "images", blots: str = "images") -> str:
    return f"""ip AS (SELECT a.doc_id, a.image_id AS i, b.image_id AS j, coalesce(bit_count(xor(a.phash, b.phash)), 99) AS pd,
 coalesce(least(bit_count(xor(a.ahash, b.ahash)), bit_count(xor(a.dhash, b.dhash))), 99) AS sd
 FROM {source} a JOIN {source} b ON a.doc_id = b.doc_id AND a.image_id < b.image_id),
gd AS (SELECT a.doc_id, least(a.image_id, b.image_id) AS i, greatest(a.image_id, b.image_id) AS j, min(bit_count(xor(a.hash, b.hash))) AS gd
 FROM variants a JOIN variants b ON a.doc_id = b.doc_id AND a.image_id <> b.image_id AND a.transform <> 'identity' AND b.transform = 'identity' GROUP BY ALL),
rd AS (SELECT a.doc_id, a.image_id AS i, b.image_id AS j, min(bit_count(xor(a.hash, b.hash))) AS rd FROM parts a JOIN parts b
 ON a.doc_id = b.doc_id AND a.image_id < b.image_id AND a.std >= 18.0 AND b.std >= 18.0 GROUP BY ALL),
lp AS (SELECT p.* FROM parts p JOIN {blots} b ON p.image_id = b.image_id AND p.doc_id = b.doc_id WHERE p.std >= 12.0),
ld AS (SELECT a.doc_id, a.image_id AS i, b.image_id AS j, min(bit_count(xor(a.hash, b.hash))) AS ld FROM lp a JOIN lp b
 ON a.doc_id = b.doc_id AND a.image_id < b.image_id GROUP BY ALL),
dist AS (SELECT ip.*, coalesce(gd, 99) AS gd, coalesce(rd, 99) AS rd, coalesce(ld, 99) AS ld FROM ip LEFT JOIN gd USING (doc_id, i, j)
 LEFT JOIN rd USING (doc_id, i, j) LEFT JOIN ld USING (doc_id, i, j))"""


def classes_sql(source: str = "images", cells: bool = False, strips: bool = False) -> str:
    """cl: the class of each image, its first image with the same hashes."""
    facets = ["(SELECT list(DISTINCT (transform, hash) ORDER BY (transform, hash)) FROM variants v WHERE v.doc_id = m.doc_id AND v.image_id = m.image_id) AS vs"]
    facets += ["(SELECT list(DISTINCT (part, hash) ORDER BY (part, hash)) FROM parts p WHERE p.doc_id = m.doc_id AND p.image_id = m.image_id AND p.std >= 18.0) AS cs"] * cells
    facets += ["(SELECT list(DISTINCT (part, hash) ORDER BY (part, hash)) FROM lp p WHERE p.doc_id = m.doc_id AND p.image_id = m.image_id) AS ls"] * strips
    names = ["phash", "ahash", "dhash", "vs"] + ["cs"] * cells + ["ls"] * strips
    return f"""sg AS (SELECT m.doc_id, m.image_id, m.phash, m.ahash, m.dhash, {", ".join(facets)} FROM {source} m),
cl AS (SELECT doc_id, image_id, min(image_id) OVER (PARTITION BY doc_id, {", ".join(names)}) AS c FROM sg)"""


def by_class_sql(found: str, lead: str = "") -> str:
    """Rows of ``found`` (doc_id, i, j, distance, severity) per pair of classes."""
    return f"""SELECT f.doc_id, {lead}least(a.c, b.c) AS class_a, greatest(a.c, b.c) AS class_b, min(distance) AS distance, min(severity) AS severity,
 count(*) AS pairs FROM ({found}) f JOIN cl a ON a.doc_id = f.doc_id AND a.image_id = i JOIN cl b ON b.doc_id = f.doc_id AND b.image_id = j GROUP BY ALL"""


LEFT = "pd > 8 AND sd > 12"
CLASS_COLUMNS = ("doc_id", "class_a", "class_b", "distance", "severity", "pairs")


@add(
    "j7_geometric_matches",
    with_sql(
        X.IMAGES_SQL,
        X.VARIANTS_SQL,
        X.PARTS_SQL,
        plain_pairs_sql(),
        classes_sql(),
        select=by_class_sql(
            f"SELECT doc_id, i, j, gd AS distance, CASE WHEN gd <= 4 THEN 'high' ELSE 'medium' END AS severity FROM dist WHERE gd <= 10 AND {LEFT}"
        ),
    ),
)
def j7(spark, sf_dir):
    found = M.classes(M.signatures(X.images(spark, sf_dir), X.image_variants(spark, sf_dir)))
    return M.geometric_classes(found).select(*CLASS_COLUMNS)


@add(
    "j8_region_matches",
    with_sql(
        X.IMAGES_SQL,
        X.VARIANTS_SQL,
        X.PARTS_SQL,
        plain_pairs_sql(),
        classes_sql(cells=True),
        select=by_class_sql(
            f"SELECT doc_id, i, j, rd AS distance, 'medium' AS severity FROM dist WHERE rd <= 2 AND gd > 10 AND {LEFT}"
        ),
    ),
)
def j8(spark, sf_dir):
    variants, parts = X.image_variants(spark, sf_dir), X.image_parts(spark, sf_dir)
    found = M.classes(M.signatures(X.images(spark, sf_dir), variants, cells=parts))
    return M.part_classes(found, "cells", G.REGION).select(*CLASS_COLUMNS)


@add(
    "j9_loading_control_strips",
    with_sql(
        X.IMAGES_SQL,
        X.VARIANTS_SQL,
        X.PARTS_SQL,
        plain_pairs_sql(),
        classes_sql(strips=True),
        select=by_class_sql(
            "SELECT doc_id, i, j, ld AS distance, CASE WHEN ld <= 2 THEN 'high' ELSE 'medium' END AS severity "
            f"FROM dist WHERE ld <= 5 AND gd > 10 AND {LEFT}"
        ),
    ),
)
def j9(spark, sf_dir):
    variants, parts = X.image_variants(spark, sf_dir), X.image_parts(spark, sf_dir)
    found = M.classes(M.signatures(X.images(spark, sf_dir), variants, strips=parts))
    return M.part_classes(found, "strips", G.STRIP, G.STRIP_HIGH_BITS).select(*CLASS_COLUMNS)


#: Each pass on the plain pairs that the passes before it left; the support of a primary pair counts images.
PASSES = """prim AS (SELECT doc_id, i, j, pd FROM dist WHERE pd <= 8),
touch AS (SELECT doc_id, i, j FROM prim UNION SELECT doc_id, j, i FROM prim UNION SELECT doc_id, i, i FROM prim UNION SELECT doc_id, j, j FROM prim),
span AS (SELECT p.doc_id, p.i, p.j, p.pd, count(DISTINCT t.j) AS span FROM prim p JOIN touch t ON t.doc_id = p.doc_id AND (t.i = p.i OR t.i = p.j) GROUP BY ALL),
hits AS (SELECT doc_id, 'primary' AS pass, i, j, pd AS distance, CASE WHEN span >= 5 THEN 'low' WHEN span > 2 OR pd > 4 THEN 'medium' ELSE 'high' END AS severity FROM span
 UNION ALL SELECT doc_id, 'secondary', i, j, sd, CASE WHEN sd <= 4 THEN 'high' ELSE 'medium' END FROM dist WHERE sd <= 12 AND pd > 8
 UNION ALL SELECT doc_id, 'geometric', i, j, gd, CASE WHEN gd <= 4 THEN 'high' ELSE 'medium' END FROM dist WHERE gd <= 10 AND pd > 8 AND sd > 12
 UNION ALL SELECT doc_id, 'region', i, j, rd, 'medium' FROM dist WHERE rd <= 2 AND pd > 8 AND sd > 12 AND gd > 10
 UNION ALL SELECT doc_id, 'loading_control', i, j, ld, CASE WHEN ld <= 2 THEN 'high' ELSE 'medium' END FROM dist WHERE ld <= 5 AND pd > 8 AND sd > 12 AND gd > 10)"""


@add(
    "g1_duplicate_passes",
    with_sql(
        X.IMAGES_SQL,
        X.VARIANTS_SQL.replace("variants AS (", "all_variants AS (", 1),
        X.PARTS_SQL.replace("parts AS (", "all_parts AS (", 1),
        "usable AS (SELECT * FROM images WHERE width >= 64 AND height >= 64 AND bytes_size >= 5120)",
        "blots AS (SELECT * FROM usable WHERE width >= 80 AND height >= 60 AND bytes_size >= 8192)",
        "variants AS (SELECT v.* FROM all_variants v SEMI JOIN usable USING (doc_id, image_id))",
        "parts AS (SELECT p.* FROM all_parts p SEMI JOIN usable USING (doc_id, image_id))",
        plain_pairs_sql("usable", "blots"),
        PASSES,
        classes_sql("usable", cells=True, strips=True),
        select=by_class_sql("SELECT * FROM hits", "pass, "),
    ),
)
def g1(spark, sf_dir):
    parts = X.image_parts(spark, sf_dir)
    out, _ = M.duplicate_classes(X.images(spark, sf_dir), X.image_variants(spark, sf_dir), parts, parts)
    return out


ALGOS = (
    "hashes AS (SELECT doc_id, 'phash' AS algo, image_id, phash FROM images UNION ALL SELECT doc_id, 'ahash', image_id, ahash FROM images "
    "UNION ALL SELECT doc_id, 'dhash', image_id, dhash FROM images)"
)


def algo_rows(spark, sf_dir):
    pick = [F.struct(F.lit(a).alias("algo"), F.col(a).alias("phash")) for a in ("phash", "ahash", "dhash")]
    return (
        X.images(spark, sf_dir)
        .select("doc_id", "image_id", "page", F.explode(F.array(*pick)).alias("h"))
        .select("doc_id", "image_id", "page", "h.*")
    )


@add(
    "j10_algorithm_matches",
    with_sql(
        X.IMAGES_SQL,
        ALGOS,
        edges_sql("e", "phash", 8, "doc_id, algo", "hashes"),
        select="SELECT doc_id, algo, image_a, image_b, distance, CASE WHEN distance <= 4 THEN 'high' WHEN distance <= 8 THEN 'medium' ELSE 'low' END AS severity FROM e",
    ),
)
def j10(spark, sf_dir):
    out = G.algorithm_matches(algo_rows(spark, sf_dir))
    return out.select("doc_id", "algo", "image_a", "image_b", "distance", "severity")


UNITS = ALGOS + (
    ", units AS (SELECT doc_id, algo, image_id // 3 AS page, phash AS hash, CASE WHEN image_id % 2 = 0 THEN 1 ELSE 0 END AS region FROM hashes)"
)


def page_units(spark, sf_dir):
    return algo_rows(spark, sf_dir).select(
        "doc_id",
        "algo",
        F.floor(F.col("image_id") / 3).alias("page"),
        F.col("phash").alias("hash"),
        F.when(F.col("image_id") % 2 == 0, "region").otherwise("tile").alias("kind"),
    )


#: Plain pairs of pages by their best pair of units, counted per pair of page classes.
PAGES = """um AS (SELECT doc_id, algo, page, hash, max(region) AS region FROM units WHERE hash IS NOT NULL GROUP BY ALL),
ps AS (SELECT doc_id, algo, page, list((hash, region) ORDER BY hash) AS u FROM um GROUP BY ALL),
pc AS (SELECT doc_id, algo, page, min(page) OVER (PARTITION BY doc_id, algo, u) AS c FROM ps),
hits AS (SELECT a.doc_id, a.algo, a.page AS i, b.page AS j, bit_count(xor(a.hash, b.hash)) AS distance,
 CASE WHEN a.region = 1 AND b.region = 1 AND a.algo = 'phash' AND bit_count(xor(a.hash, b.hash)) <= 8 THEN 1 ELSE 0 END AS prim
 FROM um a JOIN um b ON a.doc_id = b.doc_id AND a.algo = b.algo AND a.page < b.page),
best AS (SELECT doc_id, algo, i, j, min(distance) AS distance, max(prim) AS prim FROM hits
 WHERE prim = 1 OR distance <= CASE WHEN algo = 'ahash' THEN 4 ELSE 10 END GROUP BY ALL)"""


@add(
    "j11_j12_page_units",
    with_sql(
        X.IMAGES_SQL,
        UNITS,
        PAGES,
        select="SELECT b.doc_id, b.algo, least(x.c, y.c) AS page_a, greatest(x.c, y.c) AS page_b, min(distance) AS distance, max(prim) AS \"primary\", "
        "count(*) AS pairs FROM best b JOIN pc x ON x.doc_id = b.doc_id AND x.algo = b.algo AND x.page = i "
        "JOIN pc y ON y.doc_id = b.doc_id AND y.algo = b.algo AND y.page = j GROUP BY ALL",
    ),
)
def j11(spark, sf_dir):
    return M.page_class_matches(page_units(spark, sf_dir))


@add(
    "j13_cross_paper",
    with_sql(
        X.IMAGES_SQL,
        """pp AS (SELECT a.doc_id, a.image_id, a.width, a.height, a.bytes_size, b.doc_id AS paper, min(bit_count(xor(a.phash, b.phash))) AS d
 FROM images a JOIN images b ON a.width >= 64 AND a.height >= 64 AND b.doc_id <> a.doc_id AND bit_count(xor(a.phash, b.phash)) <= 6 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d, paper) AS r, count(*) OVER (PARTITION BY image_id) AS papers FROM pp)""",
        select="SELECT doc_id, image_id, paper AS matched_paper, d AS distance, papers, least(papers, 8) AS hits, CASE WHEN d = 0 AND width >= 180 "
        "AND height >= 120 AND bytes_size >= 15360 THEN 'high' ELSE 'medium' END AS severity FROM rk WHERE r = 1",
    ),
)
def j13(spark, sf_dir):
    images = X.images(spark, sf_dir)
    index = images.select(F.col("doc_id").alias("paper_id"), "phash")
    return G.cross_paper_matches(images, index)


@add(
    "j13_cross_paper_edges",
    with_sql(
        X.IMAGES_SQL,
        select="SELECT a.phash AS hash, b.doc_id AS paper, min(bit_count(xor(a.phash, b.phash))) AS distance "
        "FROM (SELECT DISTINCT phash FROM images WHERE width >= 64 AND height >= 64) a "
        "JOIN images b ON bit_count(xor(a.phash, b.phash)) <= 6 GROUP BY ALL",
    ),
)
def j13_edges(spark, sf_dir):
    images = X.images(spark, sf_dir)
    edges = G.cross_paper_edges(images, images.select(F.col("doc_id").alias("paper_id"), "phash"))
    return edges.select(F.col("hash_a").alias("hash"), F.col("paper_id").alias("paper"), "distance")


@add(
    "r6_index_screening",
    with_sql(
        X.IMAGES_SQL,
        "b AS (SELECT DISTINCT doc_id AS paper, doc_id % 2 AS batch, phash FROM images WHERE width >= 64 AND height >= 64)",
        select="SELECT a.batch, a.phash AS hash, b.paper, min(bit_count(xor(a.phash, b.phash))) AS distance FROM (SELECT DISTINCT batch, phash FROM b) a "
        "JOIN b ON b.batch <= a.batch AND bit_count(xor(a.phash, b.phash)) <= 6 GROUP BY ALL",
    ),
)
def r6(spark, sf_dir):
    """All images in two batches of papers: each meets the index of earlier batches and itself."""
    images = X.images(spark, sf_dir)
    path, out = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}", None
    for batch_id in (0, 1):
        batch = images.filter(F.pmod("doc_id", F.lit(2)) == batch_id)
        edges = I.batch_edges(batch, path, batch_id).select(
            F.lit(batch_id).cast("long").alias("batch"), F.col("hash_a").alias("hash"), F.col("paper_id").alias("paper"), "distance"
        )
        out = edges if out is None else out.unionByName(edges)
        I.append(batch, path, batch_id)
    return out


@add(
    "j14_file_reuse",
    with_sql(
        X.IMAGES_SQL,
        select="SELECT doc_id, sha1, count(*) AS occurrences, count(DISTINCT page) AS places, min(page) AS first_page FROM images GROUP BY ALL HAVING count(DISTINCT page) > 1",
    ),
)
def j14(spark, sf_dir):
    return G.file_reuse(X.images(spark, sf_dir))


@add(
    "j15_texture_reuse",
    with_sql(
        X.PARTS_SQL,
        """tex AS (SELECT doc_id, image_id, part, hash & 65535 AS content, hash FROM parts),
ex AS (SELECT doc_id, sum(c) AS matches FROM (SELECT doc_id, content, count(*) AS c FROM tex GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id),
tr AS (SELECT DISTINCT doc_id, content, image_id, part, t FROM (SELECT *, unnest([(content >> 4) | ((content & 15) << 12), (content >> 8) | ((content & 255) << 8)]) AS t FROM tex) WHERE t <> content),
rt AS (SELECT a.doc_id, count(*) AS matches FROM tr a WHERE EXISTS (SELECT 1 FROM tex b WHERE b.doc_id = a.doc_id AND b.content = a.t) GROUP BY ALL),
dh AS (SELECT DISTINCT doc_id, hash FROM tex),
nr AS (SELECT a.doc_id, count(*) AS matches FROM dh a JOIN dh b ON a.doc_id = b.doc_id AND a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 4 GROUP BY ALL)""",
        select="SELECT doc_id, 'exact' AS kind, matches FROM ex UNION ALL SELECT doc_id, 'rotated', matches FROM rt UNION ALL SELECT doc_id, 'near', matches FROM nr",
    ),
)
def j15(spark, sf_dir):
    content = F.col("hash").bitwiseAND(F.lit(65535).cast("long"))
    turn = lambda n, low: F.shiftright(content, n).bitwiseOR(
        F.shiftleft(content.bitwiseAND(F.lit(low).cast("long")), 16 - n)
    )
    cells = X.image_parts(spark, sf_dir).select(
        "doc_id",
        "image_id",
        F.col("part").alias("cell"),
        content.alias("content"),
        F.array_distinct(F.array(turn(4, 15), turn(8, 255))).alias("turns"),
        "hash",
    )
    return G.texture_reuse(cells)


GRID = """grid AS (SELECT doc_id, image_id, k AS cell, k // 4 AS r, k % 4 AS c, CAST(list_sum(list_transform(range(4), lambda i:
 CASE WHEN embedding[CAST(4 * k + i + 1 AS INT)] > 0 THEN 1 << CAST(i AS INT) ELSE 0 END)) AS BIGINT) * 31 AS hash
 FROM (SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS image_id, embedding, unnest(range(16)) AS k FROM embeddings)),
mm AS (SELECT a.doc_id, a.image_id, abs(a.r - b.r) AS dr, abs(a.c - b.c) AS dc, bit_count(xor(a.hash, b.hash)) AS d FROM grid a JOIN grid b
 ON a.image_id = b.image_id AND a.cell < b.cell AND (a.r <> b.r OR abs(a.c - b.c) >= 2) AND bit_count(xor(a.hash, b.hash)) <= 2),
agg AS (SELECT doc_id, image_id, count(*) AS matches, min(d) AS best,
 count(*) >= 8 AND count(*) FILTER (dr = 0 AND dc >= 2) * 1.0 / count(*) >= 0.6 AS multipanel_horizontal,
 count(*) >= 8 AND count(*) FILTER (dc = 0 AND dr >= 2) * 1.0 / count(*) >= 0.6 AS multipanel_vertical,
 count(*) >= 8 AND count(*) FILTER (dr = 0 AND dc >= 2 AND dc % 2 = 0) * 1.0 / count(*) >= 0.5 AS regular_stride FROM mm GROUP BY ALL),
s1 AS (SELECT *, CASE WHEN matches >= 15 THEN 3 WHEN matches >= 5 THEN 2 ELSE 1 END AS r0,
 multipanel_horizontal OR multipanel_vertical OR regular_stride AS lay FROM agg),
s2 AS (SELECT *, r0 - CASE WHEN lay AND r0 = 3 THEN 1 ELSE 0 END AS r1 FROM s1)"""


@add(
    "j16_j17_copy_move",
    with_sql(
        GRID,
        select="SELECT doc_id, image_id, matches, best, multipanel_horizontal, multipanel_vertical, regular_stride, "
        "['low', 'medium', 'high'][r1 - CASE WHEN lay AND best > 0 AND r1 > 1 THEN 1 ELSE 0 END] AS severity FROM s2",
    ),
)
def j16(spark, sf_dir):
    def cell(k):
        bits = sum(
            (
                F.when(F.element_at("embedding", 4 * k + i + 1) > 0, 1 << i).otherwise(0)
                for i in range(1, 4)
            ),
            F.when(F.element_at("embedding", 4 * k + 1) > 0, 1).otherwise(0),
        )
        return F.struct(
            F.lit(k // 4).alias("row"), F.lit(k % 4).alias("col"), (bits * 31).cast("long").alias("hash")
        )

    cells = (
        X.read(spark, sf_dir, "embeddings")
        .select(
            F.col("label").cast("long").alias("doc_id"),
            F.col("vec_id").alias("image_id"),
            F.explode(F.array(*[cell(k) for k in range(16)])).alias("c"),
        )
        .select("doc_id", "image_id", "c.*", F.lit(20.0).alias("std"))
    )
    return G.copy_move(cells, radius=2)


@add(
    "j35_panel_pairs",
    with_sql(
        X.PARTS_SQL,
        select="SELECT a.doc_id, a.image_id, a.part AS panel_a, b.part AS panel_b, bit_count(xor(a.hash, b.hash)) AS distance, "
        "CASE WHEN bit_count(xor(a.hash, b.hash)) <= 4 THEN 'high' ELSE 'medium' END AS severity FROM parts a JOIN parts b "
        "ON a.image_id = b.image_id AND a.part < b.part AND bit_count(xor(a.hash, b.hash)) <= 10",
    ),
)
def j35(spark, sf_dir):
    panels = X.image_parts(spark, sf_dir).withColumnRenamed("part", "panel")
    return G.panel_pairs(panels).drop("score")


@add(
    "a27_same_dimensions",
    with_sql(
        X.IMAGES_SQL,
        "s AS (SELECT doc_id, width // 100 AS width, height // 100 AS height FROM images)",
        select="SELECT doc_id, width, height, count(*) AS images FROM s GROUP BY ALL HAVING count(*) >= 3",
    ),
)
def a27(spark, sf_dir):
    images = X.images(spark, sf_dir)
    for side in ("width", "height"):
        images = images.withColumn(side, F.floor(F.col(side) / 100))
    return G.same_dimensions(images)


@add(
    "p8_size_classes",
    with_sql(
        X.IMAGES_SQL,
        select="SELECT doc_id, CASE WHEN width < 64 OR height < 64 THEN 'dimensions' WHEN bytes_size < 5120 THEN 'bytes' ELSE 'eligible' END AS size_class, "
        "count(*) AS images FROM images GROUP BY ALL",
    ),
)
def p8(spark, sf_dir):
    return G.size_classes(X.images(spark, sf_dir))


@add(
    "p9_decorative_images",
    with_sql(
        X.IMAGES_SQL,
        select="SELECT image_id, least(width, height) < 48 OR width * height < 4096 OR bytes_size < 2048 AS decorative FROM images",
    ),
)
def p9(spark, sf_dir):
    return X.images(spark, sf_dir).select("image_id", G.decorative().alias("decorative"))


@add(
    "p17_usable_paper_ids",
    with_sql(
        X.IMAGES_SQL,
        "n AS (SELECT image_id, CASE WHEN image_id % 3 = 0 THEN sha1 WHEN image_id % 3 = 1 THEN ' Main ' ELSE 'paper-' || image_id END AS paper_id FROM images)",
        select="SELECT image_id, paper_id, NOT (lower(trim(paper_id)) IN ('', 'original', 'paper', 'main', 'document', 'file', 'image', 'inputs', 'workspace', 'materials') "
        "OR regexp_matches(lower(trim(paper_id)), '^[0-9a-f]{10,40}$')) AS usable FROM n",
    ),
)
def p17(spark, sf_dir):
    name = (
        F.when(F.col("image_id") % 3 == 0, F.col("sha1"))
        .when(F.col("image_id") % 3 == 1, " Main ")
        .otherwise(F.concat(F.lit("paper-"), F.col("image_id")))
    )
    return X.images(spark, sf_dir).select("image_id", name.alias("paper_id")).withColumn(
        "usable", G.usable_paper_id(F.col("paper_id"))
    )


@add(
    "h26_average_hash",
    with_sql(
        X.IMAGES_SQL,
        """w AS (SELECT image_id, list_sum(list_transform(range(64), lambda i: CASE WHEN pixels[CAST(i + 1 AS INT)] > list_avg(pixels)
 THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INT) ELSE CAST(0 AS HUGEINT) END)) AS w FROM images)""",
        select="SELECT image_id, CAST(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END AS BIGINT) AS hash FROM w",
    ),
)
def h26(spark, sf_dir):
    return X.images(spark, sf_dir).select("image_id", G.average_hash(F.col("pixels")).alias("hash"))


@add(
    "g4_pixel_entropy",
    with_sql(
        X.IMAGES_SQL,
        "v AS (SELECT image_id, unnest(pixels) AS v FROM images)",
        "c AS (SELECT image_id, v, count(*) AS c FROM v GROUP BY ALL)",
        select="SELECT image_id, sum(c) AS pixels, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy, count(DISTINCT v // 16) AS tones FROM c GROUP BY ALL",
    ),
)
def g4(spark, sf_dir):
    return rounded(G.pixel_entropy(X.images(spark, sf_dir)), entropy=6)


@add("g4_edge_density")
def g4_edges(spark, sf_dir):
    return X.images(spark, sf_dir).select(
        "image_id", G.edge_density(F.col("pixels"), F.lit(8)).alias("edge_density")
    )


@add("g2_g3_noise_outliers")
def g2(spark, sf_dir):
    noise = X.images(spark, sf_dir).select(
        "image_id", G.tile_noise(F.col("pixels"), F.lit(8), F.lit(4)).alias("noise")
    )
    return G.noise_outliers(noise)


@add(
    "k1_most_similar",
    with_sql(
        X.IMAGES_SQL,
        edges_sql("e", "phash", 10),
        select="SELECT image_a, image_b, distance, 1 - distance / 64.0 AS similarity FROM e ORDER BY distance, image_a, image_b LIMIT 50",
    ),
)
def k1(spark, sf_dir):
    edges = G.similar_images(X.images(spark, sf_dir), 10)
    return G.most_similar(edges, 50).select("image_a", "image_b", "distance", "similarity")


@add(
    "f5_image_clusters",
    with_sql(
        X.IMAGES_SQL,
        """e AS (SELECT a.image_id AS u, b.image_id AS v FROM images a JOIN images b ON bit_count(xor(a.phash, b.phash)) <= 4)""",
        select="""SELECT u AS image_id, min(v) AS component FROM (
 WITH RECURSIVE reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u) SELECT * FROM reach) GROUP BY u""",
    ),
)
def f5(spark, sf_dir):
    return G.image_clusters(X.images(spark, sf_dir))
