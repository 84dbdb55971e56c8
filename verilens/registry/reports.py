"""Lookups, audits, evaluation and logs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import columns as C
from ..operators import evaluation as E
from ..operators import lookups as L
from ..operators import text as T
from . import corpus as X
from .columns import LINE, LINE4, ORDERS, rounded, with_sql

QUERIES = {}


def add(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


# --------------------------------------------------------------------------- audits


@add(
    "a19_column_profile",
    with_sql(
        ORDERS, X.NUMERIC_SQL,
        "s AS (SELECT table_id, col_idx, avg(num) AS mean, stddev_pop(num) AS sd FROM numeric GROUP BY ALL)",
        select="""SELECT table_id, col_idx, CASE WHEN count(*) FILTER (regexp_matches(text, '^[+-]?\\d+$')) = count(*) THEN 'int' ELSE 'float' END AS dtype,
 count(*) AS count, 0 AS missing, count(DISTINCT text) AS distinct_values, count(*) - count(DISTINCT text) AS duplicates, min(num) AS min_value, max(num) AS max_value,
 round(max(mean), 4) AS mean, round(max(sd), 4) AS pstdev, count(*) FILTER (abs(num - mean) > 3 * sd) AS outliers FROM numeric JOIN s USING (table_id, col_idx) GROUP BY table_id, col_idx""",
    ),
)
def a19(spark, sf_dir):
    out = rounded(A.column_profile(X.order_cells(spark, sf_dir)), mean=4, pstdev=4)
    return out.drop("doc_id", "header", "flags")


@add(
    "a20_table_audit",
    with_sql(
        LINE4,
        "c AS (SELECT doc_id, table_id, col_idx, count(*) AS rows, count(*) - count(DISTINCT text) AS duplicates FROM cells GROUP BY ALL)",
        "t AS (SELECT doc_id, table_id, max(rows) AS rows, count(*) AS columns, sum(duplicates) AS duplicates, 0 AS missing, sum(rows) AS cells FROM c GROUP BY ALL)",
        select="SELECT * FROM t UNION ALL SELECT doc_id, NULL, sum(rows), sum(columns), sum(duplicates), 0, sum(cells) FROM t GROUP BY doc_id",
    ),
)
def a20(spark, sf_dir):
    out = A.table_audit(A.column_profile(X.packed_lines(spark, sf_dir, 4), outliers=False))
    return out.drop("flags", "schema_hash", "missing_pct")


@add(
    "s8_table_inventory",
    with_sql(
        LINE,
        select="SELECT doc_id, table_id, count(*) // 8 AS rows, 8 AS columns, list_sort(list(DISTINCT header)) AS headers FROM cells GROUP BY ALL",
    ),
)
def s8(spark, sf_dir):
    out = A.table_inventory(X.line_cells(spark, sf_dir))
    return out.withColumn("headers", F.array_sort("headers"))


@add(
    "s9_read_table",
    with_sql(
        LINE4,
        "r AS (SELECT row_idx, max(text) FILTER (col_idx = 0) AS c0, max(text) FILTER (col_idx = 1) AS c1, max(text) FILTER (col_idx = 2) AS c2 FROM cells WHERE table_id = 7 GROUP BY ALL)",
        select="SELECT * FROM r",
    ),
)
def s9(spark, sf_dir):
    out = A.read_table(X.line_cells(spark, sf_dir, 4), 7, [0, 1, 2])
    return out.select("row_idx", *[F.col(str(i)).alias(f"c{i}") for i in range(3)])


@add(
    "s10_table_chunk",
    with_sql(
        LINE4,
        "r AS (SELECT table_id, row_idx, list(text ORDER BY col_idx) AS \"values\" FROM cells GROUP BY ALL)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS pos, count(*) OVER (PARTITION BY table_id) AS n FROM r)",
        select="SELECT table_id, pos, \"values\", n > 150 AS has_more FROM p WHERE pos >= 100 AND pos < 150",
    ),
)
def s10(spark, sf_dir):
    return A.table_chunk(X.packed_lines(spark, sf_dir, 4), 100, 50).drop("doc_id", "schema_hash")


def source_tables(spark, sf_dir):
    s = F.col("s_suppkey")
    return X.read(spark, sf_dir, "supplier").select(
        F.floor(s / 4).alias("doc_id"),
        s.alias("table_id"),
        F.lit("xlsx").alias("source_kind"),
        F.when(s % 3 != 0, F.concat(F.lit("Sheet"), s % 5)).otherwise("").alias("sheet_name"),
        F.when(s % 2 == 0, F.concat(F.lit("Fig. S"), s % 7)).otherwise("").alias("fig_name"),
    )


TABLES = """t AS (SELECT s_suppkey // 4 AS doc_id, s_suppkey AS table_id, CASE WHEN s_suppkey % 3 <> 0 THEN 'Sheet' || (s_suppkey % 5) END AS sheet,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Fig. S' || (s_suppkey % 7) END AS fig, dense_rank() OVER (PARTITION BY s_suppkey // 4 ORDER BY s_suppkey) AS k FROM supplier)"""


@add(
    "p5_table_labels",
    with_sql(
        TABLES,
        select="SELECT doc_id, table_id, CASE WHEN fig IS NOT NULL AND sheet IS NOT NULL THEN fig || ' in ' || sheet WHEN fig IS NOT NULL THEN fig "
        "WHEN sheet IS NOT NULL THEN 'Table ' || sheet || ' #' || k ELSE 'Table ' || k END AS label FROM t",
    ),
)
def p5(spark, sf_dir):
    return A.table_label(source_tables(spark, sf_dir))


@add(
    "h17_figure_keys",
    with_sql(TABLES, select="SELECT table_id, CASE WHEN fig IS NOT NULL THEN 'figs' || (table_id % 7) END AS fig_key FROM t"),
)
def h17(spark, sf_dir):
    return source_tables(spark, sf_dir).select("table_id", L.figure_key(F.col("fig_name")).alias("fig_key"))


@add(
    "p4_selected_tables",
    with_sql(LINE4, select="SELECT table_id, count(*) AS cells FROM cells WHERE table_id IN (3, 5, 8) GROUP BY table_id"),
)
def p4(spark, sf_dir):
    chosen = L.select_tables(X.line_cells(spark, sf_dir, 4), [3, 5, 8])
    return chosen.groupBy("table_id").agg(F.count(F.lit(1)).alias("cells"))


FILLS = ("yellow", "FFFF00", "#FFD966", "00B0F0", "FF0000")


def highlights(spark, sf_dir):
    """All line items; those with a discount of 10 % are filled in column 0."""
    fill = F.element_at(F.array(*[F.lit(f) for f in FILLS]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * (1 << 24) + F.col("l_partkey")
    return X.read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_suppkey") / 4).alias("doc_id"),
        F.col("l_suppkey").alias("table_id"),
        row.alias("row_idx"),
        F.lit(0).alias("col_idx"),
        F.when(F.col("l_suppkey") % 7 == 0, "5").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value"),
        F.when(F.expr("round(l_discount * 100) = 10"), fill).alias("fill"),
    )


HIGH = f"""h AS (SELECT l_suppkey // 4 AS doc_id, l_suppkey AS table_id, CASE WHEN l_suppkey % 7 = 0 THEN 5 ELSE CAST(l_quantity AS INT) END AS v,
 (l_orderkey * 8 + l_linenumber) * 16777216 + l_partkey AS row_idx FROM lineitem WHERE round(l_discount * 100) = 10)"""


@add(
    "a25_p16_highlight_rollup",
    with_sql(
        HIGH,
        select="SELECT doc_id, table_id, count(*) AS cells, count(*) FILTER (table_id % 5 < 3) AS yellow, 1 AS fills, "
        "CASE WHEN count(*) FILTER (table_id % 5 < 3) > 0 OR count(*) >= 5 THEN 'medium' ELSE 'low' END AS severity FROM h GROUP BY doc_id, table_id",
    ),
)
def a25(spark, sf_dir):
    return A.highlight_rollup(highlights(spark, sf_dir))


@add(
    "a26_highlight_checks",
    with_sql(
        HIGH,
        "c AS (SELECT doc_id, table_id, v, count(*) AS c FROM h GROUP BY ALL)",
        "s AS (SELECT doc_id, table_id, sum(c) AS n, max(c) AS top, count(*) AS distinct_values FROM c GROUP BY ALL)",
        "l AS (SELECT table_id, v - lag(v) OVER (PARTITION BY table_id ORDER BY row_idx) AS st FROM h)",
        "m AS (SELECT table_id, min(st) AS lo, max(st) AS hi FROM l GROUP BY ALL)",
        select="""SELECT doc_id, table_id, n, top, distinct_values, CASE WHEN distinct_values = 1 AND n >= 3 THEN 'highlight_zero_variance'
 WHEN n >= 3 AND top / n >= 0.75 THEN 'highlight_repeated' WHEN n >= 4 AND lo = hi AND lo <> 0 THEN 'highlight_progression' END AS "check" FROM s JOIN m USING (table_id)""",
    ),
)
def a26(spark, sf_dir):
    return A.highlight_checks(highlights(spark, sf_dir)).drop("col_idx")


@add(
    "a26_highlight_offsets",
    with_sql(
        HIGH,
        "w AS (SELECT doc_id, table_id, 0 AS col, row_idx, v FROM h UNION ALL SELECT doc_id, table_id, 1, row_idx, v + CASE WHEN table_id % 3 = 0 THEN 4 WHEN table_id % 3 = 1 THEN 0 ELSE row_idx % 3 END FROM h)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY table_id, col ORDER BY row_idx) AS pos FROM w)",
        select="""SELECT a.doc_id, a.table_id, a.col AS col_a, b.col AS col_b, count(*) AS n, min(b.v - a.v)::DOUBLE AS "offset",
 CASE WHEN min(b.v - a.v) = 0 THEN 'high' ELSE 'medium' END AS severity FROM o a JOIN o b ON a.table_id = b.table_id AND a.doc_id = b.doc_id AND a.col < b.col AND a.pos = b.pos
 GROUP BY ALL HAVING count(*) >= 3 AND min(b.v - a.v) = max(b.v - a.v)""",
    ),
)
def a26_offsets(spark, sf_dir):
    first = highlights(spark, sf_dir)
    table = F.col("table_id") % 3
    moved = F.when(table == 0, 4).when(table == 1, 0).otherwise(F.col("row_idx") % 3)
    second = first.withColumns(
        {"col_idx": F.lit(1), "value": (F.col("value").cast("long") + moved).cast("string")}
    )
    found = A.highlight_offsets(first.unionByName(second))
    return found.withColumn("offset", F.col("offset").cast("double"))


def detections(spark, sf_dir):
    """Words of event rows as OCR detections, one page per user and day hour."""
    e = F.col("event_id")
    return X.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        F.floor(e / 2000).alias("page"),
        ((e % 7) * 50.0).alias("x"),
        (F.floor(e / 10) * 5.0 + e % 3).alias("y"),
        F.when(e % 4 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")).alias("text"),
        "event_id",
    )


@add(
    "a31_ocr_grid",
    with_sql(
        "d AS (SELECT user_id AS doc_id, event_id // 2000 AS page, (event_id % 7) * 50.0 AS x, (event_id // 10) * 5.0 + event_id % 3 AS y, event_id FROM events)",
        "j AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, x) > 12 THEN 1 ELSE 0 END AS jump FROM d)",
        "g AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS grid_row FROM j)",
        select="SELECT doc_id, page, CAST(grid_row AS BIGINT) AS grid_row, count(*) AS cells FROM g GROUP BY ALL",
    ),
)
def a31(spark, sf_dir):
    grid = A.ocr_grid(detections(spark, sf_dir))
    return grid.groupBy("doc_id", "page", "grid_row").agg(F.count(F.lit(1)).alias("cells"))


GRID = (
    "d AS (SELECT user_id AS doc_id, event_id // 2000 AS page, (event_id % 7) * 50.0 AS x, (event_id // 10) * 5.0 + event_id % 3 AS y, event_id FROM events)",
    "j AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, x) > 12 THEN 1 ELSE 0 END AS jump FROM d)",
    "g AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS grid_row FROM j)",
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, grid_row ORDER BY x) AS col FROM g)",
)


@add(
    "a30_grid_stats",
    with_sql(
        *GRID,
        "t AS (SELECT doc_id, page, count(*) AS cells, count(*) FILTER (event_id % 4 <> 0) AS numeric_cells, max(grid_row)::BIGINT + 1 AS rows, max(col)::INT AS cols FROM k GROUP BY ALL)",
        select="SELECT *, rows >= 3 AND cols >= 2 AND numeric_cells / cells >= 0.3 AS table_like FROM t",
    ),
)
def a30(spark, sf_dir):
    return A.grid_stats(A.ocr_grid(detections(spark, sf_dir)))


@add(
    "a30_constant_columns",
    with_sql(
        *GRID,
        select='SELECT doc_id, page, col::INT AS "column", count(*) AS n, 4.5::DOUBLE AS "value" FROM k WHERE doc_id % 3 = 0 GROUP BY ALL HAVING count(*) >= 4',
    ),
)
def a30_constant(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, "4.50").otherwise(F.col("event_id").cast("string"))
    return A.constant_grid_columns(A.ocr_grid(detections(spark, sf_dir).withColumn("text", text)))


@add(
    "a29_forensics_score",
    with_sql(
        X.FINDINGS_SQL,
        """w AS (SELECT doc_id, rank, CASE WHEN rank = 3 AND "check" IN ('panel_sift_match', 'full_image_duplicate') THEN 0.24 WHEN rank = 3 THEN 0.20
 WHEN rank = 2 AND "check" = 'panel_sift_match' THEN 0.12 WHEN rank = 2 THEN 0.09 ELSE 0.03 END AS w FROM f WHERE slot = 1)""",
        "s AS (SELECT doc_id, least(1.0, round(sum(w), 6)) AS score, count(*) FILTER (rank = 3) AS high, count(*) FILTER (rank = 2) AS medium FROM w GROUP BY ALL)",
        select="SELECT *, CASE WHEN score >= 0.55 OR high >= 2 THEN 'high' WHEN score >= 0.25 OR medium >= 2 THEN 'medium' ELSE 'low' END AS risk FROM s",
    ),
)
def a29(spark, sf_dir):
    return A.forensics_score(X.findings(spark, sf_dir).filter("detector = 'image_forensics'"))


# --------------------------------------------------------------------------- lookups


@add(
    "j20_verified_citations",
    with_sql(
        X.PAPERS_SQL,
        "c AS (SELECT DISTINCT doc_id, doc_id % 12 AS slot FROM papers WHERE doc_id % 12 = 7)",
        select="SELECT doc_id, '[Smith 2019]' AS raw, 2 AS score, 'match' AS status FROM c UNION ALL SELECT doc_id, '(Jones, 2020)', 0, 'not_found' FROM c",
    ),
)
def j20(spark, sf_dir):
    works = X.read(spark, sf_dir, "nation").filter("n_nationkey = 0").select(
        F.lit("smith 2019").alias("key"),
        F.lit("A title").alias("title"),
        F.lit(2019).alias("year"),
        F.array(F.lit("Smith")).alias("authors"),
    )
    out = L.verify_citations(T.citations(X.paper_blocks(spark, sf_dir)), works)
    return out.filter("year <> '1234'").select("doc_id", "raw", "score", "status")


@add(
    "j21_cited_retractions",
    with_sql(
        X.PAPERS_SQL,
        select="SELECT DISTINCT doc_id, '10.1371/journal.a1' AS doi, 'high' AS severity FROM papers WHERE doc_id % 12 = 3 OR doc_id % 7 IN (0, 1)",
    ),
)
def j21(spark, sf_dir):
    dois = X.paper_blocks(spark, sf_dir).select(
        "doc_id", F.col("block_no").alias("position"), F.explode(T.find_all(F.col("text"), T.DOI)).alias("doi")
    )
    retracted = X.read(spark, sf_dir, "nation").select(
        F.concat(F.lit("https://doi.org/10.1371/JOURNAL.A"), F.col("n_nationkey")).alias("doi"),
        (F.col("n_nationkey") < 5).alias("is_retracted"),
        F.col("n_name").alias("title"),
    )
    return L.cited_retractions(dois, retracted).select("doc_id", "doi", "severity")


@add(
    "j22_link_findings",
    with_sql(
        X.PAPERS_SQL,
        select="SELECT doc_id, 'https://example.org/data' AS url, 'dead_page' AS status, 'medium' AS severity FROM papers WHERE doc_id % 12 = 5",
    ),
)
def j22(spark, sf_dir):
    status = X.read(spark, sf_dir, "region").filter("r_regionkey = 0").select(
        F.lit("https://example.org/data").alias("url"), F.lit("dead_page").alias("status")
    )
    return L.link_findings(T.statement_links(X.papers(spark, sf_dir)), status)


@add(
    "j23_cache_freshness",
    "SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN e.k IS NULL THEN 'missing' WHEN 1706572800 - e.ts > 86400 * 10 THEN 'stale' ELSE 'fresh' END AS state "
    "FROM customer LEFT JOIN (SELECT user_id AS k, max(epoch(ts)) AS ts FROM events WHERE event_type = 'view' GROUP BY ALL) e ON e.k = c_custkey",
)
def j23(spark, sf_dir):
    keys = X.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    cache = (
        X.read(spark, sf_dir, "events")
        .filter("event_type = 'view'")
        .groupBy(F.col("user_id").cast("string").alias("key"))
        .agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("ts"))
    )
    return L.stale_entries(keys, cache, 1706572800.0, 86400.0 * 10)


def two_sides(spark, sf_dir):
    line = X.read(spark, sf_dir, "lineitem")
    pdf = line.filter("l_linenumber % 2 = 0").select(
        (F.col("l_suppkey") % 50).alias("fig"), (F.floor(F.col("l_extendedprice") / 10) / 100.0).alias("num")
    )
    source = line.filter("l_linenumber % 2 = 1").select(
        (F.col("l_suppkey") % 50).alias("fig"), (F.floor("l_extendedprice") / 1000.0).alias("num")
    )
    return pdf, source



SIDES = """p AS (SELECT l_suppkey % 50 AS fig, floor(l_extendedprice / 10) / 100.0 AS v FROM lineitem WHERE l_linenumber % 2 = 0),
r AS (SELECT l_suppkey % 50 AS fig, floor(l_extendedprice) / 1000.0 AS v FROM lineitem WHERE l_linenumber % 2 = 1),
b4 AS (SELECT fig, CAST(round(v * 1000) AS BIGINT) AS i, count(*) FILTER (s = 0) AS q, count(*) FILTER (s = 1) AS r FROM
 (SELECT fig, v, 0 AS s FROM p UNION ALL SELECT fig, v, 1 FROM r) GROUP BY ALL),
b3 AS (SELECT fig, i // 10 + CASE WHEN i % 10 > 5 OR (i % 10 = 5 AND (i // 10) % 2 = 1) THEN 1 ELSE 0 END AS k2,
 greatest(q - r, 0) AS q, greatest(r - q, 0) AS r FROM b4),
b2 AS (SELECT fig, k2, sum(q) AS q, sum(r) AS r FROM b3 GROUP BY fig, k2),
m AS (SELECT fig, sum(greatest(q - r, 0)) AS missing FROM b2 GROUP BY fig),
n AS (SELECT fig, count(*) AS n FROM p GROUP BY fig)"""


@add(
    "j24_multiset_missing",
    with_sql(SIDES, select="SELECT fig, n, CAST(missing AS BIGINT) AS missing, round(missing / n, 6) AS fraction FROM n JOIN m USING (fig)"),
)
def j24(spark, sf_dir):
    pdf, source = two_sides(spark, sf_dir)
    return rounded(L.multiset_missing(pdf, source, ["fig"]), fraction=6)


@add("j25_source_consistency")
def j25(spark, sf_dir):
    pdf, source = two_sides(spark, sf_dir)
    return rounded(L.source_consistency(pdf, source, ["fig"]), fraction=6, unused_fraction=6)


@add(
    "j26_integer_multiset",
    """WITH c AS (SELECT l_suppkey % 50 AS fig, l_quantity AS v, count(*) FILTER (l_linenumber % 2 = 0) AS q, count(*) FILTER (l_linenumber % 2 = 1) AS r FROM lineitem GROUP BY ALL)
 SELECT fig, sum(q) AS n, sum(greatest(q - r, 0)) AS missing FROM c GROUP BY fig HAVING sum(q) > 0""",
)
def j26(spark, sf_dir):
    line = X.read(spark, sf_dir, "lineitem")
    side = lambda k: line.filter(F.col("l_linenumber") % 2 == k).select(
        (F.col("l_suppkey") % 50).alias("fig"), F.col("l_quantity").alias("num")
    )
    return L.multiset_missing(side(0), side(1), ["fig"]).select("fig", "n", "missing")


@add("j27_sentence_labels")
def j27(spark, sf_dir):
    events = X.read(spark, sf_dir, "events")
    sentences = events.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("sentence_no"),
        F.concat(F.lit("The "), "event_type", F.lit(" group reached "), F.floor("value").cast("string"), F.lit("% overall.")).alias("text"),
    )
    labels = events.groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("label")).agg(
        F.floor(F.avg("value")).cast("double").alias("value")
    )
    return L.nearest_percent_gap(sentences, labels)


@add(
    "a21_percent_overlap",
    """WITH e AS (SELECT user_id AS doc_id, CAST(round_even(value, 0) AS INT) AS b, event_type FROM events),
 p AS (SELECT doc_id, b, count(*) AS c FROM e WHERE event_type = 'view' GROUP BY ALL),
 t AS (SELECT DISTINCT doc_id, b FROM e WHERE event_type = 'click'),
 m AS (SELECT k.doc_id, k.b, EXISTS (SELECT 1 FROM t WHERE t.doc_id = k.doc_id AND abs(t.b - k.b) <= 2) AS hit FROM p k)
 SELECT doc_id, count(*) AS buckets, count(*) FILTER (hit) AS matched, count(*) FILTER (hit) = 0 AS fires FROM m WHERE doc_id IN (SELECT doc_id FROM t) GROUP BY doc_id""",
)
def a21(spark, sf_dir):
    events = X.read(spark, sf_dir, "events").withColumnRenamed("user_id", "doc_id").withColumnRenamed("value", "pct")
    return L.percent_overlap(events.filter("event_type = 'view'"), events.filter("event_type = 'click'"))


@add("j29_nearest_captions")
def j29(spark, sf_dir):
    e = F.col("event_id")
    base = X.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.floor(e / 500).alias("page"), "event_id",
        (e * 37 % 800).alias("at"), (e % 3 * 200).alias("left"), "event_type",
    )
    captions = base.filter("event_type = 'view'").select(
        "doc_id", "page", F.concat(F.lit("Table "), "event_id").alias("caption"), F.col("at").alias("bottom"),
        "left", (F.col("left") + 180).alias("right"),
    )
    tables = base.filter("event_type = 'click'").select(
        "doc_id", "page", F.col("event_id").alias("table_id"), F.col("at").alias("top"), "left", (F.col("left") + 250).alias("right")
    )
    return L.nearest_caption(captions, tables)


@add(
    "j33_companion_images",
    with_sql(X.IMAGES_SQL, select="SELECT doc_id, CASE WHEN image_id % 4 = 0 THEN page + 10000 ELSE page END AS page, image_id FROM images"),
)
def j33(spark, sf_dir):
    images = X.images(spark, sf_dir).select("doc_id", "page", "image_id")
    return L.with_companions(images.filter("image_id % 4 <> 0"), images.filter("image_id % 4 = 0"))


def metadata(spark, sf_dir):
    o = F.col("o_orderkey")
    return X.read(spark, sf_dir, "orders").select(
        o.alias("doc_id"),
        F.when(o % 11 == 0, "RETRACTED: study").otherwise("A study").alias("title"),
        F.when(o % 5 == 0, " ").otherwise("Ann Lee").alias("author"),
        F.when(o % 7 == 0, "iText 5.5").otherwise("pdfTeX-1.40").alias("producer"),
        F.lit("LaTeX").alias("creator"),
        F.lit("short").alias("subject"),
        F.date_format("o_orderdate", "'D:'yyyyMMdd'120000'").alias("creation_date"),
        F.date_format(F.date_add("o_orderdate", (o % 800 - 10).cast("int")), "'D:'yyyyMMdd").alias("mod_date"),
        (o % 2).alias("embedded"),
        (o % 13 == 0).cast("int").alias("scripts"),
    )


@add(
    "t22_h18_metadata_rules",
    """SELECT o_orderkey AS doc_id, u.check AS "check", u.severity AS severity FROM orders, (VALUES ('suspicious_producer', 'medium', 7), ('empty_author', 'low', 5), ('retracted_title', 'high', 11), ('scripts', 'medium', 13))
 AS u("check", severity, k) WHERE o_orderkey % u.k = 0 UNION ALL SELECT o_orderkey, 'embedded_files', 'low' FROM orders WHERE o_orderkey % 2 = 1
 UNION ALL SELECT o_orderkey, 'modified_before_created', 'high' FROM orders WHERE o_orderkey % 800 < 10 UNION ALL SELECT o_orderkey, 'modified_late', 'low' FROM orders WHERE o_orderkey % 800 - 10 > 365""",
)
def t22(spark, sf_dir):
    return L.metadata_rules(metadata(spark, sf_dir))


@add(
    "t23_ai_fingerprints",
    """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN ['midjourney'] WHEN c_custkey % 4 = 1 THEN ['c2pa'] ELSE [] END AS tools, c_custkey % 4 = 2 AS prompt,
 CASE WHEN c_custkey % 4 = 0 THEN 'high' ELSE 'medium' END AS severity FROM customer WHERE c_custkey % 4 < 3""",
)
def t23(spark, sf_dir):
    k = F.col("c_custkey")
    value = F.when(k % 4 == 0, "Made with Midjourney v5").when(k % 4 == 1, "C2PA manifest").when(
        k % 4 == 2, "a cell, photorealistic, octane render"
    ).otherwise("Figure 1")
    meta = X.read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit("xmp").alias("field"), value.alias("value"))
    return L.ai_fingerprints(meta).drop("field")


@add(
    "t24_supplements",
    """WITH d AS (SELECT s_suppkey AS k FROM supplier), a AS (SELECT l_suppkey + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS k, count(*) AS files, sum(CAST(l_quantity AS BIGINT)) AS bytes,
 count(*) FILTER (l_linenumber = 7 AND l_quantity = 50) AS suspicious FROM lineitem GROUP BY ALL)
 SELECT d.k AS doc_id, d.k % 2 = 0 AS claimed, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, coalesce(suspicious, 0) AS suspicious,
 CASE WHEN coalesce(suspicious, 0) > 0 THEN 'high' WHEN d.k % 2 = 0 AND files IS NULL THEN 'medium' END AS severity FROM d LEFT JOIN a USING (k)""",
)
def t24(spark, sf_dir):
    docs = X.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("doc_id"),
        F.when(F.col("s_suppkey") % 2 == 0, "See Supplementary Materials.").otherwise("Nothing.").alias("text"),
    )
    # every third supplier's files belong to the next one
    files = X.read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") + F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0)).alias("doc_id"),
        F.col("l_quantity").cast("long").alias("size_bytes"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") == 50), "EXE").otherwise("csv").alias("ext"),
    )
    return L.supplements(docs, files)


@add(
    "a24_file_fingerprints",
    "SELECT l_suppkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS creator, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS created, count(*) AS files FROM lineitem GROUP BY ALL HAVING count(*) >= 3",
)
def a24(spark, sf_dir):
    files = X.read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"),
        F.col("l_linenumber").cast("string").alias("creator"),
        F.col("l_quantity").cast("int").cast("string").alias("created"),
    )
    return L.file_fingerprints(files)


@add(
    "p11_applicability",
    """WITH d AS (SELECT doc_id, n_chars > 500 AS t, doc_id % 2 = 0 AS tb, doc_id % 3 = 0 AS im, doc_id % 5 = 0 AS rf FROM documents)
 SELECT doc_id, u.det AS detector, CASE WHEN u.f = 'tables' AND NOT tb THEN 'no_tables' WHEN u.f = 'images' AND NOT im THEN 'no_images' WHEN u.f = 'references' AND NOT rf THEN 'no_references'
 WHEN u.f = 'text' AND NOT t THEN 'no_text' END AS skip FROM d, (VALUES ('table_relationships', 'tables'), ('table_benford', 'tables'), ('image_dup', 'images'), ('ref_duplicate', 'references'),
 ('text_patterns', 'text'), ('compliance', 'text')) AS u(det, f)""",
)
def p11(spark, sf_dir):
    k = F.col("doc_id")
    docs = X.read(spark, sf_dir, "documents").select(
        k, (F.col("n_chars") > 500).alias("has_text"), (k % 2 == 0).alias("has_tables"),
        (k % 3 == 0).alias("has_images"), (k % 5 == 0).alias("has_references"),
    )
    return L.applicable(docs)


# --------------------------------------------------------------------------- evaluation


def gold(spark, sf_dir):
    """Expected and absent detectors per user."""
    detectors = F.array(*[F.lit(d) for d in X.DETECTORS])
    pick = lambda shift: F.element_at(detectors, ((F.col("u") + shift) % 8 + 1).cast("int"))
    return (
        X.read(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct().select(
            F.col("u").cast("string").alias("case_id"),
            F.array(pick(0), pick(3), F.lit("ref_duplicate")).alias("expected_detectors"),
            F.array(pick(5)).alias("absent_detectors"),
            F.when(F.col("u") % 2 == 0, "core").otherwise("controls").alias("benchmark"),
        )
    )


_d = X._list(X.DETECTORS)
GOLD = f"""u AS (SELECT DISTINCT user_id AS u FROM events),
ex AS (SELECT CAST(u AS VARCHAR) AS case_id, unnest([{_d}[u % 8 + 1], {_d}[(u + 3) % 8 + 1], 'ref_duplicate']) AS det FROM u),
ab AS (SELECT CAST(u AS VARCHAR) AS case_id, {_d}[(u + 5) % 8 + 1] AS det FROM u),
fired AS (SELECT DISTINCT doc_id, detector FROM f),
e1 AS (SELECT case_id, count(*) AS expected, count(detector) AS found FROM ex LEFT JOIN fired ON doc_id = case_id AND detector = det GROUP BY ALL),
a1 AS (SELECT case_id, count(*) AS absent, count(detector) AS false_alarms FROM ab LEFT JOIN fired ON doc_id = case_id AND detector = det GROUP BY ALL),
cs AS (SELECT *, found * 1.0 / expected AS recall FROM e1 JOIN a1 USING (case_id))"""


def recall_cases(spark, sf_dir):
    return E.case_recall(gold(spark, sf_dir), X.findings(spark, sf_dir))


@add(
    "e1_j34_case_recall",
    with_sql(X.FINDINGS_SQL, GOLD, select="SELECT case_id, expected, found, absent, false_alarms, round(recall, 6) AS recall FROM cs"),
)
def e1(spark, sf_dir):
    return rounded(recall_cases(spark, sf_dir), recall=6)


@add(
    "e1_overall_recall",
    with_sql(
        X.FINDINGS_SQL, GOLD,
        select="SELECT sum(expected) AS expected, sum(found) AS found, sum(false_alarms) AS false_alarms, round(sum(found) * 1.0 / sum(expected), 6) AS recall, sum(found) * 1.0 / sum(expected) >= 0.7 AS passed FROM cs",
    ),
)
def e1_all(spark, sf_dir):
    return rounded(E.overall_recall(recall_cases(spark, sf_dir)), recall=6)


@add(
    "e2_target_recall",
    "SELECT CAST(user_id AS VARCHAR) AS case_id, count(*) FILTER (event_type = 'click') AS exact, count(*) FILTER (event_type = 'view') AS partial, count(*) FILTER (event_type = 'error') AS missed, "
    "round(count(*) FILTER (event_type IN ('click', 'view')) * 1.0 / nullif(count(*) FILTER (event_type IN ('click', 'view', 'error')), 0), 6) AS recall FROM events GROUP BY user_id",
)
def e2(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "exact").when(F.col("event_type") == "view", "partial").when(
        F.col("event_type") == "error", "missed"
    )
    rows = X.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("case_id"), status.alias("status"))
    return rounded(E.target_recall(rows), recall=6)


def scored_findings(spark, sf_dir):
    k = F.col("finding_id").cast("long")
    return X.findings(spark, sf_dir).select(
        F.col("doc_id").alias("case_id"), "finding_id", "detector", "severity",
        (k * 7919 % 1000).alias("score"), (k % 4 == 0).alias("relevant"),
    )


PREC = """pk AS (SELECT doc_id AS case_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, e * 7919 % 1000 DESC, detector, finding_id) AS r FROM f),
pr AS (SELECT case_id, count(*) AS considered, count(*) FILTER (e % 4 = 0) AS relevant, count(*) FILTER (e % 4 = 0) * 1.0 / count(*) AS precision FROM pk WHERE r <= 20 GROUP BY ALL)"""


@add("e3_precision_at_k", with_sql(X.FINDINGS_SQL, PREC, select="SELECT * FROM pr"))
def e3(spark, sf_dir):
    return E.precision_at_k(scored_findings(spark, sf_dir))


@add(
    "e4_gates",
    with_sql(
        X.FINDINGS_SQL, GOLD, PREC,
        select="SELECT round((SELECT sum(found) * 1.0 / sum(expected) FROM cs), 6) AS recall, (SELECT sum(found) * 1.0 / sum(expected) FROM cs) >= 0.7 AS recall_ok, "
        "round((SELECT avg(precision) FROM pr), 6) AS precision, (SELECT avg(precision) FROM pr) >= 0.15 AS precision_ok",
    ),
)
def e4(spark, sf_dir):
    out = E.gates(recall_cases(spark, sf_dir), E.precision_at_k(scored_findings(spark, sf_dir)))
    return rounded(out, recall=6, precision=6)


@add(
    "e5_expectations",
    with_sql(
        X.FINDINGS_SQL,
        "x AS (SELECT DISTINCT doc_id AS case_id FROM f)",
        "c AS (SELECT doc_id AS case_id, count(*) AS findings, CAST(bool_or(contains(lower(title), 'signal 1')) AS INT) AS m1, CAST(bool_or(contains(lower(title), 'in image_dup')) AS INT) AS m2, "
        "CAST(bool_or(contains(lower(title), 'signal 99 in')) AS INT) AS b FROM f GROUP BY ALL)",
        select="SELECT case_id, findings, m1 + m2 AS met, b AS broken, findings >= 1 AND findings <= 80 AND m1 + m2 = 2 AND b = 0 AS passed FROM c",
    ),
)
def e5(spark, sf_dir):
    found = X.findings(spark, sf_dir)
    expected = found.select(F.col("doc_id").alias("case_id")).distinct().select(
        "case_id", F.lit(1).alias("min_findings"), F.lit(80).alias("max_findings"),
        F.array(F.lit("Signal 1"), F.lit("in image_dup")).alias("must"), F.array(F.lit("signal 99 in")).alias("must_not"),
    )
    return E.expectations(expected, found)


@add(
    "e6_regression_gates",
    with_sql(
        X.FINDINGS_SQL, GOLD,
        "hi AS (SELECT doc_id AS case_id, count(*) FILTER (rank = 3) AS high FROM f GROUP BY ALL)",
        "j AS (SELECT *, CASE WHEN CAST(case_id AS BIGINT) % 2 = 0 THEN 'core' ELSE 'controls' END AS benchmark FROM cs LEFT JOIN hi USING (case_id))",
        select="SELECT benchmark, count(*) AS cases, bool_and(found = expected) AS recall_ok, avg(coalesce(high, 0)) <= 2 AS budget_ok, sum(false_alarms) = 0 AS absent_ok FROM j GROUP BY benchmark",
    ),
)
def e6(spark, sf_dir):
    cases = recall_cases(spark, sf_dir).join(gold(spark, sf_dir).select("case_id", "benchmark"), "case_id")
    return E.regression_gates(cases, X.findings(spark, sf_dir))


@add(
    "e7_suggested_threshold",
    """WITH s AS (SELECT CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM labels JOIN documents USING (doc_id)),
 d AS (SELECT DISTINCT score FROM s), t AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM s),
 r AS (SELECT d.score, count(*) FILTER (label = 1) * 1.0 / max(p) AS tpr, count(*) FILTER (label <> 1) * 1.0 / max(n) AS fpr FROM d JOIN s ON s.score >= d.score, t GROUP BY d.score),
 b AS (SELECT score, tpr - fpr AS j FROM r ORDER BY round(tpr - fpr, 9) DESC, score LIMIT 1), l AS (SELECT score, tpr FROM r WHERE fpr <= 0.05 ORDER BY tpr DESC, score LIMIT 1)
 SELECT b.score AS youden_threshold, round(b.j, 6) AS youden, l.score AS fpr_threshold, round(l.tpr, 6) AS fpr_tpr FROM b, l""",
)
def e7(spark, sf_dir):
    scores = X.read(spark, sf_dir, "labels").join(X.read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = scores.select(F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))
    return rounded(E.suggested_threshold(rows), youden=6, fpr_tpr=6)


# --------------------------------------------------------------------------- logs


def tool_log(spark, sf_dir):
    return X.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration_ms"), "ts", "user_id"
    )


@add(
    "e8_tool_stats",
    """WITH o AS (SELECT event_type AS tool, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT tool, count(*) AS calls, CASE WHEN tool = 'error' THEN count(*) ELSE 0 END AS errors, round(avg(value), 6) AS avg_ms, max(value) FILTER (r = n // 2) AS p50,
 max(value) FILTER (r = greatest(CAST(floor(n * 0.95) AS BIGINT) - 1, 0)) AS p95 FROM o GROUP BY tool""",
)
def e8(spark, sf_dir):
    return rounded(E.tool_stats(tool_log(spark, sf_dir)), avg_ms=6)


PRICES = {"view": (0.5, 1.5), "click": (3.0, 15.0)}


def cost_log(spark, sf_dir):
    e = F.col("event_id")
    rows = X.read(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("model"), (e % 1000).alias("in_tok"), (e % 300).alias("out_tok")
    )
    return rows.withColumn(
        "cost_usd", E.call_cost(F.col("model"), F.col("in_tok"), F.col("out_tok"), PRICES, "view")
    )


COST = """c AS (SELECT ts, event_type AS model, event_id % 1000 AS i, event_id % 300 AS o, (event_id % 1000) / 1000.0 * CASE WHEN event_type = 'click' THEN 3.0 ELSE 0.5 END
 + (event_id % 300) / 1000.0 * CASE WHEN event_type = 'click' THEN 15.0 ELSE 1.5 END AS cost FROM events)"""


@add(
    "e9_h29_cost_summary",
    with_sql(
        COST,
        select="SELECT coalesce(model, 'total') AS model, count(*) AS calls, sum(i) AS in_tok, sum(o) AS out_tok, round(sum(cost), 6) AS cost_usd FROM c "
        "WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS GROUP BY ROLLUP (model)",
    ),
)
def e9(spark, sf_dir):
    now = F.lit("2024-01-30").cast("timestamp")
    return rounded(E.cost_summary(cost_log(spark, sf_dir), now, 7), cost_usd=6)


@add(
    "r7_windowed_tool_stats",
    "SELECT date_trunc('day', ts) AS start, event_type AS tool, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total_ms FROM events GROUP BY ALL",
)
def r7(spark, sf_dir):
    from ..streaming.pipelines import windowed_stats

    return rounded(windowed_stats(tool_log(spark, sf_dir)), total_ms=4)


@add(
    "r5_live_counters",
    """WITH c AS (SELECT user_id AS trace_id, count(*) FILTER (event_type = 'view') AS started, count(*) FILTER (event_type = 'click') AS done, count(*) FILTER (event_type = 'signup') AS skipped,
 count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY ALL) SELECT *, round((done + skipped + error) * 1.0 / nullif(started, 0), 6) AS progress FROM c""",
)
def r5(spark, sf_dir):
    from ..streaming.pipelines import live_counters

    kinds = F.create_map(*[F.lit(x) for x in ("view", "started", "click", "done", "signup", "skipped", "error", "error")])
    rows = X.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), F.try_element_at(kinds, F.col("event_type")).alias("type")
    )
    return rounded(live_counters(rows), progress=6)
