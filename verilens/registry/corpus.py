"""Normalized inputs derived from the given tables, in Spark and in SQL.

Each ``*_SQL`` string is a list of CTEs that DuckDB can run on the same files.
Columns 4 to 7 of the line-item tables carry planted relations (fixed offset,
fixed ratio, sum, sparse spread) in part of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order lines are at most 2^20 per chunk of row indexes.
LINE_CHUNK = 1 << 44

LARGE = frozenset({"lineitem", "orders", "documents", "pages", "conversations", "events"})
#: Of these, tables of many short rows, whose files have many row groups.
LONG = frozenset({"lineitem", "orders", "events"})

HEADERS = ("quantity", "price", "discount", "tax", "shifted", "scaled", "total", "group sd")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a handful of files is spread over the cores first.

    Large inputs have more files than cores and are read as they are, long tables also
    where one file gives enough splits.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in LARGE and len(df.inputFiles()) * 4 < cores:
        if name not in LONG or df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
    return df


def line_cells(spark: SparkSession, sf_dir: str, columns: int = 8, replicas: bool = False) -> DataFrame:
    """Long cells of one table per supplier, four tables per document."""
    rows = packed_lines(spark, sf_dir, columns, replicas)
    return rows.withColumn("c", F.explode("items")).select("doc_id", "table_id", "row_idx", "c.*")


def packed_lines(spark: SparkSession, sf_dir: str, columns: int = 8, replicas: bool = False) -> DataFrame:
    """The rows of ``line_cells`` with their cells in ``items``.

    With ``replicas`` two later columns of two thirds of the tables repeat the price.
    """
    q = F.col("l_quantity").cast("int")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    tax = F.col("l_tax").cast("decimal(18,2)")
    third = F.pmod("l_suppkey", F.lit(3))
    shifted = F.when(third == 0, price + 3).otherwise(price + q)
    scaled = F.when(third == 1, price * 2).otherwise(price * 2 + q)
    total = F.when(third == 2, price + tax).otherwise(price + tax + q)
    sd = F.when(q < 5, F.lit(0)).otherwise(q)

    def dec(c: Column) -> Column:
        return c.cast("decimal(18,2)").cast("string")

    texts = [
        q.cast("string"),
        dec(price),
        dec(F.col("l_discount")),
        dec(tax),
        dec(shifted),
        dec(scaled),
        dec(total),
        sd.cast("string"),
    ]
    if replicas:
        for col_idx, thirds in ((4, (0, 1)), (5, (0,)), (7, (1,))):
            texts[col_idx] = F.when(third.isin(*thirds), texts[1]).otherwise(texts[col_idx])
    structs = [
        F.struct(F.lit(i).alias("col_idx"), F.lit(HEADERS[i]).alias("header"), texts[i].alias("text"))
        for i in range(columns)
    ]
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * (1 << 24) + F.col("l_partkey")
    return (
        read(spark, sf_dir, "lineitem")
        .select(
            F.floor(F.col("l_suppkey") / 4).alias("doc_id"),
            F.col("l_suppkey").alias("table_id"),
            row.alias("row_idx"),
            F.array(*structs).alias("items"),
        )
    )


_LINE_TEXTS = (
    "CAST(q AS VARCHAR)",
    "CAST(price AS VARCHAR)",
    "CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR)",
    "CAST(tax AS VARCHAR)",
    "CAST(CAST(CASE WHEN table_id % 3 = 0 THEN price + 3 ELSE price + q END AS DECIMAL(18,2)) AS VARCHAR)",
    "CAST(CAST(CASE WHEN table_id % 3 = 1 THEN price * 2 ELSE price * 2 + q END AS DECIMAL(18,2)) AS VARCHAR)",
    "CAST(CAST(CASE WHEN table_id % 3 = 2 THEN price + tax ELSE price + tax + q END AS DECIMAL(18,2)) AS VARCHAR)",
    "CAST(CASE WHEN q < 5 THEN 0 ELSE q END AS VARCHAR)",
)


def line_cells_sql(columns: int = 8) -> str:
    parts = [
        f"SELECT doc_id, table_id, row_idx, {i} AS col_idx, '{HEADERS[i]}' AS header, "
        f"{_LINE_TEXTS[i]} AS text FROM line_base"
        for i in range(columns)
    ]
    return (
        "line_base AS (SELECT l_suppkey // 4 AS doc_id, l_suppkey AS table_id, "
        "(l_orderkey * 8 + l_linenumber) * 16777216 + l_partkey AS row_idx, "
        "CAST(l_quantity AS INTEGER) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, "
        "CAST(l_tax AS DECIMAL(18,2)) AS tax, l_discount FROM lineitem), "
        "cells AS (" + " UNION ALL ".join(parts) + ")"
    )


NUMERIC_SQL = (
    "numeric AS (SELECT *, CAST(text AS DOUBLE) AS num, CAST(text AS DECIMAL(28,10)) AS dec, "
    "row_number() OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) - 1 AS pos, "
    "count(*) OVER (PARTITION BY table_id, col_idx) AS n FROM cells)"
)


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five big tables, one per order priority: a fifth of all rows each."""
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    cust = F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "d")
    structs = [
        F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), t.alias("text"))
        for i, (h, t) in enumerate([("price", price), ("customer", cust), ("day", day)])
    ]
    table = F.substring("o_orderpriority", 1, 1).cast("long")
    return (
        read(spark, sf_dir, "orders")
        .select(
            F.lit(0).cast("long").alias("doc_id"),
            table.alias("table_id"),
            F.col("o_orderkey").alias("row_idx"),
            F.explode(F.array(*structs)).alias("c"),
        )
        .select("doc_id", "table_id", "row_idx", "c.*")
    )


ORDER_CELLS_SQL = (
    "order_base AS (SELECT 0 AS doc_id, CAST(o_orderpriority[1:1] AS BIGINT) AS table_id, "
    "o_orderkey AS row_idx, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS c0, "
    "CAST(o_custkey AS VARCHAR) AS c1, CAST(day(o_orderdate) AS VARCHAR) AS c2 FROM orders), "
    "cells AS (SELECT doc_id, table_id, row_idx, 0 AS col_idx, 'price' AS header, c0 AS text FROM order_base "
    "UNION ALL SELECT doc_id, table_id, row_idx, 1, 'customer', c1 FROM order_base "
    "UNION ALL SELECT doc_id, table_id, row_idx, 2, 'day', c2 FROM order_base)"
)


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per line of a document."""
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text")
    )


TEXT_BLOCKS_SQL = (
    "blocks AS (SELECT doc_id, unnest(range(len(parts))) AS block_no, unnest(parts) AS text "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"
)


def _sign_hash(start: int, span: int = 16) -> Column:
    """64-bit hash: signs of ``span`` vector elements, first one on top, repeated."""
    bits = [
        F.when(F.element_at("embedding", start + k) > 0, 1 << (span - 1 - k)).otherwise(0)
        for k in range(span)
    ]
    word = sum(bits[1:], bits[0]).cast("long")
    value = word
    for shift in range(span, 64, span):
        value = value.bitwiseOR(F.shiftleft(word, shift))
    return value


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose hashes are sign patterns of the vectors; doc = label."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("doc_id"),
        F.col("vec_id").alias("page"),
        F.lit(0).alias("idx"),
        F.col("vec_id").alias("image_id"),
        _sign_hash(1).alias("phash"),
        _sign_hash(17).alias("ahash"),
        _sign_hash(33).alias("dhash"),
        (40 + F.col("vec_id") * 37 % 400).cast("int").alias("width"),
        (40 + F.col("vec_id") * 53 % 300).cast("int").alias("height"),
        (1000 + F.col("vec_id") * 7919 % 40000).alias("bytes_size"),
        F.sha1(_sign_hash(1, 8).cast("string")).alias("sha1"),
        # in floats, as the vectors are: a double sum lies on the other side of some whole numbers
        F.transform(
            "embedding",
            lambda x: F.least(
                F.lit(255),
                F.greatest(F.lit(0), F.floor((x + F.lit(4).cast("float")) * F.lit(32).cast("float"))),
            ),
        ).alias("pixels"),
    )


def _sql_hash(start: int, span: int = 16) -> str:
    wide = (
        "list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[CAST(i % "
        f"{span} + {start} AS INT)] > 0 THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INT) ELSE CAST(0 AS HUGEINT) END))"
    )
    return (
        f"CAST(CASE WHEN {wide} >= 9223372036854775808 THEN {wide} - 18446744073709551616 ELSE {wide} END AS BIGINT)"
    )


IMAGES_SQL = (
    "images AS (SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS page, vec_id AS image_id, "
    f"{_sql_hash(1)} AS phash, {_sql_hash(17)} AS ahash, {_sql_hash(33)} AS dhash, "
    f"sha1(CAST({_sql_hash(1, 8)} AS VARCHAR)) AS sha1, "
    "40 + vec_id * 37 % 400 AS width, 40 + vec_id * 53 % 300 AS height, 1000 + vec_id * 7919 % 40000 AS bytes_size, "
    "list_transform(embedding, lambda x: least(255, greatest(0, CAST(floor((x + 4) * 32) AS INT)))) AS pixels FROM embeddings)"
)


# Positions (0-based, row by row) that each turn of an 8x8 picture takes its bits from.
TURNS = {
    "identity": [8 * r + c for r in range(8) for c in range(8)],
    "hflip": [8 * r + 7 - c for r in range(8) for c in range(8)],
    "vflip": [8 * (7 - r) + c for r in range(8) for c in range(8)],
    "rot90": [8 * c + 7 - r for r in range(8) for c in range(8)],
    "rot180": [8 * (7 - r) + 7 - c for r in range(8) for c in range(8)],
    "rot270": [8 * (7 - c) + r for r in range(8) for c in range(8)],
}


def image_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of every image under each turn (J7); bits are the 16 repeated signs."""
    hashes = []
    for name, order in TURNS.items():
        bits = F.array(*[(F.element_at("embedding", p % 16 + 1) > 0).cast("long") for p in order])
        value = F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
        hashes.append(F.struct(F.lit(name).alias("transform"), value.alias("hash")))
    return (
        read(spark, sf_dir, "embeddings")
        .select(
            F.col("label").cast("long").alias("doc_id"),
            F.col("vec_id").alias("image_id"),
            F.explode(F.array(*hashes)).alias("v"),
        )
        .select("doc_id", "image_id", "v.*")
    )


def _variants_sql() -> str:
    parts = []
    for name, order in TURNS.items():
        wide = " + ".join(
            f"CASE WHEN embedding[{p % 16 + 1}] > 0 THEN CAST({1 << (63 - i)} AS HUGEINT) ELSE 0 END"
            for i, p in enumerate(order)
        )
        parts.append(
            f"SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS image_id, '{name}' AS transform, {wide} AS w FROM embeddings"
        )
    return (
        "variants AS (SELECT doc_id, image_id, transform, CAST(CASE WHEN w >= 9223372036854775808 THEN "
        "w - 18446744073709551616 ELSE w END AS BIGINT) AS hash FROM (" + " UNION ALL ".join(parts) + "))"
    )


VARIANTS_SQL = _variants_sql()


def image_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cells per image: 16 vector elements each, hash of their first 8 signs."""
    cells = []
    for k in range(4):
        part = F.slice("embedding", 16 * k + 1, 16)
        mean = F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / 16
        squares = F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        spread = F.sqrt(F.greatest(squares / 16 - mean * mean, F.lit(0.0)))
        cells.append(
            F.struct(
                F.lit(k).alias("part"), _sign_hash(16 * k + 1).alias("hash"), (spread * 160).alias("std")
            )
        )
    return (
        read(spark, sf_dir, "embeddings")
        .select(
            F.col("label").cast("long").alias("doc_id"),
            F.col("vec_id").alias("image_id"),
            F.explode(F.array(*cells)).alias("c"),
        )
        .select("doc_id", "image_id", "c.*")
    )


PARTS_SQL = "parts AS (" + " UNION ALL ".join(
    f"SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS image_id, {k} AS part, {_sql_hash(16 * k + 1)} AS hash, "
    f"list_stddev_pop(list_transform(embedding[{16 * k + 1}:{16 * k + 16}], lambda x: CAST(x AS DOUBLE))) * 160 AS std FROM embeddings"
    for k in range(4)
) + ")"


DETECTORS = (
    "table_relationships",
    "image_forensics",
    "image_dup",
    "table_round_bias",
    "pdf_metadata",
    "text_patterns",
    "cross_paper_image",
    "image_noise_inconsistency",
)
TABLE_CHECKS = (
    "fixed_offset",
    "matching_decimal_tails",
    "high_duplicate_rate",
    "cross_table_fixed_offset",
    "arithmetic_progression",
    "excel_fabrication_span",
)
IMAGE_CHECKS = ("ela", "copy_move", "texture_overlap", "panel_sift_match", "full_image_duplicate")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per event; document = user."""
    e, whole = F.col("event_id"), F.floor("value")
    slot, octet = e % 8, F.floor(e / 8)
    s = lambda c: c.cast("string")
    detector = _pick(DETECTORS, slot)
    check = F.when(slot == 0, _pick(TABLE_CHECKS, octet % 6)).when(
        slot == 1, _pick(IMAGE_CHECKS, octet % 5)
    ).otherwise("")
    cents = F.floor(F.round(F.col("value") * 100)).cast("long")
    table, image = slot == 0, slot.isin(1, 2)
    panel = (slot == 1) & (octet % 5 == 3)
    keys = {
        "n": F.when(table, s(whole % 60)),
        "offset": F.when(table, s(((cents % 700) / 100).cast("decimal(8,2)"))),
        "match_fraction": F.when(table, s(((e % 10 + 1) / 10).cast("decimal(3,1)"))),
        "left_table": F.when(check == "cross_table_fixed_offset", F.concat(F.lit("Table "), s(e % 5))),
        "right_table": F.when(check == "cross_table_fixed_offset", F.concat(F.lit("Table "), s(e % 7))),
        "left_column": F.when(table, F.when(e % 9 == 0, "col_1").otherwise("dose")),
        "right_column": F.when(table, F.lit("dose b")),
        "high_member_count": F.when(table, s(whole % 9)),
        "ratio": F.when(slot == 3, s(((e % 10) / 10).cast("decimal(3,1)"))),
        "matched_paper_id": F.when(slot == 6, F.when(e % 3 == 0, "main").otherwise("10.1000/x")),
        "substantial_image": F.when(slot == 6, F.when(e % 5 == 0, "false").otherwise("true")),
        "secondary": F.when((slot == 1) & (e % 3 == 0), F.lit("true")),
        "page_a": F.when(image, s(octet % 6)),
        "index_a": F.when(image, s(octet % 2)),
        "page_b": F.when(image, s(cents % 6)),
        "index_b": F.when(image, s(cents % 2)),
        "panel_a": F.when(panel, s(octet % 4)),
        "panel_b": F.when(panel, s(octet % 4 + 1)),
        "page": F.when(panel, s(octet % 6)),
        "pubpeer_pattern": F.when(table & (octet % 6 < 3), F.concat(F.lit("pattern_"), s(octet % 2))),
    }
    pairs = [x for k, v in keys.items() for x in (F.lit(k), v)]
    return read(spark, sf_dir, "events").select(
        s(e).alias("finding_id"),
        s(F.col("user_id")).alias("doc_id"),
        detector.alias("detector"),
        check.alias("check"),
        _pick(("info", "low", "medium", "high"), (F.floor(e / 4) + whole) % 4).alias("severity"),
        F.concat(F.lit("Signal "), s(e % 100), F.lit(" in "), detector).alias("title"),
        F.concat(F.lit("Table "), s(e % 5), F.lit(", columns 1 and 2")).alias("location"),
        F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("raw"),
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FINDINGS_SQL = f"""fb AS (SELECT *, event_id AS e, event_id % 8 AS slot, event_id // 8 AS octet, CAST(floor(value) AS BIGINT) AS whole,
 CAST(floor(round(value * 100)) AS BIGINT) AS cents FROM events),
fc AS (SELECT *, {_list(DETECTORS)}[slot + 1] AS detector, CASE WHEN slot = 0 THEN {_list(TABLE_CHECKS)}[octet % 6 + 1]
 WHEN slot = 1 THEN {_list(IMAGE_CHECKS)}[octet % 5 + 1] ELSE '' END AS "check" FROM fb),
f AS (SELECT CAST(e AS VARCHAR) AS finding_id, CAST(user_id AS VARCHAR) AS doc_id, detector, "check", slot, octet, e,
 ['info','low','medium','high'][(e // 4 + whole) % 4 + 1] AS severity, (e // 4 + whole) % 4 AS rank,
 'Signal ' || (e % 100) || ' in ' || detector AS title, 'Table ' || (e % 5) || ', columns 1 and 2' AS location,
 CASE WHEN slot = 0 THEN whole % 60 ELSE 0 END AS n, CASE WHEN slot = 0 THEN (cents % 700) / 100.0 END AS "offset",
 CASE WHEN slot = 0 THEN (e % 10 + 1) / 10.0 END AS match_fraction,
 CASE WHEN "check" = 'cross_table_fixed_offset' THEN 'table ' || (e % 5) END AS left_table,
 CASE WHEN "check" = 'cross_table_fixed_offset' THEN 'table ' || (e % 7) END AS right_table,
 slot = 0 AND e % 9 = 0 AS blanks, CASE WHEN slot = 0 THEN whole % 9 ELSE 0 END AS high_members, (e % 10) / 10.0 AS ratio,
 slot = 6 AND e % 3 = 0 AS generic, slot = 6 AND e % 5 = 0 AS small, slot = 1 AND e % 3 = 0 AS secondary,
 CASE WHEN slot IN (1, 2) THEN octet % 6 END AS page_a, CASE WHEN slot IN (1, 2) THEN octet % 2 END AS index_a,
 CASE WHEN slot IN (1, 2) THEN cents % 6 END AS page_b, CASE WHEN slot IN (1, 2) THEN cents % 2 END AS index_b,
 CASE WHEN slot = 1 AND octet % 5 = 3 THEN octet % 4 END AS panel_a,
 CASE WHEN slot = 0 AND octet % 6 < 3 THEN 'pattern_' || (octet % 2) END AS pattern FROM fc)"""


# Lines a paper may hold; a document gets the lines doc_id % 12 and doc_id % 7 + 12.
PAPER_LINES = (
    "TODO: cite the source. We saw [?] here and {{ name }} there",
    "As an AI language model, I cannot provide data.",
    "The effect was t(28) = 2.20, p = .04 and F(2, 45) = 3.10, p = .001.",
    "[1] Smith J. A long title of the work. Journal. 2019;1:1-10. 10.1371/journal.a1",
    "Contact: ann.b@gmail.com, bob@uni.edu, ann.b@gmail.com",
    "Data availability statement: data are available upon reasonable request at https://example.org/data.",
    "Scores (n = 20) were mean = 3.45, SD = 1.20, p = 0.045 and 47.3% agreed. Certainly, yes!!",
    "Earlier work [Smith 2019] and (Jones, 2020) agrees [3, 4] and [7]. See arXiv:2001.01234",
    "Funding: grant number 5. The authors declare no conflict of interest. Ethics approval was given.",
    "Materials and Methods",
    "Deeply learning models and machine-learned rules meet covid-2019 in 深学习",
    "Ann Lee 1, Bo Chen 2, Cy Diaz 1. Department of Physics, University of Somewhere. Institute of Chemistry, Anytown",
    "[2] Jones K. Another long title of the work. Journal. 2020;2:2-9. 10.1371/journal.a1 PMID: 123456",
    "[3] Brown, A. (2018). Third title of the work, journal of things, 3, 1-9. 10.1371/journal.a1",
    "1. White B. \"A quoted title of good length\" Journal 4 (2017): 1-10. PMID: 123456",
    "Results and Discussion",
    "A correlation of r(30) = .45, p = .01 and z = 1.96, p = .05 held; chi2(2) = 5.99, p = .05.",
    "RETRACTED: the paper. Reviewed by: Ann Lee, Bo Chen",
    "Raw data are no longer available. api_key = abcdef1234567890 in /home/annlee and Bearer abcdefgh1234",
)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts with two lines of a paper appended."""
    lines = F.array(*[F.lit(x) for x in PAPER_LINES])
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws(
            "\n",
            "text",
            F.element_at(lines, (F.col("doc_id") % 12 + 1).cast("int")),
            F.element_at(lines, (F.col("doc_id") % 7 + 13).cast("int")),
        ).alias("text"),
    )


def paper_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text")
    )


_LINES_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in PAPER_LINES) + "]"
PAPERS_SQL = (
    f"papers AS (SELECT doc_id, text || chr(10) || {_LINES_SQL}[CAST(doc_id % 12 + 1 AS INT)] || chr(10) || "
    f"{_LINES_SQL}[CAST(doc_id % 7 + 13 AS INT)] AS text FROM documents), "
    "blocks AS (SELECT doc_id, unnest(range(len(parts))) AS block_no, unnest(parts) AS text "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM papers))"
)


def phrase_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four words of every benchmark item, with its id as the intended term."""
    words = F.slice(F.split(F.regexp_replace(F.lower("text"), r"[^a-z ]", ""), " +"), 1, 4)
    return (
        read(spark, sf_dir, "benchmark")
        .select(F.array_join(words, " ").alias("phrase"), F.col("item_id").cast("string").alias("intended"))
        .filter(F.col("phrase").rlike("^[a-z]+ [a-z]+ [a-z]+ [a-z]+$"))
    )


PHRASES_SQL = (
    "phrases AS (SELECT array_to_string(string_split_regex(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +')[1:4], ' ') AS phrase, "
    "CAST(item_id AS VARCHAR) AS intended FROM benchmark), "
    "dict AS (SELECT * FROM phrases WHERE regexp_matches(phrase, '^[a-z]+ [a-z]+ [a-z]+ [a-z]+$'))"
)
