"""Operators have no budgets, heads or caps: data beyond the former limits counts."""

import pytest
from pyspark.sql import functions as F

from verilens.operators import audit, columns, consistency, findings, lookups, relations, text
from verilens.operators import images as pictures

CELLS = "doc_id long, table_id long, row_idx long, col_idx int, header string, text string"


def test_all_cited_dois_are_looked_up(spark):
    dois = spark.range(120).select(F.lit(1).alias("doc_id"), "id", F.concat(F.lit("10.1/x"), "id").alias("doi"))
    dois = dois.withColumnRenamed("id", "position")
    retracted = spark.createDataFrame([("10.1/X119", True, "t"), ("10.1/x3", True, "u")], "doi string, is_retracted boolean, title string")
    assert {r.doi for r in lookups.cited_retractions(dois, retracted).collect()} == {"10.1/x119", "10.1/x3"}


def test_all_percent_buckets_are_compared(spark):
    prose = spark.createDataFrame([(1, float(p)) for p in range(10, 90, 5)], "doc_id long, pct double")
    table = spark.createDataFrame([(1, 85.0)], "doc_id long, pct double")
    row = lookups.percent_overlap(prose, table).first()
    assert (row.buckets, row.matched, row.fires) == (16, 1, False)
    assert lookups.percent_overlap(prose, table, top=5).first().fires


def test_chunk_keeps_the_callers_limit(spark):
    cells = spark.range(2600).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("table_id"), F.col("id").alias("row_idx"), F.lit(0).alias("col_idx"),
        F.lit("h").alias("header"), F.col("id").cast("string").alias("text"),
    )
    assert audit.table_chunk(cells, 0, 2500).count() == 2500


def test_all_side_pairs_are_listed(spark):
    items = spark.range(20).select(
        F.lit("d").alias("doc_id"), F.concat(F.lit("a"), "id").alias("side_a"), F.lit("z").alias("side_b"), F.lit("t").alias("title")
    )
    assert findings.pair_locations(items).count() == 20


def test_every_mean_and_decimal_column_is_tested(spark):
    headers = ("n", "mean a", "mean b", "score", "sd")
    rows = [(1, 1, 1, c, h, t) for c, (h, t) in enumerate(zip(headers, ("20", "3.45", "3.46", "2.33", "0.5"), strict=True))]
    found = {(r.role, r.value, r.severity) for r in consistency.grim_rows(spark.createDataFrame(rows, CELLS)).collect()}
    assert found == {("mean", 3.46, "low"), ("value", 2.33, "low")}


@pytest.mark.parametrize(
    ("body", "categories"),
    [
        ("The raw data are no longer available. Authors were unresponsive.", {"raw_data_unavailable", "authors_unresponsive"}),
        ("Intro.\nData availability: Not applicable.\nFUNDING\nnone", {"not_applicable"}),
        ("Intro.\nData sharing\n" + "word " * 3000 + "The raw data are no longer available.", {"raw_data_unavailable"}),
        ("Intro.\nOpen research\nAll is in the supplement.\n2. Methods\nThe raw data are not available.", set()),
    ],
)
def test_availability_flags(spark, body, categories):
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    assert {r.category for r in text.availability_flags(docs).collect()} == categories


def test_copy_loops_count_all_places(spark):
    unit = " ".join(f"u{k}" for k in range(6))
    filler = lambda j: " ".join(f"f{j}x{k}" for k in range(20))
    body = " ".join(f"{unit} {filler(j)}" for j in range(5))
    row = text.copy_loops(spark.createDataFrame([(1, 0, body)], "doc_id long, block_no int, text string")).first()
    assert row.repetitions == 5


def test_secondary_matches_leave_primary_ones(spark):
    rows = [(1, 1, 7, 100, 5), (1, 2, 7, 5, 1 << 40), (1, 3, 7, 5, 1 << 41), (1, 4, 0x7FFF0000FFFF, 5, 1 << 42), (1, 5, 0x7FFF0000FFFF, 5, 1 << 42)]
    images = spark.createDataFrame(rows, "doc_id long, image_id long, phash long, ahash long, dhash long")
    found = {(r.image_a, r.image_b, r.copies_b) for r in pictures.secondary_matches(images).collect()}
    # 2 and 3 share a perceptual hash with 1; 5 is a copy of 4
    assert found == {(1, 4, 2), (2, 4, 2), (3, 4, 2)}


def test_byline_ends_at_its_marker(spark):
    """Addresses far behind 5,000 characters count; those behind the abstract don't."""
    long_list = ", ".join(f"Given Family {i}" for i in range(1, 600))
    paper = long_list + "\nlast@gmail.com last@gmail.com\nAbstract\nother@qq.com"
    docs = spark.createDataFrame([(1, paper), (2, "no marker " * 900 + "a@b.org")], "doc_id long, text string")
    got = {r.doc_id: r for r in text.byline_emails(docs).collect()}
    assert (got[1].emails, got[1].duplicates, got[1].free_mail) == (2, 1, 2)
    assert got[2].emails == 1


def name_of(i):
    return f"Given{chr(97 + i % 26)}{chr(97 + i // 26)} Family{chr(97 + i % 26)}"


def test_authors_of_long_and_plain_lists(spark):
    indexed = ", ".join(f"{name_of(i)} {i + 1}" for i in range(99))
    filler = "x" * 5000
    stacked = f"{name_of(0)} 1,2,13, {name_of(1)} 2,3,4, {name_of(2)} 5"
    plain = "; ".join(name_of(i) for i in range(7))
    repeated = f"{name_of(0)} and {name_of(1)} then {'y' * 230} {name_of(0)}"
    rows = [
        (1, indexed + filler + "\nUniversity of Somewhere, City"),
        (2, stacked + "\nInstitute of Things, Town"),
        (3, plain),
        (4, repeated),
        (5, plain + "\n1. Introduction\n" + ", ".join(f"{name_of(i)} 3" for i in range(9))),
    ]
    got = {r.doc_id: r for r in text.authorship(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].authors, got[1].affiliations, got[1].severity) == (99, 1, "high")
    assert (got[2].authors, got[2].stacked_authors, got[2].stacking_severity) == (3, 2, "medium")
    assert (got[3].authors, got[3].stacked_authors, got[3].stacking_severity) == (7, 0, None)
    # the gap runs from the end of one name to the start of the next, also for a name seen before
    assert got[4].authors == 2
    assert got[5].authors == 7


def test_every_holder_of_a_run_is_linked(spark):
    values = [3.25, 8.5, 1.75, 9.25, 4.5, 6.75, 2.25]
    rows = [(1, t, r, 0, "h", str(v)) for t in range(4) for r, v in enumerate(values)]
    cells = spark.createDataFrame(rows, "doc_id long, table_id long, row_idx long, col_idx int, header string, text string")
    found = relations.sequence_reuse(columns.decimal_cells(cells)).collect()
    assert {(r.table_a, r.table_b, r.windows, r.max_loci) for r in found} == {(0, t, 3, 4) for t in (1, 2, 3)}


def test_all_matching_papers_are_listed(spark):
    images = spark.createDataFrame([(0, 1, 5, 300, 200, 20_000)], "doc_id long, image_id long, phash long, width int, height int, bytes_size long")
    index = spark.createDataFrame([(p, 5 ^ (1 << (p % 3 + 8))) for p in range(1, 13)], "paper_id long, phash long")
    edges = pictures.cross_paper_edges(images, index).collect()
    assert {(r.paper_id, r.distance) for r in edges} == {(p, 1) for p in range(1, 13)}
    nearest = pictures.cross_paper_matches(images, index).first()
    assert (nearest.papers, nearest.hits) == (12, 8)
