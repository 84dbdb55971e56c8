"""Delimited records against the csv module, with files cut into many small blocks."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from verilens.registry import sources
from verilens.sources import readers, records


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "48b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def expected(path, delimiter):
    with open(path, encoding="utf-8-sig") as f:  # line breaks read as \n
        return [row for row in csv.reader(f, delimiter=delimiter)]


def parsed(found, name):
    rows = sorted((r.row_idx, r.record, r.delimiter) for r in found if r.path.endswith("/" + name))
    return [next(csv.reader(io.StringIO(text), delimiter=d), []) for _, text, d in rows]


def noise(seed, delimiter):
    """Fields with quotes, breaks and delimiters anywhere, many of them badly quoted."""
    rng = random.Random(seed)
    parts = ["a", "bc", '"', '""', delimiter, "\n", ",", " ", "é", "long word " * 3, f'{delimiter}"', f'"{delimiter}', '"\n']
    return "".join(rng.choice(parts) for _ in range(rng.randrange(400)))


@pytest.mark.parametrize("delimiter", [",", ";"])
def test_records_equal_the_csv_module(spark, tmp_path, small_blocks, delimiter):
    names = [f"n{delimiter == ','}{seed}.csv" for seed in range(12)]
    for seed, name in enumerate(names):
        (tmp_path / name).write_text(noise(seed, delimiter), encoding="utf-8")
    found = records.read_records(spark, str(tmp_path), delimiter).collect()
    for name in names:
        assert parsed(found, name) == expected(tmp_path / name, delimiter), name


def test_delimiters_per_file_in_one_scan(spark, tmp_path, small_blocks):
    rows = [["h1", "h2", "h3"], *[[f"x{i}", "a\nb;c|d,e" * (i % 3), 'say "q"\n' * 9] for i in range(9)]]
    names = {"c.csv": ",", "s.csv": ";", "t.csv": "\t", "p.csv": "|"}
    for name, d in names.items():
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f, delimiter=d).writerows(rows)
    known = records._text(spark, str(tmp_path)).select("path").distinct()
    tail = F.substring_index("path", "/", -1)
    known = known.withColumn("delimiter", F.when(tail == "c.csv", ",").when(tail == "s.csv", ";").when(tail == "t.csv", "\t").otherwise("|"))
    found = records.read_records(spark, str(tmp_path), known).collect()
    for name, d in names.items():
        assert parsed(found, name) == rows == expected(tmp_path / name, d)


def test_break_across_a_block_border_is_one_row(spark, tmp_path, small_blocks):
    cell = "first line\n" + "second line, quoted \n" * 20 + "end"
    (tmp_path / "b.csv").write_text(f'id,note\n1,"{cell}"\n2,plain\n', encoding="utf-8-sig")
    path = str(tmp_path / "b.csv")
    assert records.scan_blocks(spark, path).count() > 5
    got = [(c.header, c.text) for c in readers.read_delimited(spark, [path]).orderBy("row_idx", "col_idx").collect()]
    assert got == [("id", "1"), ("note", cell), ("id", "2"), ("note", "plain")]


def test_open_quote_runs_to_the_end(spark, tmp_path, small_blocks):
    (tmp_path / "o.csv").write_text('a,b\n1,"open\n' + "x,y\n" * 40)
    got = parsed(records.read_records(spark, str(tmp_path), ",").collect(), "o.csv")
    rows = expected(tmp_path / "o.csv", ",")
    assert got == [rows[0], ["1", rows[1][1].removesuffix("\n")]]


def test_single_column_is_tried_again(spark, tmp_path):
    (tmp_path / "d.csv").write_text("x;y;z\n1,5;2,5;3,5\n4,5;5,5;6,5\n")
    (tmp_path / "one.csv").write_text("only\n1\n2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "break.csv").write_text("\r\na,b\r\n , \r\n")
    found = readers.infer_delimiters(spark, str(tmp_path)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.delimiter) for r in found} == {("d.csv", ";"), ("one.csv", ","), ("break.csv", ",")}
    cells = readers.read_delimited(spark, str(tmp_path)).collect()
    assert {(c.header, c.text) for c in cells} == {
        ("x", "1,5"), ("y", "2,5"), ("z", "3,5"), ("x", "4,5"), ("y", "5,5"), ("z", "6,5"), ("only", "1"), ("only", "2"),
        ("col_1", "a"), ("col_2", "b"),
    }


def test_unknown_delimiter_is_an_error(spark, tmp_path):
    (tmp_path / "u.csv").write_text("a:b\n")
    known = records._text(spark, str(tmp_path)).select("path", F.lit(":").alias("delimiter"))
    with pytest.raises(Exception, match="not a known delimiter"):
        records.read_records(spark, str(tmp_path), known)


def test_documents_survive_the_round_trip(spark, tmp_path):
    rows = [(1, "en", "web", 'He said "x",\nthen left; '), (2, None, "a,b", ""), (3, "de", "s", None), (4, "fr", "\t", 'a\n\n\n"b"')]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sources.s1(spark, str(tmp_path)).collect()}
    assert {k: r.n_chars for k, r in got.items()} == {1: 23, 2: 0, 3: 0, 4: 7}
