import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from verilens.operators.plugins import Operator, Registry, run_image_backend
from verilens.model import FINDINGS
from verilens.sources import readers, sinks
from verilens.streaming import limits, pipelines


def test_delimited_and_json_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n;\n3;4;5\n")
    (tmp_path / "b.tsv").write_text("p\tq\n7\t8,5\n")
    (tmp_path / "c.json").write_text(json.dumps({"headers": ["h"], "rows": [["9"], ["10", "11"]]}))
    cells = readers.read_data_files(spark, [str(tmp_path / n) for n in ("a.csv", "b.tsv", "c.json")])
    got = {(r.path.rsplit("/", 1)[1], r.header, r.text) for r in cells.collect()}
    assert {("a.csv", "x", "1"), ("a.csv", "y", "4"), ("a.csv", "col_3", "5"), ("b.tsv", "q", "8,5"), ("c.json", "h", "10"), ("c.json", "col_2", "11")} <= got


def test_jsonl_skips_bad_lines_and_reads_gzip(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"tool": "a", "ok": true}\nnot json\n')
    with gzip.open(tmp_path / "old.jsonl.gz", "wt") as f:
        f.write('{"tool": "b", "ok": false}\n')
    rows = readers.read_jsonl(spark, str(tmp_path), "tool string, ok boolean").collect()
    assert {r.tool for r in rows} == {"a", "b"}


def test_discovery_depth_and_hidden(spark, tmp_path):
    for p in ("a.csv", "d1/d2/d3/b.csv", "d1/d2/d3/d4/c.csv", ".hid/e.csv", "note.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    found = {r.path.rsplit("/", 1)[1] for r in readers.discover_files(spark, str(tmp_path)).collect()}
    assert found == {"a.csv", "b.csv"}


def one_finding(tables):
    return tables["docs"].select(
        F.concat(F.lit("f"), "doc_id").alias("finding_id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.lit("demo").alias("detector"), F.lit("c").alias("check"), F.lit("low").alias("severity"),
        F.lit("t").alias("title"), F.lit("l").alias("location"),
        F.create_map(F.lit("k"), F.lit("v")).alias("raw"),
    )


def test_resume_skips_finished_documents(spark, tmp_path):
    paths = str(tmp_path / "findings"), str(tmp_path / "runs")
    sinks.run_pending(spark, "demo", {"docs": spark.createDataFrame([(1,), (2,)], "doc_id long")}, one_finding, *paths)
    sinks.run_pending(spark, "demo", {"docs": spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")}, one_finding, *paths)
    assert spark.read.parquet(paths[0]).count() == 3
    assert spark.read.parquet(paths[1]).count() == 3
    sinks.export(spark.read.schema(FINDINGS).parquet(paths[0]), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_plugins(spark):
    registry = Registry()
    registry.add(Operator("demo", ("docs",), one_finding))
    registry.add(Operator("other", ("images",), one_finding))
    assert registry.run({"docs": spark.createDataFrame([(1,)], "doc_id long")}).count() == 1

    def analyze(image):
        if image["image_id"] == 2:
            raise ValueError("bad")
        return [{"kind": "x", "score": 0.5}]

    images = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, image_id long")
    rows = {r.image_id: r.error for r in run_image_backend(images, "b", analyze).collect()}
    assert rows == {1: None, 2: "bad"}


START = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    folder = tmp_path / "in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(90)
    return df.sparkSession.table(name).collect()


def test_sliding_window_counts_allowed_hits_only(spark, tmp_path):
    rows = [("k", START + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 1, 2, 61, 62))]
    events = stream(spark, tmp_path, rows, "key string, ts timestamp, request_id long")
    out = {r.request_id: r.allowed for r in drain(limits.sliding_window(events, 2), "r1")}
    assert out == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_token_bucket(spark, tmp_path):
    rows = [("k", START + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 0, 0, 30, 31))]
    events = stream(spark, tmp_path, rows, "key string, ts timestamp, request_id long")
    out = [r.allowed for r in sorted(drain(limits.token_bucket(events, 2), "r2"), key=lambda r: r.request_id)]
    assert out == [True, True, False, True, False]


def test_idempotent_ingest(spark, tmp_path):
    rows = [("k", START + dt.timedelta(seconds=s), i, b) for i, (s, b) in enumerate(((0, "x"), (1, "x"), (2, "y"), (100, "y")))]
    events = stream(spark, tmp_path, rows, "key string, ts timestamp, request_id long, body_hash string")
    out = [r.outcome for r in sorted(drain(limits.idempotent_ingest(events, 60), "r3"), key=lambda r: r.request_id)]
    assert out == ["new", "duplicate", "conflict", "new"]


def test_live_counters_and_log(spark, tmp_path):
    rows = [("t", i, START, k, "{}") for i, k in enumerate(("started", "started", "done", "error"))]
    events = stream(spark, tmp_path, rows, "trace_id string, seq long, ts timestamp, type string, payload string")
    row = drain(pipelines.live_counters(events), "r5", "complete")[0]
    assert (row.started, row.done, row.error, row.progress) == (2, 1, 1, 1.0)
    pipelines.append_log(events, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(90)
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_screening_matches_before_append(spark, tmp_path):
    schema = "doc_id long, page long, image_id long, phash long, width int, height int, bytes_size long"
    folder = tmp_path / "img"
    first = spark.createDataFrame([(1, 0, 1, 255, 200, 200, 20000)], schema)
    second = spark.createDataFrame([(2, 0, 2, 254, 200, 200, 20000), (1, 1, 3, 255, 200, 200, 20000)], schema)
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(str(folder))
        images = spark.readStream.schema(schema).parquet(str(folder))
        pipelines.screen_images(images, str(tmp_path / "index"), str(tmp_path / "hits"), str(tmp_path / "cp")).awaitTermination(120)
    hits = spark.read.parquet(str(tmp_path / "hits")).collect()
    # the papers of the second batch meet the index and each other
    assert {(h.doc_id, h.matched_paper, h.distance) for h in hits} == {(2, 1, 1), (1, 2, 1)}
    edges = spark.read.parquet(str(tmp_path / "hits_edges")).filter("batch_id = 1").collect()
    assert {(e.hash_a, e.paper_id, e.distance) for e in edges} == {(254, 1, 1), (254, 2, 0), (255, 1, 0), (255, 2, 1)}
    assert spark.read.parquet(str(tmp_path / "index" / "papers")).count() == 3


def test_state_expires_and_late_rows_are_left(spark, tmp_path):
    folder = tmp_path / "late"
    schema = "key string, ts timestamp, request_id long, body_hash string"
    parts = [[("k", 0, 1, "x")], [("other", 7200, 2, "x")], [("k", 7300, 3, "x")], [("k", 5, 4, "x")]]
    for key in parts:
        rows = [(k, START + dt.timedelta(seconds=s), i, b) for k, s, i, b in key]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        events = spark.readStream.schema(schema).parquet(str(folder))
        query = (
            limits.idempotent_ingest(events, 60).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination(90)
        states = [p["numRowsTotal"] for p in query.lastProgress["stateOperators"]]
    out = {r.request_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: "new", 2: "new", 3: "new"} and states[0] <= 2


def test_failed_steps_are_recorded(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    runs, found = str(tmp_path / "runs"), str(tmp_path / "found")

    def broken(inputs):
        raise ValueError("no such column")

    sinks.run_pending(spark, "d", {"docs": docs}, broken, found, runs)
    rows = spark.read.schema(sinks.RUNS).parquet(runs).collect()
    assert [(r.ok, r.n_findings) for r in rows] == [(False, 0)] * 2 and "no such column" in rows[0].error
    work = docs.selectExpr("doc_id", "'d' AS detector")
    assert sinks.pending(work, spark.read.schema(sinks.RUNS).parquet(runs)).count() == 2


def test_wide_and_quoted_rows(spark, tmp_path):
    wide = [f"v{i}" for i in range(700)]
    (tmp_path / "w.csv").write_text(",".join(f"h{i}" for i in range(700)) + "\n" + ",".join(wide) + '\n\n"a, b",,"say ""x"""\n')
    cells = readers.read_delimited(spark, [str(tmp_path / "w.csv")]).orderBy("row_idx", "col_idx").collect()
    assert [(c.header, c.text) for c in cells[:700]] == [(f"h{i}", v) for i, v in enumerate(wide)]
    assert [(c.header, c.text) for c in cells[700:]] == [("h0", "a, b"), ("h2", 'say "x"')]
