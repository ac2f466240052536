"""Reading and writing files."""

from __future__ import annotations

import random
import json

import pytest
from pyspark.sql import functions as F

from logtriage.config import KeywordFilterConfig, VectorFilterConfig
from logtriage.operators.catalog import context_items
from logtriage.plans.keyword_filter import keyword_filter
from logtriage.plans.vector_filter import vector_filter
from logtriage.session import join_small, shared_folder
from logtriage.sources.catalog import scan_catalog
from logtriage.sources.documents import load_documents
from logtriage.sources.index_store import ensure_index, read_index
from logtriage.operators.log_view import date_literals, number_lines
from logtriage.sources.logs import load_log, numbered_lines, scan_logs, store_dated, store_lines, store_log
from logtriage.sources.results import latest_result, load_results, save_results, write_text


def test_log_scan_keeps_order_over_splits(spark, tmp_path):
    ends = ["\n", "\r", "\r\n"]
    lines = [f"2025-10-{10 + n // 400:02d}T10:00:00 line {n}" if n % 3 else f"  more {n}" for n in range(4000)]
    (tmp_path / "app.log").write_bytes("".join(x + ends[n % 3] for n, x in enumerate(lines)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        stored = store_lines(scan_logs(spark, str(tmp_path / "app.log")), str(tmp_path / "stored"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert stored.select("block").distinct().count() > 5
    got = numbered_lines(stored).orderBy("line_no").select("line_no", "line").collect()
    assert [tuple(r) for r in got] == list(enumerate(lines))
    dated = store_dated(stored, str(tmp_path / "dated"))
    assert dated.where("eff_date IS NULL").count() == 1
    # Lines 800 to 1199, and line 1200, which has no timestamp of its own.
    assert dated.where("eff_date = '2025-10-12'").count() == 401


def files_read(df):
    """Run df and add up the files that its scans of stored lines opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    total, rest = 0, [plan]
    while rest:
        node = rest.pop()
        if node.nodeName().startswith("Scan parquet") and "/lines" in node.metadata().apply("Location"):
            total += node.metrics().apply("numFiles").value()
        rest += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().endswith("QueryStage"):
            rest.append(node.plan())
    return total


def test_dates_open_only_the_blocks_they_touch(spark, log, tmp_path):
    lines = [f"2025-{1 + n // 1000:02d}-{1 + n // 100 % 10:02d}T10:00:00 line {n}" if n % 7 else "  more" for n in range(4000)]
    stored = store_log(log(lines, 50).unionByName(log(lines, 50, "other")), str(tmp_path / "log"))
    assert stored.blocks.count() == 160
    low, high = date_literals("2025-02-03T00:00:00", "2025-02-03T23:59:59")
    kept = stored.of("log").between(low, high)
    opened = files_read(kept)
    assert opened == 3  # lines 1200 to 1299 lie in two blocks; the log's first line has no time
    got = number_lines(kept, start=low, end=high)
    want = number_lines(log(lines, 50), start=low, end=high)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 101


@pytest.mark.parametrize("seed", range(3))
def test_stored_log_keeps_the_same_lines(spark, log, tmp_path, seed):
    """Times that jump, blocks without any, a head without time: as without a summary."""
    rng = random.Random(seed)
    stamps = ["", "", "", "2025-01-05T10:00:00 ", "2025-01-06T10:00:00 ", "2025-01-07 23:59:59 ", "2025-13-07T10:00:00 "]
    lines = [rng.choice(stamps if n > 5 else stamps[:1]) + f"x {n}" for n in range(90)]
    stored = store_log(log(lines, 4), str(tmp_path / "log"))
    stored = load_log(spark, str(tmp_path / "log"))
    for start, end in (("2025-01-06T00:00:00", "2025-01-06T23:59:59"), (None, "2025-01-05T23:59:59"), ("2025-01-07T00:00:00", None), ("2025-02-01T00:00:00", None)):
        low, high = date_literals(start, end)
        got = number_lines(stored.of("log").between(low, high), start=low, end=high)
        want = number_lines(log(lines, 4), start=low, end=high)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_filters_take_a_stored_log(spark, log, tmp_path):
    lines = [f"2025-01-{1 + n // 40:02d}T10:00:{n % 60:02d} {'memory' if n % 9 == 0 else 'plain'} {n}" for n in range(400)]
    both = log(lines, 16).unionByName(log(["2025-01-04T10:00:00 memory"], 16, "other"))
    stored = store_log(both, str(tmp_path / "log"))
    cfg = KeywordFilterConfig(log_file_path="log", keywords=("memory",), start_date="2025-01-04", end_date="2025-01-05")
    texts = [keyword_filter(source, cfg).reports.collect() for source in (both, stored)]
    assert texts[0] == texts[1] and len(texts[0]) == 1
    nothing = KeywordFilterConfig(log_file_path="log", keywords=("memory",), start_date="2026-01-04")
    texts = [keyword_filter(source, nothing).reports.collect() for source in (both, stored)]
    assert texts[0] == texts[1] and len(texts[0]) == 1
    question = VectorFilterConfig(log_file_path="log", issue_description="memory", start_date="2025-01-04", end_date="2025-01-05")
    hits = [vector_filter(source, question, str(tmp_path / f"index-{n}")).select("chunk_id", "text").collect() for n, source in enumerate((both, stored))]
    assert sorted(hits[0]) == sorted(hits[1]) and hits[0]


def test_shared_folder(spark):
    class Unset:
        sparkContext = spark.sparkContext

        class conf:
            @staticmethod
            def get(name, default):
                return default

    assert shared_folder(Unset()) == shared_folder(Unset())
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert not named or shared_folder(spark) == named.rstrip("/")


def test_salted_join_gives_the_same_rows(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    small = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "k bigint, v string")
    size = F.octet_length("v") + 8
    rows = [
        sorted(tuple(r) for r in join_small(big, small, ["k"], size, F.col("n"), limit).select("k", "n", "v").collect())
        for limit in (1 << 20, 0)
    ]
    assert rows[0] == rows[1] and len(rows[0]) == 500


def test_invalid_bytes_and_missing_files(spark, tmp_path):
    (tmp_path / "bad.log").write_bytes(b"ok \xff\xfe line\nsecond \xef\xbf\xbd\n")
    got = [r.line for r in scan_logs(spark, str(tmp_path / "bad.log")).orderBy("pos").collect()]
    assert got == ["ok  line", "second �"]
    with pytest.raises(ValueError):
        scan_logs(spark, str(tmp_path / "none.log"))
    with pytest.raises(ValueError):
        load_documents(spark)
    with pytest.raises(ValueError):
        read_index(spark, str(tmp_path / "no-index"))


def test_documents(spark, tmp_path):
    (tmp_path / "docs" / "deep").mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_text("one\ntwo")
    (tmp_path / "docs" / "deep" / "b.txt").write_text("three")
    texts = lambda df: sorted(r.text for r in df.collect())
    assert texts(load_documents(spark, directory=str(tmp_path / "docs"))) == ["one\ntwo", "three"]
    assert texts(load_documents(spark, document=str(tmp_path / "docs" / "a.txt"))) == ["one\ntwo"]


def test_catalog_files(spark, tmp_path):
    item = {"id": "x", "keywords": ["Timeout", "failed"], "title": "T", "description": "timeout seen", "category": "c"}
    for folder, name, body in (
        ("components", "components.json", json.dumps([{**item, "id": "p", "keywords": ["other"]}, {**item, "files": ["f"]}])),
        ("docs", "documentation.json", "not json"),
    ):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(body)
    catalog = scan_catalog(spark, str(tmp_path))
    assert [(r.ctx_type, r.item_pos, r.id) for r in catalog.orderBy("item_pos").collect()] == [("components", 0, "p"), ("components", 1, "x")]
    asked = spark.createDataFrame([(1, ["timeout", "zzz"]), (2, ["zzz"])], "request_id bigint, keywords array<string>")
    got = context_items(asked, catalog).collect()
    assert [(r.request_id, r.source, round(r.relevance, 6), r.matched_keywords) for r in got] == [(1, "components/x", 0.7, ["timeout"])]
    assert got[0].content == "**Title:** T\n\n**Description:** timeout seen"
    assert scan_catalog(spark, str(tmp_path / "nowhere")).count() == 0


def test_index_is_reused_for_the_same_log_and_dates(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(0, "text")], "chunk_id bigint, text string")

    path = str(tmp_path / "index")
    ask = lambda **kw: ensure_index(spark, path, build, **kw)[1]
    assert not ask(file="a", start="2025-10-15")
    assert ask(file="a", start="2025-10-15")
    assert not ask(file="a", start="2025-10-16")
    assert not ask(file="b", start="2025-10-15")
    assert len(built) == 3 and ask(file="a", start="2025-10-15")


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("a-1", "2025-10-15 10:00:00", 1), ("a-2", "2025-10-16 10:00:00", 2)], "analysis_id string, t string, n int")
    rows = rows.select("analysis_id", F.col("t").cast("timestamp").alias("saved_at"), "n")
    save_results(rows, str(tmp_path / "out"))
    save_results(rows.withColumn("n", F.col("n") + 10).where("n = 12"), str(tmp_path / "out"))
    loaded = load_results(spark, str(tmp_path / "out"), rows.schema)
    assert loaded.count() == 3
    assert latest_result(loaded, "a-1").first().n == 1
    assert latest_result(loaded, "b").count() == 0
    write_text(spark.createDataFrame([("x\ny",)], "report string"), str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["x", "y"]
