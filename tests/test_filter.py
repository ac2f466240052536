"""Hand-derived results of the log filter's stages."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from logtriage.config import KeywordFilterConfig, VectorFilterConfig, date_bounds, split_keywords
from logtriage.functions.patterns import FLAGS, any_keyword_regex_column, keyword_regex
from logtriage.functions.text import core_message, duration_text, lines_of, strip
from logtriage.operators import selection
from logtriage.operators.keywords import any_keyword, keyword_counts, keyword_hits, keyword_terms
from logtriage.operators.log_view import date_literals, number_lines, with_context
from logtriage.operators.report import parse_report, parsed_reports, preview
from logtriage.plans.keyword_filter import keyword_filter, keyword_filter_batch, number_views, select_lines
from logtriage.schemas import REQUESTS
from logtriage.session import join_small

INCIDENT = [
    "2025-10-15T08:00:00 LogLevel.i Payment gateway is listening",
    "2025-10-15T08:01:10 LogLevel.d Opening ledger partition seven",
    "2025-10-15T08:02:20 LogLevel.e ERROR: ledger write timeout",
    "2025-10-15T08:02:21 LogLevel.e EXCEPTION: LedgerStalled at shard 7",
    "2025-10-15T08:03:30 LogLevel.w WARN: little memory left for the cache",
    "2025-10-15T08:04:40 LogLevel.e ERROR: gateway stops taking payments",
    "2025-10-15T08:05:50 LogLevel.i Gateway is down",
]
DATED = [
    "header without time",
    "2025-10-14T23:59:59 a",
    "  at frame",
    "2025-10-15T00:00:00 b",
    "2025-13-40T10:00:00 c",
    "2025-10-15 23:59:59.999 d",
    "2025-10-16T00:00:00 e",
    "tail",
]


def config(**settings):
    given = {
        "log_file_path": "log",
        "keywords": ("timeout", "memory"),
        "start_date": "2025-10-15",
        "end_date": "2025-10-15",
        "max_tokens": 2000,
        "context_lines": 1,
        "prioritize_by_severity": True,
        **settings,
    }
    return KeywordFilterConfig(**given)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("block_lines", [1, 2, 3, 100])
def test_incident_log(log, block_lines):
    run = keyword_filter(log(INCIDENT, block_lines), config())
    kept = rows(run.kept, "line_index", "is_match")
    assert kept == [(1, False), (2, True), (3, False), (4, True), (5, False)]
    out = run.outcome.first()
    assert (out.total, out.direct, out.context, out.included) == (5, 2, 3, 5)
    assert (out.errors, out.warnings, out.tokens) == (3, 1, 100)
    hits = run.kept.where("is_match")
    assert rows(keyword_counts(hits, ("timeout", "memory")), "keyword", "n") == [("memory", 1), ("timeout", 1)]
    report = run.reports.first().report
    assert report.startswith("=== LOG ANALYSIS SUMMARY ===\nTotal filtered entries: 5\n")
    assert report.index("[Line 1]") < report.index("[Line 2] >>> ") < report.index("[Line 5]")


@pytest.mark.parametrize(
    "max_tokens, matches_first, included, count, tokens",
    [
        (2000, True, [1, 2, 3, 4, 5], 5, 100),
        (175, True, [2, 4], 3, 60),
        (150, True, [2], 2, 40),
        (175, False, [1, 2], 3, 60),
        (125, True, [], 1, 20),
        (125, False, [], 1, 20),
    ],
)
def test_budget(log, max_tokens, matches_first, included, count, tokens):
    cfg = config(max_tokens=max_tokens, prioritize_matches=matches_first, prioritize_by_severity=False)
    run = keyword_filter(log(INCIDENT), cfg)
    assert [r[0] for r in rows(run.included, "line_index")] == included
    out = run.outcome.first()
    assert (out.included, out.tokens) == (count, tokens)


@pytest.mark.parametrize("block_lines", [1, 2, 3, 8])
def test_date_filter(log, block_lines):
    low, high = date_literals(*date_bounds("2025-10-15", "2025-10-15"))
    kept = number_lines(log(DATED, block_lines), start=low, end=high)
    assert rows(kept, "line_index", "pos") == [(0, 0), (1, 3), (2, 4), (3, 5)]


def test_malformed_bound_keeps_all(log):
    assert date_bounds("2025/10/15", "2025-10-15") == (None, None)
    cfg = config(keywords=("a", "tail"), start_date="2025/10/15", context_lines=0)
    assert [r[0] for r in rows(select_lines(log(DATED), cfg), "line_index")] == [1, 7]


KEYWORDS = ["error", "LogLevel.w", "***", "", "über", "time out", "-foo", "foo-", "k", "ſ", "İ", "a_b", "error: x", "x", "STRASSE", "."]
WORDS = ["error", "Error:", "LOGLEVEL.W", "loglevelxw", "***", "ÜBER", "über", "time", "out", "a-foo", "-foo", "foo-b", "K", "S", "ſ", "i̇", "a_b", "x", "straße", "x.y", ""]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_keyword_hits_equal_each_pattern(spark, log, monkeypatch, limit):
    monkeypatch.setattr(join_small, "__defaults__", (limit,))
    rng = random.Random(3)
    lines = [" ".join(rng.choices(WORDS, k=rng.randrange(6))) for _ in range(300)]
    both = log(lines, 40).unionByName(log(lines[:50], 40, "other"))
    asked = spark.createDataFrame([("log", KEYWORDS[:9]), ("log", KEYWORDS[5:]), ("other", ["x", "x", "***"]), ("missing", ["x"])], "file string, keywords array<string>")
    got = sorted(tuple(r) for r in keyword_hits(both, keyword_terms(asked)).select("file", "pos", "keyword").collect())
    want = []
    for name, words in (("log", KEYWORDS), ("other", ["x", "***"])):
        own = both.where(F.col("file") == name)
        for k in words:
            want += [(name, r["pos"], k) for r in own.where(F.rlike("line", F.lit(FLAGS + keyword_regex(k)))).select("pos").collect()]
    assert got == sorted(want) and len({k for _, _, k in got}) > 11


def test_batch_reads_a_log_once_per_date_view(spark, log):
    lines = [f"2025-10-{1 + n // 30:02d}T10:00:00 w{n % 17} rest" for n in range(120)]
    rows = [(i, "log", "x", [f"w{i % 20}", "none"], "llm", None if i % 2 else "2025-10-02", None, 900, 1, False, False) for i in range(40)]
    asked = spark.createDataFrame(rows, REQUESTS)
    views = asked.select(F.lit("log").alias("file"), F.when(F.col("start_date").isNull(), 1).otherwise(2).alias("view"), F.col("start_date").cast("timestamp_ntz").alias("low"), F.lit(None).cast("timestamp_ntz").alias("high"))
    assert number_views(log(lines, 16), views).count() == 120 + 90  # not 40 x 120
    kept = keyword_filter_batch(asked, log(lines, 16)).kept
    got = {}
    for r in kept.collect():
        got.setdefault(r["request_id"], []).append((r["line_index"], r["is_match"]))
    for i in range(40):
        own = [line for line in lines if i % 2 or line >= "2025-10-02"]
        assert sorted(got.get(i, [])) == _brute_force(own, f"w{i % 20}", 1, None)


def _brute_force(lines, word, context, most):
    hits = [n for n, line in enumerate(lines) if re.search(rf"\b{word}\b", line, re.IGNORECASE)]
    hits = hits[:most] if most else hits
    near = {n for h in hits for n in range(max(0, h - context), min(len(lines), h + context + 1))}
    return sorted((n, n in set(hits)) for n in near)


@pytest.mark.parametrize("seed", range(4))
def test_context_equals_brute_force(spark, log, seed):
    rng = random.Random(seed)
    lines = [rng.choice(["x error y", "plain", "plain", "other", "Error"]) for _ in range(60)]
    for block_lines, context, most in [(1, 2, None), (7, 3, None), (7, 3, 4), (4, 0, None), (3, 9, 1), (64, 1, 2)]:
        numbered = number_lines(log(lines, block_lines), hit=any_keyword(["error"]))
        near = with_context(numbered, F.lit(context), max_results=most)
        assert rows(near, "line_index", "is_match") == _brute_force(lines, "error", context, most)


@pytest.mark.parametrize("seed", range(3))
def test_dates_context_equal_brute_force(log, seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(50):
        stamp = f"2025-10-{rng.randint(13, 17):02d}T10:00:00 " if rng.random() < 0.4 else ""
        lines.append(stamp + rng.choice(["error", "fine", "fine"]))
    kept, last = [], None
    for line in lines:
        found = re.search(r"\d{4}-\d{2}-\d{2}", line)
        last = found.group() if found else last
        if last is None or "2025-10-14" <= last <= "2025-10-15":
            kept.append(line)
    want = _brute_force(kept, "error", 2, None)
    cfg = config(keywords=("error",), start_date="2025-10-14", context_lines=2)
    for block_lines in (1, 4, 9, 50):
        selected = select_lines(log(lines, block_lines), cfg)
        assert rows(selected, "line_index", "is_match") == want
        assert [r[1] for r in rows(selected, "line_index", "line")] == [kept[n] for n, _ in want]


def test_batch_equals_single_runs(spark, log):
    lines = log(INCIDENT, 2, "a").unionByName(log(DATED, 3, "b"))
    schema = (
        "request_id bigint, log_file_path string, issue_description string, keywords array<string>, filter_mode string, "
        "start_date string, end_date string, max_tokens int, context_lines int, deduplicate boolean, prioritize_by_severity boolean"
    )
    asked = [
        (1, "a", "x", ["timeout", "memory"], "llm", "2025-10-15", "2025-10-15", 175, 1, True, True),
        (2, "a", "x", ["application"], "llm", None, None, 3500, 0, False, False),
        (3, "b", "x", ["b", "d"], "llm", "2025-10-15", "", 3500, 1, True, False),
        (4, "b", "x", ["nowhere"], "llm", None, "2025-10-15", 3500, 1, True, False),
    ]
    batch = keyword_filter_batch(spark.createDataFrame(asked, schema), lines)
    got = {r.request_id: r.report for r in batch.reports.collect()}
    for rid, file, _, words, _, start, end, tokens, context, dedup, severity in asked:
        cfg = KeywordFilterConfig(
            log_file_path=file, keywords=tuple(words), start_date=start, end_date=end, max_tokens=tokens,
            context_lines=context, deduplicate=dedup, prioritize_by_severity=severity,
        )
        assert got[rid] == keyword_filter(lines.where(F.col("file") == file), cfg).reports.first().report


def test_core_message(spark):
    cases = {
        "2025-10-15 10:00:00,123 [T-1] job 42 took 17ms": "job # took #ms",
        "2025-10-15T10:00:00 job 7 took 3ms": "T#:#:# job # took #ms",
        "[a][b] x  ": "x",
        " ٣ x\t": "# x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    assert [r[0] for r in df.select(core_message(F.col("line"))).collect()] == list(cases.values())


def test_duplicates_keep_three_in_current_order(log):
    lines = [f"error {n}" for n in range(9)]
    run = keyword_filter(log(lines, 4), config(keywords=("error",), start_date=None, end_date=None))
    assert [r[0] for r in rows(run.kept, "line_index")] == [0, 1, 2]


def test_keyword_edges(spark, log):
    def hit(line, *keywords, **kw):
        return log([line]).where(any_keyword(keywords, **kw)).count() == 1

    assert not hit("x [err y", "[err") and hit("x[err y", "[err")
    assert hit("der Öl-Fehler", "öl") and not hit("Ölung", "öl")
    assert hit("a.b", "a.b") and not hit("axb", "a.b") and hit(r"x\E y", r"x\E")
    assert hit("preerror", "error", word_boundary=False) and not hit("preerror", "error")
    words = ["a.b", "[err", "öl", "x+", "_a", "", "a b", "t\\E"]
    built = spark.createDataFrame([(words,)], "k array<string>").select(any_keyword_regex_column(F.col("k"))).first()[0]
    assert built == FLAGS + "|".join(keyword_regex(k) for k in words)
    lines = ["a.b", "xa.b", "x[err", "[err", "Öl", "x+y", "x+", "_a", "t\\E.", "a b c", "--", "..t\\E"]
    df = log(lines)
    for chosen in (words, [w for w in words if w], ["a.b", "öl", "x+"]):
        together = {r.line for r in df.where(any_keyword(chosen)).collect()}
        apart = {r.line for k in chosen for r in df.where(F.rlike("line", F.lit(FLAGS + keyword_regex(k)))).collect()}
        assert together == apart


def test_settings_are_checked():
    for bad in (
        {"keywords": ()}, {"log_file_path": ""}, {"max_tokens": 0}, {"context_lines": -1}, {"max_results": 0},
        {"severity_mode": "odd"},
    ):
        with pytest.raises(ValueError):
            config(**bad)
    with pytest.raises(ValueError):
        VectorFilterConfig(log_file_path="x", issue_description="")
    assert [VectorFilterConfig(log_file_path="x", issue_description="y", max_tokens=t).k for t in (3500, 200, 199)] == [17, 1, 0]
    assert split_keywords(" a, ,b ,") == ["a", "b"]
    line = KeywordFilterConfig.command_line("a", log_file_path="x")
    assert (line.max_tokens, line.deduplicate, line.prioritize_matches) == (3000, False, False)


def test_no_match_and_preview(spark, log):
    reports = keyword_filter(log(INCIDENT), config(keywords=("nothing",))).reports
    assert reports.first().report == "No matching log entries found for the given criteria."
    long = spark.createDataFrame([("x" * 1001,)], "report string").select(preview(F.col("report"))).first()[0]
    assert long == "x" * 1000 + "..."


def test_parse_report(spark):
    text = "\n".join(
        ["=== LOG ANALYSIS SUMMARY ===", "Legend: >>> = x", "=====", "skipped", "[Line 3] >>> a >>> b", "", "  more", "[Line 4]     c",
         "[Line x] odd", "... (truncated, 2 more entries) ..."]
    )
    df = spark.createDataFrame([(1, text), (2, "one\n\n two"), (3, "  ")], "id int, report string")
    got = [tuple(r)[2:] for r in parse_report(df, "id").where("id = 1").orderBy("n").collect()]
    assert got == [
        (3, True, None, "a >>> b"), (None, None, "continuation", "more"), (4, False, None, "c"),
        (None, False, None, "[Line x] odd"), (None, None, "truncation_notice", "... (truncated, 2 more entries) ..."),
    ]
    plain = [tuple(r)[2:] for r in parse_report(df, "id").where("id = 2").orderBy("n").collect()]
    assert plain == [(1, True, None, "one"), (3, True, None, "two")]
    totals = {r.id: (r.summary, r.total_entries) for r in parsed_reports(df, "id").collect()}
    assert totals[1][0].endswith("Legend:") and totals[1][1] == 5 and totals[3] == ("", 0)


def test_report_never_exceeds_budget(log):
    lines = [f"2025-10-15T10:00:00 memory {'x' * (n % 50)} {n}" for n in range(300)]
    for tokens in (200, 333, 1000):
        run = keyword_filter(log(lines, 64), config(max_tokens=tokens, deduplicate=False))
        assert (run.included.agg(F.sum("cost")).first()[0] or 0) <= tokens * 4 - 500


def _plain_prefix(rows, budget, matches_first):
    """(line_index) of the lines that fit; rows are (priority, line_index, is_match, cost)."""
    chosen, spent = [], 0
    passes = [[r for r in rows if r[2]], [r for r in rows if not r[2]]] if matches_first else [rows]
    for part in passes:
        for priority, index, _, cost in sorted(part, key=lambda r: (-r[0], r[1])):
            if spent + cost > budget:
                break
            spent += cost
            chosen.append(index)
    return sorted(chosen)


@pytest.mark.parametrize("matches_first", [True, False])
@pytest.mark.parametrize("lines, blocks", [(4, 3), (1, 1), (1 << 12, 1 << 10)])
def test_budget_prefix_equals_plain_sums(spark, monkeypatch, matches_first, lines, blocks):
    monkeypatch.setattr(selection, "BUDGET_LINES", lines)
    monkeypatch.setattr(selection, "BUDGET_BLOCKS", blocks)
    rng = random.Random(lines)
    budgets = {"none": 0, "one": 40, "some": 900, "many": 6_000, "all": 10**9}
    rows, want = [], set()
    for key, budget in budgets.items():
        own = [(rng.choice([0, 0, 1000]), n * 3, rng.random() < 0.4, "x" * rng.randrange(30)) for n in range(200)]
        rows += [(key, budget, *r) for r in own]
        cost = [(p, n, hit, len(f"[Line {n}] >>> {text}") + 1) for p, n, hit, text in own]
        want |= {(key, n) for n in _plain_prefix(cost, budget, matches_first)}
    ranked = spark.createDataFrame(rows, "log string, budget long, priority long, line_index long, is_match boolean, line string")
    fitting = selection.fit_budget(ranked, F.col("budget"), keys=["log"], matches_first=matches_first)
    assert {tuple(r) for r in fitting.select("log", "line_index").collect()} == want
    assert {key for key, _ in want} == set(budgets) - {"none"}


def test_budget_sums_lines_only_within_blocks(spark, log):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for tokens in (3500, 20000):
            run = keyword_filter(log([f"memory {n}" for n in range(50)], 8), config(max_tokens=tokens))
            plan = run.included._jdf.queryExecution().executedPlan().toString()
            sums = re.findall(r"Window \[(?:.*?)sum\(cost#.*?\], \[(.*?)\]", plan)
            assert sums and all("_block" in partition for partition in sums)
            text = [x for x in re.findall(r"Exchange hashpartitioning\((.*?)\), ENSURE", plan) if "file" in x]
            assert text and "rank" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_small_text_functions(spark):
    seconds = [0.0, 0.9994, 1.0, 2.25, 2.35, 2.75, 59.96, 60.0, 61.5, 125.0]
    df = spark.createDataFrame([(s,) for s in seconds], "s double")

    said = ["0ms", "999ms", "1.0 seconds", "2.2 seconds", "2.4 seconds", "2.8 seconds", "60.0 seconds", "1 minute", "1 minute 1.5 seconds", "2 minutes 5.0 seconds"]
    assert [r[0] for r in df.select(duration_text(F.col("s"))).collect()] == said
    text = spark.createDataFrame([("a\r\nb\rc\n\nd\n",), ("\x1c x \t",)], "t string")
    assert text.select(lines_of(F.col("t"))).first()[0] == ["a", "b", "c", "", "d"]
    assert text.select(strip(F.col("t"))).collect()[1][0] == "x"
