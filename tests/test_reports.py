import pytest
from pyspark.sql import functions as F

from proofspark.catalog.reports import markdown_inputs
from proofspark.functions.labels import location_label
from proofspark.operators import lifecycle as L, ops, report as R
from proofspark.schemas import LOCATION


def jobs(spark, *rows):
    df = spark.createDataFrame(list(rows), "job_id long, user_id long, created string, status string")
    return df.withColumn("created_at", F.to_timestamp("created"))


def test_history_page_clamps(spark):
    df = jobs(spark, *[(i, 1, "2024-01-01 00:00:00", "completed") for i in range(45)])
    rows, total, page = R.history_page(df, 9, 20)
    assert (total, page, [r.job_id for r in rows.collect()]) == (45, 3, [4, 3, 2, 1, 0])
    empty, total, page = R.history_page(df.where("false"), 5, 20)
    assert (total, page, empty.count()) == (0, 1, 0)
    with pytest.raises(ValueError):
        R.history_page(df, 0, 20)
    with pytest.raises(ValueError):
        R.history_page(df, 1, 101)


def test_issue_page_and_latest(spark):
    issues = spark.range(7).select(F.col("id").cast("string").alias("issue_id"), F.col("id").alias("char_start"), F.col("id").alias("char_end"))
    assert [r.issue_id for r in R.issue_page(issues, 2, 5).collect()] == ["5", "6"]
    assert R.issue_page(issues, 9, 5).count() == 0
    df = jobs(spark, (1, 1, "2024-01-01 00:00:00", "queued"), (2, 1, "2024-01-02 00:00:00", "queued"), (3, 2, "2024-01-03 00:00:00", "queued"))
    assert [r.job_id for r in R.latest(df, 1, 1).collect()] == [2]


def test_rank_over_a_hot_key(spark):
    df = spark.range(5000).select(F.col("id").alias("job_id"), F.lit(1).alias("user_id"),
                                  F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37 % 90_000).alias("created_at"))
    got = R.history_pages(df, 7).collect()
    want = sorted(got, key=lambda r: (r.created_at, r.job_id), reverse=True)
    assert [r.page_no for r in want] == [i // 7 + 1 for i in range(5000)]


def test_invalid_filters(spark):
    issues = spark.createDataFrame([("a", 90, "typo", "confirmed", None)], "issue_id string, confidence int, category string, level string, feedback string")
    for bad in ({"category": "style"}, {"level": "sure"}, {"feedback": "maybe"}):
        with pytest.raises(ValueError):
            R.filter_issues(issues, **bad)
    assert R.filter_issues(issues, feedback="all").count() == 1
    with pytest.raises(ValueError):
        R.filter_status(issues, "queued")
    with pytest.raises(ValueError):
        R.search_name(issues, "x" * 101, "issue_id")


def test_search_is_literal(spark):
    df = spark.createDataFrame([("A%_b.txt",), ("axxb.txt",)], "original_name string")
    assert [r[0] for r in R.search_name(df, " a%_B ").collect()] == ["A%_b.txt"]


def test_navigation_wraps(spark):
    df = spark.createDataFrame([(1, "a", 0, 1, None), (1, "b", 2, 3, "correct"), (1, "c", 4, 5, None), (2, "z", 0, 1, None)],
                               "doc_id long, issue_id string, char_start int, char_end int, feedback string")
    assert {r.issue_id: (r.previous_id, r.next_id) for r in R.adjacent_issues(df).collect()} == {
        "a": ("c", "b"), "b": ("a", "c"), "c": ("b", "a"), "z": ("z", "z")}
    assert {r.issue_id: r.next_unreviewed_id for r in R.next_unreviewed(df).collect()} == {"a": "c", "b": "c", "c": "a", "z": None}


@pytest.mark.parametrize("loc, want", [
    (dict(page=2, line_start=3, line_end=3), "第 2 页，第 3 行"), (dict(page=2, page_end=3, line_start=9, line_end=1), "第 2 页第 9 行至第 3 页第 1 行"),
    (dict(page=2, line_start=9, line_end=1), "第 2 页第 9 行起（结束页未记录）"), (dict(page=1), "第 1 页，第 1 行"), (dict(line_start=4, line_end=6), "第 4–6 行"),
    (dict(paragraph_index=0, sentence_index=1), "第 1 段，第 2 句"), (dict(paragraph_index=2), "第 3 段"), (dict(), "字符 7–9"),
])
def test_location_labels(spark, loc, want):
    names = ["document_format", "page", "page_end", "line_start", "line_end", "paragraph_index", "sentence_index", "char_start", "char_end", "quote"]
    row = tuple({**dict.fromkeys(names), "char_start": 7, "char_end": 9, **loc}[n] for n in names)
    assert spark.createDataFrame([(row,)], f"l {LOCATION}").select(location_label(F.col("l"))).first()[0] == want


def test_markdown_shape(spark, sf_dir):
    heads, issues, misses = markdown_inputs(spark, sf_dir)
    md = R.render_markdown(heads, issues, misses).first().markdown
    assert md.startswith("# 问题报告\n\n- 文件：a\\_") and md.endswith("最终判断由作者完成。\n")


def test_plan_keeps_text_out_of_the_joins(spark):
    new = spark.createDataFrame([(1, 0, 0, 3, "abc")], "job_id long, chunk_index int, source_start int, source_end int, text string")
    stored = spark.createDataFrame([(1, 0, 0, 3, "abc", "completed", "[]", "[]"), (1, 5, 0, 1, "x", "pending", None, None)],
                                   "job_id long, chunk_index int, source_start int, source_end int, content string, status string, candidate_output string, verifier_output string")
    plan, surplus = L.plan_reuse(new, stored)
    assert [r.plan for r in plan.collect()] == ["reusable"] and [r.chunk_index for r in surplus.collect()] == [5]


def test_login_pressure_counts_an_attempt_once(spark):
    rows = [(i, "Bob", "1", False, f"2024-01-01 00:0{i}:00") for i in range(5)] + [
        (5, "bob", "1", True, "2024-01-01 00:14:59"), (6, "eve", "1", True, "2024-01-01 00:15:00"), (7, "bob", None, True, "2024-01-01 00:05:00")]
    df = spark.createDataFrame(rows, "attempt_id int, username string, ip string, success boolean, t string").withColumn("attempted_at", F.to_timestamp("t"))
    got = {r.attempt_id: (r.failures, r.blocked) for r in L.login_pressure(df).collect()}
    assert got[5] == (5, True) and got[6] == (4, False) and got[7] == (5, True) and got[0] == (0, False)


def test_alerts_and_fingerprint(spark):
    works = spark.createDataFrame([("b", "2", True), ("a", "1", True), ("c", "3", False)], "id string, revision string, active boolean")
    one = ops.reference_version(works).first()[0]
    assert one == ops.reference_version(works.orderBy("id")).first()[0] and one.startswith("sha256:")


def test_login_window_is_open_at_its_start(spark):
    df = spark.createDataFrame([(1, "u", "1", False, "2024-01-01 00:00:00"), (2, "u", "1", True, "2024-01-01 00:15:00"), (3, "u", "1", True, "2024-01-01 00:14:59")],
                               "attempt_id int, username string, ip string, success boolean, t string").withColumn("attempted_at", F.to_timestamp("t"))
    assert {r.attempt_id: r.failures for r in L.login_pressure(df).collect()} == {1: 0, 2: 0, 3: 1}
