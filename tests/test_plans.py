import json
import re
import sys

from pyspark.sql import functions as F

from proofspark.catalog import scoring
from proofspark.operators import resolve
from proofspark.operators.segment import build_segments, locate, text_lines
from proofspark.plans import fixtures as X
from proofspark.plans.proofread import proofread, proofread_responses
from proofspark.schemas import RULES
from proofspark.sources.text import gate_chunkless


def issue(quote, **over):
    return {"category": "typo", "quote": quote, "reason": "r", "suggestion": quote, "confidence": 95, **over}


def test_responses_to_issues(spark):
    texts = {1: "他们再操场上跑步。\n好。", 2: "一切正常。", 3: "坏回答。", 4: "没有复核。", 5: "没有回答。", 6: "下标不对。", 7: "　", 8: "两个回答。"}
    docs = spark.createDataFrame([(k, "general", v) for k, v in texts.items()], "doc_id long, analysis_profile string, text string")
    first = {1: {"issues": [issue("他们再操场上跑步。"), issue("不存在"), issue("好")]}, 2: {"issues": []}, 3: {"issues": [issue("坏", extra=1)]},
             4: {"issues": [issue("没有")]}, 6: {"issues": [issue("下标")]}, 8: {"issues": []}}
    verdict = {"verdict": "confirmed", "confidence": 92, "reason": "r", "suggestion": "他们在操场上跑步。"}
    second = {1: [{**verdict, "candidate_index": 0}, {**verdict, "candidate_index": 1, "verdict": "suspected", "suggestion": "棒"}],
              6: [{**verdict, "candidate_index": 1}]}
    kind = "doc_id long, chunk_index int, content string"
    a = spark.createDataFrame([(k, 0, json.dumps(v)) for k, v in first.items()] + [(8, 0, json.dumps({"issues": []}))], kind)
    b = spark.createDataFrame([(k, 0, json.dumps({"verdicts": v})) for k, v in second.items()], kind)
    issues, rejects = proofread_responses(docs, build_segments(text_lines(docs)), a, b, X.evidence(spark))
    got = sorted((r.doc_id, r.char_start, r.original_text, r.suggestion, r.level, r.line_start) for r in issues.collect())
    assert got == [(1, 2, "再", "在", "confirmed", 1), (1, 10, "好", "棒", "suspected", 2)]
    assert sorted((r.doc_id, r.error_code) for r in rejects.collect()) == [
        (3, "MODEL_OUTPUT_INVALID"), (4, "PROVIDER_UNAVAILABLE"), (5, "PROVIDER_UNAVAILABLE"), (6, "MODEL_OUTPUT_INVALID"), (7, "EXTRACTION_FAILED"), (8, "MODEL_OUTPUT_INVALID")]


def test_stored_responses_are_read_once(spark, monkeypatch):
    """Each pass reads its responses once, with the errors they already have, and found issues are stored before they are located."""
    steps, plans = sys.modules[proofread_responses.__module__], {}
    store = steps.written

    def noted(df, name, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, name, *more)

    monkeypatch.setattr(steps, "written", noted)
    kind = "doc_id long, chunk_index int, content string, error_code string"
    docs = spark.createDataFrame([(k, "general", "他们再操场上跑步。") for k in range(1, 7)], "doc_id long, analysis_profile string, text string")
    said, seen = json.dumps({"issues": [issue("他们再操场上跑步。")]}), {"candidate_index": 0, "verdict": "confirmed", "confidence": 92, "reason": "r", "suggestion": "他们在操场上跑步。"}
    heard = json.dumps({"verdicts": [seen]})
    a = spark.createDataFrame([(1, 0, said, None), (2, 0, said, None), (2, 0, "[", None), (3, 0, None, "MODEL_OUTPUT_INVALID"), (4, 0, "[", None), (5, 0, said, None),
                               (6, 0, said, None), (None, 0, said, "MODEL_OUTPUT_INVALID"), (None, 0, said, None)], kind)
    b = spark.createDataFrame([(1, 0, heard, None), (5, 0, heard, "PROVIDER_UNAVAILABLE")], kind)
    issues, rejects = proofread_responses(docs, build_segments(text_lines(docs)), a, b, X.evidence(spark))
    assert [(r.doc_id, r.char_start, r.suggestion, r.line_start) for r in issues.collect()] == [(1, 2, "在", 1)]
    assert sorted((r.stage, r.doc_id, r.error_code) for r in rejects.collect()) == [
        ("candidates", 2, "MODEL_OUTPUT_INVALID"), ("candidates", 3, "MODEL_OUTPUT_INVALID"), ("candidates", 4, "MODEL_OUTPUT_INVALID"),
        ("verdicts", 5, "PROVIDER_UNAVAILABLE"), ("verdicts", 6, "PROVIDER_UNAVAILABLE")]

    def sources(name):
        return len(re.findall("LogicalRDD|LocalRelation|Relation ", plans[name]))

    assert (sources("candidates"), sources("verdicts")) == (1, 2) and "Relation " in plans["located"] and "verdict" not in plans["located"]


def test_longest_document_and_ten_long_ones(spark):
    """200 000 characters, and ten documents of 50 000, with one issue near each end."""
    mark = "他们再操场上跑步"
    sentence = "这是一句没有问题的话。"
    long = (sentence * 20_000)[: 200_000 - len(mark)] + mark
    docs = [(0, "general", long)] + [(i, "general", (sentence * 5_000)[: 50_000 - len(mark)] + mark) for i in range(1, 11)]
    frame = spark.createDataFrame(docs, "doc_id long, analysis_profile string, text string")
    rules = spark.createDataFrame([(1, mark, "typo", None, mark, None, None, "rule 1", "他们在操场上跑步", 95, [])], RULES)

    def sure(resolved):
        return resolved.select("*", F.lit(None).cast("string").alias("v_category"), F.lit(None).cast("string").alias("v_grammar_subtype"),
                               F.lit("confirmed").alias("v_verdict"), F.lit(95).alias("v_confidence"), F.lit("r").alias("v_reason"),
                               F.lit("他们在操场上跑步").alias("v_suggestion"), F.array().cast("array<string>").alias("v_evidence_source_ids"))

    got = {r.doc_id: (r.char_start, r.original_text) for r in proofread(frame, rules, X.evidence(spark), sure, False).collect()}
    assert got == {i: ((200_000 if i == 0 else 50_000) - len(mark) + 2, "再") for i in range(11)}


def test_locate_in_lines_beyond_a_bucket(spark):
    """Sentence numbers in lines of several buckets, for spans at, before and across their bounds."""
    lines = ["一二三四五六。" * 1_500, "短！句？", "甲乙丙。丁" * 1_000]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [(a, a + w) for edge in (0, 4_096, 8_192, 10_500, 12_288) for a in range(max(edge - 3, 0), edge + 3) for w in (1, 5, 4_100)]
    frame = spark.createDataFrame([(1, a, b) for a, b in spans], "doc_id long, char_start int, char_end int")
    got = {(r.char_start, r.char_end): (r.line_start, r.line_end, r.sentence_index)
           for r in locate(frame, build_segments(text_lines(docs))).where("located").collect()}
    bounds, at = [], 0
    for number, line in enumerate(lines, 1):
        bounds.append((number, at, at + len(line)))
        at += len(line) + 1
    want = {}
    for a, b in spans:
        met = [x for x in bounds if x[1] < b and x[2] > a]
        if met:
            want[(a, b)] = (met[0][0], met[-1][0], sum(text[:max(a, met[0][1])].count(c) for c in "。！？"))
    assert got == want


def test_steps_of_responses_broadcast_nothing_that_grows(spark):
    """Sides that grow with the documents never pass through the driver, however small they look."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rows = "SELECT * FROM VALUES {} AS t(doc_id, chunk_index, candidate_index)"
    resolved, verdicts = spark.sql(rows.format("(1L, 0, 2), (2L, 0, 0)")), spark.sql(rows.format("(1L, 0, 0), (2L, 0, 5)"))
    good, bad = resolve.remap_verdicts(verdicts, resolved)
    failed = resolve.fail_documents(resolved, bad)
    chunkless = gate_chunkless(resolved, resolved.where("doc_id = 1"))
    for df in (good, bad, failed, chunkless):
        assert "BroadcastHashJoin" not in plan(df)
    assert [tuple(r) for r in good.select("doc_id", "candidate_index").collect()] == [(1, 2)]
    assert [r["doc_id"] for r in failed.collect()] == [1] and [r["doc_id"] for r in chunkless.collect()] == [2]


def test_line_issues_are_dealt_out_once(spark, sf_dir, monkeypatch):
    """One exchange of rows carries all steps by document, in more parts as the table grows."""
    plan = scoring.evaluation(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "hashpartitioning(doc_id" not in plan.split("ArrowEvalPython")[-1]
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = X.table(spark, sf_dir, "lineitem")
    assert X.dealt(rows, "l_orderkey").rdd.getNumPartitions() == slots
    monkeypatch.setattr(X, "PART_ROWS", 100)
    assert X.dealt(rows, "l_orderkey").rdd.getNumPartitions() == -(-rows.count() // 100)
