import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from proofspark.operators.evaluate import evaluate
from proofspark.operators.segment import assemble_text, build_segments
from proofspark.session import written
from proofspark.sources import files as S, tables as T
from proofspark.sources.text import gate_chunkless, gate_documents


def docx(body, member="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr(member, f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    items = {
        "a.TXT": "﻿第一行\r\n第二行\r  \n\n".encode(), "b.txt": "中文段落。".encode("gb18030"), "c.txt": b"\xff\xff\x00", "d.md": b"x", "e.pdf": b"%PDF-1.7",
        "f.pdf": b"no", "g.docx": b"PK nothing", "noext": b"x",
        "h.docx": docx("<w:p><w:r><w:t>甲&amp;乙</w:t><w:tab/><w:t>丙</w:t></w:r></w:p><w:p/><w:p><w:del><w:r><w:t>删</w:t></w:r></w:del><w:r><w:t>丁</w:t><w:br/></w:r></w:p><w:p></w:p>"),
        "i.docx": docx("<w:p>").replace(b"PK", b"PK", 1),
    }
    for name, content in items.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def names(df):
    return {os.path.basename(r.path): r.error_code for r in df.collect()}


def test_scan_decode_extract(spark, folder):
    files, rejects = S.scan_files(spark, folder)
    assert names(rejects) == {"d.md": "UNSUPPORTED_FORMAT", "e.pdf": "PDF_NOT_SUPPORTED", "f.pdf": "UNSUPPORTED_FORMAT",
                              "g.docx": "UNSUPPORTED_FORMAT", "noext": "UNSUPPORTED_FORMAT"}
    texts, bad = S.decode_txt(files.where("document_format = 'txt'"))
    assert {os.path.basename(r.path): r.text for r in texts.collect()} == {"a.TXT": "第一行\n第二行", "b.txt": "中文段落。"}
    assert names(bad) == {"c.txt": "EXTRACTION_FAILED"}
    rows, broken = S.extract_docx(files)
    assert names(broken) == {"i.docx": "EXTRACTION_FAILED"}
    got = [(r.line_no, r.text, r.paragraph_break_after) for r in rows.orderBy("line_no").collect()]
    assert got == [(1, "甲&乙\t丙", True), (2, "丁\n", False)]
    lines = rows.withColumn("doc_id", F.lit(1))
    text = assemble_text(lines).first().text
    assert text.startswith("甲&乙\t丙\n\n") and text.endswith("丁\n")
    assert {r.line for r in build_segments(lines).collect()} == {None}


def test_media_types(spark, folder):
    declared = spark.createDataFrame([("x",)], "n string")
    ok = declared.select(
        S.media_type_allowed(F.lit("Text/Plain; charset=utf-8"), F.lit("txt")), S.media_type_allowed(F.lit("application/pdf"), F.lit("txt")),
        S.media_type_allowed(F.lit("application/octet-stream"), F.lit("pdf")), S.media_type_allowed(F.lit(None).cast("string"), F.lit("docx")),
        S.media_type_allowed(F.lit("application/zip"), F.lit("docx"))).first()
    assert list(ok) == [True, False, True, True, True]


@pytest.mark.parametrize("raw, want", [("a\n\n", "a"), ("a  \n \n", "a  "), ("\n\n", ""), (" \n\t\n", " "), ("a\r\rb\r\n", "a\n\nb"), ("a", "a"), ("", ""), ("\na", "\na"), ("a\n　\n", "a")])
def test_blank_tail(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(S.clean_lines(F.col("t"))).first()[0] == want


def test_gates(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "　"), (3, "abcdef")], "doc_id long, text string")
    ok, bad = gate_documents(docs, 5)
    assert [r.doc_id for r in ok.collect()] == [1]
    assert {r.doc_id: r.error_code for r in bad.collect()} == {2: "EXTRACTION_FAILED", 3: "TEXT_TOO_LONG"}
    assert {r.doc_id for r in gate_chunkless(docs, ok).collect()} == {2, 3}


def gold_problems(spark, tmp_path, *lines):
    path = tmp_path / "gold.jsonl"
    path.write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))
    gold, bad = T.read_gold(spark, str(path))
    return gold.count(), sorted((r.document_id, r.problem) for r in bad.collect())


def test_gold_lines(spark, tmp_path):
    issue = {"category": "typo", "grammar_subtype": None, "char_start": 0, "char_end": 2}
    assert gold_problems(spark, tmp_path, {"document_id": "a", "issues": [{**issue, "note": "kept"}]}, "", {"document_id": "b", "issues": []}) == (2, [])
    assert gold_problems(spark, tmp_path, {"document_id": "a", "issues": [], "review_status": "draft"})[1] == [("a", "malformed_line")]
    assert gold_problems(spark, tmp_path, "{")[1] == [("?", "malformed_line")]
    assert gold_problems(spark, tmp_path, " ")[1] == [("?", "no_documents")]
    assert gold_problems(spark, tmp_path, {"document_id": "a b", "issues": [{**issue, "char_end": 0}, {**issue, "category": "grammar"}]})[1] == [
        ("a b", "invalid_document_id"), ("a b", "invalid_range"), ("a b", "subtype_mismatch")]
    twice = {"document_id": "a", "issues": []}
    assert gold_problems(spark, tmp_path, twice, twice)[1] == [("a", "duplicate_document_id")]


def test_reports_from_files(spark, tmp_path):
    (tmp_path / "doc-1.json").write_text(json.dumps({
        "schema": "report.v1", "report_id": "r", "job_id": "j", "complete": True, "summary": {"total": 0}, "issues": [],
        "analysis": {"provider_kind": "anthropic"}, "document": {"original_name": "n", "format": "txt", "char_count": 3}}))
    r = T.read_reports(spark, str(tmp_path)).first()
    assert (r.document_id, r.analysis.analysis_profile, r.analysis.reference_version, r.missed_issues) == ("doc-1", "general", "", [])


def test_reports_replace_their_jobs(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("job_id"), F.lit("old").alias("content"))
    T.write_reports(rows, path)
    T.write_reports(rows.where("doc_id < 10").withColumn("content", F.lit("new")), path)
    T.write_reports(rows.where("doc_id < 10").withColumn("content", F.lit("new")), path)
    got = {r.doc_id: r.content for r in T.stored_reports(spark, path).collect()}
    assert len(got) == 50 and T.stored_reports(spark, path).count() == 50
    assert all(got[i] == ("new" if i < 10 else "old") for i in range(50))


def test_usage_rows(spark):
    calls = spark.createDataFrame(
        [(1, "candidate", "anthropic", "m", None, 3, 10, 2, True, (4, None, 7)), (1, "verification", "anthropic", "v", 1, 1, 5, 1, False, None)],
        "job_id long, pass string, provider_kind string, model string, prompt_tokens int, completion_tokens int, duration_ms long, attempts int, "
        "success boolean, repair struct<prompt_tokens:int,completion_tokens:int,duration_ms:long>")
    got = sorted((r["pass"], r.prompt_tokens, r.duration_ms, r.attempt, r.success) for r in T.usage_rows(calls).collect())
    assert got == [("candidate", None, 10, 2, True), ("repair", 4, 7, 1, True), ("verification", 1, 5, 1, False)]


def test_evaluation_summary(spark, tmp_path):
    pred = spark.createDataFrame([(1, 1, "typo", None, "confirmed", 0, 2)], "doc_id long, pred_id int, category string, grammar_subtype string, level string, char_start int, char_end int")
    gold = spark.createDataFrame([(1, 1, "typo", None, 0, 2)], "doc_id long, gold_id int, category string, grammar_subtype string, char_start int, char_end int")
    T.write_eval(evaluate(pred, gold), 1, str(tmp_path / "eval"))
    out = json.loads(spark.read.text(str(tmp_path / "eval")).first().value)
    assert out["combined"]["counts"] == {"true_positive": 1, "false_positive": 0, "false_negative": 0}
    assert out["combined_by_category"]["typo"]["f1"] == 1.0 and len(out["combined_by_grammar_subtype"]) == 10


def test_written_keeps_rows(spark):
    assert written(spark.range(5), "t").count() == 5


def test_folders_are_listed_by_tasks(spark, tmp_path):
    rows = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit("-a b%20+.txt")).alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    assert S.write_files(rows, str(tmp_path)) == 2500 and len(os.listdir(tmp_path)) == 3
    for name in ("_hidden.txt", ".hidden.txt", "x._COPYING_"):
        (tmp_path / name).write_text("x")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "0" / "_logs").mkdir()
    (tmp_path / "0" / "_logs" / "y.txt").write_text("x")
    files, rejects = S.scan_files(spark, str(tmp_path))
    usual = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert files.select("path", "size_bytes", "content").exceptAll(usual.select("path", "length", "content")).isEmpty()
    assert files.count() == usual.count() == 2500 and rejects.isEmpty()
    assert len(files.inputFiles()) < 100  # the driver plans a few files of rows, not one entry a file
    assert S.read_files(spark, str(tmp_path / "1" / "*.txt"))[0].count() == len(os.listdir(tmp_path / "1"))


def test_reports_that_are_no_objects(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for name, content in {"empty": b" ", "list": b'[{"report_id":"a"},{"report_id":"b"}]', "none": b"[]", "bad": b"{ not", "worse": b"\xff\xfe\x00", "a+b": b'{"report_id":"c"} x',
                          "wide": '{"report_id":"d"}'.encode("utf-16"), "mark": b'\xef\xbb\xbf{"report_id":"e"}'}.items():
        (tmp_path / ("below" if name == "mark" else ".") / f"{name}.json").write_bytes(content)
    got = sorted((r.document_id, r.report_id) for r in T.read_reports(spark, str(tmp_path)).collect())
    assert got == [("a+b", "c"), ("bad", None), ("list", "a"), ("list", "b"), ("mark", "e"), ("wide", "d"), ("worse", None)]
