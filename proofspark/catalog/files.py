"""Queries over files: the documents written as text files and archives of several kinds, scanned, decoded and cut back into segments."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from proofspark import constants as K
from proofspark.catalog import sql as S
from proofspark.catalog.text import longs
from proofspark.operators.segment import assemble_text, build_segments
from proofspark.plans import fixtures as X
from proofspark.plans.evaluation import NotScored, evaluate_files
from proofspark.plans.proofread import full_reports
from proofspark.session import scratch_dir, written
from proofspark.sources import files as R

Q, O = {}, {}

#: By doc_id modulo 7: byte-order mark, legacy encoding, archive, foreign line breaks, and three kinds that are refused.
KINDS = ["bom.txt", "legacy.txt", "archive.docx", "breaks.TXT", "broken.txt", "note.md", "cut.docx"]


def registered(fn):
    Q[fn.__name__] = fn
    return fn


def _archive(text: str) -> bytes:
    paragraphs = "".join(f'<w:p><w:pPr><w:jc w:val="left"/></w:pPr><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def _encoded(kind: str, text: str) -> bytes:
    return {
        "bom.txt": lambda: text.encode("utf-8-sig"), "legacy.txt": lambda: text.encode("gb18030"), "archive.docx": lambda: _archive(text),
        "breaks.TXT": lambda: text.replace("\n", "\r\n").encode(), "broken.txt": lambda: text.encode() + b"\xff\xff\x00", "note.md": text.encode,
        "cut.docx": lambda: _archive(text).replace(b"word/document.xml", b"word/document.xm_", 1)}[kind]()


def write_corpus(docs: DataFrame, folder: str) -> int:
    """One file a document below the shared folder, written by the tasks; how many."""
    kinds = list(KINDS)

    @F.arrow_udf("binary")
    def encoded(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([_encoded(kinds[k % len(kinds)], t or "") for k, t in zip(doc_id.to_pylist(), text.to_pylist())], pa.binary())

    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod("doc_id", F.lit(len(kinds))) + 1).cast("int"))
    return R.write_files(docs.select("doc_id", F.concat_ws("-", F.col("doc_id").cast("string"), kind).alias("name"), encoded("doc_id", "text").alias("content")), folder)


def _corpus(spark, d):
    """(lines with doc_id, rejects with doc_id) of the documents as files."""
    folder = scratch_dir(spark, "files")
    write_corpus(X.spread(X.table(spark, d, "documents").select("doc_id", "text"), "doc_id"), folder)
    files, refused = R.scan_files(spark, folder)
    number = F.regexp_extract("path", r"([0-9]+)-[^/]*\z", 1).cast("bigint").alias("doc_id")
    texts, undecoded = R.decode_txt(files.where("document_format = 'txt'"))
    paragraphs, unread = R.extract_docx(files)
    lines = R.txt_lines(texts.select(number, "text")).withColumn("line", F.col("line_no"))
    columns = ["doc_id", "line_no", "text", "page", "line", "paragraph_break_after"]
    both = lines.select(*columns).unionByName(paragraphs.select(number, *columns[1:]))
    rejects = refused.unionByName(undecoded).unionByName(unread).select(number, "error_code")
    return written(both, "file-lines"), rejects


@registered
def file_corpus_segments(spark, d):
    """Texts, segments, lines and paragraphs of all files that can be read."""
    lines, _ = _corpus(spark, d)
    cut = build_segments(lines).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("char_start").alias("starts"), F.sum("char_end").alias("ends"), F.coalesce(F.sum("line"), F.lit(0)).alias("lines"),
        F.max("paragraph_index").alias("last_paragraph"))
    return longs(cut.join(assemble_text(lines).select("doc_id", F.md5("text").alias("digest")), "doc_id"))


_LINES = """
texts AS (SELECT doc_id, doc_id % 7 AS kind, regexp_replace(text, '\\n\\s*$', '') AS text FROM documents WHERE doc_id % 7 < 4),
lines AS (SELECT doc_id, kind, unnest(range(1, len(l) + 1)) AS n, len(l) AS of, unnest(l) AS text FROM (SELECT doc_id, kind, string_split(text, chr(10)) AS l FROM texts)),
gaps AS (SELECT *, CASE WHEN kind = 2 AND n < of THEN 1 ELSE 0 END AS gap FROM lines),
cut AS (SELECT *, coalesce(sum(length(text) + 1 + gap) OVER w, 0)::BIGINT AS s, coalesce(sum(gap + CASE WHEN regexp_matches(text, '\\S') THEN 0 ELSE 1 END) OVER w, 0)::BIGINT AS p
  FROM gaps WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
O["file_corpus_segments"] = S.with_plain(_LINES, select="""
SELECT doc_id, count(*) AS segments, sum(s)::BIGINT AS starts, sum(s + length(c.text))::BIGINT AS ends, coalesce(sum(CASE WHEN kind <> 2 THEN n END), 0)::BIGINT AS lines, max(p) AS last_paragraph,
  any_value(md5(CASE WHEN kind = 2 THEN replace(t.text, chr(10), chr(10) || chr(10)) ELSE t.text END)) AS digest
FROM cut c JOIN texts t USING (doc_id, kind) WHERE length(c.text) > 0 GROUP BY doc_id""")


@registered
def file_corpus_rejects(spark, d):
    return _corpus(spark, d)[1]


O["file_corpus_rejects"] = """
SELECT doc_id, ['EXTRACTION_FAILED', 'UNSUPPORTED_FORMAT', 'EXTRACTION_FAILED'][doc_id % 7 - 3] AS error_code FROM documents WHERE doc_id % 7 > 3"""


def _report_files(spark, d):
    """(labels as rows, reports as rows) of all documents: labels are four fifths of what the reports say."""
    docs, rules = X.documents(spark, d), X.rules(spark)
    reports = written(full_reports(docs, rules, X.evidence(spark), X.arithmetic_verdicts, F.lit("2001-08-02T00:00:00Z")), "file-reports")
    issue = "array<struct<category:string,grammar_subtype:string,location:struct<char_start:int,char_end:int>>>"
    listed = F.from_json(F.get_json_object("content", "$.issues"), issue)
    kept = F.filter(listed, lambda i: i["location"]["char_start"] % 5 != 0)
    items = F.transform(kept, lambda i: F.struct(i["category"].alias("category"), i["grammar_subtype"].alias("grammar_subtype"),
                                                 i["location"]["char_start"].alias("char_start"), i["location"]["char_end"].alias("char_end")))
    return reports.select("doc_id", F.col("job_id").alias("document_id"), items.alias("issues")), reports.select("doc_id", "content")


def write_json_files(rows: DataFrame, folder: str) -> int:
    """<doc_id>.json for each (doc_id, content), written by the tasks."""
    return R.write_files(rows.select("doc_id", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit(".json")).alias("name"), F.encode("content", "utf-8").alias("content")), folder)


def _stored_evaluation(labels, reports, spark):
    gold, folder = scratch_dir(spark, "gold-lines"), scratch_dir(spark, "report-files")
    labels.select(F.to_json(F.struct("document_id", "issues")).alias("value")).write.text(gold)
    write_json_files(reports, folder)
    return gold, folder


@registered
def evaluation_from_files(spark, d):
    """Labels and reports written as files, checked and scored."""
    gold, folder = _stored_evaluation(*_report_files(spark, d), spark)
    out = evaluate_files(spark, gold, folder)
    return longs(out.where("slice not in ('confirmed', 'suspected_only')").select("slice", "true_positive", "false_positive", "false_negative"))


_SLICES = "VALUES ('combined', NULL, NULL), ('grammar_detection', 'grammar', NULL), " + ", ".join(f"('category:{c}', '{c}', NULL)" for c in K.CATEGORIES) + ", " + ", ".join(
    f"('subtype:{s}', 'grammar', '{s}')" for s in K.GRAMMAR_SUBTYPES)
O["evaluation_from_files"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, S.OCCURRENCES, S.ISSUES, f"slices(slice, c, s) AS ({_SLICES})", select="""
SELECT slice, count(i.doc_id) FILTER (i.char_start % 5 <> 0) AS true_positive, count(i.doc_id) FILTER (i.char_start % 5 = 0) AS false_positive, 0::BIGINT AS false_negative
FROM slices x LEFT JOIN issues i ON (x.c IS NULL AND i.category <> 'paragraph' OR i.category = x.c) AND (x.s IS NULL OR i.grammar_subtype = x.s) GROUP BY slice""")


@registered
def evaluation_refusals(spark, d):
    """The problems for which spoilt files are not scored."""
    labels, reports = _report_files(spark, d)
    k = F.col("doc_id")
    extra = F.struct(F.lit("typo").alias("category"), F.lit(None).cast("string").alias("grammar_subtype"), F.lit(7).alias("char_start"), F.lit(7).alias("char_end"))
    labels = labels.withColumn("issues", F.when(k % 17 == 0, F.concat("issues", F.array(extra))).otherwise(F.col("issues")))
    content = F.when(k % 13 == 0, F.replace("content", F.lit('"complete":true'), F.lit('"complete":false'))).when(k % 19 == 0, F.lit("{ not a report")).otherwise(
        F.when(k % 23 == 0, F.replace("content", F.concat(F.lit('"report_id":"'), k.cast("string"), F.lit('"')), F.lit('"report_id":"same"'))).otherwise(F.col("content")))
    gold, folder = _stored_evaluation(labels, reports.where(k % 11 > 0).withColumn("content", content), spark)
    try:
        evaluate_files(spark, gold, folder)
        raise AssertionError("spoilt files were scored")
    except NotScored as refused:
        return spark.createDataFrame(sorted(refused.problems.items()), "problem string, times bigint")


O["evaluation_refusals"] = """
WITH k AS (SELECT doc_id AS k FROM documents WHERE regexp_matches(text, '\\S'))
SELECT * FROM (SELECT 'invalid_range' AS problem, count(*) FILTER (k % 17 = 0) AS times FROM k
  UNION ALL SELECT 'missing_report', count(*) FILTER (k % 11 = 0) FROM k
  UNION ALL SELECT 'not_a_complete_report', count(*) FILTER (k % 13 = 0 AND k % 11 > 0) FROM k
  UNION ALL SELECT 'unreadable_report', count(*) FILTER (k % 19 = 0 AND k % 13 > 0 AND k % 11 > 0) FROM k
  UNION ALL SELECT 'reused_report', (count(*) FILTER (k % 23 = 0 AND k % 19 > 0 AND k % 13 > 0 AND k % 11 > 0) > 1)::BIGINT FROM k) WHERE times > 0"""

QUERIES, ORACLES = Q, O
