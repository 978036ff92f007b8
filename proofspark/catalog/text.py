"""Queries over document texts: paragraphs, chunks, segments, locating, issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofspark import constants as K
from proofspark.catalog import sql as S
from proofspark.functions.edits import localize_edit
from proofspark.functions.spans import common_spans, protected_spans, scene_spans
from proofspark.functions.text import normalize_suggestion, safe_filename
from proofspark.operators import report as R
from proofspark.operators.chunk import chunk, paragraphs
from proofspark.operators.finalize import evidence_refs, finalize
from proofspark.operators.resolve import flag_protected, resolve_candidates
from proofspark.operators.rules import scan_occurrences, scan_rules
from proofspark.operators.segment import build_segments, locate, text_lines
from proofspark.operators.summary import summarize
from proofspark.plans import fixtures as X
from proofspark.plans.proofread import proofread
from proofspark.sources.text import gate_documents, ingest_text

Q, O = {}, {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.documents(spark, sf_dir).select("doc_id", "analysis_profile", "text")


def issues_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofread(_docs(spark, sf_dir), X.rules(spark), X.evidence(spark), X.arithmetic_verdicts)


def longs(df: DataFrame, *keep: str) -> DataFrame:
    """Integer columns as bigint, so both engines print the same types."""
    return df.select(*[
        F.col(f.name).cast("bigint").alias(f.name) if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f.name)
        for f in df.schema.fields])


def paragraph_ranges(spark, d):
    return longs(paragraphs(_docs(spark, d)))


O["paragraph_ranges"] = S.with_plain(S.DOCS, S.PARAS, select="SELECT doc_id, pno - 1 AS paragraph_no, s AS char_start, e AS char_end FROM paras")


def _chunk_rows(df):
    return longs(df.select("doc_id", "chunk_index", "source_start", "source_end", "core_start", "core_end", F.md5("text").alias("digest")))


def chunk_documents(spark, d):
    return _chunk_rows(chunk(_docs(spark, d)))


def chunk_long_paragraphs(spark, d):
    return _chunk_rows(chunk(X.documents(spark, d, newlines="").select("doc_id", "analysis_profile", "text")))


_CHUNK_SELECT = "SELECT doc_id, chunk_index, source_start, source_end, core_start, core_end, md5(text) AS digest FROM chunks"
O["chunk_documents"] = S.with_recursive(S.DOCS, S.CHUNKS, select=_CHUNK_SELECT)
O["chunk_long_paragraphs"] = S.with_recursive(S.LONG_DOCS, S.CHUNKS, select=_CHUNK_SELECT)


def rule_candidates(spark, d):
    scanned = scan_rules(chunk(_docs(spark, d)), X.rules(spark))
    return longs(scanned.select("doc_id", "chunk_index", F.explode("candidates").alias("c")).select(
        "doc_id", "chunk_index", F.col("c.quote").alias("quote"), F.col("c.category").alias("category"),
        F.col("c.confidence").alias("confidence")))


O["rule_candidates"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, select="""
SELECT doc_id, chunk_index, needle AS quote, category, confidence::BIGINT AS confidence FROM chunks, rules WHERE contains(text, needle)""")


def many_rule_candidates(spark, d):
    """Thousands of rules at once: the template of each one that occurs in a chunk."""
    scanned = scan_rules(chunk(_docs(spark, d)), X.many_rules(spark, d))
    return longs(scanned.select("doc_id", "chunk_index", F.posexplode("candidates").alias("candidate_index", "c")).select(
        "doc_id", "chunk_index", "candidate_index", F.col("c.quote").alias("quote"), F.col("c.category").alias("category"),
        F.col("c.grammar_subtype").alias("grammar_subtype"), F.col("c.confidence").alias("confidence"), F.col("c.reason").alias("reason")))


MANY_RULES = f"""
bw AS (SELECT string_split(translate(text, '.,', '。，'), ' ') AS w FROM benchmark),
needles AS (SELECT DISTINCT needle FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS needle FROM bw UNION ALL SELECT p_name FROM part)),
many AS MATERIALIZED (SELECT row_number() OVER (ORDER BY needle) AS rule_no, needle FROM needles),
told AS (SELECT *, {S._list(K.CATEGORIES)}[rule_no % 4 + 1] AS category, CASE WHEN rule_no % 4 = 2 THEN {S._list(K.GRAMMAR_SUBTYPES)}[rule_no % 10 + 1] END AS grammar_subtype,
  rule_no % 101 AS confidence, 'rule ' || rule_no AS reason FROM many)"""

O["many_rule_candidates"] = S.with_recursive(S.DOCS, S.CHUNKS, MANY_RULES, select="""
SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY rule_no) - 1 AS candidate_index, needle AS quote, category, grammar_subtype, confidence, reason
FROM chunks, told WHERE contains(text, needle)""")


def many_rule_occurrences(spark, d):
    """Thousands of rules at once: each place of each of them, overlapping ones too, with what stands around it."""
    scanned = scan_occurrences(chunk(_docs(spark, d)), X.many_rules(spark, d))
    return longs(scanned.select("doc_id", "chunk_index", F.posexplode("candidates").alias("candidate_index", "c")).select(
        "doc_id", "chunk_index", "candidate_index", F.col("c.reason").alias("reason"), F.col("c.context_before").alias("before"), F.col("c.context_after").alias("after")))


O["many_rule_occurrences"] = S.with_recursive(S.DOCS, S.CHUNKS, MANY_RULES, """
met AS MATERIALIZED (SELECT doc_id, chunk_index, text, rule_no, needle, reason FROM chunks, told WHERE contains(text, needle)),
put AS (SELECT *, unnest(list_filter(range(1, length(text) + 1), lambda i: substring(text, i, length(needle)) = needle)) AS pos FROM met)""", select="""
SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY rule_no, pos) - 1 AS candidate_index, reason,
  substring(text, greatest(pos - 12, 1), pos - greatest(pos - 12, 1)) AS before, substring(text, pos + length(needle), 12) AS after FROM put""")


def resolved_rules(spark, d):
    """Rule templates carry no context, so an ambiguous quote vanishes."""
    out = resolve_candidates(scan_rules(chunk(_docs(spark, d)), X.rules(spark)))
    return longs(out.select("doc_id", "chunk_index", "quote", "char_start", "char_end"))


O["resolved_rules"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, select="""
SELECT doc_id, chunk_index, needle AS quote, source_start + instr(text, needle) - 1 AS char_start,
       source_start + instr(text, needle) - 1 + length(needle) AS char_end
FROM chunks, rules WHERE contains(text, needle) AND NOT contains(substring(text, instr(text, needle) + 1), needle)
 AND source_start + instr(text, needle) - 1 + length(needle) // 2 >= core_start AND source_start + instr(text, needle) - 1 + length(needle) // 2 < core_end""")


def resolved_occurrences(spark, d):
    out = resolve_candidates(scan_occurrences(chunk(_docs(spark, d)), X.rules(spark)))
    return longs(out.select("doc_id", "chunk_index", "candidate_index", "quote", "char_start", "char_end"))


O["resolved_occurrences"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, S.OCCURRENCES, select="""
SELECT doc_id, chunk_index, candidate_index, quote, char_start, char_end FROM resolved""")


def protected_quotes(spark, d):
    out = resolve_candidates(scan_occurrences(chunk(_docs(spark, d)), X.rules(spark)))
    return out.groupBy("analysis_profile", "category", "protected").agg(F.count(F.lit(1)).alias("quotes"))


O["protected_quotes"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, S.OCCURRENCES, S.ISSUES, select="""
SELECT analysis_profile, category, protected, count(*) AS quotes FROM flagged GROUP BY ALL""")


def protected_fragments(spark, d):
    """Every protected fragment of whole texts with all kinds of them behind, all three scenes on the same documents."""
    docs = X.woven(spark, d)
    scenes = F.array(*[F.struct(F.lit(p).alias("profile"), scene_spans(F.col("text"), p).alias("spans")) for p in K.PROFILES])
    found = docs.select("doc_id", F.explode_outer(F.array(F.struct(common_spans(F.col("text")).alias("common"), scenes.alias("scenes")))).alias("f"))
    rows = found.select("doc_id", "f.common", F.explode_outer("f.scenes").alias("s")).select("doc_id", F.col("s.profile").alias("analysis_profile"), F.explode_outer(F.concat("common", "s.spans")).alias("s"))
    return longs(rows.where("s is not null").select("doc_id", "analysis_profile", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end")))


_WOVEN = """
kinds AS (SELECT unnest(range(0, {count})) AS kind, unnest([{texts}]) AS t),
tails AS (SELECT doc_id, string_agg('晨雾' || replace(t, '{{n}}', (doc_id % 90 + 10)::VARCHAR) || '，渔火。', '' ORDER BY i) AS tail
  FROM documents, range(0, {count}) r(i), kinds WHERE kind = (doc_id + i) % {count} GROUP BY doc_id),
chunks AS (SELECT doc_id, 0 AS chunk_index, text || tail AS text FROM documents JOIN tails USING (doc_id))""".format(
    count=len(X.WOVEN), texts=", ".join(f"'{t}'" for t, _ in X.WOVEN))

O["protected_fragments"] = S.with_plain(_WOVEN, S.SCENE_SPANS, select="""
SELECT doc_id, p AS analysis_profile, s::BIGINT AS char_start, e::BIGINT AS char_end FROM scene_spans, unnest(['general', 'academic', 'financial']) x(p) WHERE scene IS NULL OR scene = p""")

PROBES = 6


def protected_probe(spark, d):
    """Quotes all over the texts, and two in the fragments behind; half of them grammar."""
    docs = X.woven(spark, d).select("doc_id", "analysis_profile", "text", F.length("text").alias("n"))
    spans = docs.select("doc_id", "analysis_profile", "n", F.explode_outer(F.array(protected_spans(F.col("text"), F.col("analysis_profile")))).alias("spans"))
    quotes = spans.select("*", F.explode_outer(F.sequence(F.lit(0), F.lit(PROBES - 1))).alias("k"))
    place = F.when(F.col("k") < PROBES - 2, (F.col("doc_id") * 37 + F.col("k") * 211) % F.col("n")).otherwise(F.col("n") - 8 - F.col("doc_id") % 90 - F.col("k") * 3)
    start = F.greatest(place, F.lit(0)).cast("int")
    quotes = quotes.select("doc_id", "spans", "k", start.alias("start"), (start + 1 + F.col("k") % 3).cast("int").alias("end"), X.pick(["typo", "grammar"], F.col("doc_id")).alias("category"))
    return longs(flag_protected(quotes).select("doc_id", "k", "category", "protected"))


O["protected_probe"] = S.with_plain(_WOVEN, S.SCENE_SPANS, f"""
probes AS (SELECT doc_id, k, greatest(CASE WHEN k < {PROBES - 2} THEN (doc_id * 37 + k * 211) % length(text) ELSE length(text) - 8 - doc_id % 90 - k * 3 END, 0) AS st,
  ['typo', 'grammar'][doc_id % 2 + 1] AS category, ['general', 'academic', 'financial'][doc_id % 3 + 1] AS p FROM chunks, range(0, {PROBES}) r(k))""", select="""
SELECT doc_id, k, category, EXISTS (SELECT 1 FROM scene_spans s WHERE s.doc_id = probes.doc_id AND (s.scene IS NULL OR s.scene = p) AND CASE WHEN category = 'grammar'
  THEN s.s <= st AND s.e >= st + 1 + k % 3 ELSE s.s < st + 1 + k % 3 AND s.e > st END) AS protected FROM probes""")


def issue_rows(spark, d):
    out = issues_of(spark, d)
    return longs(out.select("doc_id", "chunk_index", "candidate_index", "category", "grammar_subtype", "level", "char_start",
                            "char_end", "original_text", "suggestion", "confidence"))


O["issue_rows"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, S.OCCURRENCES, S.ISSUES, select="SELECT * FROM issues")


def report_summary(spark, d):
    return longs(summarize(issues_of(spark, d), X.documents(spark, d)))


O["report_summary"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, S.OCCURRENCES, S.ISSUES, select="""
SELECT d.doc_id, count(i.doc_id) AS total, count(*) FILTER (level = 'confirmed') AS confirmed, count(*) FILTER (level = 'suspected') AS suspected,
  count(*) FILTER (category = 'typo') AS typo, count(*) FILTER (category = 'punctuation') AS punctuation,
  count(*) FILTER (category = 'grammar') AS grammar, count(*) FILTER (category = 'paragraph') AS paragraph
FROM docs d LEFT JOIN issues i USING (doc_id) GROUP BY d.doc_id""")


def issues_by_class(spark, d):
    """Flagship: issues per level and category over the whole collection."""
    return issues_of(spark, d).groupBy("level", "category").agg(
        F.count(F.lit(1)).alias("issues"), F.count_distinct("doc_id").alias("documents"))


O["issues_by_class"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, S.OCCURRENCES, S.ISSUES, select="""
SELECT level, category, count(*) AS issues, count(DISTINCT doc_id) AS documents FROM issues GROUP BY ALL""")

SEGMENTS = """
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
seg AS (
  SELECT * FROM (SELECT doc_id, line_no AS line, text AS line_text,
    coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS char_start,
    coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT + length(text) AS char_end,
    coalesce(sum(CASE WHEN regexp_matches(text, '\\S') THEN 0 ELSE 1 END) OVER w, 0)::BIGINT AS paragraph_index
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE length(line_text) > 0)"""


def _segments(spark, d):
    return build_segments(text_lines(X.spread(X.table(spark, d, "documents").select("doc_id", "text"), "doc_id")))


def line_segments(spark, d):
    return longs(_segments(spark, d).select("doc_id", "line", "char_start", "char_end", "paragraph_index"))


O["line_segments"] = S.with_plain(SEGMENTS, select="SELECT doc_id, line, char_start, char_end, paragraph_index FROM seg")


def _probe_spans(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    rows = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    start = (F.col("doc_id") * 37 + F.col("k") * 211) % F.greatest(F.col("n") - 1, F.lit(1))
    return rows.select("doc_id", start.cast("int").alias("char_start"), F.least(
        start + 1 + (F.col("doc_id") + F.col("k")) % 90, F.col("n")).cast("int").alias("char_end")).distinct()


def locate_spans(spark, d):
    out = locate(_probe_spans(spark, d), _segments(spark, d))
    return longs(out.select("doc_id", "char_start", "char_end", "line_start", "line_end", "paragraph_index", "sentence_index", "located"))


O["locate_spans"] = S.with_plain(SEGMENTS, """
spans AS (
  SELECT DISTINCT doc_id, st AS char_start, least(st + 1 + (doc_id + k) % 90, n) AS char_end FROM (
    SELECT doc_id, length(text) AS n, k, (doc_id * 37 + k * 211) % greatest(length(text) - 1, 1) AS st FROM documents, range(0, 8) t(k))),
ends AS (SELECT *, coalesce(sum(length(line_text) - length(regexp_replace(line_text, '[。！？!?]', '', 'g'))) OVER (PARTITION BY doc_id, paragraph_index ORDER BY char_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seg),
hits AS (
  SELECT p.doc_id, p.char_start, p.char_end, min_by(struct_pack(l := e.line, p := e.paragraph_index, s := e.before + length(substring(e.line_text, 1, greatest(p.char_start - e.char_start, 0)))
     - length(regexp_replace(substring(e.line_text, 1, greatest(p.char_start - e.char_start, 0)), '[。！？!?]', '', 'g'))), e.char_start) AS f, max_by(e.line, e.char_start) AS z
  FROM spans p JOIN ends e ON e.doc_id = p.doc_id AND e.char_start < p.char_end AND e.char_end > p.char_start WHERE p.char_end > p.char_start GROUP BY ALL)""", select="""
SELECT s.doc_id, s.char_start, s.char_end, h.f.l AS line_start, h.z AS line_end, h.f.p AS paragraph_index, h.f.s::BIGINT AS sentence_index, h.z IS NOT NULL AS located
FROM spans s LEFT JOIN hits h USING (doc_id, char_start, char_end)""")


def literal_edits(spark, d):
    """Typo-like corrections of part names: one character changed, dropped or added."""
    p = X.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("q"))
    at = (F.col("p_partkey") % F.length("q")).cast("int")
    kind = F.col("p_partkey") % 4
    changed = F.concat(F.substring("q", F.lit(1), at), F.when(kind == 0, F.lit("x")).when(kind == 1, F.lit("")).when(
        kind == 2, F.lit("xy")).otherwise(F.substring("q", at + 1, F.lit(1))), F.substring("q", at + 2, F.length("q")))
    edit = p.select("p_partkey", localize_edit(F.lit("typo"), F.col("q"), changed).alias("e"))
    return longs(edit.select("p_partkey", F.col("e.char_offset").alias("char_offset"), F.col("e.original_text").alias("original_text"),
                             F.col("e.suggestion").alias("suggestion")))


O["literal_edits"] = """
WITH base AS (
  SELECT p_partkey, p_name AS q, substring(p_name, 1, p_partkey % length(p_name)) || CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '' WHEN 2 THEN 'xy'
     ELSE substring(p_name, p_partkey % length(p_name) + 1, 1) END || substring(p_name, p_partkey % length(p_name) + 2) AS s FROM part),
pre AS (SELECT *, len(list_filter(range(1, least(length(q), length(s)) + 1), lambda i: substring(q, 1, i) = substring(s, 1, i))) AS p FROM base),
suf AS (SELECT *, len(list_filter(range(1, least(length(q), length(s)) - p + 1), lambda i: right(q, i) = right(s, i))) AS x FROM pre),
ok AS (SELECT *, p + x >= 4 AND (p + x) * 4 >= length(q) * 3 AND length(q) - x > p AND length(q) - x - p <= 8 AND length(s) - x - p <= 8 AS small FROM suf)
SELECT p_partkey, CASE WHEN small THEN p END AS char_offset, CASE WHEN small THEN substring(q, p + 1, length(q) - x - p) END AS original_text,
  CASE WHEN small THEN CASE WHEN length(s) - x = p THEN '删除此处的“' || substring(q, p + 1, length(q) - x - p) || '”' ELSE substring(s, p + 1, length(s) - x - p) END END AS suggestion
FROM ok"""


def issue_levels(spark, d):
    """Class merge and level decision over verdict columns derived from line items."""
    li = X.table(spark, d, "lineitem")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    rows = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("l_linenumber").cast("int").alias("candidate_index"),
        X.pick(K.CATEGORIES, F.col("l_partkey")).alias("category"),
        F.when(F.col("l_partkey") % 4 == 2, X.pick(K.GRAMMAR_SUBTYPES, F.col("l_suppkey"))).alias("grammar_subtype"),
        F.lit("quote").alias("quote"), F.lit("r").alias("reason"), F.lit("s").alias("suggestion"),
        F.lit(0).alias("char_start"), F.lit(5).alias("char_end"), (k % 101).cast("int").alias("candidate_confidence"),
        (k % 5 == 0).alias("protected"),
        F.when(k % 3 == 0, X.pick(K.CATEGORIES, k)).alias("v_category"),
        F.when((k % 3 == 0) & (k % 4 == 2), X.pick(K.GRAMMAR_SUBTYPES, k)).alias("v_grammar_subtype"),
        X.pick(["confirmed", "suspected", "confirmed", "rejected", "confirmed"], k).alias("v_verdict"),
        (k * 13 % 101).cast("int").alias("v_confidence"), F.lit("r").alias("v_reason"), F.lit("s").alias("v_suggestion"),
        F.array().cast("array<string>").alias("v_evidence_source_ids"))
    return finalize(rows, X.evidence(spark)).groupBy("category", "grammar_subtype", "level").agg(
        F.count(F.lit(1)).alias("issues"), F.sum("confidence").cast("bigint").alias("confidence"))


_CATS = "['typo','punctuation','grammar','paragraph']"
_SUBS = "[" + ",".join(f"'{s}'" for s in K.GRAMMAR_SUBTYPES) + "]"
O["issue_levels"] = f"""
WITH r AS (SELECT l_orderkey * 7 + l_linenumber AS k, {_CATS}[l_partkey % 4 + 1] AS c, CASE WHEN l_partkey % 4 = 2 THEN {_SUBS}[l_suppkey % 10 + 1] END AS s FROM lineitem),
v AS (SELECT *, k % 101 AS cc, k * 13 % 101 AS vc, CASE WHEN k % 3 = 0 THEN {_CATS}[k % 4 + 1] END AS v_c,
  CASE WHEN k % 3 = 0 AND k % 4 = 2 THEN {_SUBS}[k % 10 + 1] END AS v_s, ['confirmed','suspected','confirmed','rejected','confirmed'][k % 5 + 1] AS verdict FROM r),
m AS (SELECT *, coalesce(v_c, c) AS category, CASE WHEN v_c IS NULL THEN s ELSE v_s END AS grammar_subtype,
  v_c IS NOT NULL AND (v_c <> c OR (v_c = 'grammar' AND v_s IS DISTINCT FROM s)) AS changed FROM v WHERE verdict <> 'rejected' AND vc >= 50)
SELECT category, grammar_subtype, CASE WHEN cc >= 80 AND vc >= 80 AND verdict = 'confirmed' AND NOT changed AND category <> 'paragraph' AND k % 5 <> 0
  AND NOT (category = 'grammar' AND coalesce(grammar_subtype, '') IN ('ambiguity','illogical','word_misuse')) THEN 'confirmed' ELSE 'suspected' END AS level,
  count(*) AS issues, sum(vc)::BIGINT AS confidence FROM m GROUP BY ALL"""


def attached_evidence(spark, d):
    """Which cited works survive the category whitelist, in first-mention order."""
    li = X.table(spark, d, "lineitem")
    known = ["standard-chinese-characters-2013", "gb-t-15834-2011", "gb-t-15835-2011", "unknown"]
    ids = F.array(X.pick(known, F.col("l_partkey")), X.pick(known, F.col("l_suppkey")), X.pick(known, F.col("l_partkey")))
    refs = evidence_refs(ids, X.pick(K.CATEGORIES, F.col("l_orderkey")), X.evidence(spark))
    cited = F.array_join(F.transform(refs, lambda e: F.concat_ws("/", e["source_id"], e["revision"])), "+")
    return li.select(X.pick(K.CATEGORIES, F.col("l_orderkey")).alias("category"), cited.alias("cited")).groupBy("category", "cited").agg(
        F.count(F.lit(1)).alias("issues"))


O["attached_evidence"] = f"""
WITH k AS (SELECT {_CATS}[l_orderkey % 4 + 1] AS category, ['standard-chinese-characters-2013','gb-t-15834-2011','gb-t-15835-2011','unknown'] AS known, l_partkey % 4 + 1 AS a, l_suppkey % 4 + 1 AS b FROM lineitem)
SELECT category, CASE WHEN category = 'typo' AND (a = 1 OR b = 1) THEN 'standard-chinese-characters-2013/2013'
  WHEN category = 'punctuation' AND (a = 2 OR b = 2) THEN 'gb-t-15834-2011/GB/T 15834-2011' ELSE '' END AS cited, count(*) AS issues FROM k GROUP BY ALL"""


def gated_documents(spark, d):
    """Length and blank gate, with a lower limit so that it fires on this collection."""
    ok, rejects = gate_documents(X.table(spark, d, "documents").select("doc_id", "text"), max_chars=5_000)
    a = ok.select("doc_id", F.lit("").alias("error_code"))
    return a.unionByName(rejects.select("doc_id", "error_code"))


O["gated_documents"] = """
SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'TEXT_TOO_LONG' WHEN NOT regexp_matches(text, '\\S') THEN 'EXTRACTION_FAILED' ELSE '' END AS error_code FROM documents"""


def pasted_texts(spark, d):
    ok, rejects = ingest_text(X.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("text")), max_chars=300)
    return longs(ok.select("doc_id", "char_count", "original_name", F.lit("").alias("error_code")).unionByName(rejects.select(
        "doc_id", F.lit(None).cast("int").alias("char_count"), F.lit(None).cast("string").alias("original_name"), "error_code")))


O["pasted_texts"] = """
SELECT conv_id * 1000 + turn AS doc_id, CASE WHEN e = '' THEN length(text) END AS char_count, CASE WHEN e = '' THEN '粘贴文章.txt' END AS original_name, e AS error_code FROM (
  SELECT *, CASE WHEN NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'CONFIGURATION_INVALID' WHEN length(text) > 300 THEN 'TEXT_TOO_LONG' ELSE '' END AS e FROM conversations)"""


def source_windows(spark, d):
    docs = X.documents(spark, d).select("doc_id", "text")
    end = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") * 11 % 30_000).cast("int"))
    out = R.source_window(docs, (F.col("doc_id") * 7 % 9_000).cast("int"), end)
    return longs(out.select("doc_id", "char_start", "char_end", F.md5("text").alias("digest")))


O["source_windows"] = S.with_plain(S.DOCS, """
w AS (SELECT doc_id, text, least(doc_id * 7 % 9000, length(text)) AS a, CASE WHEN doc_id % 2 = 0 THEN doc_id * 11 % 30000 END AS e FROM docs)""", select="""
SELECT doc_id, a AS char_start, least(greatest(coalesce(e, a + 8000), a), length(text), a + 12000) AS char_end,
  md5(substring(text, a + 1, least(greatest(coalesce(e, a + 8000), a), length(text), a + 12000) - a)) AS digest FROM w""")


def missed_issues(spark, d):
    docs = X.documents(spark, d).select("doc_id", "text")
    n = F.col("doc_id")
    misses = docs.select(
        n.cast("string").alias("id"), "doc_id", F.lit(10).alias("char_start"), (11 + n % 400).cast("int").alias("char_end"),
        F.when(n % 9 == 0, F.lit("  ")).otherwise(F.lit(" 漏检 ")).alias("note"), F.lit("forged").alias("quote"))
    ok, rejects = R.validate_misses(misses, docs)
    return ok.select("id", F.md5("quote").alias("quote"), "note", F.lit("").alias("error_code")).unionByName(rejects.select(
        "id", F.lit(None).cast("string").alias("quote"), F.lit(None).cast("string").alias("note"), "error_code"))


O["missed_issues"] = S.with_plain(S.DOCS, """
m AS (SELECT doc_id, text, 1 + doc_id % 400 AS size, doc_id % 9 <> 0 AND 11 + doc_id % 400 <= length(text) AND 1 + doc_id % 400 <= 300 AS ok FROM docs)""", select="""
SELECT doc_id::VARCHAR AS id, CASE WHEN ok THEN md5(substring(text, 11, size)) END AS quote, CASE WHEN ok THEN '漏检' END AS note,
  CASE WHEN ok THEN '' ELSE 'CONFIGURATION_INVALID' END AS error_code FROM m""")


def safe_names(spark, d):
    pages = X.table(spark, d, "pages")
    return pages.select("page_id", safe_filename(F.concat("url", F.char(F.lit(7)), F.lit("x"))).alias("name"))


O["safe_names"] = """
SELECT page_id, left(replace(regexp_extract(url || chr(7) || 'x', '[^/]*$'), chr(7), ''), 180) AS name FROM pages"""


def normalized_suggestions(spark, d):
    return X.table(spark, d, "part").select("p_partkey", normalize_suggestion(F.concat("p_name", F.lit("　Ä "))).alias("norm"))


O["normalized_suggestions"] = "SELECT p_partkey, lower(regexp_replace(p_name, '\\s+', '', 'g')) || 'ä' AS norm FROM part"

for _f in (paragraph_ranges, chunk_documents, chunk_long_paragraphs, rule_candidates, many_rule_candidates, many_rule_occurrences, resolved_rules, resolved_occurrences,
           protected_quotes, protected_fragments, protected_probe, issue_rows, report_summary, issues_by_class, line_segments,
           locate_spans, literal_edits, issue_levels, attached_evidence, gated_documents, pasted_texts, source_windows,
           missed_issues, safe_names, normalized_suggestions):
    Q[_f.__name__] = _f

QUERIES, ORACLES = Q, O
