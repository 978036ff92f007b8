"""Queries that score issues against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofspark import constants as K
from proofspark.catalog import sql as S
from proofspark.catalog.text import issues_of, longs
from proofspark.operators import evaluate as E
from proofspark.operators.summary import summarize
from proofspark.plans import fixtures as X
from proofspark.session import written

Q, O = {}, {}


def registered(fn):
    Q[fn.__name__] = fn
    return fn


def line_predictions(spark, d):
    """Predictions spaced so far apart that each can meet one label only."""
    i = X.line_issues(spark, d)
    start = (F.col("n") * 40 + F.col("sk") % 11).cast("int")
    return i.select("doc_id", F.col("n").alias("pred_id"), "category", "grammar_subtype", "level", start.alias("char_start"),
                    (start + 4 + F.col("pk") % 9).cast("int").alias("char_end"))


def line_gold(spark, d):
    i = X.line_issues(spark, d).where((F.col("pk") + F.col("n")) % 4 != 0)
    start = (F.col("n") * 40 + F.col("sk") % 11 + F.col("sk") % 4).cast("int")
    other = F.col("pk") % 17 == 0
    return i.select(
        "doc_id", F.col("n").alias("gold_id"), F.when(other, "typo").otherwise(F.col("category")).alias("category"),
        F.when(~other & (F.col("sk") % 6 == 0) & (F.col("category") == "grammar"), "ambiguity").when(~other, F.col("grammar_subtype")).alias("grammar_subtype"),
        start.alias("char_start"), (start + 4 + F.col("pk") % 9).cast("int").alias("char_end"))


_SETS = """
pred AS (SELECT doc_id, n, category, grammar_subtype, level, n * 40 + sk % 11 AS s, n * 40 + sk % 11 + 4 + pk % 9 AS e FROM iss),
gold AS (SELECT doc_id, n, CASE WHEN pk % 17 = 0 THEN 'typo' ELSE category END AS category, CASE WHEN pk % 17 = 0 THEN NULL WHEN sk % 6 = 0 AND category = 'grammar' THEN 'ambiguity' ELSE grammar_subtype END AS grammar_subtype,
  n * 40 + sk % 11 + sk % 4 AS s, n * 40 + sk % 11 + sk % 4 + 4 + pk % 9 AS e FROM iss WHERE (pk + n) % 4 <> 0),
edges AS (SELECT p.doc_id, p.n, p.level, p.category, p.grammar_subtype, p.grammar_subtype IS NOT DISTINCT FROM g.grammar_subtype AS same, least(p.e, g.e) - greatest(p.s, g.s) AS o
  FROM pred p JOIN gold g ON p.doc_id = g.doc_id AND p.n = g.n AND p.category = g.category
  WHERE least(p.e, g.e) - greatest(p.s, g.s) > 0 AND 2 * (least(p.e, g.e) - greatest(p.s, g.s)) >= p.e - p.s AND 2 * (least(p.e, g.e) - greatest(p.s, g.s)) >= g.e - g.s)"""


@registered
def matched_edges(spark, d):
    out = E.match_edges(line_predictions(spark, d), line_gold(spark, d)).where("view = 'all'")
    return longs(out.select("doc_id", "category", "pred_id", "gold_id", "overlap"))


O["matched_edges"] = S.with_plain(S.LINE_ISSUES, _SETS, select="SELECT doc_id, category, n AS pred_id, n AS gold_id, o AS overlap FROM edges WHERE same OR category <> 'grammar'")


# The slices of a report, spelled out apart from the operator: (name, view, category, subtype).
_SLICES = """
slice_list(slice, view, category, sub) AS (VALUES
  ('confirmed', 'confirmed', NULL, NULL), ('suspected_only', 'suspected', NULL, NULL), ('combined', 'all', NULL, NULL),
  ('category:typo', 'all', 'typo', NULL), ('category:punctuation', 'all', 'punctuation', NULL),
  ('category:grammar', 'all', 'grammar', NULL), ('category:paragraph', 'all', 'paragraph', NULL),
  ('grammar_detection', 'grammar_any', 'grammar', NULL),
  ('subtype:word_order', 'all', 'grammar', 'word_order'), ('subtype:collocation', 'all', 'grammar', 'collocation'),
  ('subtype:missing_component', 'all', 'grammar', 'missing_component'), ('subtype:redundant_component', 'all', 'grammar', 'redundant_component'),
  ('subtype:missing_or_redundant_component', 'all', 'grammar', 'missing_or_redundant_component'),
  ('subtype:mixed_structure', 'all', 'grammar', 'mixed_structure'), ('subtype:ambiguity', 'all', 'grammar', 'ambiguity'),
  ('subtype:illogical', 'all', 'grammar', 'illogical'), ('subtype:conjunction', 'all', 'grammar', 'conjunction'),
  ('subtype:word_misuse', 'all', 'grammar', 'word_misuse'))"""

# From pred and gold (doc_id, id, category, grammar_subtype, s, e; level in pred only) to maximum matchings. Within an
# island the labels are taken in order; each is left out or given a prediction whose bit is still free.
_MATCHING = _SLICES + """,
m_sides AS (
  SELECT doc_id, unnest(['all', level] || CASE WHEN category = 'grammar' THEN ['grammar_any'] ELSE [] END) AS view, category, grammar_subtype, s, e, id, 1 AS side FROM pred
  UNION ALL SELECT doc_id, unnest(['all', 'confirmed', 'suspected'] || CASE WHEN category = 'grammar' THEN ['grammar_any'] ELSE [] END), category, grammar_subtype, s, e, id, 0 FROM gold),
m_keyed AS (SELECT *, CASE WHEN view = 'grammar_any' THEN '' ELSE coalesce(grammar_subtype, '') END AS sub FROM m_sides),
m_apart AS (SELECT *, s >= coalesce(max(e) OVER (PARTITION BY doc_id, view, category, sub ORDER BY s, e, side, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM m_keyed),
m_placed AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, view, category, sub ORDER BY s, e, side, id) AS island FROM m_apart),
m_spots AS (SELECT *, dense_rank() OVER (ORDER BY doc_id, view, category, sub, island) AS k,
  row_number() OVER (PARTITION BY doc_id, view, category, sub, island, side ORDER BY s, e, id) AS at FROM m_placed),
m_near AS (SELECT p.k, g.at AS j, (1::HUGEINT << (p.at - 1)::INT) AS bit FROM m_spots p JOIN m_spots g ON p.k = g.k AND p.side = 1 AND g.side = 0
  WHERE least(p.e, g.e) > greatest(p.s, g.s) AND 2 * (least(p.e, g.e) - greatest(p.s, g.s)) >= p.e - p.s AND 2 * (least(p.e, g.e) - greatest(p.s, g.s)) >= g.e - g.s),
m_turns AS (SELECT k, bit, dense_rank() OVER (PARTITION BY k ORDER BY j) AS j FROM m_near),
m_choices AS (SELECT k, bit, j FROM m_turns UNION SELECT k, 0::HUGEINT, j FROM m_turns),
m_states AS (SELECT DISTINCT k, 0::BIGINT AS j, 0::HUGEINT AS mask FROM m_turns
  UNION SELECT r.k, c.j, r.mask | c.bit FROM m_states r JOIN m_choices c ON c.k = r.k AND c.j = r.j + 1 WHERE r.mask & c.bit = 0),
m_best AS (SELECT k, max(bit_count(mask)) AS matched FROM m_states GROUP BY k),
m_islands AS (SELECT k, view, category, sub, count(*) FILTER (side = 1) AS p, count(*) FILTER (side = 0) AS g FROM m_spots GROUP BY ALL),
slices AS (SELECT l.slice, coalesce(sum(matched), 0)::BIGINT AS tp, coalesce(sum(p), 0)::BIGINT AS p, coalesce(sum(g), 0)::BIGINT AS g
  FROM slice_list l LEFT JOIN (m_islands LEFT JOIN m_best USING (k)) i ON i.view = l.view AND (i.category = l.category OR l.category IS NULL AND i.category <> 'paragraph')
    AND (l.sub IS NULL OR i.sub = l.sub) GROUP BY l.slice)"""


# Where every prediction meets one label at most, the pairs themselves are the matching.
_PAIRED = _SLICES + """,
slices AS (SELECT l.slice,
  (SELECT count(*) FROM edges x WHERE (x.category = l.category OR l.category IS NULL AND x.category <> 'paragraph') AND (l.sub IS NULL OR x.grammar_subtype = l.sub)
     AND (l.view IN ('all', 'grammar_any') OR x.level = l.view) AND (l.view = 'grammar_any' OR x.same OR x.category <> 'grammar')) AS tp,
  (SELECT count(*) FROM pred x WHERE (x.category = l.category OR l.category IS NULL AND x.category <> 'paragraph') AND (l.sub IS NULL OR x.grammar_subtype = l.sub)
     AND (l.view IN ('all', 'grammar_any') OR x.level = l.view)) AS p,
  (SELECT count(*) FROM gold x WHERE (x.category = l.category OR l.category IS NULL AND x.category <> 'paragraph') AND (l.sub IS NULL OR x.grammar_subtype = l.sub)) AS g
  FROM slice_list l)"""

_METRICS = """tp AS true_positive, p - tp AS false_positive, g - tp AS false_negative,
  CASE WHEN p = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / p END AS "precision", CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / g END AS recall,
  CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (tp::DOUBLE / p) * (tp::DOUBLE / g) / (tp::DOUBLE / p + tp::DOUBLE / g) END AS f1"""


@registered
def evaluation(spark, d):
    return E.evaluate(line_predictions(spark, d), line_gold(spark, d))


O["evaluation"] = S.with_plain(S.LINE_ISSUES, _SETS, _PAIRED, select=f"SELECT slice, {_METRICS} FROM slices")


@registered
def contested_evaluation(spark, d):
    """Dense spans of one class compete for the same labels; the matching must be a maximum one."""
    i = X.line_issues(spark, d)
    start = (F.col("n") * 2 + F.col("sk") % 3).cast("int")
    pred = i.select("doc_id", F.col("n").alias("pred_id"), F.lit("typo").alias("category"), F.lit(None).cast("string").alias("grammar_subtype"),
                    "level", start.alias("char_start"), (start + 4 + F.col("pk") % 3).cast("int").alias("char_end"))
    gold = i.where("n % 3 <> 0").select(
        "doc_id", F.col("n").alias("gold_id"), F.lit("typo").alias("category"), F.lit(None).cast("string").alias("grammar_subtype"),
        (start + 1).alias("char_start"), (start + 5 + F.col("sk") % 2).cast("int").alias("char_end"))
    return E.evaluate(pred, gold)


O["contested_evaluation"] = S.with_recursive(S.LINE_ISSUES, """
pred AS (SELECT doc_id, n AS id, 'typo' AS category, NULL::VARCHAR AS grammar_subtype, level, n * 2 + sk % 3 AS s, n * 2 + sk % 3 + 4 + pk % 3 AS e FROM iss),
gold AS (SELECT doc_id, n AS id, 'typo' AS category, NULL::VARCHAR AS grammar_subtype, n * 2 + sk % 3 + 1 AS s, n * 2 + sk % 3 + 5 + sk % 2 AS e FROM iss WHERE n % 3 <> 0)""",
    _MATCHING, select=f"SELECT slice, {_METRICS} FROM slices")


@registered
def issue_evaluation(spark, d):
    """The collection's issues against labels shifted by a few characters, some of them missing."""
    issues = written(issues_of(spark, d), "issues")
    k = F.col("doc_id") + F.col("char_start")
    pred = issues.select("doc_id", F.col("issue_id").alias("pred_id"), "category", "grammar_subtype", "level", "char_start", "char_end")
    gold = issues.where(k % 4 != 0).select(
        "doc_id", F.col("issue_id").alias("gold_id"), "category", "grammar_subtype",
        (F.col("char_start") + F.col("char_start") % 3).cast("int").alias("char_start"),
        (F.col("char_end") + F.col("char_start") % 3).cast("int").alias("char_end"))
    return E.evaluate(pred, gold)


O["issue_evaluation"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, S.OCCURRENCES, S.ISSUES, """
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, char_start, char_end, category, chunk_index, candidate_index) AS id FROM issues),
pred AS (SELECT doc_id, id, category, grammar_subtype, level, char_start AS s, char_end AS e FROM numbered),
gold AS (SELECT doc_id, id, category, grammar_subtype, char_start + char_start % 3 AS s, char_end + char_start % 3 AS e FROM numbered WHERE (doc_id + char_start) % 4 <> 0)""",
    _MATCHING, select=f"SELECT slice, {_METRICS} FROM slices")


@registered
def evaluation_strata(spark, d):
    docs = X.documents(spark, d).select("doc_id", "analysis_profile", F.length("text").alias("char_count"))
    return E.strata(docs, E.class_counts(line_predictions(spark, d), line_gold(spark, d)))


O["evaluation_strata"] = S.with_plain(S.DOCS, S.LINE_ISSUES, _SETS, """
b AS (SELECT doc_id, analysis_profile, CASE WHEN length(text) BETWEEN 500 AND 2000 THEN '500-2000' WHEN length(text) BETWEEN 2001 AND 10000 THEN '2001-10000' WHEN length(text) BETWEEN 10001 AND 50000 THEN '10001-50000' END AS band FROM docs),
cells AS (SELECT * FROM (VALUES ('general'),('academic'),('financial')) a(analysis_profile), (VALUES ('500-2000'),('2001-10000'),('10001-50000')) c(band)),
tot AS (SELECT analysis_profile, band, count(*) AS documents,
  coalesce(sum((SELECT count(*) FROM edges x WHERE x.doc_id = b.doc_id AND (same OR category <> 'grammar') AND category <> 'paragraph')), 0)::BIGINT AS tp,
  coalesce(sum((SELECT count(*) FROM pred x WHERE x.doc_id = b.doc_id AND category <> 'paragraph')), 0)::BIGINT AS p,
  coalesce(sum((SELECT count(*) FROM gold x WHERE x.doc_id = b.doc_id AND category <> 'paragraph')), 0)::BIGINT AS g FROM b WHERE band IS NOT NULL GROUP BY ALL),
f AS (SELECT c.analysis_profile, c.band, coalesce(documents, 0) AS documents, coalesce(tp, 0) AS tp, coalesce(p, 0) AS p, coalesce(g, 0) AS g FROM cells c LEFT JOIN tot USING (analysis_profile, band))""",
    select=f"SELECT analysis_profile, band, documents, {_METRICS} FROM f")


@registered
def release_gates(spark, d):
    k = F.col("o_orderkey")
    runs = X.table(spark, d, "orders").select(
        F.col("o_custkey").alias("configuration"), k.alias("run_no"), ((k * 7 % 20 + 81) / 100.0).alias("confirmed_precision"),
        ((k * 11 % 20 + 81) / 100.0).alias("combined_recall"), ((k * 13 % 40 + 61) / 100.0).alias("suspected_precision"))
    return E.release_gate(runs).select("configuration", "run_no", "passed", "released")


O["release_gates"] = """
WITH r AS (SELECT o_custkey AS configuration, o_orderkey AS run_no, (o_orderkey * 7 % 20 + 81) >= 90 AND (o_orderkey * 11 % 20 + 81) >= 90 AND (o_orderkey * 13 % 40 + 61) >= 70 AS passed FROM orders)
SELECT *, passed AND coalesce(lag(passed) OVER (PARTITION BY configuration ORDER BY run_no), false) AS released FROM r"""


@registered
def coverage(spark, d):
    k = F.col("o_orderkey")
    o = X.table(spark, d, "orders")
    gold = o.select(k.cast("string").alias("document_id"))
    reports = o.where(k % 5 != 0).select(k.cast("string").alias("document_id"), F.floor(k / 2).alias("report_id"), (k - k % 7 % 2).alias("job_id"))
    return E.coverage_gaps(gold, reports)


O["coverage"] = """
WITH r AS (SELECT o_orderkey AS k, o_orderkey // 2 AS report_id, o_orderkey - o_orderkey % 7 % 2 AS job_id FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'missing_report' AS problem, o_orderkey::VARCHAR AS subject FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'reused_report', report_id::VARCHAR FROM r GROUP BY report_id HAVING count(*) > 1
UNION ALL SELECT 'reused_job', job_id::VARCHAR FROM r GROUP BY job_id HAVING count(*) > 1"""


@registered
def duplicate_lines(spark, d):
    return E.duplicates(X.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


O["duplicate_lines"] = "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"


@registered
def gold_problems(spark, d):
    i = X.line_issues(spark, d)
    k = F.col("doc_id")
    item = F.struct(
        F.when(F.col("sk") % 31 == 0, "style").otherwise(F.col("category")).alias("category"),
        F.when(F.col("pk") % 29 != 0, F.col("grammar_subtype")).alias("grammar_subtype"), "char_start",
        (F.col("char_end") - F.when(F.col("sk") % 20 == 0, 1).otherwise(0)).alias("char_end"))
    name = F.when(k % 37 == 0, F.concat(F.lit("no spaces "), k.cast("string"))).otherwise(F.floor(k / (1 + F.floor(k / 1000) % 2)).cast("bigint").cast("string"))
    gold = i.groupBy(k, name.alias("document_id")).agg(F.collect_list(item).alias("issues")).drop("doc_id")
    return E.gold_violations(gold)


O["gold_problems"] = S.with_plain(S.LINE_ISSUES, """
g AS (SELECT *, CASE WHEN doc_id % 37 = 0 THEN 'no spaces ' || doc_id ELSE (doc_id // (1 + doc_id // 1000 % 2))::VARCHAR END AS document_id, CASE WHEN sk % 31 = 0 THEN 'style' ELSE category END AS c,
  CASE WHEN pk % 29 <> 0 THEN grammar_subtype END AS s FROM iss)""", select="""
SELECT DISTINCT document_id, 'invalid_range' AS problem FROM g WHERE sk % 20 = 0
UNION SELECT document_id, 'subtype_mismatch' FROM g WHERE (c = 'grammar') <> (s IS NOT NULL)
UNION SELECT document_id, 'unknown_category' FROM g WHERE c = 'style'
UNION SELECT document_id, 'invalid_document_id' FROM g WHERE doc_id % 37 = 0
UNION SELECT document_id, 'duplicate_document_id' FROM g GROUP BY document_id HAVING count(DISTINCT doc_id) > 1""")


@registered
def report_problems(spark, d):
    i = X.line_issues(spark, d)
    k = F.col("doc_id")
    heads = summarize(i, X.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))).select(
        k.alias("document_id"), F.when(k % 41 == 0, "report.v0").otherwise("report.v1").alias("schema"), (k % 43 != 0).alias("complete"),
        F.lit(510).alias("char_count"), (F.col("total") + F.when(k % 47 == 0, 1).otherwise(0)).alias("total"),
        "confirmed", "suspected", "typo", "punctuation", "grammar", "paragraph")
    size = F.col("char_end") - F.col("char_start")
    body = i.select(
        k.alias("document_id"), F.when(k % 53 == 0, "same").otherwise(F.col("issue_id")).alias("issue_id"), "category",
        F.when(F.col("pk") % 29 != 0, F.col("grammar_subtype")).alias("grammar_subtype"), "level", "char_start", "char_end",
        F.repeat(F.lit("x"), size + F.when(F.col("sk") % 33 == 0, 1).otherwise(0)).alias("original_text"),
        F.repeat(F.lit("x"), size + F.when(F.col("sk") % 33 == 0, 1).otherwise(0)).alias("quote"))
    gold = i.select(k.alias("document_id"), (F.col("char_end") + 2).alias("char_end"))
    return E.validate_reports(heads, body, gold, "report.v1").select(F.col("document_id"), "problem")


O["report_problems"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT o_orderkey AS document_id, 'not_a_complete_report' AS problem FROM orders WHERE o_orderkey % 41 = 0 OR o_orderkey % 43 = 0
UNION SELECT o_orderkey, 'summary_mismatch' FROM orders WHERE o_orderkey % 47 = 0
UNION SELECT doc_id, 'out_of_bounds' FROM iss WHERE char_end > 510
UNION SELECT doc_id, 'quote_mismatch' FROM iss WHERE sk % 33 = 0
UNION SELECT doc_id, 'subtype_mismatch' FROM iss WHERE category = 'grammar' AND pk % 29 = 0
UNION SELECT doc_id, 'duplicate_issue_id' FROM iss WHERE doc_id % 53 = 0 GROUP BY doc_id HAVING count(*) > 1
UNION SELECT doc_id, 'gold_out_of_bounds' FROM iss WHERE char_end + 2 > 510""")

QUERIES, ORACLES = Q, O
