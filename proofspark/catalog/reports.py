"""Queries over report rows: filters, joins, pages, navigation, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofspark import constants as K
from proofspark.catalog import sql as S
from proofspark.catalog.text import longs
from proofspark.functions import labels as L
from proofspark.operators import report as R
from proofspark.operators.summary import summarize
from proofspark.plans import fixtures as X

Q, O = {}, {}


def registered(fn):
    Q[fn.__name__] = fn
    return fn


def _epoch(name: str):
    return F.unix_seconds(name).alias(name)


@registered
def filtered_issues(spark, d):
    out = R.filter_issues(X.line_issues(spark, d), "grammar", "confirmed", 60, "unreviewed")
    return longs(out.select("issue_id", "category", "level", "confidence"))


O["filtered_issues"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT issue_id, category, level, confidence FROM iss WHERE category = 'grammar' AND level = 'confirmed' AND confidence >= 60 AND feedback IS NULL""")


@registered
def reviewed_issues(spark, d):
    out = R.filter_issues(X.line_issues(spark, d), min_confidence=250, feedback="disputed")
    return longs(out.select("issue_id", "confidence", "feedback"))


O["reviewed_issues"] = S.with_plain(S.LINE_ISSUES, select="SELECT issue_id, confidence, feedback FROM iss WHERE confidence >= 100 AND feedback = 'disputed'")


@registered
def active_jobs(spark, d):
    return R.filter_status(X.jobs(spark, d), "active").select("job_id", "status")


O["active_jobs"] = S.with_plain(S.JOBS, select=f"SELECT job_id, status FROM jobs WHERE status NOT IN {S.TERMINAL}")


@registered
def own_jobs(spark, d):
    """Owner isolation: what one user may see of the whole table."""
    return R.for_user(X.jobs(spark, d), 7).select("job_id", "user_id", "status")


O["own_jobs"] = S.with_plain(S.JOBS, select="SELECT job_id, user_id, status FROM jobs WHERE user_id = 7")


@registered
def name_search(spark, d):
    return R.search_name(X.documents(spark, d), " _1").select("doc_id", "original_name")


O["name_search"] = S.with_plain(S.DOCS, select="SELECT doc_id, original_name FROM docs WHERE contains(lower(original_name), '_1')")


@registered
def content_available(spark, d):
    return R.with_content_available(X.stored_documents(spark, d), X.as_of()).select("doc_id", "content_available")


O["content_available"] = S.with_plain(S.STORED, select=f"""
SELECT doc_id, coalesce(storage_path IS NOT NULL AND input_expires_at > {S.AS_OF}, false) AS content_available FROM stored""")


@registered
def issues_with_feedback(spark, d):
    """Every reviewer's verdicts at once, then one reviewer's."""
    base = X.line_issues(spark, d)
    feedback = base.where("feedback is not null").select("issue_id", F.col("user_id"), F.col("feedback").alias("verdict"))
    return R.with_feedback(base.drop("feedback"), feedback).select("issue_id", "user_id", "feedback")


O["issues_with_feedback"] = S.with_plain(S.LINE_ISSUES, select="SELECT issue_id, user_id, feedback FROM iss")


def _misses(spark, d):
    i = X.line_issues(spark, d)
    return i.where("n % 3 = 0").select(
        F.col("doc_id").alias("report_id"), "user_id", F.col("issue_id").alias("id"), (F.col("pk") % 5).alias("created_at"),
        F.when(F.col("sk") % 9 == 0, "other").otherwise(F.col("category")).alias("category"), "char_start", "char_end",
        F.lit("q*").alias("quote"), F.lit("n_1").alias("note"))


_MISSES = """
misses AS (SELECT doc_id AS report_id, user_id, issue_id AS id, pk % 5 AS created_at, CASE WHEN sk % 9 = 0 THEN 'other' ELSE category END AS category, char_start, char_end FROM iss WHERE n % 3 = 0)"""


def _reports(spark, d):
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), (F.col("o_orderkey") % 150).alias("user_id"))


@registered
def reports_with_misses(spark, d):
    out = R.with_misses(_reports(spark, d), _misses(spark, d))
    return out.select("report_id", F.array_join(F.transform("missed_issues", lambda m: m["id"]), ",").alias("missed"))


O["reports_with_misses"] = S.with_plain(S.LINE_ISSUES, _MISSES, select="""
SELECT o_orderkey AS report_id, coalesce(string_agg(id, ',' ORDER BY created_at, id), '') AS missed FROM orders
LEFT JOIN misses ON report_id = o_orderkey AND misses.category <> 'other' GROUP BY o_orderkey""")


@registered
def job_history(spark, d):
    return R.history(X.jobs(spark, d), X.documents(spark, d)).select("job_id", "status", "original_name", "document_format")


O["job_history"] = S.with_plain(S.DOCS, S.JOBS, select="""
SELECT job_id, status, original_name, document_format FROM jobs JOIN docs ON docs.doc_id = document_id AND docs.user_id = jobs.user_id""")


@registered
def history_last_page(spark, d):
    """A page far past the end becomes the last one."""
    rows, _, _ = R.history_page(R.filter_status(X.jobs(spark, d), "all"), page=10_000_000, size=20)
    return rows.select("job_id", "status")


O["history_last_page"] = S.with_plain(S.JOBS, """
mine AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, job_id DESC) AS r, count(*) OVER () AS n FROM jobs)""", select="""
SELECT job_id, status FROM mine WHERE (r - 1) // 20 = (n - 1) // 20""")


@registered
def history_pages(spark, d):
    return longs(R.history_pages(X.jobs(spark, d)).select("job_id", "user_id", "page_no"))


O["history_pages"] = S.with_plain(S.JOBS, select="""
SELECT job_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id DESC) - 1) // 20 + 1 AS page_no FROM jobs""")


@registered
def history_totals(spark, d):
    return R.history_totals(X.jobs(spark, d))


O["history_totals"] = S.with_plain(S.JOBS, select=f"""
SELECT user_id, count(*) AS total, count(*) FILTER (status NOT IN {S.TERMINAL}) AS active, count(*) FILTER (status = 'completed') AS completed,
 count(*) FILTER (status = 'failed') AS failed FROM jobs GROUP BY user_id""")


@registered
def latest_jobs(spark, d):
    """Newest jobs per user; a small n so that it cuts at every scale."""
    return R.latest_per_user(X.jobs(spark, d), 5).select("job_id", "user_id", _epoch("created_at"))


O["latest_jobs"] = S.with_plain(S.JOBS, select="""
SELECT job_id, user_id, epoch(created_at)::BIGINT AS created_at FROM jobs
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY jobs.created_at DESC, job_id DESC) <= 5""")


@registered
def issue_pages(spark, d):
    return longs(R.issue_pages(X.line_issues(spark, d), size=2).select("issue_id", "page_no"))


O["issue_pages"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT issue_id, (row_number() OVER (PARTITION BY doc_id ORDER BY char_start, char_end, issue_id) - 1) // 2 + 1 AS page_no FROM iss""")


@registered
def adjacent_issues(spark, d):
    return R.adjacent_issues(X.line_issues(spark, d)).select("issue_id", "previous_id", "next_id")


O["adjacent_issues"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT issue_id, coalesce(lag(issue_id) OVER w, last_value(issue_id) OVER z) AS previous_id, coalesce(lead(issue_id) OVER w, first_value(issue_id) OVER z) AS next_id FROM iss
WINDOW w AS (PARTITION BY doc_id ORDER BY char_start, char_end, issue_id), z AS (PARTITION BY doc_id ORDER BY char_start, char_end, issue_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")


@registered
def next_unreviewed(spark, d):
    return R.next_unreviewed(X.line_issues(spark, d)).select("issue_id", "next_unreviewed_id")


O["next_unreviewed"] = S.with_plain(S.LINE_ISSUES, """
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY char_start, char_end, issue_id) AS p FROM iss)""", select="""
SELECT a.issue_id, arg_min(b.issue_id, CASE WHEN b.p > a.p THEN b.p ELSE b.p + 1000 END) AS next_unreviewed_id
FROM r a LEFT JOIN r b ON a.doc_id = b.doc_id AND b.feedback IS NULL AND b.p <> a.p GROUP BY a.issue_id""")


@registered
def review_progress(spark, d):
    docs = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return longs(R.review_progress(X.line_issues(spark, d), docs))


O["review_progress"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT o_orderkey AS doc_id, count(issue_id) AS total, count(feedback) AS reviewed,
  CASE WHEN count(issue_id) = 0 THEN 100 ELSE floor(count(feedback) * 100 / count(issue_id) + 0.5) END::BIGINT AS percent
FROM orders LEFT JOIN iss ON iss.doc_id = o_orderkey GROUP BY o_orderkey""")


@registered
def line_summary(spark, d):
    docs = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return longs(summarize(X.line_issues(spark, d), docs))


O["line_summary"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT o_orderkey AS doc_id, count(issue_id) AS total, count(*) FILTER (level = 'confirmed') AS confirmed, count(*) FILTER (level = 'suspected') AS suspected,
  count(*) FILTER (category = 'typo') AS typo, count(*) FILTER (category = 'punctuation') AS punctuation, count(*) FILTER (category = 'grammar') AS grammar,
  count(*) FILTER (category = 'paragraph') AS paragraph FROM orders LEFT JOIN iss ON iss.doc_id = o_orderkey GROUP BY o_orderkey""")


@registered
def report_sources(spark, d):
    docs = X.stored_documents(spark, d).withColumn("char_count", F.length("text"))
    out = R.report_source(X.reports(spark, d), X.jobs(spark, d), docs, X.as_of())
    return longs(out.select("report_id", "original_name", "char_count", F.md5("text").alias("digest")))


O["report_sources"] = S.with_plain(S.STORED, S.JOBS, S.REPORTS, select=f"""
SELECT r.report_id, original_name, length(text) AS char_count, md5(text) AS digest FROM reports r JOIN jobs j USING (job_id) JOIN stored s ON s.doc_id = j.document_id WHERE r.expires_at > {S.AS_OF}""")


@registered
def idempotency_violations(spark, d):
    k = F.col("o_orderkey")
    reqs = X.table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("user_id"), F.when(k % 7 == 0, F.lit("  ")).when(k % 11 == 0, F.lit(" short ")).otherwise(
            F.concat(F.lit(" key-"), F.lpad((k % 3000).cast("string"), 6, "0"))).alias("idempotency_key"),
        (k % 3000 % 100).alias("document_id"), F.lit(1).alias("model_profile_id"), X.pick(K.PROFILES, k).alias("analysis_profile"))
    return R.check_idempotency(reqs)[1]


O["idempotency_violations"] = """
WITH r AS (SELECT o_custkey % 50 AS user_id, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'short' ELSE 'key-' || lpad((o_orderkey % 3000)::VARCHAR, 6, '0') END AS idempotency_key FROM orders)
SELECT DISTINCT user_id, idempotency_key, 'CONFIGURATION_INVALID' AS error_code FROM r WHERE length(idempotency_key) < 8
UNION ALL
SELECT user_id, idempotency_key, 'CONFLICT' FROM r WHERE length(idempotency_key) >= 8 GROUP BY ALL HAVING count(DISTINCT (k % 3000 % 100, k % 3)) > 1"""


def _located(spark, d):
    i = X.line_issues(spark, d)
    n = F.col("n")
    location = F.struct(
        F.lit("pdf").alias("document_format"), F.when(n % 4 < 2, (F.col("pk") % 9 + 1).cast("int")).alias("page"),
        F.when((n % 4 == 1) & (F.col("sk") % 2 == 0), (F.col("pk") % 9 + 2).cast("int")).alias("page_end"),
        F.when(n % 4 < 3, (F.col("pk") % 30 + 1).cast("int")).alias("line_start"),
        F.when(n % 4 < 3, (F.col("sk") % 30 + 1).cast("int")).alias("line_end"),
        F.when(n % 8 == 3, n).alias("paragraph_index"), F.when(F.col("pk") % 2 == 0, n).alias("sentence_index"),
        "char_start", "char_end", F.lit("q").alias("quote"))
    return i.withColumn("location", location)


_LABEL = """
loc AS (SELECT *, CASE WHEN n % 4 < 2 THEN pk % 9 + 1 END AS page, CASE WHEN n % 4 = 1 AND sk % 2 = 0 THEN pk % 9 + 2 END AS page_end, CASE WHEN n % 4 < 3 THEN pk % 30 + 1 END AS a,
  CASE WHEN n % 4 < 3 THEN sk % 30 + 1 END AS b FROM iss),
lab AS (SELECT *, CASE
  WHEN page IS NOT NULL AND page_end <> page THEN concat('第 ', page, ' 页第 ', a, ' 行至第 ', page_end, ' 页第 ', b, ' 行')
  WHEN page IS NOT NULL AND page_end IS NULL AND b < a THEN concat('第 ', page, ' 页第 ', a, ' 行起（结束页未记录）')
  WHEN page IS NOT NULL AND a = b THEN concat('第 ', page, ' 页，第 ', a, ' 行')
  WHEN page IS NOT NULL THEN concat('第 ', page, ' 页，第 ', a, '–', b, ' 行')
  WHEN a = b THEN concat('第 ', a, ' 行') WHEN a IS NOT NULL THEN concat('第 ', a, '–', b, ' 行')
  WHEN n % 8 = 3 AND pk % 2 = 0 THEN concat('第 ', n + 1, ' 段，第 ', n + 1, ' 句') WHEN n % 8 = 3 THEN concat('第 ', n + 1, ' 段')
  ELSE concat('字符 ', char_start, '–', char_end) END AS place FROM loc)"""


@registered
def location_labels(spark, d):
    return _located(spark, d).select("issue_id", L.location_label(F.col("location")).alias("place"))


O["location_labels"] = S.with_plain(S.LINE_ISSUES, _LABEL, select="SELECT issue_id, place FROM lab")


@registered
def class_labels(spark, d):
    i = X.line_issues(spark, d)
    return i.select(L.category_label(F.col("category")).alias("category"), L.subtype_label(F.col("grammar_subtype")).alias("subtype"),
                    L.level_label(F.col("level")).alias("level"), L.feedback_label(F.col("feedback")).alias("feedback")).groupBy(
        "category", "subtype", "level", "feedback").agg(F.count(F.lit(1)).alias("issues"))


def _map(labels: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


O["class_labels"] = S.with_plain(S.LINE_ISSUES, select=f"""
SELECT {_map(K.CATEGORY_LABELS, 'category')} AS category, {_map(K.SUBTYPE_LABELS, 'grammar_subtype')} AS subtype, {_map(K.LEVEL_LABELS, 'level')} AS level,
 {_map(K.FEEDBACK_LABELS, 'feedback')} AS feedback, count(*) AS issues FROM iss GROUP BY ALL""")


@registered
def escaped_markdown(spark, d):
    pages = X.table(spark, d, "pages")
    return pages.select("page_id", F.md5(L.markdown_text(F.col("html"))).alias("text"), L.markdown_url(F.concat("url", F.lit(" <é>"))).alias("url"))


O["escaped_markdown"] = r"""
SELECT page_id, md5(replace(replace(replace(regexp_replace(html, '([!-/:-@\[-`{-~])', '\\\1', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), '  ' || chr(10) || '  ')) AS text,
 replace(url, ' ', '%20') || '%20%3Cé%3E' AS url FROM pages"""


def markdown_inputs(spark, d):
    o = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.concat(F.lit("a_"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("original_name"),
        F.lit(9).alias("char_count"), X.pick(K.PROFILES, F.col("o_orderkey")).alias("analysis_profile"), F.lit("anthropic").alias("provider_kind"),
        F.lit("m-1").alias("candidate_model"), F.lit("m2").alias("verifier_model"), F.lit("v7").alias("prompt_version"),
        F.lit("").alias("reference_version"), F.lit("1.0").alias("analyzer_version"), F.lit(False).alias("reference_profile"))
    issues = _located(spark, d).select(
        F.col("doc_id").alias("report_id"), "issue_id", "category", "level", "location", F.lit("o*").alias("original_text"),
        F.lit("r").alias("reason"), F.lit("s").alias("suggestion"), "confidence", "feedback",
        F.when(F.col("pk") % 2 == 0, F.array(F.struct(F.lit("x").alias("source_id"), F.lit("T").alias("title"), F.lit("R-1").alias("revision"),
                                                      F.lit("http://h/a b").alias("source_url")))).otherwise(
            F.array().cast("array<struct<source_id:string,title:string,revision:string,source_url:string>>")).alias("evidence_refs"))
    return o, issues, _misses(spark, d)


@registered
def markdown_reports(spark, d):
    return R.render_markdown(*markdown_inputs(spark, d)).select("report_id", F.md5("markdown").alias("digest"))


O["markdown_reports"] = S.with_plain(S.LINE_ISSUES, _LABEL, _MISSES, f"""
parts AS (SELECT doc_id, string_agg('## ' || p || '. ' || t, '' ORDER BY p) AS body, count(*) FILTER (level = 'confirmed') AS c, count(*) FILTER (level = 'suspected') AS s FROM (
  SELECT doc_id, level, row_number() OVER (PARTITION BY doc_id ORDER BY char_start, char_end, issue_id) AS p, concat({_map(K.CATEGORY_LABELS, 'category')}, ' · ', {_map(K.LEVEL_LABELS, 'level')},
    E'\\n\\n- 位置：', place, E'\\n- 原文：o\\\\*\\n- 原因：r\\n- 建议：s\\n- 置信度：', confidence, E'%\\n', CASE WHEN feedback IS NOT NULL THEN concat('- 作者审核：', {_map(K.FEEDBACK_LABELS, 'feedback')}, chr(10)) ELSE '' END,
    CASE WHEN pk % 2 = 0 THEN E'- 参考资料（具体条款未核对）：\\n  - [T R\\\\-1](<http://h/a%20b>)\\n' ELSE '' END, chr(10)) AS t FROM lab) GROUP BY doc_id),
missed AS (SELECT report_id, string_agg(concat('- ', category, '（字符 ', char_start, '–', char_end, E'）：q\\\\*；说明：n\\\\_1\\n'), '' ORDER BY created_at, id) AS m FROM misses WHERE category <> 'other' GROUP BY report_id)""", select=f"""
SELECT o_orderkey AS report_id, md5(concat(E'# 问题报告\\n\\n- 文件：a\\\\_', o_orderkey, E'\\\\.txt\\n- 正文字数：9\\n- 分析场景：', {_map(K.PROFILE_LABELS, "['general','academic','financial'][o_orderkey % 3 + 1]")},
  E'\\n- 正式问题：', coalesce(c, 0), E'\\n- 疑似问题：', coalesce(s, 0), E'\\n- 模型接口：anthropic\\n- 模型：m\\\\-1 / m2\\n- 提示词版本：v7\\n- 依据库版本：旧报告未记录\\n- 分析器版本：1\\\\.0\\n- 模型配置：未经验证\\n\\n',
  coalesce(body, E'未发现需要报告的问题。最终结果仍请作者自行审核。\\n\\n'), CASE WHEN m IS NOT NULL THEN concat(E'## 作者标记的漏检\\n\\n', m, chr(10)) ELSE '' END, E'> 以上为辅助建议，最终判断由作者完成。\\n')) AS digest
FROM orders LEFT JOIN parts ON doc_id = o_orderkey LEFT JOIN missed ON report_id = o_orderkey""")


@registered
def broken_constraints(spark, d):
    i = X.line_issues(spark, d).select(
        "issue_id", (F.col("qty") * 3).alias("confidence"), F.when(F.col("pk") % 50 == 0, "odd").otherwise(F.col("category")).alias("category"),
        "level", "char_start", (F.col("char_end") - F.when(F.col("sk") % 20 == 0, 1).otherwise(0)).alias("char_end"))
    return R.violations(i, "issue_id")


O["broken_constraints"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT issue_id, 'confidence_range' AS problem FROM iss WHERE qty * 3 > 100 UNION ALL SELECT issue_id, 'category_domain' FROM iss WHERE pk % 50 = 0
UNION ALL SELECT issue_id, 'span_order' FROM iss WHERE sk % 20 = 0""")

QUERIES, ORACLES = Q, O
