"""Reading, filtering, paging, navigating and exporting reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark import constants as K
from proofspark.functions import labels as L
from proofspark.functions.text import trim_unicode
from proofspark.operators.ranking import newest_first
from proofspark.operators.summary import COUNTERS, counters


def for_user(df: DataFrame, user_id) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def filter_issues(
    issues: DataFrame, category: str | None = None, level: str | None = None, min_confidence: int = 0,
    feedback: str | None = None,
) -> DataFrame:
    """Issues of a category, level, least confidence and review state (``unreviewed`` or a verdict)."""
    if category is not None and category not in K.CATEGORIES:
        raise ValueError("CONFIGURATION_INVALID: category")
    if level is not None and level not in K.LEVELS:
        raise ValueError("CONFIGURATION_INVALID: level")
    if feedback not in (None, "all", "unreviewed", *K.FEEDBACK_VERDICTS):
        raise ValueError("CONFIGURATION_INVALID: feedback")
    out = issues.where(F.col("confidence") >= min(min_confidence, 100))
    if category:
        out = out.where(F.col("category") == category)
    if level:
        out = out.where(F.col("level") == level)
    if feedback == "unreviewed":
        out = out.where(F.col("feedback").isNull())
    elif feedback in K.FEEDBACK_VERDICTS:
        out = out.where(F.col("feedback") == feedback)
    return out


def filter_status(jobs: DataFrame, status: str = "all") -> DataFrame:
    if status not in ("all", "active", *K.TERMINAL):
        raise ValueError("CONFIGURATION_INVALID: status")
    if status == "all":
        return jobs
    if status == "active":
        return jobs.where(~F.col("status").isin(K.TERMINAL))
    return jobs.where(F.col("status") == status)


def search_name(df: DataFrame, query: str, column: str = "original_name") -> DataFrame:
    """Literal, case-insensitive substring search; `%` and `_` mean themselves."""
    needle = query.strip()
    if len(needle) > 100:
        raise ValueError("CONFIGURATION_INVALID: search")
    return df.where(F.contains(F.lower(column), F.lower(F.lit(needle))))


def source_window(df: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """char_start, char_end and text of the asked window: 8000 characters by default, 12000 at most."""
    total = F.length("text")
    at = F.least(F.greatest(start, F.lit(0)), total)
    wanted = at + 8_000 if end is None else F.coalesce(end, at + 8_000)
    until = F.least(F.greatest(wanted, at), total, at + 12_000)
    kept = [c for c in df.columns if c != "text"]
    return df.select(*kept, at.alias("char_start"), until.alias("char_end"), F.substring("text", at + 1, until - at).alias("text"))


def with_content_available(docs: DataFrame, as_of: Column) -> DataFrame:
    return docs.withColumn("content_available", F.coalesce(
        F.col("storage_path").isNotNull() & (F.col("input_expires_at") > as_of), F.lit(False)))


def with_feedback(issues: DataFrame, feedback: DataFrame, user_id=None) -> DataFrame:
    """Issues with the reader's verdict, NULL where unreviewed."""
    mine = feedback if user_id is None else for_user(feedback, user_id)
    keys = ["issue_id"] if user_id is not None else ["issue_id", "user_id"]
    return issues.join(mine.select(*keys, F.col("verdict").alias("feedback")), keys, "left")


def with_misses(reports: DataFrame, misses: DataFrame) -> DataFrame:
    """Reports with their nested missed issues in order of creation; unknown categories are dropped."""
    entry = F.struct("created_at", "id", "category", "char_start", "char_end", "quote", "note")
    nested = misses.where(F.col("category").isin(K.CATEGORIES)).groupBy("report_id", "user_id").agg(
        F.array_sort(F.collect_list(entry)).alias("missed_issues"))
    out = reports.join(nested, ["report_id", "user_id"], "left")
    return out.withColumn("missed_issues", F.coalesce("missed_issues", F.array().cast(
        nested.schema["missed_issues"].dataType)))


def history(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Jobs with the document they belong to, same owner only."""
    return jobs.join(docs.select(
        F.col("doc_id").alias("document_id"), "user_id", "original_name", "document_format"), ["document_id", "user_id"])


def history_pages(jobs: DataFrame, size: int = 20) -> DataFrame:
    """Every user's jobs with the page they appear on, newest first."""
    ranked = newest_first(jobs, ["user_id"])
    return ranked.withColumn("page_no", F.floor((F.col("rank") - 1) / size).cast("int") + 1).drop("rank")


def latest_per_user(df: DataFrame, n: int = 200, key: str = "job_id") -> DataFrame:
    """Every user's newest rows."""
    return newest_first(df, ["user_id"], key).where(F.col("rank") <= n).drop("rank")


def history_page(df: DataFrame, page: int = 1, size: int = 20) -> tuple[DataFrame, int, int]:
    """(rows, total, page): newest first; a page past the end becomes the last page."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("CONFIGURATION_INVALID: page")
    total = df.count()
    page = min(page, max(-(-total // size), 1))
    rows = df.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).offset((page - 1) * size).limit(size)
    return rows, total, page


def history_totals(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("status").isin(K.TERMINAL)).alias("active"),
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def latest(df: DataFrame, user_id, n: int = 200, key: str = "job_id") -> DataFrame:
    """A user's newest rows, as one bounded top-n."""
    return for_user(df, user_id).orderBy(F.col("created_at").desc(), F.col(key).desc()).limit(n)


def issue_page(issues: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """A page in report order; empty past the end."""
    page, size = max(page, 1), min(max(size, 1), 100)
    return issues.orderBy("char_start", "char_end", "issue_id").offset((page - 1) * size).limit(size)


def issue_pages(issues: DataFrame, key: str = "doc_id", size: int = 50) -> DataFrame:
    """Every report's issues with the page they appear on."""
    rank = F.row_number().over(_report_order(key))
    return issues.withColumn("page_no", F.floor((rank - 1) / size).cast("int") + 1)


def _report_order(key: str, reverse: bool = False) -> W:
    columns = [F.col(c) for c in ("char_start", "char_end", "issue_id")]
    return W.partitionBy(key).orderBy(*[c.desc() for c in columns] if reverse else columns)


def adjacent_issues(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """Previous and next issue in report order; both ends wrap around."""
    order = _report_order(key)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return issues.withColumn("next_id", F.coalesce(F.lead("issue_id").over(order), F.first("issue_id").over(whole))).withColumn(
        "previous_id", F.coalesce(F.lag("issue_id").over(order), F.last("issue_id").over(whole)))


def next_unreviewed(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """The next issue without feedback behind each one, wrapping around, never the issue itself."""
    order = _report_order(key)
    open_id = F.when(F.col("feedback").isNull(), F.col("issue_id"))
    # both frames grow from the partition's start, so each row adds itself once
    behind = F.last(open_id, True).over(_report_order(key, reverse=True).rowsBetween(W.unboundedPreceding, -1))
    before = F.first(open_id, True).over(order.rowsBetween(W.unboundedPreceding, -1))
    return issues.withColumn("next_unreviewed_id", F.coalesce(behind, before))


def review_progress(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """Reviewed issues and rounded percentage per document; 100 where there is nothing to review."""
    counts = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count("feedback").alias("reviewed"))
    out = docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["total", "reviewed"])
    return out.withColumn("percent", F.when(F.col("total") == 0, 100).otherwise(
        F.floor(F.col("reviewed") * 100 / F.col("total") + 0.5)).cast("int"))


def report_source(reports: DataFrame, jobs: DataFrame, docs: DataFrame, as_of: Column) -> DataFrame:
    """Name, format, size and text behind every unexpired report."""
    live = reports.where(F.col("expires_at") > as_of).select("report_id", "user_id", "job_id")
    to_doc = jobs.select("job_id", "document_id")
    source = docs.select(F.col("doc_id").alias("document_id"), "original_name", "document_format", "char_count", "text")
    return live.join(to_doc, "job_id").join(source, "document_id")


def check_idempotency(reqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a clean key, violations): keys are trimmed, 8..128 long, and always ask for the same thing."""
    key = trim_unicode(F.col("idempotency_key"))
    clean = reqs.withColumn("idempotency_key", F.when(F.length(key) > 0, key))
    bad_length = clean.where(~F.length("idempotency_key").between(8, 128)).select(
        "user_id", "idempotency_key", F.lit("CONFIGURATION_INVALID").alias("error_code")).distinct()
    asked = F.struct("document_id", "model_profile_id", "analysis_profile")
    conflict = clean.where(F.length("idempotency_key").between(8, 128)).groupBy("user_id", "idempotency_key").agg(
        F.count_distinct(asked).alias("n")).where("n > 1").select(
        "user_id", "idempotency_key", F.lit("CONFLICT").alias("error_code"))
    return clean, bad_length.unionByName(conflict)


def validate_misses(misses: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): spans inside the text, 300 characters at most, a real note; the quote is cut from the source."""
    text = docs.select("doc_id", "text")
    joined = misses.drop("quote").join(text, "doc_id")
    note = trim_unicode(F.col("note"))
    size = F.col("char_end") - F.col("char_start")
    ok = (
        (F.col("char_start") >= 0) & (size > 0) & (size <= 300) & (F.col("char_end") <= F.length("text"))
        & F.length(note).between(1, 1_000)
    )
    checked = joined.select(
        *[c for c in joined.columns if c not in ("text", "note")], note.alias("note"), F.coalesce(ok, F.lit(False)).alias("ok"),
        F.when(ok, F.substring("text", F.col("char_start") + 1, size)).alias("quote"))
    rejects = checked.where("not ok").select("id", F.lit("CONFIGURATION_INVALID").alias("error_code"))
    return checked.where("ok").drop("ok"), rejects


def _issue_markdown(i: Column) -> Column:
    refs = F.array_join(F.transform(i["evidence_refs"], lambda e: F.concat(
        F.lit("  - ["), L.markdown_text(e["title"]), F.lit(" "), L.markdown_text(e["revision"]), F.lit("](<"),
        L.markdown_url(e["source_url"]), F.lit(">)\n"))), "")
    return F.concat(
        L.category_label(i["category"]), F.lit(" · "), L.level_label(i["level"]), F.lit(K.REPORT_ISSUE["place"]),
        L.location_label(i["location"]), F.lit(K.REPORT_ISSUE["original"]), L.markdown_text(i["original_text"]),
        F.lit(K.REPORT_ISSUE["reason"]), L.markdown_text(i["reason"]), F.lit(K.REPORT_ISSUE["suggestion"]), L.markdown_text(i["suggestion"]),
        F.lit(K.REPORT_ISSUE["confidence"]), i["confidence"].cast("string"), F.lit("%\n"),
        F.when(i["feedback"].isNotNull(), F.concat(F.lit(K.REPORT_ISSUE["feedback"]), L.feedback_label(i["feedback"]), F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.size(i["evidence_refs"]) > 0, F.concat(F.lit(K.REPORT_ISSUE["references"]), refs)).otherwise(F.lit("")),
        F.lit("\n"),
    )


def render_markdown(
    reports: DataFrame, issues: DataFrame, misses: DataFrame, title: str = K.REPORT_TITLE,
    footer: str = K.REPORT_FOOTER,
) -> DataFrame:
    """(report_id, markdown): the whole report as escaped Markdown.

    ``reports``: report_id, original_name, char_count and the analysis columns. Each issue is rendered on its own row;
    a report then joins its parts in report order, bounded by one document's issues.
    """
    order = F.struct(F.col("location.char_start").alias("s"), F.col("location.char_end").alias("e"), "issue_id")
    part = _issue_markdown(F.struct(*[c for c in issues.columns]))
    parts = issues.select("report_id", F.struct(order.alias("o"), part.alias("t")).alias("p"), "level").groupBy("report_id").agg(
        F.array_sort(F.collect_list("p")).alias("parts"), F.count_if(F.col("level") == "confirmed").alias("confirmed"),
        F.count_if(F.col("level") == "suspected").alias("suspected"))
    miss_line = F.concat(
        F.lit("- "), F.col("category"), F.format_string(K.REPORT_MISS_PLACE, "char_start", "char_end"),
        L.markdown_text(F.col("quote")), F.lit(K.REPORT_MISS_NOTE), L.markdown_text(F.col("note")), F.lit("\n"))
    missed = misses.where(F.col("category").isin(K.CATEGORIES)).select(
        "report_id", F.struct("created_at", "id", miss_line.alias("t")).alias("m")).groupBy("report_id").agg(
        F.array_sort(F.collect_list("m")).alias("misses"))
    joined = reports.join(parts, "report_id", "left").join(missed, "report_id", "left").na.fill(0, ["confirmed", "suspected"])

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {K.REPORT_HEAD[label]}{K.REPORT_COLON}"), value, F.lit("\n"))

    md = L.markdown_text
    head = F.concat(
        F.lit(f"# {title}\n\n"), line("name", md(F.col("original_name"))), line("chars", F.col("char_count").cast("string")),
        line("profile", L.profile_label(F.col("analysis_profile"))),
        line("confirmed", F.col("confirmed").cast("string")), line("suspected", F.col("suspected").cast("string")),
        line("provider", md(F.col("provider_kind"))),
        line("models", F.concat(md(F.col("candidate_model")), F.lit(" / "), md(F.col("verifier_model")))),
        line("prompts", md(F.col("prompt_version"))),
        line("reference", md(F.when(F.col("reference_version") == "", F.lit(K.REPORT_NO_REFERENCE)).otherwise(F.col("reference_version")))),
        line("analyzer", md(F.col("analyzer_version"))),
        line("setup", F.when(F.col("reference_profile"), F.lit(K.REPORT_REFERENCE_SETUP)).otherwise(F.lit(K.REPORT_OTHER_SETUP))), F.lit("\n"),
    )
    body = F.when(F.col("parts").isNull(), F.lit(K.REPORT_NO_ISSUES)).otherwise(F.array_join(
        F.transform("parts", lambda p, n: F.concat(F.lit("## "), (n + 1).cast("string"), F.lit(". "), p["t"])), ""))
    tail = F.when(F.col("misses").isNotNull(), F.concat(
        F.lit(K.REPORT_MISSES), F.array_join(F.transform("misses", lambda m: m["t"]), ""), F.lit("\n"))).otherwise(F.lit(""))
    return joined.select("report_id", F.concat(head, body, tail, F.lit(f"> {footer}\n")).alias("markdown"))


def merge_issue_sets(reused: DataFrame, fresh: DataFrame) -> DataFrame:
    """Issues of reused and newly analysed chunks, ready for the document-level fold."""
    return reused.unionByName(fresh)


def violations(df: DataFrame, key: str) -> DataFrame:
    """(key, problem) for every broken column rule the table's columns are subject to."""
    rules = {
        "confidence": ("confidence_range", F.col("confidence").between(0, 100)),
        "progress": ("progress_range", F.col("progress").between(0, 100)),
        "category": ("category_domain", F.col("category").isin(K.CATEGORIES)),
        "level": ("level_domain", F.col("level").isin(K.LEVELS)),
        "verdict": ("verdict_domain", F.col("verdict").isin(K.FEEDBACK_VERDICTS)),
        "status": ("status_domain", F.col("status").isin(K.STATUSES)),
        "char_end": ("span_order", F.col("char_end") > F.col("char_start")),
    }
    broken = [F.when(~rule, F.lit(name)) for column, (name, rule) in rules.items() if column in df.columns]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("problem"))
