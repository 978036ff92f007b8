"""Gold labels, reports, usage facts and evaluation summaries as sources and sinks."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from proofspark import constants as K
from proofspark.functions.text import explode_rows, is_blank, once, whole_json
from proofspark.operators.evaluate import gold_violations
from proofspark.operators.summary import COUNTERS
from proofspark.schemas import GOLD, REPORT
from proofspark.session import written
from proofspark.sources.files import read_files
from proofspark.sources.store import KeyedStore

REPORT_SCHEMA = "report.v1"
EVALUATION_SCHEMA = "evaluation.v3"


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(gold, violations) of JSON lines; any violation means the load fails as a whole.

    Members beyond document_id and issues are refused at the top level; issues may carry more.
    """
    lines = spark.read.text(path).where(~is_blank(F.col("value")))
    opened = once(lines, ["value"], g=F.from_json("value", GOLD, {"mode": "PERMISSIVE"}), shape=F.schema_of_variant(whole_json(F.col("value"))))
    filled = F.forall("g.issues", lambda i: i["category"].isNotNull() & i["char_start"].isNotNull() & i["char_end"].isNotNull())
    known = (
        (F.size(F.json_object_keys("value")) == 2) & F.regexp_like("shape", F.lit(r"\AOBJECT<document_id: STRING, issues: ARRAY<")) & filled)
    parsed = once(opened, ["g"], known=F.coalesce(known, F.lit(False)))
    malformed = parsed.where(~F.col("known")).select(
        F.coalesce("g.document_id", F.lit("?")).alias("document_id"), F.lit("malformed_line").alias("problem"))
    gold = parsed.where("known").select("g.*")
    empty = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("?").alias("document_id"), F.lit("no_documents").alias("problem"))
    return gold, malformed.unionByName(gold_violations(gold)).unionByName(empty)


def _json_text(content: pa.Array) -> pa.Array:
    """JSON in any of its encodings, told by the first bytes; null where they don't hold text."""
    def text(value: bytes) -> str | None:
        try:
            return value.decode(json.detect_encoding(value))
        except UnicodeDecodeError:
            return None

    return pa.array([text(v) for v in content.to_pylist()], pa.string())


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports stored as <document_id>.json, in subfolders too, with document_id from the file name; absent members get their defaults.

    A file that is no JSON object has null members, an empty one no row, and a list a row for each of its items.
    """
    name = F.regexp_replace(F.regexp_extract("path", r"[^/]*\z", 0), r"\.json\z", "")
    files = read_files(spark, folder)[1].select(name.alias("document_id"), "content")
    texts = once(files, ["document_id"], text=F.arrow_udf(_json_text, "string")("content"))
    one, several = F.array(F.from_json("text", REPORT)), F.coalesce(F.from_json("text", ArrayType(StructType.fromDDL(REPORT))), F.array(F.lit(None)))
    items = F.when(F.regexp_like("text", F.lit(r"\A\s*+\[")), several).when(F.regexp_like("text", F.lit(r"\A\s*+\z")), F.slice(one, 1, 0)).otherwise(one)
    raw = explode_rows(texts, items, "at", "r", ["document_id"]).select("document_id", "r.*")
    return raw.select(
        "document_id", "schema", "report_id", "job_id", "document",
        F.col("analysis").withField("analysis_profile", F.coalesce("analysis.analysis_profile", F.lit("general")))
        .withField("reference_version", F.coalesce("analysis.reference_version", F.lit(""))).alias("analysis"),
        "summary", "issues", F.coalesce("missed_issues", F.array()).alias("missed_issues"), "complete", "generated_at")


def load_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.where("active").select("id", "title", "revision", "source_url")


def usage_rows(calls: DataFrame) -> DataFrame:
    """One usage fact per pass and repair of a chunk call.

    ``calls``: job_id, pass, provider_kind, model, prompt_tokens, completion_tokens, duration_ms, attempts, success and
    ``repair`` (struct of tokens and duration, or NULL). A repair counts as one successful attempt of its own.
    """
    facts = ["job_id", "pass", "provider_kind", "model", "prompt_tokens", "completion_tokens", "duration_ms", "attempt", "success"]
    main = calls.select(*[F.col("attempts").alias("attempt") if f == "attempt" else F.col(f) for f in facts])
    repairs = calls.where(F.col("repair").isNotNull()).select(
        "job_id", F.lit("repair").alias("pass"), "provider_kind", "model", "repair.prompt_tokens", "repair.completion_tokens",
        "repair.duration_ms", F.lit(1).alias("attempt"), F.lit(True).alias("success"))
    return main.unionByName(repairs)


def assemble_reports(heads: DataFrame, issues: DataFrame, generated_at: Column) -> DataFrame:
    """One complete report per head row (doc_id, report_id, job_id, document, analysis) with its ordered issues.

    A report nests the issues of one document, which the length gate bounds.
    """
    order = F.struct(F.col("char_start").alias("s"), F.col("char_end").alias("e"), F.col("issue_id").alias("k"))
    location = F.struct(*[F.col(c) for c in (
        "document_format", "page", "page_end", "line_start", "line_end", "paragraph_index", "sentence_index", "char_start",
        "char_end")], F.col("original_text").alias("quote"))
    issue = F.struct(
        F.col("issue_id").alias("id"), "category", "grammar_subtype", "level", location.alias("location"), "original_text",
        "reason", "suggestion", "confidence", "evidence_refs", F.lit(None).cast("string").alias("feedback"))
    nested = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), issue.alias("i")))).alias("n"))
    joined = heads.join(nested.hint("merge"), "doc_id", "left").withColumn(
        "issues", F.coalesce(F.transform("n", lambda x: x["i"]), F.array()))
    items = F.col("issues")

    def having(field: str, value: str) -> Column:
        return F.size(F.filter(items, lambda i: i[field] == value))

    counts = {"total": F.size(items)}
    counts.update({level: having("level", level) for level in K.LEVELS})
    counts.update({category: having("category", category) for category in K.CATEGORIES})
    return joined.select(
        "doc_id", F.lit(REPORT_SCHEMA).alias("schema"), "report_id", "job_id", "document", "analysis",
        F.struct(*[counts[c].alias(c) for c in COUNTERS]).alias("summary"), "issues", F.lit(True).alias("complete"),
        generated_at.alias("generated_at"))


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("doc_id", "job_id", F.to_json(F.struct(*[c for c in reports.columns if c != "doc_id"])).alias("content"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Store one row per job, whole or not at all; writing the same jobs again replaces them."""
    KeyedStore(reports.sparkSession, path, "job_id").replace(reports)


def stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """The reports that count, one per job."""
    return KeyedStore(spark, path, "job_id").read()


def _replace_partitions(staged: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``staged`` has rows of; rows are gathered by partition, so each gets few files."""
    staged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def purge_stored(ids: DataFrame, path: str, partition: str, columns: list[str]) -> None:
    """Null ``columns`` in the rows of a stored table whose key is in the only column of ``ids``.

    The keys alone are read to find the partitions that hold such rows; all others are neither read nor written. Tables
    partitioned by the day of creation expire day by day. The list of partitions is the only thing that reaches the driver.
    """
    spark, key = ids.sparkSession, ids.columns[0]
    ids = written(ids.distinct(), "purge-ids")
    stored = spark.read.parquet(path)
    touched = [row[0] for row in stored.select(key, partition).join(ids, key, "left_semi").select(partition).distinct().collect()]
    if not touched:
        return
    marked = stored.where(F.col(partition).isin(touched)).join(ids.withColumn("_purge", F.lit(True)), key, "left")
    emptied = marked.select(*[
        F.when(F.col("_purge").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])
    _replace_partitions(written(emptied, "purge-stage"), path, partition)


def evaluation_summary(metrics: DataFrame, documents: int | Column) -> DataFrame:
    """The metrics of all slices as one JSON document; the number of slices is fixed."""
    number = F.struct(
        "precision", "recall", "f1", F.struct("true_positive", "false_positive", "false_negative").alias("counts"))
    by_name = metrics.agg(F.map_from_entries(F.collect_list(F.struct("slice", number.alias("m")))).alias("m"))

    def group(prefix: str, names: list[str]) -> Column:
        return F.struct(*[F.col("m")[f"{prefix}:{n}"].alias(n) for n in sorted(names)])

    return by_name.select(F.to_json(F.struct(
        F.lit(EVALUATION_SCHEMA).alias("schema"), F.lit(documents).alias("documents"),
        F.array(*[F.lit(c) for c in K.CATEGORIES if c != "paragraph"]).alias("language_categories"),
        *[F.col("m")[n].alias(n) for n in ("confirmed", "suspected_only", "combined")],
        group("category", K.CATEGORIES).alias("combined_by_category"), F.col("m")["grammar_detection"].alias("grammar_detection"),
        group("subtype", K.GRAMMAR_SUBTYPES).alias("combined_by_grammar_subtype"))).alias("value"))


def write_eval(metrics: DataFrame, documents: int, path: str) -> None:
    evaluation_summary(metrics, documents).coalesce(1).write.mode("overwrite").text(path)
