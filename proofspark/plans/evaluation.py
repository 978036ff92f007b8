"""Scoring stored reports against labels, both from files: all contracts hold, or nothing is scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofspark.operators.evaluate import coverage_gaps, evaluate, validate_reports
from proofspark.operators.summary import COUNTERS
from proofspark.session import written
from proofspark.sources.tables import REPORT_SCHEMA, evaluation_summary, read_gold, read_reports


class NotScored(ValueError):
    """Labels or reports break a contract; ``problems`` has how often which one."""

    def __init__(self, problems: dict[str, int]) -> None:
        super().__init__("not scored: " + ", ".join(f"{n} {p}" for p, n in sorted(problems.items())))
        self.problems = problems


@dataclass
class Inspected:
    """Labels and predictions one row each, and every (document_id, problem) that was found."""

    gold: DataFrame
    predictions: DataFrame
    documents: DataFrame
    problems: DataFrame


def inspect_files(spark: SparkSession, gold_path: str, reports_path: str) -> Inspected:
    """Load JSON lines of labels and a folder of reports, and check them against each other.

    A labelled document without a report is a gap, not a clean text; reports of other documents are not looked at.
    """
    labels, broken = read_gold(spark, gold_path)
    labels = written(labels, "evaluation-gold")
    reports = written(read_reports(spark, reports_path).join(labels.select("document_id").distinct(), "document_id", "left_semi"), "evaluation-reports")
    gold = labels.select("document_id", F.explode("issues").alias("i")).select("document_id", "i.category", "i.grammar_subtype", "i.char_start", "i.char_end")
    issues = reports.select("document_id", F.explode("issues").alias("i")).select(
        "document_id", F.col("i.id").alias("issue_id"), "i.category", "i.grammar_subtype", "i.level", "i.location.char_start", "i.location.char_end", "i.original_text", "i.location.quote")
    readable = F.col("schema").isNotNull() & F.col("complete").isNotNull() & F.col("summary").isNotNull() & F.col("issues").isNotNull() & F.col("document").isNotNull()
    heads = reports.where(readable).select("document_id", "schema", "complete", "document.char_count", *[F.col(f"summary.{c}").alias(c) for c in COUNTERS])
    unread = reports.where(~readable).select("document_id", F.lit("unreadable_report").alias("problem"))
    gaps = coverage_gaps(labels.select("document_id").distinct(), reports).select(F.col("subject").alias("document_id"), "problem")
    problems = broken.unionByName(unread).unionByName(gaps).unionByName(validate_reports(heads, issues, gold, REPORT_SCHEMA)).distinct()
    return Inspected(gold, issues, labels.select("document_id"), written(problems, "evaluation-problems"))


def evaluate_files(spark: SparkSession, gold_path: str, reports_path: str, output: str | None = None) -> DataFrame:
    """Metrics of all slices, also written as one JSON document to ``output``; raises ``NotScored`` if any contract is broken."""
    found = inspect_files(spark, gold_path, reports_path)
    problems = {r["problem"]: r["count"] for r in found.problems.groupBy("problem").count().collect()}  # a row a kind of problem
    if problems:
        raise NotScored(problems)
    metrics = evaluate(found.predictions.withColumnRenamed("document_id", "doc_id"), found.gold.withColumnRenamed("document_id", "doc_id"))
    if output:
        evaluation_summary(metrics, found.documents.count()).coalesce(1).write.mode("overwrite").text(output)
    return metrics
