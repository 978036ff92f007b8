"""Views over the given tables in the shape the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from proofspark.constants import CATEGORIES, FEEDBACK_VERDICTS, GRAMMAR_SUBTYPES, PROFILES, STATUSES, TERMINAL
from proofspark.schemas import RULES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when a scan has fewer splits than the cluster has slots; a wide scan is left alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)


#: Rows of a part, when a table is dealt out by a key.
PART_ROWS = 500_000


def dealt(df: DataFrame, key: str, lines: int = 1) -> DataFrame:
    """Rows of a table dealt out by a key, once for all steps by that key; there are more parts as the table grows.

    ``lines``: how many rows of the given tables a row stands for, where it was made of several.
    """
    parts = -(-df.count() * lines // PART_ROWS)  # told by the file footers
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str, newlines: str = "\n\n") -> DataFrame:
    """Documents with full-width stops and blank lines between paragraphs."""
    return shaped(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"), newlines)


def shaped(raw: DataFrame, newlines: str = "\n\n") -> DataFrame:
    """The same over (doc_id, source, text) rows of any origin."""
    return raw.select(
        "doc_id", (F.col("doc_id") % 150).alias("user_id"),
        F.concat_ws("_", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("original_name"),
        pick(["txt", "docx", "pdf"], F.col("doc_id")).alias("document_format"),
        pick(["general", "academic", "financial"], F.col("doc_id")).alias("analysis_profile"),
        F.replace(F.translate("text", ".,", "。，"), F.lit("\n"), F.lit(newlines)).alias("text"),
    )


#: Fragments of all protected kinds with the scene that shields them; {n} is a number of two digits.
WOVEN = [
    ("https://host{n}.test/p?k={n}", None), ("`let v{n} = 0`", None), ("$u_{n}-w$", None), ("$$\nu_{n}-w\n$$", None), ("\\(u_{n}-w\\)", None), ("[{n}]", "academic"),
    ("[{n}-9{n}]", "academic"), ("10.55{n}/z{n}", "academic"), ("{n}.25%", "financial"), ("20{n}-03-17", "financial"),
]


def woven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, analysis_profile, text): each document as it is, and behind it all kinds of fragments between words."""
    kinds, n = F.array(*[F.lit(t) for t, _ in WOVEN]), (F.col("doc_id") % 90 + 10).cast("string")
    parts = F.transform(F.sequence(F.lit(0), F.lit(len(WOVEN) - 1)), lambda i: F.concat(
        F.lit("晨雾"), F.replace(F.element_at(kinds, ((F.col("doc_id") + i) % len(WOVEN) + 1).cast("int")), F.lit("{n}"), n), F.lit("，渔火。")))
    raw = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return raw.select("doc_id", pick(["general", "academic", "financial"], F.col("doc_id")).alias("analysis_profile"), F.concat("text", F.array_join(parts, "")).alias("text"))


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of rules: every pair of neighbouring words of the benchmark passages, and every part name."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i.cast("int")), F.element_at("w", (i + 1).cast("int"))))
    words = table(spark, sf_dir, "benchmark").select(F.split(F.translate("text", ".,", "。，"), " ", -1).alias("w")).where("size(w) > 1")
    needles = words.select(F.explode(pairs).alias("needle")).union(table(spark, sf_dir, "part").select("p_name")).distinct()
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("needle"))
    category = pick(CATEGORIES, F.col("rule_no"))
    none = F.lit(None).cast("string")
    return needles.select(number.alias("rule_no"), "needle").select(
        "rule_no", "needle", category.alias("category"), F.when(category == "grammar", pick(GRAMMAR_SUBTYPES, F.col("rule_no"))).alias("grammar_subtype"),
        F.col("needle").alias("quote"), none.alias("context_before"), none.alias("context_after"), F.concat(F.lit("rule "), F.col("rule_no").cast("string")).alias("reason"),
        F.lit("other words").alias("suggestion"), (F.col("rule_no") % 101).cast("int").alias("confidence"), F.array().cast("array<string>").alias("evidence_source_ids"))


# --- fixed values: the rule table of the fixtures ---
RULE_ROWS = [
    (1, "the the", "grammar", "redundant_component", "the", 92),
    (2, "the of", "grammar", "word_order", "of the", 85),
    (3, "de la", "typo", None, "du", 95),
    (4, "der die", "grammar", "collocation", "die", 78),
    (5, "and the", "punctuation", None, "，the", 81),
    (6, "in the", "grammar", "ambiguity", "in a", 97),
    (7, "un la", "paragraph", None, "split", 70),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(no, needle, cat, sub, needle, None, None, f"rule {no}", sug, conf, []) for no, needle, cat, sub, sug, conf in RULE_ROWS],
        RULES,
    )


# --- fixed values: the citable reference works ---
EVIDENCE_ROWS = [
    ("gb-t-15834-2011", "标点符号用法", "GB/T 15834-2011",
     "https://openstd.samr.gov.cn/bzgk/std/newGbInfo?hcno=22EA6D162E4110E752259661E1A0D0A8", True),
    ("gb-t-15835-2011", "出版物上数字用法", "GB/T 15835-2011",
     "https://std.samr.gov.cn/gb/search/gbDetailed?id=71F772D7DA87D3A7E05397BE0A0AB82A", True),
    ("standard-chinese-characters-2013", "通用规范汉字表", "2013",
     "https://www.moe.gov.cn/jyb_sjzl/ziliao/A19/201306/t20130601_186002.html", True),
]


def evidence(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        EVIDENCE_ROWS, "id string, title string, revision string, source_url string, active boolean"
    )


def arithmetic_verdicts(resolved: DataFrame) -> DataFrame:
    """Deterministic stand-in for the second model pass, as ``v_*`` columns on the resolved candidates."""
    rule_no = F.regexp_extract("reason", r"\d+", 0).cast("int")
    conf = (F.lit(40) + (F.col("doc_id") * 31 + F.col("char_start") * 17 + rule_no * 7) % 61).cast("int")
    flips = (F.col("doc_id") + rule_no) % 11 == 0
    return resolved.select(
        "*",
        F.when(flips, F.lit("typo")).otherwise(F.col("category")).alias("v_category"),
        F.when(~flips, F.col("grammar_subtype")).alias("v_grammar_subtype"),
        F.when(conf < 45, "rejected").when(conf < 80, "suspected").otherwise("confirmed").alias("v_verdict"),
        conf.alias("v_confidence"), F.col("reason").alias("v_reason"), F.col("suggestion").alias("v_suggestion"),
        F.array(F.lit("standard-chinese-characters-2013"), F.lit("gb-t-15834-2011"),
                F.lit("standard-chinese-characters-2013")).alias("v_evidence_source_ids"),
    )


AS_OF_TEXT = "2001-08-02 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def line_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue per order and line number, with classes and spans by arithmetic."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = dealt(lines, "l_orderkey").groupBy(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("n")
    ).agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("int").alias("qty"))
    start = ((F.col("n") * 37 + F.col("pk")) % 500).cast("int")
    return li.select(
        F.concat_ws("-", "doc_id", "n").alias("issue_id"), "doc_id", "n", "pk", "sk", "qty",
        (F.col("doc_id") % 150).alias("user_id"), pick(CATEGORIES, F.col("pk")).alias("category"),
        F.when(F.col("pk") % 4 == 2, pick(GRAMMAR_SUBTYPES, F.col("sk"))).alias("grammar_subtype"),
        F.when(F.col("qty") >= 25, "confirmed").otherwise("suspected").alias("level"),
        start.alias("char_start"), (start + 1 + F.col("sk") % 20).cast("int").alias("char_end"),
        F.least(F.col("qty") * 2, F.lit(100)).alias("confidence"),
        F.when((F.col("doc_id") + F.col("n")) % 2 == 0, pick(FEEDBACK_VERDICTS, F.col("pk"))).alias("feedback"),
    )


def document_of(spark: SparkSession, sf_dir: str, number: Column) -> Column:
    """Some document of the whole table for each number."""
    return number % table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).scalar()


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    created = as_of() - F.make_dt_interval(mins=(k * 7 % 400).cast("int"))
    ended = pick(STATUSES, k).isin(TERMINAL)
    started = pick(STATUSES, k) != "queued"
    return o.select(
        k.alias("job_id"), (F.col("o_custkey") % 150).alias("user_id"), document_of(spark, sf_dir, k).alias("document_id"),
        pick(PROFILES, k).alias("analysis_profile"), pick(STATUSES, k).alias("status"), pick(STATUSES, k).alias("stage"),
        (k % 101).cast("int").alias("progress"), (k % 9).cast("int").alias("completed_chunks"),
        F.when(started, F.concat(F.lit("w"), (k % 10).cast("string"))).alias("worker_id"),
        F.when(started, as_of() + F.make_dt_interval(mins=(k % 5 - 2).cast("int"))).alias("lease_until"),
        created.alias("created_at"), F.when(started, created + F.expr("INTERVAL 5 MINUTES")).alias("started_at"),
        F.when(ended, created + F.make_dt_interval(mins=(k % 90 + 6).cast("int"))).alias("completed_at"),
        (created + F.expr("INTERVAL 120 MINUTES")).alias("timeout_at"),
        F.when(k % 13 == 0, "WORKER_LEASE_EXPIRED").alias("error_code"),
        F.when(pick(STATUSES, k) == "completed", k).alias("report_id"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    made = F.col("o_orderdate").cast("timestamp")
    return o.where(pick(STATUSES, F.col("o_orderkey")) == "completed").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 150).alias("user_id"),
        made.alias("created_at"), (made + F.expr("INTERVAL 180 DAYS")).alias("expires_at"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return shaped(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "user_id", "original_name", "document_format", "text",
        F.when(d % 4 != 0, F.concat(F.lit("f/"), d.cast("string"))).alias("storage_path"),
        F.when(d % 6 != 0, as_of() + F.make_dt_interval(hours=(24 - d % 72).cast("int"))).alias("input_expires_at"))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored chunks per job."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index")).select(
        k.alias("job_id"), "chunk_index", F.concat(F.lit("text "), k.cast("string")).alias("content"),
        F.when(k % 3 != 0, F.lit("{}")).alias("candidate_output"), F.when(k % 3 != 0, F.lit("[]")).alias("verifier_output"),
        F.when((k + F.col("chunk_index")) % 4 == 0, "completed").otherwise("pending").alias("status"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_returnflag") == "A", "candidate").when(F.col("l_returnflag") == "N", "verification").otherwise("repair").alias("pass"),
        pick(["openai_compatible", "openai_responses", "anthropic"], F.col("l_partkey")).alias("provider_kind"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model"),
        F.when(n % 5 != 0, (F.col("l_quantity") * 10).cast("int")).alias("prompt_tokens"),
        F.when(n % 4 != 0, F.col("l_quantity").cast("int")).alias("completion_tokens"),
        F.floor("l_extendedprice").cast("bigint").alias("duration_ms"), (1 + n % 3).cast("int").alias("attempt"),
        (F.col("l_linestatus") == "F").alias("success"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_attempts(table(spark, sf_dir, "events"))


def as_attempts(events: DataFrame) -> DataFrame:
    """Login attempts from batch or streaming event rows."""
    return events.select(
        F.col("event_id").alias("attempt_id"), F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("username"),
        (F.col("user_id") % 40).cast("string").alias("ip"), (F.col("event_type") != "error").alias("success"),
        F.col("ts").cast("timestamp").alias("attempted_at"))


def status_events(events: DataFrame) -> DataFrame:
    """Status events in the shape of the job monitor, from batch or streaming event rows."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "queued").when(kind == "click", "analyzing").when(kind == "view", "verifying")
        .when(kind == "purchase", "completed").otherwise("failed"))
    return events.select(
        F.col("user_id").alias("job_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id",
        status.alias("status"), status.alias("stage"), (F.col("event_id") % 3).cast("int").alias("progress"),
        F.lit(0).alias("completed_chunks"), F.concat(F.lit("w"), (F.col("event_id") % 10).cast("string")).alias("worker_id"))
