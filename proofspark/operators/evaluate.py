"""Scoring issues against adjudicated labels."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from proofspark import constants as K
from proofspark.functions.text import valid_document_id
from proofspark.operators.summary import COUNTERS, counters

# Views a prediction takes part in. The strict ones compare category and subtype, the last one grammar as a whole.
VIEWS = ["confirmed", "suspected", "all", "grammar_any"]


def _with_views(df: DataFrame, level: Column | None) -> DataFrame:
    """Rows repeated for the matching problems they belong to (four at most)."""
    levels = F.array(F.lit("confirmed"), F.lit("suspected")) if level is None else F.array(level)
    views = F.concat(levels, F.array(F.lit("all")), F.when(
        F.col("category") == "grammar", F.array(F.lit("grammar_any"))).otherwise(F.array().cast("array<string>")))
    return df.select("*", F.explode(views).alias("view")).withColumn(
        "sub", F.when(F.col("view") == "grammar_any", F.lit("")).otherwise(F.coalesce("grammar_subtype", F.lit(""))))


KLASS = ["doc_id", "view", "category", "sub"]


def _sides(pred: DataFrame, gold: DataFrame, pred_extra: list, gold_extra: list) -> DataFrame:
    span = [*KLASS, "char_start", "char_end"]
    return _with_views(pred, F.col("level")).select(*span, F.lit(True).alias("predicted"), *pred_extra).unionByName(
        _with_views(gold, None).select(*span, F.lit(False).alias("predicted"), *gold_extra))


def _with_islands(spans: DataFrame) -> DataFrame:
    """Spans that no chain of overlaps connects get different islands within their class."""
    order = W.partitionBy(*KLASS).orderBy("char_start", "char_end")
    reach = F.max("char_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn(
        "fresh", F.when(F.coalesce(F.col("char_start") < reach, F.lit(False)), 0).otherwise(1)
    ).withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("fresh")


def _edges(placed: DataFrame, extra: list[str]) -> DataFrame:
    side = [*KLASS, "island"]

    def half(predicted: bool, mark: str) -> DataFrame:
        rows = placed.where(F.col("predicted") == predicted)
        return rows.select(*side, F.col("char_start").alias(f"{mark}s"), F.col("char_end").alias(f"{mark}e"),
                           *[F.col(c).alias(f"{mark}_{c}") for c in extra])

    overlap = F.least("pe", "ge") - F.greatest("ps", "gs")
    return half(True, "p").join(half(False, "g"), side).withColumn("overlap", overlap).where(
        (F.col("overlap") > 0) & (F.col("overlap") * 2 >= F.col("pe") - F.col("ps"))
        & (F.col("overlap") * 2 >= F.col("ge") - F.col("gs")))


def match_edges(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs that may match: same class, overlapping by at least half of either length.

    ``pred`` has (doc_id, pred_id, category, grammar_subtype, level, char_start, char_end), ``gold`` the same with
    gold_id and no level. A pair is only sought inside an island, not across the whole document.
    """
    both = _sides(pred, gold, [F.col("pred_id").alias("id")], [F.col("gold_id").alias("id")])
    return _edges(_with_islands(both), ["id"]).select(
        *KLASS, "island", F.col("p_id").alias("pred_id"), F.col("g_id").alias("gold_id"), "overlap")


def _pairable(spans: np.ndarray) -> tuple[dict, dict, dict]:
    """(neighbours of each predicted span, supply, demand) from rows (start, end, predicted, n)."""
    supply = {(s, e): n for s, e, predicted, n in spans.tolist() if predicted}
    demand = {(s, e): n for s, e, predicted, n in spans.tolist() if not predicted}
    golds = sorted(demand)
    starts = [g[0] for g in golds]
    longest = max(g[1] - g[0] for g in golds)
    near: dict = {}
    for ps, pe in supply:
        hits = []
        for gs, ge in golds[bisect_right(starts, ps - longest):bisect_left(starts, pe)]:
            overlap = min(pe, ge) - max(ps, gs)
            if overlap > 0 and overlap * 2 >= pe - ps and overlap * 2 >= ge - gs:
                hits.append((gs, ge))
        if hits:
            near[(ps, pe)] = hits
    return near, supply, demand


def largest_matching(spans: np.ndarray) -> int:
    """Size of a maximum one-to-one matching among rows (start, end, predicted, n).

    Equal spans are interchangeable and serve as often as they occur. Units move along shortest alternating paths
    until no path is left.
    """
    near, supply, demand = _pairable(spans)
    used: dict = {g: {} for g in demand}
    total = 0
    while True:
        came, back = {}, {}
        frontier = [p for p in near if supply[p] > 0]
        seen, goal = set(frontier), None
        while frontier and goal is None:
            following = []
            for p in frontier:
                for g in near[p]:
                    if g in came:
                        continue
                    came[g] = p
                    if demand[g] > 0:
                        goal = g
                        break
                    for other, units in used[g].items():
                        if units > 0 and other not in seen:
                            seen.add(other)
                            back[other] = g
                            following.append(other)
                if goal is not None:
                    break
            frontier = following
        if goal is None:
            return total
        forward, given_up = [], []
        p, g = came[goal], goal
        forward.append((p, g))
        while p in back:
            g = back[p]
            given_up.append((p, g))
            p = came[g]
            forward.append((p, g))
        units = min([supply[p], demand[goal], *[used[g][q] for q, g in given_up]])
        for q, g in forward:
            used[g][q] = used[g].get(q, 0) + units
        for q, g in given_up:
            used[g][q] -= units
        supply[p] -= units
        demand[goal] -= units
        total += units


def _matching_size(spans: Column) -> Column:
    def solve(batch: pd.Series) -> pd.Series:
        return batch.map(lambda flat: None if flat is None else largest_matching(np.asarray(flat, dtype=np.int64).reshape(-1, 4)))

    return F.pandas_udf(solve, "bigint", F.PandasUDFType.SCALAR)(spans)


def class_counts(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """predicted, labelled and matched per (doc_id, view, category, sub).

    Copies of a span are counted before anything is grouped, and an island brings its spans together, never the pairs
    between them. One prediction against one label is plain arithmetic; only islands whose spans compete go through
    Python, many per batch.
    """
    spans = _sides(pred, gold, [], []).groupBy(*KLASS, "char_start", "char_end", "predicted").agg(F.count(F.lit(1)).alias("n"))

    def side(predicted: bool, column: str) -> Column:
        return F.when(F.col("predicted") == predicted, F.col(column))

    islands = _with_islands(spans).groupBy(*KLASS, "island").agg(
        F.count(side(True, "n")).alias("preds"), F.count(side(False, "n")).alias("golds"),
        F.coalesce(F.sum(side(True, "n")), F.lit(0)).alias("predicted"), F.coalesce(F.sum(side(False, "n")), F.lit(0)).alias("labelled"),
        F.max(side(True, "char_start")).alias("ps"), F.max(side(True, "char_end")).alias("pe"),
        F.max(side(False, "char_start")).alias("gs"), F.max(side(False, "char_end")).alias("ge"),
        F.flatten(F.collect_list(F.array(*[F.col(c).cast("bigint") for c in ("char_start", "char_end", "predicted", "n")]))).alias("flat"))
    overlap = F.least("pe", "ge") - F.greatest("ps", "gs")
    fits = (overlap > 0) & (overlap * 2 >= F.col("pe") - F.col("ps")) & (overlap * 2 >= F.col("ge") - F.col("gs"))
    duel = (F.col("preds") == 1) & (F.col("golds") == 1)
    solved = islands.select(
        *KLASS, "predicted", "labelled",
        F.when(duel, F.when(fits, F.least("predicted", "labelled")).otherwise(F.lit(0))).alias("plain"),
        _matching_size(F.when(~duel & (F.col("preds") > 0) & (F.col("golds") > 0), F.col("flat"))).alias("contested"))
    return solved.groupBy(*KLASS).agg(
        F.sum("predicted").alias("predicted"), F.sum("labelled").alias("labelled"),
        F.sum(F.coalesce("plain", "contested", F.lit(0))).alias("matched"))


def _slices() -> list[tuple]:
    """(slice, view, category or None for the language categories, subtype or None)."""
    return [
        ("confirmed", "confirmed", None, None), ("suspected_only", "suspected", None, None),
        ("combined", "all", None, None),
        *[(f"category:{c}", "all", c, None) for c in K.CATEGORIES],
        ("grammar_detection", "grammar_any", "grammar", None),
        *[(f"subtype:{s}", "all", "grammar", s) for s in K.GRAMMAR_SUBTYPES],
    ]


def slice_spine(spark: SparkSession) -> DataFrame:
    """Every slice, whether or not anything falls into it."""
    return spark.createDataFrame([(i, s[0]) for i, s in enumerate(_slices())], "slice_no int, slice string")


def _slice_rows(counts: DataFrame, value: str) -> Column:
    """The slices a (view, category, sub) count adds to."""
    hits = []
    for name, view, category, subtype in _slices():
        inside = F.col("view") == view
        inside = inside & ((F.col("category") == category) if category else (F.col("category") != "paragraph"))
        if subtype:
            inside = inside & (F.col("sub") == subtype)
        hits.append(F.when(inside, F.lit(name)))
    return F.explode(F.array_compact(F.array(*hits)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def with_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from true_positive, false_positive, false_negative."""
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return (
        counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0.0, F.lit(0.0)).otherwise(
            F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    )


def slice_counts(classes: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """true/false positives and false negatives per slice (and ``extra`` keys) from class counts."""
    extra = extra or []
    return classes.select("*", _slice_rows(classes, "matched").alias("slice")).groupBy(*extra, "slice").agg(
        F.sum("matched").alias("true_positive"),
        F.sum(F.col("predicted") - F.col("matched")).alias("false_positive"),
        F.sum(F.col("labelled") - F.col("matched")).alias("false_negative"),
    )


def evaluate(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per slice with counts, precision, recall and f1; empty slices have zeros."""
    counts = slice_counts(class_counts(pred, gold))
    spine = slice_spine(pred.sparkSession)
    filled = spine.join(counts, "slice", "left").na.fill(0, ["true_positive", "false_positive", "false_negative"])
    return with_metrics(filled).drop("slice_no")


def length_band(chars: Column) -> Column:
    return (
        F.when(chars.between(500, 2_000), "500-2000").when(chars.between(2_001, 10_000), "2001-10000")
        .when(chars.between(10_001, 50_000), "10001-50000").otherwise("outside")
    )


BANDS = ["500-2000", "2001-10000", "10001-50000"]


def strata(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Sample size and combined metrics per scenario and length band; empty cells stay visible."""
    spark = docs.sparkSession
    cells = spark.createDataFrame([(p, b) for p in K.PROFILES for b in BANDS], "analysis_profile string, band string")
    banded = docs.select("doc_id", "analysis_profile", length_band(F.col("char_count")).alias("band")).where(F.col("band") != "outside")
    sizes = banded.groupBy("analysis_profile", "band").agg(F.count(F.lit(1)).alias("documents"))
    combined = classes.where((F.col("view") == "all") & (F.col("category") != "paragraph")).groupBy("doc_id").agg(
        *[F.sum(c).alias(c) for c in ("predicted", "labelled", "matched")])
    scored = banded.join(combined.hint("merge"), "doc_id").groupBy("analysis_profile", "band").agg(
        F.sum("matched").alias("true_positive"), F.sum(F.col("predicted") - F.col("matched")).alias("false_positive"),
        F.sum(F.col("labelled") - F.col("matched")).alias("false_negative"))
    keys = ["analysis_profile", "band"]
    filled = cells.join(sizes, keys, "left").join(scored, keys, "left").na.fill(
        0, ["documents", "true_positive", "false_positive", "false_negative"])
    return with_metrics(filled)


def release_gate(runs: DataFrame) -> DataFrame:
    """Per configuration and run: does this run pass, and did the one before it pass as well?"""
    passed = (
        (F.col("confirmed_precision") >= 0.90) & (F.col("combined_recall") >= 0.90) & (F.col("suspected_precision") >= 0.70)
    )
    by_config = W.partitionBy("configuration").orderBy("run_no")
    return runs.withColumn("passed", passed).withColumn(
        "released", F.col("passed") & F.coalesce(F.lag("passed").over(by_config), F.lit(False)))


def coverage_gaps(gold: DataFrame, reports: DataFrame) -> DataFrame:
    """Labelled documents without a report, and report or job ids used more than once."""
    missing = gold.join(reports, "document_id", "left_anti").select(
        F.lit("missing_report").alias("problem"), F.col("document_id").alias("subject"))
    labelled = reports.join(gold.select("document_id"), "document_id", "left_semi")
    out = missing
    for column, problem in (("report_id", "reused_report"), ("job_id", "reused_job")):
        reused = labelled.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            F.lit(problem).alias("problem"), F.col(column).cast("string").alias("subject"))
        out = out.unionByName(reused)
    return out


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def gold_violations(gold: DataFrame) -> DataFrame:
    """Problems of labelled documents (document_id, issues array); any row fails the load."""
    issue = F.col("i")
    per_issue = gold.select("document_id", F.explode("issues").alias("i")).select(
        "document_id", F.explode(F.array_compact(F.array(
            F.when(~F.coalesce(issue["char_start"] < issue["char_end"], F.lit(False)), "invalid_range"),
            F.when((issue["category"] == "grammar") != issue["grammar_subtype"].isNotNull(), "subtype_mismatch"),
            F.when(~F.coalesce(issue["category"].isin(K.CATEGORIES), F.lit(False)), "unknown_category"),
            F.when(~issue["grammar_subtype"].isin(K.GRAMMAR_SUBTYPES), "unknown_subtype"),
        ))).alias("problem"))
    bad_id = gold.where(~F.coalesce(valid_document_id(F.col("document_id")), F.lit(False))).select(
        "document_id", F.lit("invalid_document_id").alias("problem"))
    twice = duplicates(gold, ["document_id"]).select("document_id", F.lit("duplicate_document_id").alias("problem"))
    return per_issue.unionByName(bad_id).unionByName(twice).distinct()


def validate_reports(reports: DataFrame, issues: DataFrame, gold: DataFrame, schema_tag: str) -> DataFrame:
    """(document_id, problem) for every broken contract.

    ``reports``: document_id, schema, complete, char_count and the seven counters. ``issues``: document_id, issue_id,
    category, grammar_subtype, level, char_start, char_end, original_text, quote. ``gold``: document_id, char_end.
    """
    recount = issues.groupBy("document_id").agg(*[c.alias(f"r_{n}") for c, n in zip(counters(), COUNTERS)])
    joined = reports.join(recount, "document_id", "left").na.fill(0, [f"r_{n}" for n in COUNTERS])
    differs = F.lit(False)
    for name in COUNTERS:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"r_{name}"))
    heads = joined.select("document_id", F.explode(F.array_compact(F.array(
        F.when((F.col("schema") != schema_tag) | ~F.col("complete"), "not_a_complete_report"),
        F.when(differs, "summary_mismatch"),
    ))).alias("problem"))
    bounds = reports.select("document_id", "char_count")
    body = issues.join(bounds, "document_id").select("document_id", F.explode(F.array_compact(F.array(
        F.when(F.col("char_start") >= F.col("char_end"), "invalid_range"),
        F.when(F.col("char_end") > F.col("char_count"), "out_of_bounds"),
        F.when((F.col("original_text") != F.col("quote"))
               | (F.length("original_text") != F.col("char_end") - F.col("char_start")), "quote_mismatch"),
        F.when((F.col("category") == "grammar") != F.col("grammar_subtype").isNotNull(), "subtype_mismatch"),
    ))).alias("problem"))
    twice = duplicates(issues, ["document_id", "issue_id"]).select("document_id", F.lit("duplicate_issue_id").alias("problem"))
    beyond = gold.join(bounds, "document_id").where(F.col("char_end") > F.col("char_count")).select(
        "document_id", F.lit("gold_out_of_bounds").alias("problem"))
    return heads.unionByName(body).unionByName(twice).unionByName(beyond).distinct()
