"""Folding duplicate issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark.functions.text import let, normalize_suggestion


def _survivors(rows: Column) -> Column:
    """Fold ordered issues: overlap with an earlier survivor keeps the more confident one in its place."""

    def step(acc: Column, x: Column) -> Column:
        overlapping = F.transform(acc, lambda a: (a["s"] < x["e"]) & (x["s"] < a["e"]))

        def place(at: Column) -> Column:
            better = x["confidence"] > F.get(acc, (at - 1).cast("int"))["confidence"]
            return (
                F.when(at == 0, F.concat(acc, F.array(x)))
                .when(better, F.transform(acc, lambda a, i: F.when(i == at - 1, x).otherwise(a)))
                .otherwise(acc)
            )

        return let(F.array_position(overlapping, F.lit(True)), place)

    return F.aggregate(F.slice(rows, 2, F.size(rows) - 1), F.slice(rows, 1, 1), step)


def dedup_issues(issues: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Keep one issue per set of repeats inside ``scope`` (default: the document).

    Repeats share category, subtype and normalised suggestion and overlap a survivor. Issues that no chain of
    overlaps connects cannot meet in the fold, so a window first cuts each class into such islands, which keeps the
    folded groups as small as the overlaps are.
    """
    klass = [*(scope or ["doc_id"]), "category", "grammar_subtype", "norm"]
    order = [
        F.col("char_start"), F.col("char_end"), F.col("confidence").desc(), F.col("chunk_index"), F.col("candidate_index")
    ]
    by_class = W.partitionBy(*klass).orderBy(*order)
    reach = F.max("char_end").over(by_class.rowsBetween(W.unboundedPreceding, -1))
    entry = F.struct(
        F.col("char_start").alias("s"), F.col("char_end").alias("e"), (-F.col("confidence")).alias("rank"),
        F.col("chunk_index").alias("c"), F.col("candidate_index").alias("k"), F.col("confidence"),
        F.struct(*issues.columns).alias("row"),
    )
    return (
        issues.withColumn("norm", normalize_suggestion(F.col("suggestion")))
        .withColumn("fresh", F.when(F.coalesce(F.col("char_start") < reach, F.lit(False)), 0).otherwise(1))
        .withColumn("island", F.sum("fresh").over(by_class.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*klass, "island")
        .agg(F.array_sort(F.collect_list(entry), _by_order).alias("rows"))
        .select("doc_id", F.explode(_survivors(F.col("rows"))).alias("x"))
        .select(*["doc_id" if c == "doc_id" else f"x.row.{c}" for c in issues.columns])
    )


def _by_order(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for field in ("k", "c", "rank", "e", "s"):
        out = F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(out)
    return out


def fold_issues(issues: DataFrame) -> DataFrame:
    """Repeats first within each chunk, then across the document."""
    placed = issues.repartition("doc_id")
    return dedup_issues(dedup_issues(placed, ["doc_id", "chunk_index"]))
