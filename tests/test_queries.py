"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = {k: q for k, q in queries().items() if not (k == "pipeline" or re.match(r"op\d+_", k))}, oracle_sql()
#: Queries without SQL; their operators are tested against plain Python.
UNCHECKED: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    rows, problem, _ = check.compare(spark, con, sf_dir, QUERIES[name], ORACLES.get(name))
    assert problem == "" or (problem is None and name in UNCHECKED)
    assert rows > 0


def test_entry(spark):
    assert entry(spark).columns == ["level", "category", "issues", "documents"] and entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) - set(ORACLES) <= UNCHECKED


def test_text_stays_out_of_the_issue_shuffle(spark, sf_dir):
    """Up to the accepted issue the plan is narrow: beside spreading the scan, only issue rows are exchanged."""
    plan = QUERIES["issue_rows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_no_query_pairs_everything(spark, sf_dir):
    heavy = ["locate_spans", "matched_edges", "evaluation", "login_pressure", "releasable_documents", "deletion_plans", "frozen_configs", "chunk_reuse"]
    for name in heavy:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_retention_never_moves_texts(spark, sf_dir):
    """Below the retention queries no exchange carries a document's text, whatever Spark can broadcast."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("cancelled_documents", "expired_inputs", "report_released_documents", "completed_documents"):
            plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().explainString(mode)
            moved = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]", plan)
            assert moved and not any(re.search(r"\btext#", columns) for columns in moved), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
