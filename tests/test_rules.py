"""Rule tables of any size: the automaton against the expression, and against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from proofspark.operators import rules as R
from proofspark.plans import fixtures as X
from proofspark.schemas import RULES


def table(spark, needles):
    return spark.createDataFrame(
        [(k, n, "grammar", "ambiguity", n, "b", None, f"r{k}", "s", k % 101, ["e"] if k % 2 else []) for k, n in enumerate(needles)], RULES)


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def found(df):
    return {r.doc_id: [tuple(c) for c in r.candidates] for r in df.collect()}


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_automaton_equals_expression(spark, every, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choices("ab，😀", k=n))
    needles = [word(rng.randint(1, 4)) for _ in range(20)] + ["a", "a", None, "\\E", "aa"] + ([] if every else [""])
    rows = [word(rng.randint(1, 60)) for _ in range(60)] + ["aaaa", "x\\Ey", "", None, "😀"]
    rules, chunks = table(spark, needles), texts(spark, rows)
    want = found(R.scan_occurrences(chunks, rules) if every else R.scan_rules(chunks, rules))
    got = found(R.scan_many(chunks, rules, every_occurrence=every, most=most))
    blank = {k for k, t in enumerate(rows) if not t}
    assert {k: v for k, v in got.items() if k not in blank} == {k: v for k, v in want.items() if k not in blank}
    assert all(got[k] == [] for k in blank)


def test_many_rules_take_one_pass(spark):
    """Beyond a few rules the plan holds no rule, one scan of the texts, and only texts and candidates meet Python."""
    needles = [f"needle {k:05d}" for k in range(5000)]
    chunks = texts(spark, [f"a needle {k:05d} and needle {(k * 7) % 5000:05d}." for k in range(300)])
    out = R.scan_occurrences(chunks, table(spark, needles))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "needle" not in plan
    got = found(out)
    assert all(sorted(c[2] for c in got[k]) == sorted([needles[k], needles[k * 7 % 5000]]) for k in range(300))
    assert got[5][0][3:5] == ("a ", " and needle ")


def test_no_rules(spark):
    rules = spark.createDataFrame([], RULES)
    assert found(R.scan_rules(texts(spark, ["a"]), rules)) == {0: []}
    assert found(R.scan_many(texts(spark, ["a"]), rules, every_occurrence=True)) == {0: []}


def test_many_rules_of_the_tables(spark, sf_dir):
    rules = X.many_rules(spark, sf_dir)
    assert rules.count() > 1000 and rules.select("rule_no").distinct().count() == rules.count() == rules.select("needle").distinct().count()
    assert rules.agg(F.max("rule_no")).first()[0] == rules.count()


def test_a_task_holds_one_lot(spark, monkeypatch):
    """Several lots are one call of Python, which reads them from the shared folder one by one."""
    needles = [f"needle {k:05d}" for k in range(600)]
    chunks = texts(spark, [f"a needle {k:05d} and needle {(k * 7) % 600:05d}." for k in range(600)]).coalesce(1)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda _: pytest.fail("rules are broadcast"))
    out = R.scan_many(chunks, table(spark, needles), every_occurrence=True, most=2000)
    udfs = out._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")[1].split("\n")[0]
    assert udfs.count("scan(") == 1
    got = found(out)
    assert all([c[2] for c in got[k]] == sorted([needles[k], needles[k * 7 % 600]]) for k in range(600))
