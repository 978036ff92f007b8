import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofspark import constants as K
from proofspark.operators import evaluate as E

PRED = "doc_id long, pred_id int, category string, grammar_subtype string, level string, char_start int, char_end int"
GOLD = "doc_id long, gold_id int, category string, grammar_subtype string, char_start int, char_end int"


def slices(spark, pred, gold):
    p = spark.createDataFrame([(d, i, c, s, lv, a, b) for i, (d, c, s, lv, a, b) in enumerate(pred)], PRED)
    g = spark.createDataFrame([(d, i, c, s, a, b) for i, (d, c, s, a, b) in enumerate(gold)], GOLD)
    return {r.slice: (r.true_positive, r.false_positive, r.false_negative) for r in E.evaluate(p, g).collect()}


def fits(p, g):
    o = min(p[1], g[1]) - max(p[0], g[0])
    return o > 0 and 2 * o >= p[1] - p[0] and 2 * o >= g[1] - g[0]


def plain_matching(preds, golds):
    owner = {}

    def place(i, tried):
        for j, g in enumerate(golds):
            if j in tried or not fits(preds[i], g):
                continue
            tried.add(j)
            if j not in owner or place(owner[j], tried):
                owner[j] = i
                return True
        return False

    return sum(place(i, set()) for i in range(len(preds)))


def test_largest_matching_random():
    random.seed(5)
    for _ in range(3000):
        def spans():
            return [(s, s + random.randint(1, 7)) for s in (random.randint(0, 14) for _ in range(random.randint(1, 12)))]

        preds, golds = spans(), spans()
        packed = [(*p, 1, preds.count(p)) for p in set(preds)] + [(*g, 0, golds.count(g)) for g in set(golds)]
        assert E.largest_matching(np.array(packed)) == plain_matching(preds, golds)


def test_reassignment_beats_greedy_order(spark):
    # the longer overlap would take the only label the second prediction can use
    got = slices(spark, [(1, "typo", None, "confirmed", 0, 10), (1, "typo", None, "suspected", 2, 8)],
                 [(1, "typo", None, 1, 9), (1, "typo", None, 0, 14)])
    assert got["combined"] == (2, 0, 0)
    assert got["confirmed"] == (1, 0, 1) and got["suspected_only"] == (1, 0, 1)


def test_slices(spark):
    got = slices(
        spark,
        [(1, "grammar", "collocation", "confirmed", 0, 4), (1, "paragraph", None, "suspected", 50, 60), (2, "typo", None, "confirmed", 0, 2),
         (2, "typo", None, "confirmed", 0, 2)],
        [(1, "grammar", "word_order", 0, 4), (1, "paragraph", None, 52, 60), (2, "typo", None, 0, 2), (3, "punctuation", None, 0, 1)])
    assert got["combined"] == (1, 2, 2)
    assert got["grammar_detection"] == (1, 0, 0)
    assert got["subtype:collocation"] == (0, 1, 0) and got["subtype:word_order"] == (0, 0, 1)
    assert got["category:paragraph"] == (1, 0, 0) and got["category:typo"] == (1, 1, 0)
    assert got["suspected_only"] == (0, 0, 3)
    assert len(got) == 18 and got["subtype:illogical"] == (0, 0, 0)


def test_random_documents_against_plain_matching(spark):
    random.seed(9)
    pred, gold = [], []
    for d in range(40):
        for _ in range(random.randint(0, 10)):
            s = random.randint(0, 30)
            pred.append((d, random.choice(["typo", "punctuation"]), None, random.choice(K.LEVELS), s, s + random.randint(1, 8)))
        for _ in range(random.randint(0, 10)):
            s = random.randint(0, 30)
            gold.append((d, random.choice(["typo", "punctuation"]), None, s, s + random.randint(1, 8)))
    got = slices(spark, pred, gold)
    for name, levels in (("confirmed", ["confirmed"]), ("suspected_only", ["suspected"]), ("combined", K.LEVELS)):
        tp = sum(plain_matching([(p[4], p[5]) for p in pred if p[0] == d and p[1] == c and p[3] in levels],
                                [(g[3], g[4]) for g in gold if g[0] == d and g[1] == c]) for d in range(40) for c in ("typo", "punctuation"))
        assert got[name] == (tp, sum(p[3] in levels for p in pred) - tp, len(gold) - tp)


def test_prediction_order_does_not_matter(spark):
    random.seed(1)
    pred = [(1, "typo", None, "confirmed", s, s + 4) for s in (0, 1, 2, 3, 5, 6)]
    gold = [(1, "typo", None, s, s + 5) for s in (0, 2, 4)]
    want = slices(spark, pred, gold)["combined"]
    random.shuffle(pred)
    assert slices(spark, pred, gold)["combined"] == want


@pytest.mark.parametrize("runs, released", [([True, True], [False, True]), ([True, False, True], [False, False, False]), ([True, True, True], [False, True, True])])
def test_release_needs_two_runs(spark, runs, released):
    df = spark.createDataFrame([("c", i, 0.9 if ok else 0.89, 0.9, 0.7) for i, ok in enumerate(runs)],
                               "configuration string, run_no int, confirmed_precision double, combined_recall double, suspected_precision double")
    assert [r.released for r in E.release_gate(df).orderBy("run_no").collect()] == released


def test_length_bands(spark):
    df = spark.createDataFrame([(499,), (500,), (2000,), (2001,), (10001,), (50001,)], "n int")
    assert [r[0] for r in df.select(E.length_band(F.col("n"))).collect()] == ["outside", "500-2000", "500-2000", "2001-10000", "10001-50000", "outside"]
