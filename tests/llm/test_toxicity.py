"""Neighbours and votes against plain Python, held-out labels, and odd tables."""

import numpy as np
import pytest

from proofspark.llm import toxicity as T
from proofspark.llm.queries import op13_toxicity

DOCS, LABELS = "doc_id bigint, text string, score double, terms string", "doc_id bigint, quality int, toxic int"


def random_index(rng, m, t, block):
    owner, term = np.nonzero(rng.random((m, t)) < 0.15)
    count = rng.integers(1, 4, len(owner))
    index = T.Index(rng.permutation(m) * 3, rng.integers(0, 2, m), rng.random(t) + 0.5, block)
    ids = index.ids.copy()
    weight = np.zeros((m, t))
    weight[owner, term] = np.log1p(count) * index.idf[term]
    norm = np.linalg.norm(weight, axis=1, keepdims=True)
    return index.load(owner, term, count), dict(zip(ids.tolist(), np.divide(weight, norm, out=np.zeros_like(weight), where=norm > 0)))


@pytest.mark.parametrize("block", [1, 4, 64])
def test_neighbours_are_exact(block):
    rng = np.random.default_rng(block)
    index, vectors = random_index(rng, 200, 30, block)
    for _ in range(60):
        term = np.sort(rng.choice(30, rng.integers(1, 8), replace=False))
        count = rng.integers(1, 4, len(term))
        q = np.zeros(30)
        q[term] = np.log1p(count) * index.idf[term]
        q /= np.linalg.norm(q)
        want = sorted((-round(float(v @ q), T.DECIMALS), i) for i, v in vectors.items() if i != 3 and round(float(v @ q), T.DECIMALS) > 0)[:10]
        found, sims, _ = index.nearest(term, count, 10, without=3)
        assert [int(index.ids[f]) for f in found] == [i for _, i in want]
        assert np.allclose(sims, [-s for s, _ in want], atol=2 * 10.0**-T.DECIMALS)


def test_blocks_are_skipped():
    """Examples about different things lie in blocks of their own, and a query about one thing reads few of them."""
    m = 6400
    term, owner = np.arange(m) % 100, np.arange(m)
    index = T.Index(np.arange(m), np.zeros(m, np.int64), np.ones(100)).load(owner, term, np.ones(m))
    found, sims, read = index.nearest(np.array([7]), np.array([1]), 32)
    assert len(found) == 32 and (sims == 1).all() and read <= 4 and index.blocks == 100


def test_monotone():
    x, y = np.array([0.0, 0.1, 0.2, 0.3, 0.3]), np.array([0, 1, 0, 1, 1])
    knots, levels = T.monotone(x, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all() and 0 <= levels[0] and levels[-1] <= 1


def test_terms():
    assert T.terms_of("Ab ab, 12 longer LONGEST") == {"ab": 2, "longer": 1, "longest": 1, "longe~": 2}
    assert T.terms_of(None) == T.terms_of("") == {}


def test_given_table(spark, sf_dir):
    """Neighbours of the registered query are those of a plain search in the same space; labels that are held out are not looked at."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in op13_toxicity(spark, sf_dir).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    voter, vectors = T.train(docs, labels, ~T.held_out(T.F.col("doc_id")))
    rows = {r.doc_id: dict(zip(r.terms, np.log1p(r.counts) * voter.index.idf[r.terms])) for r in vectors.collect()}
    cos = lambda a, b: sum(v * b.get(k, 0) for k, v in a.items()) / (np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) or 1)
    for doc_id, r in got.items():
        near = sorted((-round(cos(rows[doc_id], rows[i]), T.DECIMALS), i) for i in voter.index.ids.tolist() if i != doc_id)
        assert [x.doc_id for x in r.nearest] == [i for s, i in near[: T.EVIDENCE] if s < 0]
    other = labels.withColumn("toxic", T.F.when(T.held_out(T.F.col("doc_id")), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    assert {r.doc_id: r.score for r in T.toxicity(docs, other).collect()} == {d: r.score for d, r in got.items()}


def test_planted(spark):
    """Insults among invented words: held-out texts are told apart, by whole words and by words with the same beginning."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abdeghiklmnoprst"), rng.integers(2, 9)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.integers(30, 120))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.integers(len(words)), rng.choice(["dolt", "twerp", "knavish" + word(), "knavish" + word()]))
        docs.append((i, " ".join(words), 0.0, ""))
        labels.append((i, 1, int(toxic)))
    got = T.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).where("held_out").collect()
    hit = sum(r.predicted for r in got if r.doc_id % 5 == 0)
    assert hit >= 0.95 * sum(r.doc_id % 5 == 0 for r in got) and sum(r.predicted for r in got if r.doc_id % 5) <= 0.02 * len(got)


def test_odd_rows(spark):
    docs = [(None, None, 0.0, ""), (1, "", 0.0, ""), (1, "", 0.0, ""), (2, "fool " * 300_000, 0.0, ""), (3, None, 0.0, ""), (3, "fool", 0.0, "")]
    some = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], LABELS)
    assert T.toxicity(spark.createDataFrame([], DOCS), none).collect() == []
    assert {r.score for r in T.toxicity(some, none).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 0, 1), (2, None, None), (3, 1, 1), (None, 1, 1), (9, 0, 7)], LABELS)
    got = T.toxicity(some, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in T.toxicity(some, spark.createDataFrame([(1, 0, 1)], LABELS)).collect()} == {1.0}
