"""Orchard search against plain nearest centroids, rounds against plain Python, and odd tables."""

import hashlib

import numpy as np
import pytest

from proofspark.llm import orchard

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string"


def plain(rows, k, rounds, d):
    kept = [(i, np.floor(np.array(v, float) * 64).astype(np.int64)) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].astype("<i4").tobytes()))
    x, c = np.array([v for _, v in kept]), np.array([v for _, v in order[:k]])
    for turn in range(rounds + 1):
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        best = far.argmin(1)
        if turn < rounds:
            c = np.array([x[best == j].sum(0) // (best == j).sum() if (best == j).any() else c[j] for j in range(len(c))])
    near = far.min(1)
    return sorted((-1 if i is None else i, int(b), int(n), int(near[best == b].sum()), int(near.sum()), hashlib.sha256(",".join(map(str, c[b])).encode()).hexdigest()) for (i, _), b, n in zip(kept, best, near))


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_search_is_exact(spread):
    rng = np.random.default_rng(spread)
    for k in (1, 2, 7, 40):
        c = rng.integers(-spread, spread + 1, (k, 3))
        x = rng.integers(-spread, spread + 1, (500, 3))
        best, near, _ = orchard.Centroids(c).nearest(x)
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (best == far.argmin(1)).all() and (near == far.min(1)).all()  # argmin: ties to the smaller number


def test_search_prunes():
    rng = np.random.default_rng(1)
    c = rng.integers(-10_000, 10_000, (64, 2))
    x = c[rng.integers(0, 64, 2000)] + rng.integers(-30, 30, (2000, 2))
    best, _, spent = orchard.Centroids(c).nearest(x)
    assert spent < 2000 * 64 / 4 and (best == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()


def test_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 150, rng.normal(size=4).round(1).tolist()) for i in range(300)]
    rows += [(None, [0.5, -0.5, 0.25, 0.0]), (900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    rows += [(i, [0.1, 0.2, 0.3, 0.4]) for i in range(1000, 1100)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(5)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = orchard.clusters(df, k=6, components=4).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == plain(rows, 6, 3, 4)


def test_empty_and_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert orchard.clusters(none).collect() == [] and orchard.clusters(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    two = spark.createDataFrame([(1, [0.0] * 64, 0, ""), (2, [3e38] * 64, 0, "")], SCHEMA)
    got = {r.vec_id: r for r in orchard.clusters(two).collect()}
    assert {got[1].cluster, got[2].cluster} == {0, 1} and got[2].distance == 0 and got[1].inertia == 0
