"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, types as T

from proofspark.llm.common import whole

#: Labelled rows that the model is fitted on, at most: those with the smallest digests of their ids.
FITTED = 40_000
#: Weight of the pooled covariance and of the spherical one in each class.
POOLED, SPHERICAL = 0.1, 0.01
THRESHOLD = 0.7

_CLASSES = np.zeros((256, 6))
for _k, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\v\f", b".,;:'\"()-?", range(128, 256))):
    _CLASSES[list(_members), _k] = 1
N_FEATURES = 22


def _share(part: float, whole: float) -> float:
    """A share with its variance evened out."""
    return math.asin(math.sqrt(min(1.0, max(0.0, part / whole)))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; all finite, also of an empty one."""
    text = text or ""
    words, data = text.split(), text.encode()
    n, size = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digit, white, mark, other = (counts @ _CLASSES).tolist()
    letters = upper + lower + other
    p = counts[counts > 0] / max(1, size)
    tally = Counter(words)
    top = tally.most_common(1)[0][1] if n else 0
    pairs, triples = len(set(zip(words, words[1:]))), len(set(zip(words, words[1:], words[2:])))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    plain = sum(map(str.isalpha, tally))
    title = sum(map(str.istitle, tally))
    return [
        math.log1p(n), math.log1p(size), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        _share(upper, letters), _share(digit, size), _share(white, size), _share(mark, size),
        _share(size - letters - digit - white - mark, size), _share(other, letters),
        float(-(p * np.log2(p)).sum()), math.log((len(tally) + 1) / (n + 1)), _share(top, n), _share(same, max(1, n - 1)),
        _share(max(0, n - 1 - pairs), n), _share(max(0, n - 2 - triples), n), _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(len(lines)) - math.log1p(n), _share(plain, len(tally)), _share(title, len(tally)),
        _share(counts[124], max(1, n)), _share(counts[33] + counts[35] + counts[36] + counts[37] + counts[38] + counts[42], size),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes, and the line that turns differences into scores."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = [((x - m) @ f.T) for m, f in zip(self.means, self.factors)]
        density = [-0.5 * (y * y).sum(1) - d for y, d in zip(z, self.logs)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the difference is damped, since statistics outside both classes say little."""
        return 1 / (1 + np.exp(-np.clip(self.slope * _damped(self.difference(x)) + self.shift, -30, 30)))


def _damped(d: np.ndarray) -> np.ndarray:
    return np.sign(d) * np.log1p(np.abs(d))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, spherical: float = SPHERICAL) -> Discriminant:
    """Fit on statistics ``x`` and labels ``y``; a class without rows gets the other's shape and scores stay at the labels' share."""
    y = y.astype(bool)
    if not y.any() or y.all():
        d = x.shape[1] if x.ndim == 2 else N_FEATURES
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0.0, 0.0 if not len(y) else 30.0 if y.all() else -30.0)
    means = np.stack([x[~y].mean(0), x[y].mean(0)])
    centred = np.where(y[:, None], x - means[1], x - means[0])
    spread = centred.std(0) + 1e-3
    covs = [np.cov(centred[c] / spread, rowvar=False, bias=True) for c in (~y, y)]
    common = (covs[0] * (~y).sum() + covs[1] * y.sum()) / len(y)
    factors, logs = [], []
    for cov in covs:
        cov = (1 - pooled) * cov + pooled * common
        cov = (1 - spherical) * cov + spherical * np.trace(cov) / len(cov) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(factor) / spread)
        logs.append(np.log(np.diag(factor)).sum())
    model = Discriminant(means, np.stack(factors), np.array(logs))
    d, w = _damped(model.difference(x)), np.zeros(2)
    for _ in range(50):  # logistic line by Newton steps, lightly penalised
        q = 1 / (1 + np.exp(-np.clip(w[0] * d + w[1], -30, 30)))
        g = np.array([((y - q) * d).sum() - 1e-3 * w[0], (y - q).sum()])
        v = q * (1 - q) + 1e-9
        h = np.array([[(v * d * d).sum() + 1e-3, (v * d).sum()], [(v * d).sum(), v.sum()]])
        w += np.clip(np.linalg.solve(h, g), -1, 1)
    model.slope, model.shift = max(0.0, float(w[0])), float(w[1])
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([statistics(x) for x in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("quality")], ["x", "quality"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = FITTED) -> Discriminant:
    """Fit on the labelled rows of ``docs`` for which ``learn`` holds, ``most`` of them at most. Rows with a null id or label are not learned from."""
    digest = F.xxhash64("doc_id")
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(digest, "doc_id").limit(most))
    # at most FITTED narrow rows: a bounded broadcast, so texts stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality").select("text", "quality")
    got = rows.mapInArrow(_measure, "x array<double>, quality int").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, N_FEATURES)
    y = got["quality"].to_numpy()
    order = np.lexsort((y, *x.T))  # the same model whatever the order in which rows arrive
    return fit(x[order], y[order])


def _scorer(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0)
            x = np.array([statistics(t) for t in pa.compute.struct_field(rows, "text").to_pylist()], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([rows, pa.array(model.score(x))], ["_row", "_score"])

    return run


def scored(docs: DataFrame, model: Discriminant) -> DataFrame:
    """(_row, _score) of every row of ``docs``: all its columns and the score of its whole text, in one scan without a shuffle."""
    rows = docs.select(whole(docs))
    return rows.mapInArrow(_scorer(model), T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only whole texts are looked at.

    Labels are learned from rows that are not held out, or those of ``learn``. Empty and null texts get a score as well;
    a null id is not held out; repeated rows are repeated; other columns are ignored.
    """
    model = train(docs, labels, ~held_out(F.col("doc_id")) if learn is None else learn)
    out = scored(docs.select("doc_id", "text"), model).select("_row.doc_id", "_score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all their columns, without those whose score is below the threshold."""
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    return scored(docs, model).where(F.col("_score") >= THRESHOLD).select("_row.*")
