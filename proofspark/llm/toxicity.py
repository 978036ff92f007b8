"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, votes weighted by distance.

Terms are the words of a text, in lower case, and the beginnings of its words, which hold inflected forms together. The
space of the vectors is made of the terms that the labels show to be more frequent in toxic texts; their weights are log(1 + count) times an inverse
document frequency counted over all documents. The index has the labelled examples in blocks: a posting list a term, and
for each term and block the largest weight. A query sums the bounds of all blocks, reads blocks in falling order of their
bounds, and stops when a bound is below the k-th best similarity, so the neighbours are exactly the k nearest.

Each neighbour votes with the square of its similarity, besides a small vote for the labels' mean; leaving each example
out of its own neighbours shows how often a vote was right, and a monotone fit of that turns votes into scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from proofspark.session import written

#: Bounds of the fit: labelled rows at most (those with the smallest digests of their ids), and terms of the space.
EXAMPLES, TERMS = 20_000, 4096
#: A term needs that many examples, that many times the frequency of the other class, and that many standard errors between both logs.
LEAST, LIFT, APART = 3, 8, 3.2
#: Words remembered a task.
REMEMBERED = 400_000
BEGINNING, NEIGHBOURS, BLOCK, EVIDENCE = 5, 32, 64, 3
#: Weight of the vote for the labels' mean.
PRIOR = 0.05
THRESHOLD = 0.3
#: Similarities are compared to that many decimals, so that ties are ties on every machine; bounds get as much slack.
DECIMALS = 9

_WORD = re.compile(r"[^\W\d_]+")
SCORED = "doc_id bigint, score double, nearest array<struct<doc_id:bigint,similarity:double,toxic:int>>"
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()),
                     ("nearest", pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())])))])


def beginning(word: str) -> str | None:
    """The term that longer words with the same first letters share."""
    return word[:BEGINNING] + "~" if len(word) > BEGINNING else None


def terms_of(text: str | None) -> Counter:
    """Counts of the terms of a whole text: its words, and their beginnings."""
    words = Counter(_WORD.findall((text or "").lower()))
    starts: Counter = Counter()
    for w, n in words.items():
        if len(w) > BEGINNING:
            starts[beginning(w)] += n
    words.update(starts)
    return words


@dataclass
class Index:
    """Normalised vectors of the examples as posting lists, and the largest weight of each term and block.

    Examples lie in the order of their heaviest terms, so that those of one block are alike and most bounds are low.
    """

    ids: np.ndarray
    toxic: np.ndarray
    idf: np.ndarray
    block: int = BLOCK

    def load(self, owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> Index:
        """Postings from (example, term, count) triples."""
        m, t = len(self.ids), len(self.idf)
        self.blocks = -(-m // self.block)
        weight = np.log1p(count) * self.idf[term]
        norm = np.sqrt(np.bincount(owner, weight * weight, m))
        weight = weight / norm[owner]
        heaviest = np.lexsort((term, -weight, owner))
        first = np.searchsorted(owner[heaviest], np.arange(m + 1))
        names = np.full((m, 3), t)
        for k in range(3):
            has = first[:-1] + k < first[1:]
            names[has, k] = term[heaviest][first[:-1][has] + k]
        order = np.lexsort((self.ids, *names.T[::-1]))
        self.ids, self.toxic = self.ids[order], self.toxic[order]
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        owner = place[owner]
        order = np.lexsort((owner, term))
        self.owner, self.weight = owner[order], weight[order]
        cell = term[order] * self.blocks + self.owner // self.block
        self.starts = np.searchsorted(cell, np.arange(t * self.blocks + 1))
        self.most = np.zeros(t * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(t, self.blocks)
        return self

    def query(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = np.log1p(count) * self.idf[term]
        norm = np.sqrt((weight * weight).sum())
        return weight / norm if norm else weight

    def nearest(self, term: np.ndarray, count: np.ndarray, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """The k most similar examples with a similarity above 0, ties by their ids, and how many blocks were read."""
        found, sims, read = np.empty(0, np.int64), np.empty(0), 0
        if not len(term) or not self.blocks:
            return found, sims, read
        q = self.query(term, count)
        bounds = q @ self.most[term]
        order = np.argsort(-bounds, kind="stable")
        order = order[: int((bounds > 0).sum())]
        at, step, slack = 0, 4, 2 * 10.0**-DECIMALS
        while at < len(order) and (len(sims) < k or bounds[order[at]] >= sims[-1] - slack):
            here = order[at : at + step]
            if len(sims) == k:
                here = here[bounds[here] >= sims[-1] - slack]
            cells = term[:, None] * self.blocks + here
            low, size = self.starts[cells].ravel(), (self.starts[cells + 1] - self.starts[cells]).ravel()
            ends = np.cumsum(size)
            post = np.repeat(low - ends + size, size) + np.arange(int(ends[-1]))
            place = np.repeat(np.tile(np.arange(len(here)) * self.block, len(term)), size) + self.owner[post] % self.block
            got = np.bincount(place, np.repeat(np.repeat(q, len(here)), size) * self.weight[post], len(here) * self.block).round(DECIMALS)
            new = np.flatnonzero(got > 0)
            owners = here[new // self.block] * self.block + new % self.block
            got = got[new]
            if without is not None:
                other = self.ids[owners] != without
                owners, got = owners[other], got[other]
            found, sims = np.concatenate([found, owners]), np.concatenate([sims, got])
            best = np.lexsort((self.ids[found], -sims))[:k]
            found, sims = found[best], sims[best]
            at, step, read = at + len(here), min(64, 2 * step), read + len(here)
        return found, sims, read


@dataclass
class Voter:
    """Votes of neighbours and the steps that turn a vote into a score."""

    index: Index
    mean: float
    votes: np.ndarray
    scores: np.ndarray

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        weight = sims * sims
        return float(((weight * self.index.toxic[found]).sum() + PRIOR * self.mean) / (weight.sum() + PRIOR))

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.scores)) if len(self.votes) else self.mean


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising fit of ``y`` by ``x``, equal neighbours pooled; each pool is drawn to the mean a little."""
    mean = float(y.mean())
    pools: list[list[float]] = []
    values, back = np.unique(x, return_inverse=True)
    for v, s, n in zip(values, np.bincount(back, y), np.bincount(back)):
        pools.append([float(s), float(n), float(v), float(v)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s1, n1, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + s1, pools[-1][1] + n1, pools[-1][2], high]
    knots, levels = [], []
    for s, n, low, high in pools:
        level = (s + mean) / (n + 1)
        knots += [low, high] if high > low else [low]
        levels += [level, level] if high > low else [level]
    return np.array(knots), np.maximum.accumulate(np.clip(levels, 0.0, 1.0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and labels to the terms that each one has."""
    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
            words = list(terms_of(text.as_py()))
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic] * len(part), pa.int32())], ["term", "toxic"])


def _vectors(space: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}  # terms of each word met so far
        for b in batches:
            terms, counts = [], []
            for text in b.column(1):
                own: dict[int, int] = {}
                for word, n in Counter(_WORD.findall((text.as_py() or "").lower())).items():
                    if word not in known:
                        known[word] = [space[t] for t in (word, beginning(word)) if t in space]
                    for t in known[word]:
                        own[t] = own.get(t, 0) + n
                terms.append(sorted(own))
                counts.append([own[t] for t in terms[-1]])
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "terms", "counts"])

    return run


def chosen_terms(examples: DataFrame, positive: int, negative: int, least: int = LEAST, lift: float = LIFT, apart: float = APART, most: int = TERMS) -> list[str]:
    """Terms that are more frequent in the toxic ``examples`` (text, toxic) than in the others, ``most`` of them at most."""
    seen = examples.mapInArrow(_counted, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    ratio = F.log(a / (positive + 1)) - F.log(b / (negative + 1))
    ranked = seen.where(ratio >= math.log(lift)).select("term", F.round(ratio / F.sqrt(1 / a + 1 / b), 6).alias("z")).where(F.col("z") >= apart)
    return sorted(r["term"] for r in ranked.orderBy(F.desc("z"), "term").limit(most).collect())


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = EXAMPLES) -> tuple[Voter, DataFrame]:
    """The fitted voter, and the written (doc_id, terms, counts) of every row of ``docs``.

    Examples are the labelled ids for which ``learn`` holds, ``most`` at most; of rows that repeat an id, the one with the
    smallest text is the example. Document frequencies are counted over all rows.
    """
    toxic = F.col("toxic").cast("int")
    known = (labels.select("doc_id", toxic.alias("toxic")).where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # at most EXAMPLES narrow rows: a bounded broadcast
    marked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    examples = written(marked.select("doc_id", "text", "toxic"), "toxicity-examples")
    sizes = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    space = {t: k for k, t in enumerate(chosen_terms(examples.select("text", "toxic"), positive, negative))} if positive and negative else {}
    made = _vectors(space)
    schema = "doc_id bigint, terms array<int>, counts array<bigint>"
    vectors = written(docs.select("doc_id", "text").mapInArrow(made, schema), "toxicity-vectors")
    frequency = np.zeros(len(space))
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the space
        frequency[r["term"]] = r["count"]
    total = vectors.count()
    got = examples.select("doc_id", "text").mapInArrow(made, schema).join(F.broadcast(known), "doc_id").toArrow()
    rows = sorted(got.to_pylist(), key=lambda r: r["doc_id"])
    index = Index(np.array([r["doc_id"] for r in rows], np.int64), np.array([r["toxic"] for r in rows], np.int64), np.log((1 + total) / (1 + frequency)) + 1)
    owner = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows]) if rows else np.empty(0, np.int64)
    index.load(owner.astype(np.int64), np.array([t for r in rows for t in r["terms"]], np.int64), np.array([c for r in rows for c in r["counts"]], np.int64))
    toxic_of = np.array([r["toxic"] for r in rows], np.int64)
    mean = positive / max(1, positive + negative)
    voter = Voter(index, mean, np.empty(0), np.empty(0))
    if positive and negative:
        votes = np.array([voter.vote(*index.nearest(np.array(r["terms"], np.int64), np.array(r["counts"], np.int64), without=r["doc_id"])[:2]) for r in rows])
        voter.votes, voter.scores = monotone(np.round(votes, 6), toxic_of)
    return voter, vectors


def _scorer(voter: Voter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = voter.index
        none = voter.score(round(voter.vote(np.empty(0, np.int64), np.empty(0)), 6))
        for b in batches:
            out = []
            for doc_id, terms, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                t, c = terms.values.to_numpy(), counts.values.to_numpy()
                if not len(t):
                    out.append((doc_id, none, []))
                    continue
                found, sims, _ = index.nearest(t.astype(np.int64), c, without=doc_id)
                evidence = [{"doc_id": int(index.ids[f]), "similarity": float(s), "toxic": int(index.toxic[f])} for f, s in zip(found[:EVIDENCE], sims)]
                out.append((doc_id, voter.score(round(voter.vote(found, sims), 6)), evidence))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], _SCORED.field(k).type) for k in range(3)], schema=_SCORED)

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest) of every row; only whole texts are looked at.

    ``nearest`` is the evidence: the most similar labelled examples, never the row's own id. Labels are learned from rows
    that are not held out, or those of ``learn``. A text without any term of the space, an empty and a null one have no
    neighbours and get the score of the labels' mean vote. Without labels of both classes every score is that of the
    labels' share. A null id is not held out; repeated rows are repeated; an empty table gives no rows; other columns are
    ignored.
    """
    voter, vectors = train(docs, labels, ~held_out(F.col("doc_id")) if learn is None else learn)
    out = vectors.mapInArrow(_scorer(voter), SCORED)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "nearest")
