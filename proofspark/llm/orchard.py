"""Centroid clustering in whole numbers, nearest centroids found by Orchard's search.

Every centroid has the list of all centroids by their distance from it. The search for a vector holds its best centroid so
far and walks down that one's list; a closer centroid, or an equally close one of a smaller number, becomes the best, and
its own list is walked from the start, past centroids that are marked as visited. By the triangle inequality nothing can
follow that is as close once the list is strictly beyond twice the current distance. Distances are whole numbers, so ties
are exact. A round is one scan: tasks send one row of sums a cluster, and only the centroids, whose number is a parameter,
reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from proofspark.session import written

COMPONENTS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components saturate here, so that every distance fits 64 bits: 64 * (2 * 2^27)^2 < 2^63.
LARGEST = 1 << 27
#: Rows searched at a time.
STEP = 8192

SUMS = "cluster int, rows bigint, inertia decimal(38,0), sums array<decimal(38,0)>"
_SUMS = pa.schema([("cluster", pa.int32()), ("rows", pa.int64()), ("inertia", pa.decimal128(38, 0)), ("sums", pa.list_(pa.decimal128(38, 0)))])


@dataclass
class Centroids:
    """Centroids with their neighbour lists: ``order[c]`` are all centroids by distance from c, ``far[c]`` the squared distances."""

    at: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.at)
        self.far = np.stack([_squared(self.at, c) for c in self.at]) if k else np.zeros((0, 0), np.int64)
        self.order = np.argsort(self.far, axis=1, kind="stable")
        self.far = np.take_along_axis(self.far, self.order, 1)
        sums = self.at.sum(1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each row, its squared distance, and how many distances were computed."""
        n, k = len(x), len(self.at)
        rows = np.arange(n)
        best = self.by_sum[np.minimum(np.searchsorted(self.sums, x.sum(1)), k - 1)]  # a cheap first guess
        distance = _squared(x, self.at[best])
        visited = np.zeros((n, k), bool)
        visited[rows, best] = True
        place, spent = np.zeros(n, np.int64), n
        while len(rows):
            now, here = best[rows], place[rows]
            # squared: beyond twice the distance is beyond four times its square; divided, so that nothing overflows
            going = -(-self.far[now, here] // 4) <= distance[rows]
            rows, now, here = rows[going], now[going], here[going]
            other = self.order[now, here]
            place[rows] += 1
            fresh = ~visited[rows, other]
            seen, met, held = rows[fresh], other[fresh], now[fresh]
            visited[seen, met] = True
            away = _squared(x[seen], self.at[met])
            spent += len(seen)
            closer = (away < distance[seen]) | ((away == distance[seen]) & (met < held))
            moved = seen[closer]
            best[moved], distance[moved], place[moved] = met[closer], away[closer], 0
            rows = rows[place[rows] < k]
        return best, distance, spent


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def whole_vectors(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of exactly ``components`` finite components as whole numbers floor(scale * component), in 32 bits each."""
    fits = (F.size("embedding") == components) & F.forall("embedding", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    kept = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * components), b.num_rows, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())], ["vec_id", "x"])

    return kept.mapInArrow(run, "vec_id bigint, x binary")


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    parts = b.column("x").to_pylist()
    return np.frombuffer(b"".join(parts), "<i4").reshape(len(parts), -1).astype(np.int64)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest hashes, in that order; of repeated ids, those with the smallest vectors."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(name, "x").limit(k).select("x").collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in rows], np.int64)


def _sums(centroids: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.at)
        rows, inertia, sums = np.zeros(k, np.int64), [0] * k, np.zeros(centroids.at.shape, np.int64)
        kept = [[0] * centroids.at.shape[1] for _ in range(k)]
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                x = _vectors(b.slice(at, STEP))
                best, distance, _ = centroids.nearest(x)
                for c in np.unique(best):
                    mine = best == c
                    rows[c] += mine.sum()
                    sums[c] = x[mine].sum(0)
                    kept[c] = [a + int(s) for a, s in zip(kept[c], sums[c])]
                    inertia[c] += sum(map(int, distance[mine]))
        used = [c for c in range(k) if rows[c]]
        yield pa.RecordBatch.from_pylist([{"cluster": c, "rows": int(rows[c]), "inertia": inertia[c], "sums": kept[c]} for c in used], schema=_SUMS)

    return run


def _totals(vectors: DataFrame, centroids: Centroids) -> dict[int, tuple[int, int, list[int]]]:
    """(rows, inertia, sums) of each cluster that has any; one row a cluster and task is shuffled."""
    d = centroids.at.shape[1]
    parts = vectors.mapInArrow(_sums(centroids), SUMS)
    each = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(d)]
    got = parts.groupBy("cluster").agg(F.sum("rows").alias("rows"), F.sum("inertia").alias("inertia"), *each).collect()
    return {r["cluster"]: (r["rows"], int(r["inertia"]), [int(r[f"s{j}"]) for j in range(d)]) for r in got}


def _assigned(centroids: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                best, distance, _ = centroids.nearest(_vectors(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def clusters(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector of ``table`` (vec_id, embedding).

    Vectors that are null, of another length, or hold a null or non-finite component are left out; so an empty table gives
    no rows. Rows that repeat a vec_id, and rows without one, are vectors of their own; equal vectors share a cluster. With
    fewer than ``k`` vectors there are as many centroids. Components beyond 2^27 / 64 saturate. Other columns are ignored.
    Inertias are exact; one beyond 64 bits is null.
    """
    spark = table.sparkSession
    vectors = written(whole_vectors(table, components, scale), "orchard-vectors")
    at = first_centroids(vectors, k, seed)
    if not len(at):
        return _empty(spark)
    centroids = Centroids(at)
    for _ in range(rounds):
        at = centroids.at.copy()
        for c, (n, _, sums) in _totals(vectors, centroids).items():
            at[c] = [s // n for s in sums]  # floor, also below zero
        centroids = Centroids(at)
    totals = _totals(vectors, centroids)
    inertia = {c: t[1] for c, t in totals.items()}
    names = {c: hashlib.sha256(",".join(map(str, centroids.at[c].tolist())).encode()).hexdigest() for c in inertia}
    rows = [(c, x, names[c]) for c, x in inertia.items()]
    known = spark.createDataFrame([(c, str(x), str(sum(inertia.values())), s) for c, x, s in rows], "cluster int, own string, every string, centroid_sha256 string")
    known = known.select("cluster", F.col("own").try_cast("bigint").alias("cluster_inertia"), F.col("every").try_cast("bigint").alias("inertia"), "centroid_sha256")
    found = vectors.mapInArrow(_assigned(centroids), "vec_id bigint, cluster int, distance bigint")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a cluster


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
