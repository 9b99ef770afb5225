"""Centroid clustering in exact integers, with an n-simplex projection as the filter.

Components become integers floor(scale * x). A few pivots span a simplex; an object's distances to them (computed once and cached)
fix the apex of the simplex over that base: its coordinates in the space of the pivots and its altitude above it. For two objects
with apexes (y, a) and (z, b), |y - z|^2 + (a - b)^2 <= d^2 <= |y - z|^2 + (a + b)^2. In each round a centroid whose lower bound exceeds
the smallest upper bound of a vector cannot be its nearest; only the others are compared, in exact integers, so the result is that
of comparing all. Apexes are doubles: both bounds are widened by ``SLACK`` of the distances to the first pivot, far beyond their rounding,
and a bound that is no number excludes nothing.

Centroids (``k`` of them) and pivots travel with the task; vectors are read from a staged table, each round is one narrow pass with sums
per task and an aggregation, and the driver sees k centroids a round. Sums are split into limbs of 30 bits, so they are exact for
components of any size.

Rows whose vector is null, has not ``dims`` components, or holds a null or non-finite one take no part and give no row. Null ids take
part but start no centroid. Repeated rows count as often as they stand; of equal hashes the smaller vector comes first. Fewer rows than k give
fewer centroids, an empty table no rows. Extra columns are ignored. Distances (and their sums) that fit no long are null.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codegrid.llm.common import drop, staged

PIVOTS = 16  # at most; pivots that hardly rise above the others are left out
RISE = 1e-2  # least share of a pivot's distance that must rise above the simplex so far
SLACK = 1e-5
_SMALL = 1 << 26  # components below it have 64-bit distances and sums
_LIMB = 30


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product leaves the doubles."""
    return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale


def _real(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf


class Vectors:
    """Rows of a batch: those with small components as one integer matrix, the others as Python integers."""

    def __init__(self, raw: np.ndarray, scale: int) -> None:
        with np.errstate(over="ignore"):
            scaled = np.floor(raw * scale)
        self.small = np.abs(scaled).max(axis=1, initial=0) < _SMALL
        self.x = np.where(self.small[:, None], scaled, 0).astype(np.int64)
        self.large = {i: [_whole(v, scale) for v in raw[i].tolist()] for i in np.flatnonzero(~self.small).tolist()}

    def row(self, i: int) -> list[int]:
        return self.large.get(i) or self.x[i].tolist()

    def squared(self, point: list[int], at: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows ``at`` to a point: longs, or Python integers if any needs them."""
        if self.small[at].all() and max(map(abs, point)) < _SMALL:
            gap = self.x[at] - np.array(point, np.int64)
            return np.einsum("ij,ij->i", gap, gap)
        return np.array([sum((p - q) ** 2 for p, q in zip(self.row(i), point)) for i in at.tolist()] or [0], object)[:len(at)]


class Simplex:
    """The base: pivots p0, p1, ... and the Cholesky factor of the products (pi - p0)(pj - p0)."""

    def __init__(self, points: list[list[int]], most: int) -> None:
        x = np.array([[_real(v) for v in p] for p in points])
        x = x[np.abs(x).max(axis=1, initial=0) < 1e100] if len(x) else x
        chosen, rest = [0], x - x[:1]
        full = (rest ** 2).sum(axis=1)
        while 0 < len(x) and len(chosen) < most:
            height = (rest ** 2).sum(axis=1)
            height[height < RISE * full] = 0
            i = int(height.argmax())
            if not height[i] > 0:
                break
            chosen.append(i)
            unit = rest[i] / math.sqrt(height[i])
            rest = rest - np.outer(rest @ unit, unit)
        finite = [p for p in points if max(map(lambda v: abs(_real(v)), p), default=0) < 1e100]
        self.pivots = [finite[i] for i in chosen] if finite else points[:1]
        base = (x[chosen[1:]] - x[:1]) if finite else np.zeros((0, 0))
        self.length = (base ** 2).sum(axis=1)
        self.inverse = np.linalg.inv(np.linalg.cholesky(base @ base.T)) if len(base) else np.zeros((0, 0))

    def apex(self, squared: np.ndarray) -> np.ndarray:
        """Apexes of objects from their squared distances to the pivots, one row each: coordinates, altitude, and the distance to
        the first pivot that the slack is measured by."""
        with np.errstate(all="ignore"):
            first = squared[:, :1]
            y = ((first + self.length - squared[:, 1:]) / 2) @ self.inverse.T
            altitude = np.sqrt(np.maximum(first[:, 0] - (y ** 2).sum(axis=1), 0))
        return np.column_stack([y, altitude, first[:, 0]])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between the objects of two lists of apexes."""
    with np.errstate(all="ignore"):
        flat = np.zeros((len(a), len(b)))
        for i in range(a.shape[1] - 2):
            flat += (a[:, None, i] - b[None, :, i]) ** 2
        slack = SLACK * (a[:, None, -1] + b[None, :, -1])
        return (flat + (a[:, None, -2] - b[None, :, -2]) ** 2 - slack, flat + (a[:, None, -2] + b[None, :, -2]) ** 2 + slack)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _to_pivots(v: Vectors, n: int, pivots: list[list[int]]) -> np.ndarray:
    at = np.arange(n)
    return np.array([[_real(int(d)) for d in v.squared(p, at)] for p in pivots], float).reshape(len(pivots), n).T


def _project(simplex: Simplex, dims: int, scale: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                raw = _matrix(b.column("x"), dims)
                apex = simplex.apex(_to_pivots(Vectors(raw, scale), len(raw), simplex.pivots))
                offsets = pa.array(np.arange(0, apex.size + 1, apex.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.ListArray.from_arrays(offsets, pa.array(apex.ravel()))], ["id", "x", "apex"])
    return run


def _nearest(batch, centroids: list[list[int]], corners: np.ndarray, dims: int, scale: int):
    """(vectors, cluster, squared distance, centroids compared) of a batch: bounds first, integers for what they leave."""
    v = Vectors(_matrix(batch.column("x"), dims), scale)
    low, high = bounds(_matrix(batch.column("apex"), corners.shape[1]), corners)
    with np.errstate(invalid="ignore"):
        left = ~(low > np.where(np.isnan(high), np.inf, high).min(axis=1, initial=np.inf)[:, None])
    cluster = np.full(len(left), -1)
    best = np.zeros(len(left), np.int64)
    for j, c in enumerate(centroids):
        at = np.flatnonzero(left[:, j])
        d = v.squared(c, at)
        if d.dtype == object and best.dtype != object:
            best = best.astype(object)
        nearer = (cluster[at] < 0) | (d < best[at]).astype(bool)
        cluster[at[nearer]] = j
        best[at[nearer]] = d[nearer]
    return v, cluster, best, left.sum(axis=1)


def _sums(centroids, corners, dims: int, scale: int):
    """One row per task, cluster, component and limb of the sum; the rows of a cluster are counted as component -1."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v, cluster, _, _ = _nearest(b, centroids, corners, dims, scale)
            for j in np.unique(cluster).tolist():
                mine = np.flatnonzero(cluster == j)
                add = np.append(v.x[mine[v.small[mine]]].sum(axis=0), len(mine)).astype(object)
                for i in mine[~v.small[mine]].tolist():
                    add[:dims] += np.array(v.large[i], object)
                total[j] = total.get(j, 0) + add
        rows = []
        for j, t in total.items():
            for d, n in enumerate(map(int, t)):
                limb = 0
                while not -(1 << _LIMB) <= n < 1 << _LIMB:
                    rows.append((j, d if d < dims else -1, limb, n & ((1 << _LIMB) - 1)))
                    n, limb = n >> _LIMB, limb + 1
                rows.append((j, d if d < dims else -1, limb, n))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                             ["cluster", "dim", "limb", "value"])
    return run


def _assign(centroids, corners, dims: int, scale: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                _, cluster, best, compared = _nearest(b, centroids, corners, dims, scale)
                distance = pa.array([int(d) if d < 1 << 63 else None for d in best.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster, pa.int32()), distance, pa.array(compared, pa.int32())],
                                                 ["id", "cluster", "distance", "n_compared"])
    return run


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_compared) of every vector of ``vectors`` (vec_id, embedding) that
    takes part. Centroids start as the k vectors with the smallest sha256 of ``seed:vec_id``; after ``rounds`` of assigning and replacing by
    the floor of the mean, vectors are assigned once more. ``n_compared`` is the number of centroids that the bounds left to compare."""
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where(
        (F.size("x") == dims) & F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))))
    start = rows.where("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy("h", "x").limit(k).collect()
    centroids = [[_whole(v, scale) for v in r["x"]] for r in start]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_compared int")
    simplex = Simplex(centroids, pivots)
    cached = staged(rows.mapInArrow(_project(simplex, dims, scale), "id long, x array<double>, apex array<double>"), "km-apexes")

    def corners() -> np.ndarray:
        return simplex.apex(np.array([[_real(sum((a - b) ** 2 for a, b in zip(c, p))) for p in simplex.pivots] for c in centroids]))

    for _ in range(rounds):
        sums = cached.mapInArrow(_sums(centroids, corners(), dims, scale), "cluster int, dim int, limb int, value long")
        total: dict[tuple[int, int], int] = {}
        for r in sums.groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).toLocalIterator():
            total[r["cluster"], r["dim"]] = total.get((r["cluster"], r["dim"]), 0) + (r["value"] << (_LIMB * r["limb"]))
        centroids = [[total[j, d] // total[j, -1] for d in range(dims)] if (j, -1) in total else c for j, c in enumerate(centroids)]
    last = staged(cached.mapInArrow(_assign(centroids, corners(), dims, scale), "id long, cluster int, distance long, n_compared int"), "km-last")
    drop(cached)
    per = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("n"), F.count(F.lit(1)).alias("m")).collect()
    sums = {r["cluster"]: int(r["s"]) if r["n"] == r["m"] else None for r in per}  # k rows at most

    def long(n: int | None) -> int | None:
        return n if n is not None and n < 1 << 63 else None
    inertia = long(sum(sums.values())) if None not in sums.values() else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(j, long(s), inertia, digests[j]) for j, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(about), "cluster").select(  # at most k rows
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared")
