"""Centroid clustering: bounds that hold, and the same result as comparing every vector with every centroid in whole numbers."""
import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from codegrid.llm import simplex


def brute(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(Fraction(v) * scale) for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        near = assigned()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, c) in zip(kept, near) if c == j]
            if mine:
                centroids[j] = [sum(v) // len(mine) for v in zip(*mine)]
    near = assigned()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def long(n):
        return n if n < 1 << 63 else None
    total = long(sum(d for d, _ in near))
    return sorted(((i, c, long(d), long(sum(e for e, o in near if o == c)), total, digest[c]) for (i, _), (d, c) in zip(kept, near)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(12, 8))
    x = [(i, (centre[i % 12] + 0.1 * rng.normal(size=8)).tolist()) for i in range(300)]
    x += [(300 + i, x[i][1]) for i in range(30)] + [(7, x[7][1]), (8, x[90][1])]  # copies, repeated ids
    x += [(400, None), (401, [0.5] * 7), (402, [float("nan")] + [0.0] * 7), (403, [None] + [0.0] * 7), (404, [float("inf")] * 8), (405, []),
          (None, x[3][1]), (406, [0.0] * 8), (407, [-0.001] * 8), (408, [0.0] * 8)]
    return x


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, distance int, cluster int")


@pytest.mark.parametrize("extra", [[], [(500, [1e6] * 8), (501, [1e6 + 3] * 8)], [(500, [3e300, -1e308] + [1.5] * 6), (501, [2.0 ** 60] * 8), (502, [-(2.0 ** 40)] * 8)]])
def test_against_brute_force(spark, rows, extra):
    args = {"k": 10, "rounds": 3, "dims": 8, "scale": 256, "seed": 2}
    got = simplex.cluster(table(spark, rows + extra), **args, pivots=5).drop("n_compared").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows + extra, **args)


def test_the_filter_filters(spark, rows):
    got = simplex.cluster(table(spark, rows), k=10, dims=8, pivots=6).collect()
    assert np.mean([r.n_compared for r in got]) < 4


@pytest.mark.parametrize("k", [1, 1000])
def test_one_centroid_and_more_than_there_are(spark, rows, k):
    args = {"k": k, "rounds": 2, "dims": 8, "scale": 256, "seed": 2}
    some = rows[:40] + rows[-10:]
    assert sorted((tuple(r) for r in simplex.cluster(table(spark, some), **args).drop("n_compared").collect()), key=str) == brute(some, **args)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = rng.integers(-10 ** rng.integers(1, 8), 10 ** rng.integers(1, 8) + 1, size=(60, 10)) * rng.integers(0, 2, size=10)
        base = simplex.Simplex([p.tolist() for p in x[:20]], 16)
        squared = np.array([[float(((a - p) ** 2).sum()) for p in np.array(base.pivots)] for a in x])
        low, high = simplex.bounds(base.apex(squared), base.apex(squared))
        true = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        assert (low <= true).all() and (true <= high).all()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert simplex.cluster(empty).count() == 0
