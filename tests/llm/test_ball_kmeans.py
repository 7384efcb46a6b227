from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import ball_kmeans as B

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int, distance int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds, scale, dims, seed=1):
    """Lloyd's rounds in Python's integers, every vector against every centroid."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = assign()
    total = sum(d for d, _ in of)
    sums = [sum(d for d, c in of if c == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, sums[c], total, sha[c]) for (i, _), (d, c) in zip(kept, of, strict=True)], key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_equals_lloyd_on_clusters_ties_and_odd_rows(spark):
    draw = random.Random(1)
    rows = [(i, [round(draw.gauss(3 * (i % 6), 0.7) * 2) / 2 for _ in range(3)]) for i in range(400)]
    rows += [(500 + i, [1.0, 1.0, 1.0]) for i in range(200)] + [(i, [-0.3, 0.2, 0.1]) for i in (7, 7, 7)]
    rows += [(900, None), (901, [1.0]), (902, [None, 1.0, 1.0]), (903, [math.nan] * 3), (904, [math.inf, 0.0, 0.0]), (None, [2.0, 2.0, 2.0]), (905, [])]
    assert got(B.ball_kmeans(table(spark, rows), k=7, rounds=3, scale=4, dims=3)) == brute(rows, 7, 3, 4, 3)


def test_few_vectors_and_none(spark):
    few = [(1, [0.5]), (2, [0.5]), (3, [-1.0])]
    assert got(B.ball_kmeans(table(spark, few), k=16, dims=1)) == brute(few, 16, 3, 64, 1)
    assert got(B.ball_kmeans(table(spark, []), dims=1)) == [] and got(B.ball_kmeans(table(spark, [(1, None)]), dims=1)) == []


def test_large_integers_stay_exact(spark):
    rows = [(i, [2.0**40 + i / 64, -(2.0**40)]) for i in range(30)]
    assert got(B.ball_kmeans(table(spark, rows), k=3, rounds=2, scale=64, dims=2)) == brute(rows, 3, 2, 64, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=6), st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=6))
def test_core_and_annuli_lose_no_move(points, before, after):
    """Members of balls by any earlier centroids get the centroid that a full comparison gives, ties to the smaller number."""
    n = min(len(before), len(after))
    before, after = before[:n], after[:n]
    m = np.array(points, dtype=np.float64)
    square = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    cluster = np.array([min((square(p, c), j) for j, c in enumerate(before))[1] for p in points])
    radii = {}
    for p, c in zip(points, cluster.tolist(), strict=True):
        radii[c] = max(radii.get(c, 0), square(p, after[c]))
    new, distance, _ = B.reassign(m, cluster, after, B.balls(after, radii))
    assert list(zip(distance.tolist(), new.tolist(), strict=True)) == [min((square(p, c), j) for j, c in enumerate(after)) for p in points]


def test_stable_core_is_not_compared():
    draw = np.random.default_rng(2)
    centroids = [(0, 0), (100, 0), (0, 100), (500, 500)]
    m = np.floor(np.array(centroids)[np.arange(400) % 4] + draw.normal(size=(400, 2)) * 5)
    radii = {j: int(((m[np.arange(400) % 4 == j] - centroids[j]) ** 2).sum(axis=1).max()) for j in range(4)}
    rings = B.balls(centroids, radii)
    assert all(not ball.neighbours for ball in rings)
    assert B.reassign(m, np.arange(400) % 4, centroids, rings)[2] == 0
