from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm import voronoi_topk as K

SCHEMA = "vec_id long, embedding array<double>, row string, score string, slab int, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, is_query, k):
    """The k best of every query by comparing all; rows that tie in score and id give the same output in any order."""
    good = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is None or not is_query(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), math.inf if j is None else j) for m, j, x in good if m != n)
        out += [(i, r, None if j == math.inf else j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize(("pivots", "slab", "group"), [(64, 2048, 1024), (5, 7, 3)])
def test_equals_brute_force(spark, pivots, slab, group):
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + draw.gauss(0, 0.05) for c in centres[i % 5]]) for i in range(300)]
    rows += [(1000 + i, centres[0]) for i in range(150)]  # a third are the same
    rows += [(7, None), (8, [1.0, None]), (9, [math.nan] * 6), (10, [math.inf] * 6), (None, centres[1]), (20, rows[20][1]), (20, centres[2]), (30, [0.5, 0.5]), (40, [0.0] * 6)]
    query = lambda i: i % 10 == 0
    assert got(K.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, 10, pivots=pivots, slab=slab, group=group)) == brute(rows, query, 10)


def test_norms_that_differ_much(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) * 10 ** draw.choice([-3, 0, 4]) for _ in range(4)]) for i in range(200)]
    assert got(K.top_k(table(spark, rows), F.col("vec_id") % 4 == 0, 3, pivots=8, slab=16, group=8)) == brute(rows, lambda i: i % 4 == 0, 3)


def test_products_beyond_doubles_are_exact(spark):
    big = 2.0**17 + 1 / 1024
    rows = [(0, [big, 1.0]), (1, [big, 1 / 1024]), (2, [big, 3 / 1024]), (3, [big, 3 / 1024]), (4, [-1.0, 0.0])]
    assert got(K.top_k(table(spark, rows), F.col("vec_id") == 0, 3)) == brute(rows, lambda i: i == 0, 3)
    huge = [(0, [2.0**50, 1.0]), (1, [2.0**50, 2.0]), (2, [-(2.0**50), 0.0])]
    assert got(K.top_k(table(spark, huge), F.col("vec_id") == 0, 3)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_few_and_none(spark):
    assert got(K.top_k(table(spark, []), F.lit(True))) == []
    assert got(K.top_k(table(spark, [(1, [1.0])]), F.lit(True))) == []
    assert got(K.top_k(table(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") == 1)) == [(1, 1, 2, 1024 * 2048)]
    assert got(K.top_k(table(spark, [(1, None), (2, [])]), F.lit(True))) == []
    assert got(K.top_k(table(spark, [(1, []), (2, [])]), F.lit(True))) == [(1, 1, 2, 0), (2, 1, 1, 0)]


def test_far_slabs_are_left_out(spark):
    """Clusters far apart: a query meets few of the candidates."""
    import numpy as np

    draw = np.random.default_rng(5)
    centres = draw.normal(size=(8, 8)) * 20
    x = (centres[np.arange(400) % 8] + draw.normal(size=(400, 8)) * 0.01) * 1024
    radius = float(np.linalg.norm(x, axis=1).max())
    space = K._Space(x[:8], radius, 8)
    d = space.to_pivots(x, lifted=True)
    cell, own = d.argmin(axis=1), d.min(axis=1)
    nearest = [sorted(own[cell == j])[:11] for j in range(8)]
    import pyarrow as pa

    from quillspan.llm import vectors as V

    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), V.arrays(x)], ["row", "vec_id", "v"])
    found = next(K._bounds(space, nearest, 10)(iter([batch])))
    low, high = (np.array(found.column(c).to_pylist()) for c in ("low", "high"))
    met = (low[:, cell] <= own[None, :]) & (high[:, cell] >= own[None, :])
    true = x @ x.T
    best = np.argsort(-true, axis=1)[:, :11]
    assert met[np.arange(400)[:, None], best].all() and met.mean() < 0.5
