"""Lloyd's rounds in exact integers as ball k-means.

A cluster is a ball: its centroid and, as radius, its furthest member's distance from it. After the centroids have moved, cluster j is a
neighbour of i only if half the distance between their centroids is within i's radius; no member of i can be nearer to any other. A
member of i nearer than half the way to i's nearest neighbour is in the stable core and stays uncompared. The rest of the ball is cut into
annuli by half the distances to the neighbours in order; a member of the l-th annulus is compared with the l nearest neighbours
alone. All tests are on squared integers, so ties are seen as such.

Centroids, radii and neighbours are a few numbers for each cluster; vectors stay in tasks, and sums of vectors are taken there before they meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import vectors as V
from quillspan.scratch import release, save

Centroid = tuple[int, ...]


def _matrix(centroids: list[Centroid], dims: int) -> np.ndarray:
    return np.array(centroids, dtype=np.float64).reshape(len(centroids), dims)


def _squares(a: np.ndarray, centroids: list[Centroid], which: list[int] | np.ndarray) -> np.ndarray:
    """Exact squared distances to some of the centroids; theirs may be beyond what doubles hold."""
    chosen = [centroids[j] for j in which]
    if all(abs(x) <= V.EXACT for c in chosen for x in c):
        return V.squares(a, _matrix(chosen, a.shape[1]))
    left = V.objects(a)
    return np.array([[sum((int(x) - y) ** 2 for x, y in zip(r, c, strict=True)) for c in chosen] for r in left], dtype=object).reshape(len(a), len(chosen))


def between(centroids: list[Centroid]) -> list[list[int]]:
    """Squared distances between centroids."""
    return [[sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for b in centroids] for a in centroids]


@dataclass
class Ball:
    """A cluster's neighbours, nearest first, with the squared distances of their centroids."""

    neighbours: list[int]
    apart: list[int]


def balls(centroids: list[Centroid], radii: dict[int, int]) -> list[Ball]:
    """The neighbours of each ball: those with (d / 2)^2 <= radius^2. ``radii`` has the squared radii of the clusters that have members."""
    out = []
    for i, row in enumerate(between(centroids)):
        near = sorted((d, j) for j, d in enumerate(row) if j != i and i in radii and d <= 4 * radii[i])
        out.append(Ball([j for _, j in near], [d for d, _ in near]))
    return out


def reassign(m: np.ndarray, cluster: np.ndarray, centroids: list[Centroid], rings: list[Ball]) -> tuple[np.ndarray, np.ndarray, int]:
    """New clusters and squared distances of vectors, and how many distances to other centroids were taken."""
    new, compared = cluster.copy(), 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.unique(cluster):
        mine = np.flatnonzero(cluster == i)
        own = _squares(m[mine], centroids, [i])[:, 0]
        best, which = own.copy(), np.full(len(mine), i)
        ball = rings[i]
        # annulus of a member: as many of the nearest neighbours as lie within twice its distance; 0 is the core
        apart = np.array([*ball.apart, None], dtype=object)[:-1]
        ring = np.searchsorted(apart.astype(np.float64), 4.0 * own, side="right") if own.dtype != object and all(d < V.EXACT for d in ball.apart) else np.array([sum(d <= 4 * int(o) for d in ball.apart) for o in own], dtype=np.int64)
        for l in np.unique(ring[ring > 0]):
            at = np.flatnonzero(ring == l)
            others = ball.neighbours[:l]
            d = _squares(m[mine[at]], centroids, others)
            compared += d.size
            for n, j in enumerate(others):
                b, w = best[at], which[at]
                nearer = (d[:, n] < b) | ((d[:, n] == b) & (j < w))
                best[at], which[at] = np.where(nearer, d[:, n], b), np.where(nearer, j, w)
        new[mine] = which
        found.append((mine, best))
    distance = np.zeros(len(m), dtype=np.result_type(*[d.dtype for _, d in found]) if found else np.float64)
    for mine, d in found:
        distance[mine] = d
    return new, distance, compared


def _keep(vector: str, scale: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, m = V.integers(batch.column(vector), scale, dims)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(ok)), V.arrays(m)], ["vec_id", "v"])

    return run


def _first(centroids: list[Centroid], dims: int):
    """Every vector against every centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = V.padded(batch.column("v"), dims)
            if not len(m):
                continue
            d = _squares(m, centroids, range(len(centroids)))
            cluster = d.argmin(axis=1)  # the first of equal ones
            yield _rows(batch, cluster, d[np.arange(len(m)), cluster])

    return run


def _rows(batch: pa.RecordBatch, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), V.longs(distance)], ["vec_id", "v", "cluster", "distance"])


def _again(centroids: list[Centroid], rings: list[Ball], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = reassign(V.padded(batch.column("v"), dims), np.asarray(batch.column("cluster")).astype(np.int64), centroids, rings)
            yield _rows(batch, cluster, distance)

    return run


def _sums(dims: int):
    """Sums and counts of a task's vectors by cluster: a row for each cluster and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            m, cluster = V.padded(batch.column("v"), dims), np.asarray(batch.column("cluster"))
            exact = np.abs(m).max(initial=0) * len(m) < V.EXACT
            for i in np.unique(cluster):
                mine = m[cluster == i]
                s = [int(x) for x in mine.sum(axis=0)] if exact else [sum(map(int, c)) for c in mine.T]
                n, before = total.get(int(i), (0, [0] * dims))
                total[int(i)] = (n + len(mine), [a + b for a, b in zip(before, s, strict=True)])
        flat = [(i, d, n, Decimal(x)) for i, (n, s) in total.items() for d, x in enumerate(s)]
        columns = list(zip(*flat, strict=True)) if flat else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)), strict=True)], ["cluster", "dim", "n", "s"])

    return run


def _radii(centroids: list[Centroid], dims: int):
    """The largest squared distance of a task's members from their cluster's centroid, as text, as it may be beyond long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            m, cluster = V.padded(batch.column("v"), dims), np.asarray(batch.column("cluster"))
            for i in np.unique(cluster):
                most[int(i)] = max(most.get(int(i), 0), int(_squares(m[cluster == i], centroids, [i]).max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array([str(x) for x in most.values()], pa.string())], ["cluster", "radius"])

    return run


def _moved(assigned: DataFrame, centroids: list[Centroid], dims: int) -> list[Centroid]:
    """Centroids at the floor of their members' mean; those without members stay."""
    sums = assigned.select("v", "cluster").mapInArrow(_sums(dims), "cluster int, dim int, n long, s decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # clusters times components
        out[r.cluster][r.dim] = int(r.s) // r.n
    return [tuple(c) for c in out]


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, vector: str = "embedding") -> DataFrame:
    """``vectors`` (vec_id, ``vector``, ...) to (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector kept.

    Kept are vectors of ``dims`` components, none null, non-finite or beyond long when scaled; the integers are floor(scale * x). Centroids start as the k
    vectors with the least sha256 of ``seed:vec_id``, a null id last, then by components where ids repeat; with fewer vectors there are fewer.
    Ties of distance go to the smaller number. Repeated rows count each for itself; distances and sums beyond long are set to its end;
    other columns are not read; an empty table gives no rows. ``rounds`` times vectors are assigned and centroids moved; then they are assigned once more.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    kept = save(source.mapInArrow(_keep(vector, scale, dims), "vec_id long, v array<double>"), "kmeans-rows")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [tuple(int(x) for x in r.v) for r in kept.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()]
    schema = "vec_id long, v array<double>, cluster int, distance long"
    assigned = save(kept.mapInArrow(_first(centroids, dims), schema), "kmeans-assigned")
    release(kept)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(assigned, centroids, dims)
        furthest = assigned.select("v", "cluster").mapInArrow(_radii(centroids, dims), "cluster int, radius string").groupBy("cluster").agg(F.max(F.struct(F.length("radius"), "radius"))["radius"].alias("radius"))
        rings = balls(centroids, {r.cluster: int(r.radius) for r in furthest.collect()})
        before, assigned = assigned, save(assigned.mapInArrow(_again(centroids, rings, dims), schema), "kmeans-assigned")
        release(before)
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each cluster
    long = lambda x: F.lit(min(x, V.MOST)).cast("long")
    by = lambda f, kind: F.coalesce(*[F.when(F.col("cluster") == i, f(i)) for i in range(len(centroids))], F.lit(None).cast(kind))
    sha = lambda i: F.lit(hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest())
    return assigned.select(
        "vec_id", "cluster", "distance", by(lambda i: long(inertia.get(i, 0)), "long").alias("cluster_inertia"), long(sum(inertia.values())).alias("inertia"), by(sha, "string").alias("centroid_sha256")
    )
