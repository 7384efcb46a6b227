"""Exact top-k by inner product as a Voronoi kNN join.

Largest inner products are nearest neighbours after a lift: with R the largest norm, a candidate x gets one more component
sqrt(R^2 - |x|^2) and a query a zero, and |q - x|^2 = |q|^2 + R^2 - 2 q.x. In the lifted space:

1. Pivots, a bounded sample of candidates, cut the space into Voronoi cells. Each candidate gets its cell and its distance to that cell's pivot.
2. Candidates in the order of (cell, distance) are cut into slabs of at most SLAB rows; a summary of a slab is its range of distances.
   A summary of a cell is its k + 1 least distances.
3. A query's bound is the (k + 1)-th least of |q, pivot| + distance over all cells' summaries: no candidate further off is among its k
   best, its own row apart. For each cell that bound, the triangle inequality and the bisecting planes of the pivots leave a range of distances
   in which the query's candidates lie, or none. Queries are grouped by the order of their cells' pivots; a group's range is its members' hull.
4. A slab goes to the groups whose range it meets, rows outside the range left behind, and each (group, slab) is solved by itself: a
   slab is compared in blocks, with the members whose own range it meets. The k best of each query's slabs are its result.

A slab and a group have bounded sizes, so a vector or cell that holds a third of all rows is many tasks. Bounds carry a slack for rounding,
and scores are exact integers, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import vectors as V
from quillspan.operators.rank import positions
from quillspan.scratch import release, save

#: Pivots, at most; the sample they are drawn from has as many rows times SAMPLE.
PIVOTS, SAMPLE = 64, 16
#: Rows of a slab and queries of a group, at most.
SLAB, GROUP = 2048, 1024
#: Candidates compared at a time within a slab.
BLOCK = 256
#: Part of the largest norm by which bounds are widened for rounding.
SLACK = 1e-6


def _lift(m: np.ndarray, radius: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, radius * radius - np.einsum("ij,ij->i", m, m)))


def _distances(a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray) -> np.ndarray:
    """Distances between rows in the lifted space; ``rest`` has the last components."""
    square = (np.einsum("ij,ij->i", a, a) + rest_a**2)[:, None] + (np.einsum("ij,ij->i", b, b) + rest_b**2)[None, :] - 2 * (a @ b.T + rest_a[:, None] * rest_b[None, :])
    return np.sqrt(np.maximum(0.0, square))


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


class _Space:
    """The pivots, in an order in which neighbours are near, and the largest norm."""

    def __init__(self, pivots: np.ndarray, radius: float, width: int) -> None:
        self.radius, self.width = radius, width
        rest = _lift(pivots, radius)
        between = _distances(pivots, pivots, rest, rest)
        left, order = set(range(1, len(pivots))), [0] if len(pivots) else []
        while left:  # from each pivot to the nearest one left
            order.append(min(left, key=lambda j: (between[order[-1], j], j)))
            left.remove(order[-1])
        self.pivots, self.rest, self.between = _wide(pivots[order], width), rest[order], between[np.ix_(order, order)]

    def to_pivots(self, m: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances of candidates (lifted) or of queries to the pivots."""
        rest = _lift(m, self.radius) if lifted else np.zeros(len(m))
        return _distances(_wide(m, self.width), self.pivots, rest, self.rest)


def _clean(vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, m = V.integers(batch.column(vector), 1024)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(ok)), V.arrays(m), pa.array(V.norms(m)), pa.array(np.full(len(m), m.shape[1]), pa.int32())], ["vec_id", "v", "norm", "width"])

    return run


def _assign(space: _Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.to_pivots(V.padded(batch.column("v"), space.width), lifted=True)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["row", "vec_id", "v", "cell", "dist"])

    return run


def _bounds(space: _Space, nearest: list[list[float]], k: int):
    """For queries: their cell, and for each cell the range of pivot distances of the candidates that can be among the k best."""
    size = max(map(len, nearest), default=0)
    summary = np.full((len(nearest), size), np.inf)
    for j, ds in enumerate(nearest):
        summary[j, : len(ds)] = ds
    slack = SLACK * space.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = V.padded(batch.column("v"), space.width)
            d = space.to_pivots(m, lifted=False)
            cell = d.argmin(axis=1)
            own = d[np.arange(len(d)), cell]
            bound = np.full(len(m), np.inf)
            if summary.size > k:  # else every candidate is needed
                for i in range(len(m)):
                    bound[i] = np.partition((d[i][:, None] + summary).ravel(), k)[k] + slack
            between = np.maximum(space.between[cell], 1e-300)
            plane = (d * d - (own * own)[:, None]) / (2 * between)  # to the plane between a cell and the query's own, at least
            plane[space.between[cell] == 0] = 0
            low, high = d - bound[:, None] - slack, d + bound[:, None] + slack
            out = (plane > bound[:, None] + slack) & (slack < 1e-3 * between)
            low[out], high[out] = np.inf, -np.inf
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int32()), V.arrays(low), V.arrays(high)], ["row", "vec_id", "v", "cell", "low", "high"])

    return run


def _solve(k: int):
    """The k best of one slab for each query of one group."""

    def run(queries: pa.Table, slab: pa.Table) -> pa.Table:
        names, kinds = ["row", "query_id", "other", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        if not queries.num_rows or not slab.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        slab = slab.sort_by("dist")
        width = int(max(max(t.column("v").combine_chunks().value_lengths().to_pylist()) for t in (queries, slab)))
        q, x = V.padded(queries.column("v").combine_chunks(), width), V.padded(slab.column("v").combine_chunks(), width)
        low, high, dist = (np.asarray(t.column(c)) for t, c in ((queries, "low"), (queries, "high"), (slab, "dist")))
        rows, others = np.asarray(queries.column("row")), np.asarray(slab.column("row"))
        ids = np.array([V.MOST if i is None else i for i in slab.column("vec_id").to_pylist()], dtype=np.int64)  # a null id comes last
        exact = V.norms(q).max(initial=0) * V.norms(x).max(initial=0) < V.EXACT / 4
        at, to = [], []
        for b in range(0, len(x), BLOCK):
            part = slice(b, b + BLOCK)
            meets = np.flatnonzero((low <= dist[part][-1]) & (high >= dist[b]))
            if not len(meets):
                continue
            score = V.products(q[meets], x[part]) if not exact else q[meets] @ x[part].T
            own = rows[meets][:, None] == others[part][None, :]
            if not exact:
                for i in range(len(meets)):
                    best = sorted((j for j in range(score.shape[1]) if not own[i, j]), key=lambda j: (-score[i, j], ids[b + j], b + j))[:k]
                    at += [(int(meets[i]), b + j, score[i, j]) for j in best]
                continue
            score = np.where(own, -np.inf, score)
            keep = score >= (np.partition(score, -k, axis=1)[:, -k][:, None] if score.shape[1] > k else -np.inf)  # with all ties
            i, j = np.nonzero(keep & ~own)
            to.append((meets[i], b + j, score[i, j]))
        if exact:
            i, j, s = (np.concatenate(c) if to else np.empty(0, np.int64) for c in (zip(*to, strict=True) if to else [()] * 3))
        else:
            i, j = (np.array([t[n] for t in at], dtype=np.int64) for n in (0, 1))
            s = np.array([t[2] for t in at] + [None], dtype=object)[:-1]
        order = np.lexsort((others[j], ids[j], -s, i)) if exact else np.array(sorted(range(len(i)), key=lambda n: (i[n], -s[n], ids[j[n]], others[j[n]])), dtype=np.int64)
        i, j, s = i[order], j[order], s[order]
        first = np.searchsorted(i, i)  # where each query's rows begin
        best = np.arange(len(i)) - first < k
        i, j, s = i[best], j[best], s[best]
        query_ids, vec_ids = queries.column("vec_id").combine_chunks(), slab.column("vec_id").combine_chunks()
        return pa.table([pa.array(rows[i]), query_ids.take(pa.array(i)), pa.array(others[j]), vec_ids.take(pa.array(j)), V.longs(s)], names)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", pivots: int = PIVOTS, slab: int = SLAB, group: int = GROUP) -> DataFrame:
    """The k best candidates of each query: (query_id, rank, vec_id, score), score the exact product of floor(1024 * x).

    ``vectors`` (vec_id, ``vector``, ...); queries are the rows for which ``is_query`` holds, candidates all rows but the query's own. Ties go to the
    smaller vec_id, a null one last, and then in an order that is any but fixed. Rows that repeat an id are candidates and queries each for
    itself. Vectors that are null, or hold a null or non-finite component or one beyond long when scaled, take no part; a shorter vector counts as
    filled up with zeros. A score beyond long is set to its end, ranked by its true value within a slab. Other columns are not read; an empty table gives no rows.
    Pivots are chosen from a sample of ``pivots`` * SAMPLE rows by hash; they decide how much is skipped, never the result.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    clean = save(source.mapInArrow(_clean(vector), "vec_id long, v array<double>, norm double, width int").withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    shape = clean.agg(F.max("norm").alias("radius"), F.max("width").alias("width")).first()
    sample = [r.v for r in clean.orderBy(F.xxhash64("v", "row"), "row").limit(pivots * SAMPLE).select("v").collect()] if shape.width is not None else []
    chosen = list({tuple(v): v for v in sample}.values())[:pivots]
    space = _Space(V.padded(pa.array(chosen, pa.list_(pa.float64())), shape.width or 0) if chosen else np.zeros((1, shape.width or 0)), shape.radius or 0.0, shape.width or 0)

    # candidates: cells, slabs and their summaries
    assigned = clean.select("row", "vec_id", "v").mapInArrow(_assign(space), "row long, vec_id long, v array<double>, cell int, dist double")
    placed = positions(assigned, [F.col("cell"), F.col("dist"), F.col("row")], "_at").withColumn("slab", F.floor(F.col("_at") / slab)).drop("_at")
    placed = save(placed, "topk-placed")
    slabs = placed.groupBy("cell", "slab").agg(F.min("dist").alias("from"), F.max("dist").alias("to"))
    near = Window.partitionBy("cell").orderBy("dist", "row")
    least = placed.select("cell", "dist", "row").withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    nearest: list[list[float]] = [[] for _ in range(len(space.pivots))]
    for r in least.select("cell", "dist").collect():  # at most pivots * (k + 1) rows
        nearest[r.cell].append(r.dist)

    # queries: their ranges, and the hull of each group's
    asked = clean.where(F.coalesce(is_query, F.lit(False))).select("row", "vec_id", "v")
    ranges = asked.mapInArrow(_bounds(space, nearest, k), "row long, vec_id long, v array<double>, cell int, low array<double>, high array<double>")
    grouped = save(positions(ranges, [F.col("cell"), F.col("row")], "_at").withColumn("group", F.floor(F.col("_at") / group)).drop("_at"), "topk-queries")
    cells = grouped.select("group", F.posexplode(F.arrays_zip("low", "high")).alias("cell", "r")).groupBy("group", "cell").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
    needs = slabs.join(cells, "cell").where((F.col("to") >= F.col("low")) & (F.col("from") <= F.col("high"))).select("group", "cell", "slab", F.col("low").alias("_low"), F.col("high").alias("_high"))
    needs = save(needs, "topk-needs")

    # each (group, cell, slab) by itself
    data = placed.join(needs, ["cell", "slab"]).where(F.col("dist").between(F.col("_low"), F.col("_high"))).select("group", "cell", "slab", "row", "vec_id", "v", "dist")
    ask = grouped.drop("cell").join(needs.select("group", "cell", "slab"), "group")
    ask = ask.select("group", "cell", "slab", "row", "vec_id", "v", F.element_at("low", F.col("cell") + 1).alias("low"), F.element_at("high", F.col("cell") + 1).alias("high")).where("low <= high")
    keys = ["group", "cell", "slab"]
    found = ask.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(_solve(k), "row long, query_id long, other long, vec_id long, score long")
    found = save(found, "topk-found")
    for table in (clean, placed, grouped, needs):
        release(table)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
