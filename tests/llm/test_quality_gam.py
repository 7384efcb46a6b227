from __future__ import annotations

import math
import zlib

import numpy as np
from helpers import clashing, docs, odd_docs, plain

from quillspan.llm import quality_gam as Q


def test_held_out_accuracy_on_the_documents(spark):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = Q.quality_scores(table, Q.train(table, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.93


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    table = docs(spark, [(i, f"text {i} with words", "s") for i in range(40)])
    got = {r.doc_id: r.held_out for r in Q.quality_scores(table, Q.train(table, spark.createDataFrame([], "doc_id long, quality int"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(40)}
    flipped = lambda v: spark.createDataFrame([(i, (i // 3) % 2 if zlib.crc32(str(i).encode()) % 5 else v) for i in range(40)], "doc_id long, quality int")
    a, b = (plain(Q.quality_scores(table, Q.train(table, flipped(v)))) for v in (0, 1))
    assert a == b


def test_tree_finds_the_step():
    g = np.array([1.0, 1, 1, -1, -1])
    leaf = Q._tree(g, np.ones(5), 2)
    assert leaf[0] == leaf[2] == -3 / 4 and leaf[3] == leaf[4] == 2 / 3


def test_quadrants_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
        gain, table = Q._quadrants(g, h)
        top = max(
            sum(g[r, c].sum() ** 2 / (h[r, c].sum() + 1) for r in (slice(0, i), slice(i, None)) for c in (slice(0, j), slice(j, None))) - g.sum() ** 2 / (h.sum() + 1)
            for i in range(1, 4) for j in range(1, 5)
        )
        assert abs(gain - top) < 1e-9 and table.shape == g.shape


def test_interaction_is_learned():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, paired = Q.fit(x, y, pairs=0), Q.fit(x, y, pairs=1)
    assert np.mean((alone.score(x) > 0.5) == y) < 0.65 < 0.95 < np.mean((paired.score(x) > 0.5) == y)


def test_score_is_the_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.random((200, 2))
    m = Q.fit(x, (x[:, 0] > 0.3).astype(float), cycles=20, pairs=1)
    total = m.bias + sum(m.tables[j][np.searchsorted(m.cuts[j], x[:, j], "right")] for j in range(2))
    a, b, t = m.pairs[0]
    total += t[np.searchsorted(m.pair_cuts[a], x[:, a], "right"), np.searchsorted(m.pair_cuts[b], x[:, b], "right")]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-total)))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int")
    table = odd_docs(spark)
    model = Q.train(table, labels)
    got = Q.quality_scores(table, model)
    assert got.count() == 10 and got.where("score < 0 or score > 1 or score is null").isEmpty()
    assert plain(Q.quality_scores(clashing(table), model)) == plain(got)
    assert Q.quality_scores(docs(spark, []), model).count() == 0


def plain_model(x, y, cycles, pairs):
    """The whole fit with lists and loops: quantile cuts, greedy trees on gradients, then the pairs; gives a scoring function."""
    n, width = len(x), len(x[0])

    def cuts(j, bins):
        values = sorted(r[j] for r in x)
        quantiles = {values[math.ceil(round((n - 1) * k / bins, 9))] for k in range(1, bins)}
        return sorted(q for q in quantiles if q > values[0])

    def place(cut, v):
        return sum(c <= v for c in cut)

    def tree(g, h):
        parts, gain = [(0, len(g))], lambda a, b: a * a / (b + 1)
        while len(parts) < Q.LEAVES:
            options = []
            for p, (s, e) in enumerate(parts):
                for k in range(s + 1, e):
                    if sum(h[s:k]) > 0.5 and sum(h[k:e]) > 0.5:
                        options.append((gain(sum(g[s:k]), sum(h[s:k])) + gain(sum(g[k:e]), sum(h[k:e])) - gain(sum(g[s:e]), sum(h[s:e])), p, k))
            top = max((o[0] for o in options), default=0)
            if top <= 1e-9:
                break
            _, p, k = min((o for o in options if o[0] > top - 1e-12), key=lambda o: o[1:])
            s, e = parts[p]
            parts[p : p + 1] = [(s, k), (k, e)]
        out = [0.0] * len(g)
        for s, e in parts:
            for i in range(s, e):
                out[i] = -sum(g[s:e]) / (sum(h[s:e]) + 1)
        return out

    rate = (sum(y) + 0.5) / (n + 1)
    bias = math.log(rate / (1 - rate))
    fine, coarse = [cuts(j, Q.BINS) for j in range(width)], [cuts(j, Q.PAIR_BINS) for j in range(width)]
    tables = [[0.0] * (len(c) + 1) for c in fine]
    two = {}

    def total(r):
        return bias + sum(tables[j][place(fine[j], r[j])] for j in range(width)) + sum(t[place(coarse[a], r[a])][place(coarse[b], r[b])] for (a, b), t in two.items())

    def chance(r):
        return 1 / (1 + math.exp(-total(r)))

    for _ in range(cycles):
        for j in range(width):
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for r, label in zip(x, y, strict=True):
                p, i = chance(r), place(fine[j], r[j])
                g[i] += p - label
                h[i] += p * (1 - p)
            tables[j] = [a + Q.STEP * b for a, b in zip(tables[j], tree(g, h), strict=True)]

    def corner(a, b):
        cells = {}
        for r, label in zip(x, y, strict=True):
            p, at = chance(r), (place(coarse[a], r[a]), place(coarse[b], r[b]))
            g, h = cells.get(at, (0.0, 0.0))
            cells[at] = (g + p - label, h + p * (1 - p))
        best = (-math.inf, None)
        for k in range(1, len(coarse[a]) + 1):
            for m in range(1, len(coarse[b]) + 1):
                quads = {}
                for (i, j), (g, h) in cells.items():
                    q = (i >= k, j >= m)
                    quads[q] = (quads.get(q, (0, 0))[0] + g, quads.get(q, (0, 0))[1] + h)
                gain = sum(g * g / (h + 1) for g, h in quads.values())
                if gain > best[0] + 1e-12:
                    best = (gain, (k, m, quads))
        every = [sum(v[i] for v in cells.values()) for i in (0, 1)]
        return best[0] - every[0] ** 2 / (every[1] + 1), best[1]

    def step(a, b):
        _, (k, m, quads) = corner(a, b)
        for i in range(len(coarse[a]) + 1):
            for j in range(len(coarse[b]) + 1):
                g, h = quads.get((i >= k, j >= m), (0.0, 0.0))
                two[a, b][i][j] += Q.STEP * -g / (h + 1)

    chosen = sorted([(a, b) for a in range(width) for b in range(a + 1, width) if coarse[a] and coarse[b]], key=lambda ab: -corner(*ab)[0])[:pairs]
    for a, b in chosen:
        two[a, b] = [[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)]
    for _ in range(cycles // 3):
        for a, b in chosen:
            step(a, b)
    return chance


def test_whole_fit_equals_plain_loops():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=90), rng.integers(0, 4, 90), rng.random(90) ** 3])
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 1) | (rng.random(90) < 0.1)).astype(float)
    model, chance = Q.fit(x, y, cycles=6, pairs=2), plain_model(x.tolist(), y.tolist(), 6, 2)
    unseen = np.column_stack([rng.normal(size=30), rng.integers(-1, 6, 30), rng.random(30)])
    assert np.allclose(model.score(unseen), [chance(r) for r in unseen.tolist()]) and len(model.pairs) == 2


def test_whole_operator_equals_brute_force(spark, monkeypatch):
    """Sample, features, fit and scores on a small table, with a repeated doc_id, against plain loops."""
    monkeypatch.setattr(Q, "CYCLES", 3)
    monkeypatch.setattr(Q.fit, "__defaults__", (3, 1))
    rng = np.random.default_rng(8)
    texts = {i: " ".join(["word" * int(rng.integers(1, 4)) + "!" * int(rng.integers(0, 3) * (i % 2)) for _ in range(int(rng.integers(3, 30)))]) for i in range(60)}
    rows = [(i, t, "s") for i, t in texts.items()] + [(7, texts[7], "s")] * 5
    labels = [(i, i % 2) for i in range(0, 60) if i % 10] + [(99, 1), (3, None), (None, 1)]
    table, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    learned = [i for i in sorted(texts) if i % 10 and zlib.crc32(str(i).encode()) % 5]
    chance = plain_model([Q.features(texts[i]) for i in learned], [float(i % 2) for i in learned], 3, 1)
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in Q.quality_scores(table, Q.train(table, known)).collect()}
    for i, text in texts.items():
        p = chance(Q.features(text))
        assert got[i][0] == (zlib.crc32(str(i).encode()) % 5 == 0) and abs(got[i][1] - p) < 1e-6 and got[i][2] == (p >= 0.3)


def test_a_repeated_doc_id_keeps_the_bound(spark):
    """Many rows of one doc_id are one row of the sample, whatever their texts."""
    rows = [(1, f"text {i % 50} of one id", "s") for i in range(3000)] + [(i, f"other words {i}", "s") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    sizes = []
    fit = Q.fit
    try:
        Q.fit = lambda x, y: sizes.append(len(x)) or fit(x, y, 1, 0)
        Q.train(docs(spark, rows), labels)
    finally:
        Q.fit = fit
    assert sizes == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 40))]
