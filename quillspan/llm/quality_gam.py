"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees are boosted in cycles, one feature at a time on the gradient that all
others leave, and added into that feature's lookup table; then, with the main effects fixed, the pairs of features that
still explain most are boosted the same way into two-way tables. A score is the sum of table entries at the text's bins,
taken for whole batches, through the logistic function.

The model is fitted on the driver on the features of at most ``most`` labelled rows (some 20 numbers each).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.words import small

#: Labelled rows to fit on; bins of a feature; cycles and step of boosting; leaves of a tree; pairs; bins of a pair's axis.
MOST_ROWS, BINS, CYCLES, STEP, LEAVES, PAIRS, PAIR_BINS = 10_000, 32, 150, 0.1, 4, 8, 8
#: Rows of which one in so many is held out of learning, and the score from which a text is predicted good.
FOLDS, GOOD = 5, 0.3

FEATURES = (
    "n_words", "n_bytes", "mean_word", "max_word", "short_words", "symbols", "bars", "bangs", "capitals", "digits", "other_ascii",
    "distinct_words", "top_word", "distinct_trigrams", "n_lines", "distinct_lines", "words_per_line", "full_stops", "commas",
)
_UPPER, _DIGITS, _SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&<>|"
_PLAIN = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(48, 58)) + b" \t\n\r\x0b\x0c" + bytes(range(128, 256))


def features(text: str) -> list[float]:
    """The numbers that a score is made from; nothing but the text goes in."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = list(map(len, words))
    without = lambda drop: size - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = Counter(words)
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        n, size, sum(lengths) / n, max(lengths), sum(x <= 3 for x in lengths) / n,
        without(_SYMBOLS) / size, raw.count(b"|") / n, raw.count(b"!") / n, without(_UPPER) / size, without(_DIGITS) / size, len(raw.translate(None, _PLAIN)) / size,
        len(count) / n, max(count.values()) / n, trigrams / max(1, n - 2), len(lines), len(set(lines)) / len(lines), n / len(lines), raw.count(b".") / n, raw.count(b",") / n,
    ]


@dataclass
class Additive:
    """Cut points and tables; ``pairs`` holds (first, second, table) over coarser bins."""

    cuts: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features: bin numbers, table look-ups, one sum."""
        total = np.full(len(x), self.bias)
        for j, cuts in enumerate(self.cuts):
            total += self.tables[j][np.searchsorted(cuts, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], "right") for j in {k for p in self.pairs for k in p[:2]}}
        for a, b, table in self.pairs:
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between quantiles, fewer where values are tied."""
    if not len(values):
        return np.empty(0)
    q = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))
    return q[q > values.min()]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float = 1.0) -> np.ndarray:
    """A tree over ordered bins with gradient and curvature sums g and h: the leaf value of each bin (Newton steps)."""
    gain = lambda a, b: a * a / (b + l2)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for p, (s, e) in enumerate(parts):
            if e - s < 2:
                continue
            k = np.arange(s + 1, e)
            lg, lh, rg, rh = cg[k] - cg[s], ch[k] - ch[s], cg[e] - cg[k], ch[e] - ch[k]
            gains = np.where((lh > 0.5) & (rh > 0.5), gain(lg, lh) + gain(rg, rh) - gain(cg[e] - cg[s], ch[e] - ch[s]), 0)
            i = int(gains.argmax())
            if gains[i] > best[0]:
                best = (gains[i], (p, int(k[i])))
        if best[1] is None:
            break
        p, k = best[1]
        s, e = parts[p]
        parts[p : p + 1] = [(s, k), (k, e)]
    out = np.zeros(len(g))
    for s, e in parts:
        out[s:e] = -(cg[e] - cg[s]) / (ch[e] - ch[s] + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis of a two-way table of sums: its gain and its values."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)
    at = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    quads = list(zip(at(cg), at(ch), strict=True))
    gains = sum(a * a / (b + l2) for a, b in quads) - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)
    k, m = np.unravel_index(gains.argmax(), gains.shape)
    out = np.zeros_like(g)
    for (a, b), rows, cols in zip(quads, (slice(0, k + 1), slice(0, k + 1), slice(k + 1, None), slice(k + 1, None)), (slice(0, m + 1), slice(m + 1, None)) * 2, strict=True):
        out[rows, cols] = -a[k, m] / (b[k, m] + l2)
    return float(gains[k, m]), out


def fit(x: np.ndarray, y: np.ndarray, cycles: int = CYCLES, pairs: int = PAIRS) -> Additive:
    """Boost main effects in cycles, then the pairs with the largest gain on what is left. One class alone: a constant."""
    n, width = x.shape
    rate = (y.sum() + 0.5) / (n + 1)
    cuts, coarse = [_cuts(x[:, j], BINS) for j in range(width)], [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    model = Additive(cuts, float(np.log(rate / (1 - rate))), [np.zeros(len(c) + 1) for c in cuts], coarse, [])
    if not n or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    total = np.full(n, model.bias)
    slope = lambda: 1 / (1 + np.exp(-np.clip(total, -40, 40)))
    for _ in range(cycles):
        for j in range(width):
            p = slope()
            step = STEP * _tree(np.bincount(bins[j], p - y, len(model.tables[j])), np.bincount(bins[j], p * (1 - p), len(model.tables[j])), LEAVES)
            model.tables[j] += step
            total += step[bins[j]]
    where = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = slope(), (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = where[a] * shape[1] + where[b]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p)))

    chosen = sorted(combinations(range(width), 2), key=lambda ab: -_quadrants(*sums(*ab))[0])[:pairs]
    tables = {ab: np.zeros((len(coarse[ab[0]]) + 1, len(coarse[ab[1]]) + 1)) for ab in chosen}
    for _ in range(cycles // 3):
        for a, b in chosen:
            step = STEP * _quadrants(*sums(a, b))[1]
            tables[a, b] += step
            total += step[where[a], where[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def _texts_features(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(len(texts), len(FEATURES))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        x = _texts_features(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Additive:
    """Fit on at most ``most`` labelled rows, in hash order, whose doc_id is not held out. Null labels are left out.

    Where several rows of ``docs`` have one doc_id, the text with the least hash is used, so that the bound holds; whole texts are read.
    """
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    once = rows.groupBy("doc_id").agg(F.min("hash").alias("hash"))  # of a repeated doc_id one hash is shuffled for each task
    rows = rows.join(F.broadcast(once), ["doc_id", "hash"]).mapInArrow(_measured, "doc_id long, quality int, x array<double>")
    got = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("x").alias("x")).orderBy("doc_id").toArrow()  # rows alike
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["quality"].to_numpy().astype(float))


def _score(model, good: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            p = model.value.score(_texts_features(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= good).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, model: Additive, good: float = GOOD) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, held_out, score, predicted), a row for each row of ``docs``.

    A null, empty or blank text has the features of an empty one and gets its score. Whole texts are read. Repeated
    rows repeat; a null doc_id is kept and not held out; other columns are not read; an empty table gives no rows.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), good), "doc_id long, held_out boolean, score double, predicted int")
