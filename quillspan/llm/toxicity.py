"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order; each model is a logistic regression on which words and word heads a text
holds and on the probabilities of the categories before it. In training those probabilities are out-of-fold: each row gets them from
models that have not seen it, so later models learn to trust earlier ones as far as they deserve on new texts. The last
category is the label itself. The ones before it come from columns of the labels where these have them; else they are the
toxic rows that also hold one of the category's seed words.

The chain is fitted on at most ``most`` labelled rows, distinct texts in hash order. Spark counts words by category;
only the chosen words and the rows' indices into them reach the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.decontaminate import tokens
from quillspan.llm.words import mix, shingle_set, small, word_hashes
from quillspan.scratch import save

# Seed words of the categories before the label.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "fool", "dumb", "imbecile", "jerk"),
    "contempt": ("trash", "scum", "pathetic", "worthless", "disgusting", "garbage", "filth", "vermin", "vile"),
}
CATEGORIES = (*SEEDS, "toxic")
#: Labelled rows to fit on, words for each category, folds, and the probability from which a text is toxic.
MOST_ROWS, WORDS, FOLDS, THRESHOLD = 8000, 1000, 4, 0.35
#: A word is a feature if it stands in so many rows and its chi-square with a category is above this.
LEAST_ROWS, LEAST_CHI = 4, 15


#: Bytes of the word heads that are features beside whole words, for stems that take many endings.
HEAD = 6
#: A head is a feature for one, two, and three or more words with it.
HEAD_COUNTS = 3


def features(text: str, heads: set[bytes] | None = None) -> set[bytes]:
    """What a text holds: words, word heads with how many words have them, and its length class.

    With ``heads``, only these heads are counted. Words hold no byte below 33, so the marks 1 and 2 keep kinds apart.
    """
    words = tokens(text)
    count = Counter(h for h in (w[:HEAD] for w in words) if (len(h) == HEAD if heads is None else h in heads))
    out = set(words)
    out |= {b"\x01" + h + b"%d" % k for h, n in count.items() for k in range(1, min(n, HEAD_COUNTS) + 1)}
    out.add(b"\x02%d" % len(words).bit_length())
    return out


@dataclass
class Linear:
    """Weights of words (by index) and of the categories before."""

    bias: float
    words: np.ndarray
    before: np.ndarray


@dataclass
class Chain:
    vocabulary: dict[bytes, int]
    models: list[Linear]

    def __post_init__(self) -> None:
        self.known = set(self.vocabulary)
        self.heads = {w[1 : 1 + HEAD] for w in self.known if w[:1] == b"\x01"}

    def predict(self, sets: list[np.ndarray]) -> np.ndarray:
        """Probabilities (row, category) from the rows' word indices."""
        ends = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate([np.empty(0, np.int64), *sets])
        out = np.zeros((len(sets), len(self.models)))
        for c, m in enumerate(self.models):
            out[:, c] = _sigmoid(m.bias + _sums(m.words[flat], ends) + out[:, :c] @ m.before)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[ends])


def fit_linear(sets: list[np.ndarray], before: np.ndarray, y: np.ndarray, size: int, l2: float = 2.0, rounds: int = 200) -> Linear:
    """L2-regularised logistic regression by accelerated full-batch descent; one class alone gives a constant."""
    n = len(y)
    rate = (y.sum() + 0.01) / (n + 1)  # without rows: a low one
    bias = float(np.log(rate / (1 - rate)))
    model = Linear(bias, np.zeros(size), np.zeros(before.shape[1]))
    if not n or y.min() == y.max():
        return model
    ends = np.cumsum([0, *map(len, sets)])
    flat, row = np.concatenate([np.empty(0, np.int64), *sets]), np.repeat(np.arange(n), np.diff(ends))
    w = np.zeros(size + before.shape[1] + 1)
    w[-1] = bias
    at, old, t = w.copy(), w.copy(), 1.0
    # coordinates are scaled by how often they occur, so that one step length fits all
    scale = np.concatenate([np.bincount(flat, minlength=size) / 4.0, (before**2).sum(0) / 4, [n / 4]]) + l2
    active = 1 + np.diff(ends).max(initial=0) ** 0.5 + before.shape[1]
    for _ in range(rounds):
        error = _sigmoid(at[-1] + _sums(at[flat], ends) + before @ at[size:-1]) - y
        gradient = np.concatenate([np.bincount(flat, error[row], size), before.T @ error, [error.sum()]])
        gradient[:-1] += l2 * at[:-1]
        w = at - gradient / scale / active
        if (gradient * (w - old)).sum() > 0:
            t = 1.0
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        at, old = w + (last - 1) / t * (w - old), w
    return Linear(float(w[-1]), w[:size], w[size:-1])


def fit_chain(vocabulary: list[bytes], sets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """Models of all categories in turn; earlier probabilities are out-of-fold for every row."""
    before, models = np.zeros((len(sets), 0)), []
    for c in range(labels.shape[1]):
        y, out = labels[:, c].astype(float), np.zeros(len(sets))
        models.append(fit_linear(sets, before, y, len(vocabulary)))
        for f in range(FOLDS) if c + 1 < labels.shape[1] else ():
            fit, rest = np.nonzero(folds != f)[0], np.nonzero(folds == f)[0]
            m = fit_linear([sets[i] for i in fit], before[fit], y[fit], len(vocabulary))
            ends = np.cumsum([0, *[len(sets[i]) for i in rest]])
            flat = np.concatenate([np.empty(0, np.int64), *[sets[i] for i in rest]])
            out[rest] = _sigmoid(m.bias + _sums(m.words[flat], ends) + before[rest] @ m.before)
        before = np.column_stack([before, out])
    return Chain({w: i for i, w in enumerate(vocabulary)}, models)


def _row_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text, and two minima over its 3-word shingles' hashes, which near copies share."""
    for batch in small(batches):
        runs = [tokens(t or "") for t in batch.column("text").to_pylist()]
        words = [sorted(features(t or "")) for t in batch.column("text").to_pylist()]
        shingles = [shingle_set(word_hashes(x), 3) for x in runs]
        least = [[int(mix(s ^ salt).min() >> np.uint64(1)) if len(s) else 0 for s in shingles] for salt in (np.uint64(1), np.uint64(2))]
        ends = np.cumsum([0, *map(len, words)])
        flat = pa.array([w for s in words for w in s], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("fold_key"), batch.column("toxic"), batch.column("given"), *(pa.array(x, pa.int64()) for x in least), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
            ["fold_key", "toxic", "given", "m1", "m2", "words"],
        )


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Chain:
    """Fit the chain on at most ``most`` rows of ``labels`` (doc_id, toxic, ...) that ``docs`` (doc_id, text) holds.

    ``labels`` may have a column for each earlier category (a null is none); a category without one is marked by its seed words.
    Rows with a null doc_id or label are left out; of equal texts, and of most near copies, one row is used, so that
    a much copied text's chance words count once; so repeated rows, of one doc_id or several, change nothing. Whole texts are read, however
    long. No labelled rows: a chain that gives
    every text the same low probability.
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.array(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))) if c in labels.columns else F.lit(0) for c in SEEDS]).alias("given"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.xxhash64("text").alias("fold_key"), "toxic", "given", "text").mapInArrow(_row_words, "fold_key long, toxic int, given array<int>, m1 long, m2 long, words array<binary>")
    for m in ("m1", "m2"):  # of texts that share a minimum, the one with the least hash
        rows = rows.groupBy(F.col(m).alias("of")).agg(F.min_by(F.struct("*"), F.struct("fold_key", "toxic", "given")).alias("r")).select("r.*")
    sample = save(rows, "toxic-sample")
    seeds = {c: F.array(*[F.lit(w.encode()) for w in SEEDS[c]]) for c in SEEDS}
    marked = sample.withColumns({c: F.col("given")[i] if c in labels.columns else ((F.col("toxic") == 1) & F.arrays_overlap("words", seeds[c])).cast("int") for i, c in enumerate(SEEDS)})
    counts = marked.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CATEGORIES]).first()
    by_word = save(marked.select(F.explode("words").alias("word"), *CATEGORIES).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CATEGORIES]).where(f"n >= {LEAST_ROWS}"), "toxic-words")
    vocabulary: set[bytes] = set()
    for c in CATEGORIES:
        p, n = counts[c], counts["n"]
        if 0 < p < n:
            a, b = f"({c} / {p})", f"((n - {c}) / {n - p})"
            spread = f"((n / {n}) * (1 - n / {n}) * ({1 / p} + {1 / (n - p)}) + 1e-12)"
            best = by_word.select("word", F.expr(f"pow({a} - {b}, 2) / {spread}").alias("chi")).where(f"chi > {LEAST_CHI}").orderBy(F.desc("chi"), "word").limit(WORDS)
            vocabulary |= {bytes(r["word"]) for r in best.collect()}
    words = sorted(vocabulary)
    at = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [[at.value[w] for w in x if w in at.value] for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fold_key"), *(batch.column(c) for c in CATEGORIES), pa.array(sets, pa.list_(pa.int32()))], ["fold_key", *CATEGORIES, "at"])

    fitted = marked.mapInArrow(indices, "fold_key long, " + ", ".join(f"{c} int" for c in CATEGORIES) + ", at array<int>").orderBy("fold_key").toArrow()
    sets = [np.array(x, np.int64) for x in fitted["at"].to_pylist()]
    y = np.column_stack([fitted[c].to_numpy() for c in CATEGORIES]) if len(sets) else np.zeros((0, len(CATEGORIES)))
    folds = np.array([zlib.crc32(str(k).encode()) % FOLDS for k in fitted["fold_key"].to_pylist()], int)
    return fit_chain(words, sets, y, folds)


def _score(chain, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chain.value
        for batch in small(batches):
            found = (features(t or "", c.heads) & c.known for t in batch.column("text").to_pylist())
            sets = [np.array(sorted(c.vocabulary[w] for w in f), np.int64) for f in found]
            p = c.predict(sets)
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], [*keep, *(f"p_{n}" for n in CATEGORIES), "toxic"])

    return run


def toxicity(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, row, p_insult, p_contempt, p_toxic, toxic), a row for each row of ``docs``.

    ``row`` is a hash of the text, which tells rows of one doc_id apart. A null or empty text has no words and gets the
    chain's base probabilities. Whole texts are read, other columns are not; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    schema = "doc_id long, row long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(_score(model, threshold), schema)


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all their columns unchanged, in one pass over the table."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    model = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            text = batch.column(at).cast(pa.string())
            for scored in _score(model, threshold)(iter([pa.RecordBatch.from_arrays([text], ["text"])])):
                yield batch.filter(pc.invert(scored.column("toxic")))

    renamed = docs.toDF(*names)
    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
