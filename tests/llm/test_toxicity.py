from __future__ import annotations

import random
import zlib

import numpy as np
from helpers import clashing, docs, odd_docs, plain

from quillspan.llm import toxicity as X


def labelled(spark, n=600):
    random.seed(1)
    calm = ["tree", "river", "stone", "light", "paper", "cloud", "music", "garden", "window", "street"]
    rows, labels = [], []
    for i in range(n):
        words = [random.choice(calm) + str(random.randint(0, 40)) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[random.randint(0, 39)] = random.choice(["idiot", "trash", "scum", "moron", "nastykin" + str(random.randint(0, 9))])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    table, labels = labelled(spark)
    chain = X.train(table, labels.where("doc_id < 400"))
    truth = {r.doc_id: r.toxic == 1 for r in labels.collect()}
    got = {r.doc_id: r.toxic for r in X.toxicity(table.where("doc_id >= 400"), chain).collect()}
    assert np.mean([got[i] == truth[i] for i in got]) > 0.97
    assert X.without_toxic(table, chain).count() == 600 - sum(r.toxic for r in X.toxicity(table, chain).collect())


def test_chain_feeds_earlier_categories(spark):
    table, labels = labelled(spark)
    chain = X.train(table, labels)
    assert [len(m.before) for m in chain.models] == [0, 1, 2]
    assert abs(chain.models[2].before).max() > 0


def test_out_of_fold_probabilities_are_used():
    """A word that stands in one row only tells that row's label in sample, never out of fold."""
    sets = [np.array([i]) for i in range(40)]
    y = np.column_stack([np.arange(40) % 2, np.arange(40) % 2])
    chain = X.fit_chain([str(i).encode() for i in range(40)], sets, y, np.arange(40) // 2 % X.FOLDS)
    assert abs(chain.models[1].before[0]) < 0.5


def test_fit_linear_equals_a_long_plain_descent():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 6, 3)) for _ in range(80)]
    y = np.array([float(0 in s or rng.random() < 0.2) for s in sets])
    model = X.fit_linear(sets, np.zeros((80, 0)), y, 6, rounds=3000)
    x = np.zeros((80, 7))
    x[:, 6] = 1
    for i, s in enumerate(sets):
        x[i, s] = 1
    w = np.zeros(7)
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.02 * (x.T @ (p - y) + 2.0 * np.append(w[:6], 0))
    assert np.abs(np.append(model.words, model.bias) - w).max() < 0.02


def test_odd_rows(spark):
    table, labels = labelled(spark, 100)
    chain = X.train(table, labels)
    odd = odd_docs(spark)
    got = X.toxicity(odd, chain)
    assert got.count() == 10 and not got.where("doc_id = 1 and toxic").count()
    assert plain(X.toxicity(clashing(odd), chain)) == plain(got)
    kept = X.without_toxic(clashing(odd), chain)
    assert kept.columns == clashing(odd).columns and kept.count() == 10 - got.where("toxic").count()
    assert X.toxicity(docs(spark, []), chain).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    table, labels = labelled(spark, 50)
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        chain = X.train(table, some)
        assert X.toxicity(table, chain).where("toxic").count() == 0


def solve(x, y, penalty):
    """The logistic regression's own optimum by Newton's method; the last column is the bias, without penalty."""
    w = np.zeros(x.shape[1])
    if y.min() == y.max():
        rate = (y.sum() + 0.01) / (len(y) + 1)
        w[-1] = np.log(rate / (1 - rate))
        return w
    ridge = np.append(np.full(x.shape[1] - 1, penalty), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
    return w


def brute(texts, toxic, keys, unseen):
    """The whole operator on distinct texts: vocabulary by chi-square, the chain with out-of-fold columns, probabilities."""
    order = sorted(range(len(texts)), key=lambda i: keys[i])
    sets, n = [X.features(texts[i]) for i in order], len(texts)
    y = []
    for i, s in zip(order, sets, strict=True):
        y.append([int(toxic[i] and any(w.encode() in s for w in X.SEEDS[c])) for c in X.SEEDS] + [toxic[i]])
    y = np.array(y, float)
    vocabulary = set()
    for c in range(y.shape[1]):
        p = y[:, c].sum()
        chi = {}
        for w in set().union(*sets):
            has = np.array([w in s for s in sets])
            k, a = has.sum(), y[has, c].sum()
            if k >= X.LEAST_ROWS and 0 < p < n:
                chi[w] = (a / p - (k - a) / (n - p)) ** 2 / (k / n * (1 - k / n) * (1 / p + 1 / (n - p)) + 1e-12)
        vocabulary |= set(sorted((w for w in chi if chi[w] > X.LEAST_CHI), key=lambda w: (-chi[w], w))[: X.WORDS])
    words = sorted(vocabulary)
    one = lambda s: [float(w in s) for w in words]
    base, new = np.array([one(s) for s in sets]), np.array([one(X.features(t)) for t in unseen])
    folds = np.array([zlib.crc32(str(keys[i]).encode()) % X.FOLDS for i in order])
    before, new_before = np.zeros((n, 0)), np.zeros((len(unseen), 0))
    for c in range(y.shape[1]):
        wide = lambda rows, probs: np.column_stack([rows, probs, np.ones(len(rows))])
        x, out = wide(base, before), np.zeros(n)
        # words and earlier probabilities have one penalty
        for f in range(X.FOLDS):
            w = solve(x[folds != f], y[folds != f, c], 2.0)
            out[folds == f] = 1 / (1 + np.exp(-x[folds == f] @ w))
        w = solve(x, y[:, c], 2.0)
        new_before = np.column_stack([new_before, 1 / (1 + np.exp(-wide(new, new_before) @ w))])
        before = np.column_stack([before, out])
    return words, new_before


def test_whole_operator_equals_brute_force(spark):
    from pyspark.sql import functions as F

    table, labels = labelled(spark, 240)
    rows = table.select("doc_id", "text", F.xxhash64("text").alias("key")).orderBy("doc_id").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    seen, unseen = [r for r in rows if r.doc_id < 180], [r for r in rows if r.doc_id >= 180]
    words, want = brute([r.text for r in seen], [truth[r.doc_id] for r in seen], [r.key for r in seen], [r.text for r in unseen])
    repeats = table.where("doc_id < 180").unionByName(table.where("doc_id = 5").withColumn("doc_id", F.lit(1005).cast("long")))
    chain = X.train(repeats.unionByName(table.where("doc_id >= 180")), labels.where("doc_id < 180"))
    assert sorted(chain.vocabulary) == words
    got = {r.doc_id: (r.p_insult, r.p_contempt, r.p_toxic) for r in X.toxicity(table.where("doc_id >= 180"), chain).collect()}
    assert np.abs(np.array([got[r.doc_id] for r in unseen]) - want).max() < 0.05


def test_long_texts_and_repeated_rows_in_training(spark):
    """Repeated rows of a doc_id and very long texts change nothing but the work."""
    table, labels = labelled(spark, 100)
    long = docs(spark, [(500, "calm words " * 60_000, "s")])
    more = table.unionByName(table.where("doc_id < 20")).unionByName(long)
    chain, again = X.train(table.unionByName(long), labels), X.train(more, labels)
    assert plain(X.toxicity(table, chain)) == plain(X.toxicity(table, again))


def test_categories_from_the_labels(spark):
    """A column of the labels stands for the category's seed words."""
    from pyspark.sql import functions as F

    table, labels = labelled(spark)
    marked = labels.withColumn("insult", F.when(F.col("doc_id") % 10 == 0, 1)).withColumn("contempt", (F.col("doc_id") % 10 == 5).cast("int"))
    words = {"insult": "zork", "contempt": "blep"}
    more = table.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 10 == 0, f" {words['insult']}").when(F.col("doc_id") % 10 == 5, f" {words['contempt']}").otherwise("")))
    got = X.toxicity(more, X.train(more, marked)).collect()
    assert all((r.p_insult > 0.5) == (r.doc_id % 10 == 0) and (r.p_contempt > 0.5) == (r.doc_id % 10 == 5) for r in got)
