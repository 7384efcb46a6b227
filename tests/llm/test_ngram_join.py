from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, docs, odd_docs, plain
from pyspark.sql import functions as F

from quillspan.llm import ngram_join as J
from quillspan.llm.components import connected_components


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    post = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter()
        for g in s:
            shared.update(post[g])
            post[g].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                label[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted([(doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_equals_brute_force(spark, sf_dir, k, num, den):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd_docs(spark))
    assert plain(J.ngram_components(table, k, num, den).drop("row", "class")) == brute([(r.doc_id, r.text) for r in table.collect()], k, num, den)


@pytest.mark.parametrize("tile", [4, 2048])
def test_group_of_near_copies_over_tiles(spark, monkeypatch, tile):
    """Copies that link only through others, in more than one tile, with a hot exact copy."""
    monkeypatch.setattr(J, "TILE", tile)
    random.seed(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(1000 + i, " ".join(base), "s") for i in range(60)]
    for i in range(40):
        words = list(base)
        for _ in range(random.randint(1, 4)):
            words[random.randint(0, 79)] = f"x{random.randint(0, 500)}"
        rows.append((i, " ".join(words), "s"))
    table = docs(spark, rows)
    assert plain(J.ngram_components(table, 3, 9, 10).drop("row", "class")) == brute([(i, t) for i, t, _ in rows], 3, 9, 10)


@pytest.mark.parametrize(("tile", "num", "den"), [(3, 4, 5), (2048, 9, 10)])
def test_families_around_a_passage(spark, monkeypatch, tile, num, den):
    """Several families of near copies near the threshold, chains, and unrelated texts that share a passage."""
    monkeypatch.setattr(J, "TILE", tile)
    random.seed(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for f in range(6):
        words = [f"f{f}w{i}" for i in range(random.randint(20, 120))] + (passage if f % 2 else [])
        for _ in range(25):
            if random.random() < 0.5:
                words = list(words)
                at = random.randrange(len(words))
                words[at : at + random.randint(0, 2)] = [f"x{random.randint(0, 9)}" for _ in range(random.randint(0, 2))]
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, " ".join([*(f"u{i}n{j}" for j in range(random.randint(5, 60))), *passage])) for i in range(60)]
    random.shuffle(rows)
    table = docs(spark, [(i, t, "s") for i, t in rows])
    assert plain(J.ngram_components(table, 3, num, den).drop("row", "class")) == brute(rows, 3, num, den)


def test_similar_sets_always_share_a_key(spark):
    """Whatever the order of keys by how common they are, the sets left after the commonest are dropped meet."""
    rng, seen = np.random.default_rng(1), 0
    random.seed(7)
    spare = {}
    for num, den in ((9, 10), (4, 5), (1, 2)):
        sizes = spark.range(1, 1200).select(F.col("id").cast("int").alias("n"))
        spare |= {(num, den, r.n): r.d for r in sizes.select("n", J.left_out(F.col("n"), num, den).alias("d")).collect()}
    for _ in range(6000):
        num, den = random.choice([(9, 10), (4, 5), (1, 2)])
        a = np.unique(rng.integers(0, 2**63, int(10 ** random.uniform(0, 2.7))).astype(np.uint64))
        cut = random.randint(0, max(0, len(a) * (den - num) // den))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, random.randint(0, cut + 1)).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if len(b) and den * inter >= num * (len(a) + len(b) - inter) and not np.array_equal(a, b):
            seen += 1
            keys = [J.set_keys(x, num, den) for x in (a, b)]
            common = set(np.intersect1d(*keys).tolist())
            often = {x: (random.randint(0, 3) + (3 if x in common and seen % 2 else 0), x) for x in np.concatenate(keys).tolist()}
            kept = [set(sorted(x.tolist(), key=often.get)[: len(x) - spare[num, den, len(s)]]) for x, s in zip(keys, (a, b), strict=True)]
            assert kept[0] & kept[1]
    assert seen > 800


@pytest.mark.parametrize("dense", [1, 3, 24])
def test_overlaps_equal_set_intersections(monkeypatch, dense):
    monkeypatch.setattr(J, "DENSE_FROM", dense)
    monkeypatch.setattr(J, "COLUMNS", 3)
    random.seed(1)
    make = lambda n: [np.array(sorted(random.sample(range(30), random.randint(0, 20))), np.int64) for _ in range(n)]
    for _ in range(60):
        a, b = make(random.randint(1, 9)), make(random.randint(1, 9))
        assert (J.overlaps(a, b) == [[len(set(x) & set(y)) for y in b] for x in a]).all()
        own = J.overlaps(a, None)
        np.fill_diagonal(own, 0)
        assert (own == [[len(set(x) & set(y)) * (i != j) for j, y in enumerate(a)] for i, x in enumerate(a)]).all()


def test_components_of_a_long_path(spark):
    path = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = connected_components(path.unionByName(spark.createDataFrame([(900, 901), (905, 905)], "a long, b long")))
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(301)} | {(900, 900), (901, 900), (905, 905)}
    assert connected_components(path.limit(0)).count() == 0


def test_empty_and_clashing(spark):
    assert J.ngram_components(docs(spark, [])).count() == 0
    table = odd_docs(spark)
    assert plain(J.ngram_components(clashing(table))) == plain(J.ngram_components(table))


def _template_pages(n, draw):
    """Pages of one template, too unlike to link, and a few that are near copies of some of them."""
    base = [f"t{i}" for i in range(180)]
    pages = [" ".join(base[:90] + [f"o{p}x{i}" for i in range(30)] + base[90:]) for p in range(n)]
    copies = []
    for p in range(0, n, 50):
        words = pages[p].split()
        words[draw.randrange(100, 200)] = "changed"
        copies.append(" ".join(words))
    return [(i, t, "s") for i, t in enumerate(pages + copies)]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_unlinked_pages_of_a_template_are_not_compared_with_each_other(spark, monkeypatch, k, num, den):
    """Sets that are sent to blocks are in proportion to the pages."""
    monkeypatch.setattr(J, "TILE", 16)
    sent = []
    multiply = J._multiply

    def counting(docs, stand, spots, *args):
        sent.append(spots.select(F.sum(F.size("spots"))).first()[0] or 0)
        return multiply(docs, stand, spots, *args)

    monkeypatch.setattr(J, "_multiply", counting)
    shipped = {}
    for n in (150, 300):
        rows = _template_pages(n, random.Random(n))
        sent.clear()
        assert plain(J.ngram_components(docs(spark, rows), k, num, den).drop("row", "class")) == brute([r[:2] for r in rows], k, num, den)
        shipped[n] = sum(sent)
    assert shipped[300] <= 2.2 * shipped[150]
