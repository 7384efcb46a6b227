from __future__ import annotations

import random
import time

import numpy as np
from helpers import clashing, docs, odd_docs, plain

from quillspan.llm import decontaminate as D
from quillspan.llm.words import window_hashes, word_hashes


def tiling(text, item, least):
    a, b, tiles = [0] * len(text), [0] * len(item), []
    while True:
        size, found = least - 1, []
        for j in range(len(item)):
            for i in range(len(text)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > size:
                    size, found = n, [(i, j)]
                elif n == size and n >= least:
                    found.append((i, j))
        if size < least:
            return sorted(tiles)
        for i, j in found:
            if not any(a[i : i + size]) and not any(b[j : j + size]):
                a[i : i + size] = b[j : j + size] = [1] * size
                tiles.append((i, j, size))


def seed_tiles(text, item, least):
    """Tiles of one text and one item by way of their seeds."""
    h, other = word_hashes(D.tokens(text)), word_hashes(D.tokens(item))
    n = min(least, len(other))
    starts = np.flatnonzero(np.isin(window_hashes(h, n), window_hashes(other, n)))
    return sorted(D.tiles_of_seeds(starts, h[starts[:, None] + np.arange(n)], other)) if len(starts) else []


def test_tiles_equal_the_plain_algorithm():
    random.seed(5)
    for _ in range(200):
        text, item = [random.choice("0123") for _ in range(random.randint(0, 40))], [random.choice("0123") for _ in range(random.randint(1, 15))]
        if random.random() < 0.6:
            k = random.randint(0, len(text))
            text[k:k] = item[len(item) // 2 :] + item[: len(item) // 2]
        least = random.choice([2, 3, 4])
        assert seed_tiles(" ".join(text), " ".join(item), least) == tiling(text, item, min(least, len(item)))


def test_long_repetitive_text_is_tiled_in_seconds():
    began = time.perf_counter()
    got = seed_tiles("spam " * 100_000, "spam " * 900 + "ham", 5)
    assert got == [(0, 0, 900)] and time.perf_counter() - began < 10


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_finds_copies_reordered_and_changed_passages(spark):
    w = ITEM.split()
    table = docs(spark, [
        (1, "before " + ITEM + " after", "s"), (2, " ".join(w[10:] + ["other"] + w[:10]), "s"), (3, ITEM.upper().replace(" ", ", "), "s"),
        (4, " ".join(w[:8]) + " nothing else", "s"), (5, " ".join(reversed(w)), "s"), (6, "unrelated words only", "s"),
    ])
    got = {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in D.contaminated(table, items(spark, [(9, ITEM), (10, "beta short")])).collect()}
    assert got == {(1, 9): (20, 1), (2, 9): (20, 2), (3, 9): (20, 1)}


def test_short_null_and_blank_items(spark):
    table = docs(spark, [(1, "we saw two words here", "s"), (2, None, "s")])
    got = D.contaminated(table, items(spark, [(1, "two words"), (2, None), (3, " ,; "), (4, "words two")]))
    assert plain(got.select("doc_id", "item_id", "covered")) == [(1, 1, 2)]


def test_equals_every_text_against_every_item(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    bench = [(i, " ".join(draw.choices(words, k=draw.choice([1, 2, 4, 5, 6, 9, 14])))) for i in range(25)] + [(3, "w1 w2"), (None, "w3 w4 w5")]
    table = []
    for i in range(60):
        parts = [" ".join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(3)]
        for _ in range(draw.randint(0, 3)):
            said = draw.choice(bench)[1].split()
            cut = draw.randint(0, len(said))
            parts.insert(draw.randint(0, 3), " ".join(said[cut:] + said[:cut]))
        table.append((i % 50, " ".join(parts), "s"))
    want = []
    for doc_id, text, _ in table:
        for item_id, item in bench:
            found = tiling(text.split(), item.split(), min(5, len(item.split())))
            covered = sum(n for _, _, n in found)
            if 2 * covered >= len(item.split()):
                want.append((doc_id, item_id, covered, len(item.split()), len(found), ",".join(f"{i}:{j}:{n}" for i, j, n in found)))
    assert len(want) > 100 and plain(D.contaminated(docs(spark, table), items(spark, bench)).drop("row")) == sorted(want, key=str)


def test_odd_rows(spark):
    table, bench = odd_docs(spark), items(spark, [(1, "one two three four five six"), (2, "word word word word word word")])
    got = plain(D.contaminated(table, bench).select("doc_id", "item_id"))
    assert got == [(5, 2), (7, 1), (7, 1)]
    assert plain(D.contaminated(clashing(table), bench)) == plain(D.contaminated(table, bench))
    assert D.contaminated(docs(spark, []), bench).count() == 0 and D.contaminated(table, bench.limit(0)).count() == 0
