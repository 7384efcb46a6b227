from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from helpers import clashing, docs, odd_docs, plain
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspan.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def best(items, capacity):
    items, least = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(items):
            least[0] = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins) if x + items[i] <= capacity}.values():
            bins[b] += items[i]
            go(i + 1, bins)
            bins[b] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return least[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=10))
def test_plan_is_optimal_on_small_cases(items):
    counts = Counter(items)
    plan = P.plan(counts, 50)
    held = Counter()
    for filling, bins in plan:
        assert sum(n * k for n, k in filling) <= 50
        for n, k in filling:
            held[n] += k * bins
    assert held == counts and sum(m for _, m in plan) == best(items, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(12, 50), min_size=12, max_size=20))
def test_plan_is_optimal_around_large_pieces(items):
    assert sum(m for _, m in P.plan(Counter(items), 50)) == best(items, 50)


@pytest.mark.parametrize(("seed", "low", "high", "n"), [(1, 1300, 2100, 500), (2, 900, 1800, 400), (5, 1200, 1500, 400), (6, 700, 1400, 400)])
def test_branch_and_bound_beats_best_fit(seed, low, high, n):
    counts = Counter(np.random.default_rng(seed).integers(low, high, n).tolist())
    found, fit = (sum(m for _, m in x) for x in (P.plan(counts, 4096), P.best_fit(counts, 4096)))
    assert P.least_bins(counts, 4096) <= found < fit


def undominated(counts, left, waste):
    """All fillings, and whether some free piece improves a subset of their pieces, by trying all subsets."""
    kinds, out = sorted(counts, reverse=True), []

    def go(i, room, chosen):
        if i == len(kinds):
            if room <= waste:
                free = {x for x in counts if counts[x] > chosen.count(x)}
                sums = {(sum(c), k) for k in range(1, len(chosen) + 1) for c in combinations(chosen, k)}
                if not any(s <= x <= s + room and (x > s or k > 1) for s, k in sums for x in free):
                    out.append((room, chosen))
            return
        for times in range(min(counts[kinds[i]], room // kinds[i]), -1, -1):
            go(i + 1, room - times * kinds[i], chosen + [kinds[i]] * times)

    go(0, left, [])
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 60), st.integers(0, 40))
def test_fillings_are_the_undominated_ones(items, left, waste):
    counts = Counter(items)
    found = list(P.fillings(counts, left, waste, [10**9]))
    assert sorted(found) == undominated(counts, left, waste) and [w for w, _ in found] == sorted(w for w, _ in found)


def reference(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), max_size=40))
def test_ids_equal_the_tokenizers(text):
    assert P.token_bytes(text, PATH) == reference(text)


def test_ids_of_odd_texts():
    random.seed(2)
    alphabet = [chr(c) for c in range(256)] + ["İ", "Σ", "́", "<|endoftext|>", " ", "中", "'s", "'RE"]
    for _ in range(1500):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 20)))
        assert P.token_bytes(text, PATH) == reference(text)


def check(rows, texts, capacity):
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    for doc_id, text in texts:
        ids = reference(text or "") + np.array([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            want[doc_id][(k, k * capacity, len(part) // 4, zlib.crc32(part))] += 1
    assert pieces == want
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("bucket_rows", [3, 200_000])
def test_pieces_and_places(spark, sf_dir, bucket_rows):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd_docs(spark))
    rows = P.pack(table, PATH, 512, 1, bucket_rows).collect()
    n = check(rows, [(r.doc_id, r.text) for r in table.collect()], 512)
    assert n <= -(-sum(r.length for r in rows) // 512) * 1.01 + 1


def test_empty_and_clashing(spark):
    assert P.pack(docs(spark, []), PATH).count() == 0
    table = docs(spark, [(i, "same text", "s") for i in range(50)])
    assert plain(P.pack(clashing(table), PATH)) == plain(P.pack(table, PATH))
