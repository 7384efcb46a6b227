"""Sequence comparisons over arrays: built-ins where they can, and the loops that they cannot express."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def edit_distance(a: Column, b: Column) -> Column:
    """Edits between two arrays of strings or numbers: the built-in string distance over one character for each distinct element."""
    def coded(x: Column, known: Column) -> Column:
        # element k is character k, past the surrogates from there on; UTF-32 has four bytes for each
        code = lambda e: F.array_position(known, e).cast("int")
        hexes = F.transform(x, lambda e: F.lpad(F.hex(code(e) + F.when(code(e) >= 0xD800, 0x800).otherwise(0)), 8, "0"))
        return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-32")

    both = F.transform(F.array(F.array_distinct(F.concat(a, b))), lambda known: F.levenshtein(coded(a, known), coded(b, known)))
    return F.element_at(both, 1)


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one integer."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """``lcs_length`` of two array columns; Arrow batches, as no built-in has it."""
    return pd.Series([None if x is None or y is None else lcs_length(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], dtype="Int32")


def word_error_rate(edits: Column, ref_words: Column, pred_words: Column) -> Column:
    """Edits over reference words; an empty reference gives 0 if the prediction is empty too, else 1."""
    return F.when(ref_words > 0, edits / ref_words).when(pred_words > 0, 1.0).otherwise(0.0)


def quality_bucket(wer: Column) -> Column:
    return F.when(wer <= 0.15, "good").when(wer <= 0.30, "usable").otherwise("poor")


# Starts tried from the cursor, words beyond the unit's own length, cost of a later start, least accepted score.
REACH, SLACK, LATER, ACCEPT = 120, 12, 0.003, 0.45


def word_span(unit: Sequence[str], places: Mapping[str, Sequence[int]], n: int, cursor: int) -> tuple[int, int, float, str]:
    """Where a unit's words stand among a recording's ``n``: (start, end, score, method); ``places`` has each word's positions, ascending.

    A start scores the share of the unit's words that follow from it in order within the unit's length and SLACK, less a little for each word skipped;
    of the next REACH starts the best wins, the earliest on ties. Below the accepted score the unit takes as many words as it has.

    Starts between two places of the first word meet the same chain of places, and see more of it the later they are. So for each
    place of the first word and each length of chain only the earliest start that sees so much can win.
    """
    size, width, last = len(unit), len(unit) + SLACK, min(n, cursor + REACH)
    if not size or not n:
        return cursor, cursor, 0.0, "empty"
    best_score, best_start, best_end = 0.0, cursor, cursor
    firsts = places.get(unit[0], ())
    low = cursor
    for q in firsts[bisect_left(firsts, cursor) :]:
        if low >= last:
            break
        high = min(q, last - 1)
        for found, word in enumerate(unit[1:] + [None], 1):
            start = max(low, q - width + 1)
            if start > high:
                break
            score = found / size - LATER * (start - cursor)
            if score > best_score:
                best_score, best_start, best_end = score, start, q + 1
            nexts = places.get(word, ())
            i = bisect_right(nexts, q)
            if i == len(nexts):
                break
            q = nexts[i]
        low = high + 1
    kept = round(best_score, 3)
    if best_score >= ACCEPT:
        return best_start, best_end, kept, "token_match"
    return cursor, min(n, cursor + size), kept, "word_count_fallback"
