"""Fill-in-middle: texts cut in three at code points and put together in another order.

Cuts are given in code points and texts are held as UTF-8. While a text's code points are counted, a sparse index of checkpoints is
kept: the byte offset and the code points before it, every STEP bytes. A cut is found by binary search among the
checkpoints and a scan of at most STEP bytes from there, so no text is decoded or held as one number for each character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.words import small, texts

#: Bytes between checkpoints.
STEP = 1024

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


@dataclass
class Checkpoints:
    """The sparse index of one text: checkpoint i stands at byte ``i * step``, with ``before[i]`` code points before it."""

    starts: np.ndarray
    before: np.ndarray
    step: int

    @property
    def units(self) -> int:
        """Code points of the text."""
        return int(self.before[-1])

    def byte_of(self, unit: int) -> int:
        """The byte at which code point ``unit`` begins; the text's end for its number of code points."""
        if unit >= self.units:
            return len(self.starts)
        i = int(np.searchsorted(self.before, unit, side="right")) - 1  # the last checkpoint with at most ``unit`` before it
        at = i * self.step
        return at + int(np.flatnonzero(self.starts[at : at + self.step])[unit - int(self.before[i])])


def checkpoints(text: bytes, step: int = STEP) -> Checkpoints:
    """Count a text's code points, keeping a checkpoint every ``step`` bytes. A code point begins at any byte that is not 10xxxxxx."""
    starts = np.frombuffer(text, np.int8) >= -64
    before = np.zeros(-(-len(text) // step) + 1, np.int64)
    if len(text):
        np.cumsum(np.add.reduceat(starts, np.arange(0, len(text), step), dtype=np.int64), out=before[1:])
    return Checkpoints(starts, before, step)


def cut(text: bytes, h1: int, h2: int, step: int = STEP) -> tuple[int, int, int, int, int]:
    """The number n of code points, and where the first and second cut lie, in code points and then in bytes: at h1 and h2 modulo n + 1."""
    index = checkpoints(text, step)
    a, b = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
    return index.units, a, b, index.byte_of(a), index.byte_of(b)


def _transform(plain_from: int, spm_below: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            ids = batch.column("doc_id")
            draws = [batch.column(h).to_pylist() for h in ("h1", "h2", "h3", "h4")]
            ns, forms, prefixes, middles, outs = [], [], [], [], []
            for text, h1, h2, h3, h4 in zip(texts(batch, "text"), *draws, strict=True):
                n, a, b, at, to = cut(text, h1, h2, step)
                if not text or h3 % 100 >= plain_from or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    form, out, a, b = "plain", text, None, None
                elif h4 % 100 < spm_below:
                    form, out = "spm", b"".join((SUFFIX, text[to:], PREFIX, text[:at], MIDDLE, text[at:to]))
                else:
                    form, out = "psm", b"".join((PREFIX, text[:at], SUFFIX, text[to:], MIDDLE, text[at:to]))
                ns.append(n)
                forms.append(form)
                prefixes.append(a)
                middles.append(None if a is None else b - a)
                outs.append(out)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outs, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, step: int = STEP) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, n, form, prefix_chars, middle_chars, output), a row for each row.

    The draws h1 to h4 are the first 8-digit groups of the hex sha256 of ``seed:doc_id``: cuts at h1 and h2 modulo n + 1 code points, plain
    if h3 % 100 >= ``plain_from``, else suffix first if h4 % 100 < ``spm_below``. Texts that are empty or hold a mark stay plain. A null text is
    empty; a null doc_id is drawn for as an empty one; rows that share an id are each transformed, with the same draws; texts of any
    length are cut whole; other columns are not read; an empty table gives no rows. Rows never meet, so nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *draws)
    return rows.mapInArrow(_transform(plain_from, spm_below, step), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone: a marked output holds each mark once."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    first, rest = (lambda mark: F.substring_index(output, mark, 1)), (lambda mark: F.substring_index(output, mark, -1))
    middle = rest(m)
    psm = F.concat(F.substring_index(first(s), p, -1), middle, F.substring_index(rest(s), m, 1))
    spm = F.concat(F.substring_index(rest(p), m, 1), middle, F.substring_index(first(p), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_digests(formatted: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` gives with digests of the output and of the text restored from it, in place of the output."""
    text = restored(F.col("output"), F.col("form"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return formatted.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(text).alias("restored_sha256"))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The four draws of a document, as ``fill_in_middle`` takes them."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
