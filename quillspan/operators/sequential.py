"""Operators whose state runs along a sequence: per-key Arrow functions that keep to one group."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quillspan.functions import vocab
from quillspan.functions.sequences import word_span
from quillspan.operators.scan import fits, scan


def align_units(df: DataFrame, key: str) -> DataFrame:
    """Units aligned with words, the cursor carried along: ``df`` (key, units, words array<string>, starts, ends array<double>, seconds).

    (key, unit_no, start_word, end_word, start_seconds, end_seconds, score, method), a row for each unit; units without
    words take even shares of the duration. Each row is independent, so batches stream without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                cursor, n = 0, len(r.units)
                places = defaultdict(list)
                for i, word in enumerate(r.words):
                    places[word].append(i)
                for i, unit in enumerate(r.units):
                    a, b, score, method = word_span(list(unit), places, len(r.words), cursor)
                    cursor = max(cursor, b)
                    if a < len(r.words) and b > a:
                        start, end = r.starts[a], r.ends[min(b, len(r.words)) - 1]
                    else:
                        start, end = r.seconds * i / n, r.seconds * (i + 1) / n
                    out.append((getattr(r, key), i, a, b, round(max(0.0, start), 3), round(max(start, min(r.seconds, end)), 3), score, method))
            yield pd.DataFrame(out, columns=[key, "unit_no", "start_word", "end_word", "start_seconds", "end_seconds", "score", "method"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "units", "words", "starts", "ends", "seconds").mapInPandas(run, f"{key} {kind}, unit_no int, start_word int, end_word int, start_seconds double, end_seconds double, score double, method string")


def _matched(keys: Sequence[str], tolerance: int):
    """Matches of events that come sorted by (keys, stretch, pos).

    References wait until all predictions within their reach are seen, and free predictions stay until no reference can reach them, so
    what is held is what lies within the tolerance, however long a stretch is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs: deque[int] = deque()
        free: deque[int] = deque()
        of, stretch, out = None, None, []

        def settle(ref: int) -> None:
            while free and free[0] < ref - tolerance:
                free.popleft()
            best = None
            for i, p in enumerate(free):
                if p > ref + tolerance or best is not None and p - ref >= abs(free[best] - ref):
                    break
                if best is None or abs(p - ref) < abs(free[best] - ref):
                    best = i
            if best is not None:
                out.append((*of, ref, free[best]))
                del free[best]

        for pdf in batches:
            for *k, s, pos, is_ref in zip(*[pdf[c].tolist() for c in (*keys, "_stretch", "pos", "is_ref")], strict=True):
                if s != stretch or k != of:
                    while refs:
                        settle(refs.popleft())
                    free.clear()
                    of, stretch = k, s
                while refs and refs[0] + tolerance < pos:
                    settle(refs.popleft())
                if is_ref:
                    refs.append(pos)
                else:
                    reached = refs[0] if refs else pos
                    while free and free[0] < reached - tolerance:
                        free.popleft()
                    free.append(pos)
            yield pd.DataFrame(out, columns=[*keys, "ref", "pred"])
            out.clear()
        while refs:
            settle(refs.popleft())
        yield pd.DataFrame(out, columns=[*keys, "ref", "pred"])

    return run


def match_events(df: DataFrame, keys: Sequence[str], tolerance: int) -> DataFrame:
    """Greedy one-to-one matches of ``df`` (keys..., pos long, is_ref boolean): (keys..., ref, pred).

    Each reference in turn takes the nearest free prediction, the earlier one on ties. Events more than ``tolerance`` apart do not compete, so a key's
    events are cut into stretches where such a gap is. A stretch is streamed in order by one task and not gathered, so one without a gap takes time but no memory.
    """
    events = df.select(*keys, "pos", "is_ref", F.monotonically_increasing_id().alias("_id"))
    line = [F.col("pos"), F.col("is_ref"), F.col("_id")]
    small = fits(df, keys)
    gaps = scan(events, keys, line, before={"_prev": F.col("pos")}, small=small).withColumn("_gap", F.coalesce(F.col("pos") - F.col("_prev") > tolerance, F.lit(False)).cast("long"))
    stretches = scan(gaps.drop("_prev"), keys, line, sums={"_stretch": F.col("_gap")}, small=small).select(*keys, "_stretch", "pos", "is_ref")
    ordered = stretches.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "pos", "is_ref")
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.mapInPandas(_matched(keys, tolerance), f"{kinds}, ref long, pred long")


def decode_batched(df: DataFrame, decode, schema: str, size: int = 8) -> DataFrame:
    """A model slot: ``decode(list of rows)`` gives rows; a batch that fails is halved until single rows fail alone."""

    def attempt(rows: list[dict]) -> list[dict]:
        try:
            return decode(rows)
        except Exception:
            if len(rows) == 1:
                raise
            half = len(rows) // 2
            return attempt(rows[:half]) + attempt(rows[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            out = [x for i in range(0, len(rows), size) for x in attempt(rows[i : i + size])]
            if out:
                yield pd.DataFrame(out)

    return df.mapInPandas(run, schema)


def register_unit_splitter(spark: SparkSession, name: str = "split_units") -> None:
    """A table function for SQL: ``LATERAL split_units(text)`` gives (unit_no, unit) for the units between runs of exclamation marks."""

    @udtf(returnType="unit_no int, unit string")
    class Splitter:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            said = re.sub(vocab.CONTROL_RE, " ", text or "")
            units = (" ".join(u.split()) for u in re.split(vocab.IU_SEPARATOR_RE, said))
            yield from enumerate(u for u in units if u)

    spark.udtf.register(name, Splitter)


def collated(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a group as arrays in order, for a model's batch; groups are a handful of rows."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(*keys).agg(rows.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])
