"""Personal data by bootstrapped contextual extraction.

Regular expressions find the base entities: emails, IP addresses, card numbers and phone numbers. They are the seeds.
The one or two words before a seed are a lexical pattern. How often a pattern stands in the corpus at all, and how
often an entity follows, gives its confidence; a pattern passes it on to the other identifier-like strings that follow
it, and these, by how sure they are, to the patterns before them. Spark scores this graph of patterns and instances for
a few rounds; instances above a threshold are found identifiers of the kind that scored best.

Patterns and instances are hashes. A scan asks a bitmap of fixed size whether a word or pair of words may be a pattern, and
the exact join that follows drops the rest, so no table of patterns is held by a task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quillspan.llm.bitmap import FILTER_BITS, collected_bits
from quillspan.llm.decontaminate import tokens
from quillspan.llm.words import small, window_hashes, word_hashes
from quillspan.scratch import holding, release, save

# The kinds in order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)|[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Words as ``tokens`` cuts them, and what may stand between a pattern and the string it announces.
TOKEN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
BETWEEN = re.compile(r"[\x00-\x20\"'(\[{<#*$%&|=:;,.!?>)\]}/\\^_`~-]*")
# What a pattern can announce: groups of digits parted by single blanks; a mail address in words; a word no longer than mail addresses get.
GROUPS = re.compile(r"\+?[0-9][0-9().\-/]{0,24}(?:\x20[0-9(][0-9().\-/]{0,24}){0,8}(?![^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])")
SPELLED = re.compile(r"[\w.+-]{1,64}(?:\x20(?:at|dot|\(at\)|\(dot\)|\[at\]|\[dot\])\x20[\w-]+)+", re.IGNORECASE)
SPOKEN = re.compile(r"\x20[(\[]?(at|dot)[)\]]?\x20", re.IGNORECASE)
WORD = re.compile(r"[^\x20\x09-\x0D]{1,300}")
NAME = re.compile(r"@|\(at\)|\[at\]|_|[0-9]", re.IGNORECASE)
ENDS = "\"')]}>*#$%&|=:;,.!?-/"

#: Digits of a number at least; distinct seeds behind a pattern at least; share of its occurrences that seeds follow from
#: which on a pattern announces others; rounds; score from which an instance counts.
DIGITS, SUPPORT, PROMISING, ROUNDS, SURE = 5, 3, 0.2, 3, 0.8
#: Characters of an announced word at most, as of mail addresses.
LONGEST = 254


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base entities, sorted; each kind leftmost and without overlaps."""
    out: list[tuple[int, int, int]] = []
    at = text.find("@")
    pos = 0
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            pos = found.end()
        else:
            pos = max(pos, at + 1)  # no local part holds an @
        at = text.find("@", max(pos, at + 1))
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if m[1] is not None and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 38:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidate(text: str, at: int) -> tuple[int, int, bool] | None:
    """(start, end, is a number) of the identifier-like string after a position, if one stands there."""
    start = BETWEEN.match(text, at).end()
    if m := GROUPS.match(text, start):
        end = start + len(m[0].rstrip(ENDS + "("))
        if sum(c.isdigit() for c in text[start:end]) >= DIGITS:
            return start, end, True
    if (m := SPELLED.match(text, start)) and {"at", "dot"} <= {x.lower() for x in SPOKEN.findall(m[0])}:
        return start, m.end(), False
    if not (m := WORD.match(text, start)) or m.end() - start > LONGEST:
        return None
    end = start + len(m[0].rstrip(ENDS))
    if not NAME.search(text, start, end):
        return None
    digits = sum("0" <= c <= "9" for c in text[start:end])
    if any(c.isalpha() or c == "@" for c in text[start:end]):
        return start, end, False
    return (start, end, True) if digits >= DIGITS else None


def _signed(hashes: np.ndarray) -> list[int]:
    return hashes.view(np.int64).tolist()


def contexts(text: str, start: int) -> list[int]:
    """The patterns before a position: hashes of its last word, and of its last two."""
    size = 64
    while True:
        words = tokens(text[max(0, start - size) : start])
        if len(words) > 2 or size >= start:  # the first may be cut
            break
        size *= 4
    h = word_hashes(words[-2:])
    return _signed(window_hashes(h[-1:], 1)) + _signed(window_hashes(h, 2))


_SCHEMA = (
    "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans array<struct<start:int,kind_no:int,end:int>>, seeds array<struct<kind_no:int,instance:long,patterns:array<long>>>"
)


def _instance(text: str) -> int:
    h = xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("end", pa.int32())]))
    seeds_type = pa.list_(pa.struct([("kind_no", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
    for batch in small(batches):
        counts, shas, spans, seeds = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text)
            n = Counter(k for _, k, _ in found)
            counts.append([n[k] for k in range(len(KINDS))])
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest())
            spans.append([{"start": a, "kind_no": k, "end": b} for a, k, b in found])
            seeds.append([{"kind_no": k, "instance": _instance(text[a:b]), "patterns": contexts(text, a)} for a, k, b in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))), pa.array(shas, pa.string()), pa.array(spans, spans_type), pa.array(seeds, seeds_type)],
            ["doc_id", "row", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "seeds"],
        )


def _maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _occurrences(bits):
    """How often each of the patterns stands in a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            hits = [np.empty(0, np.uint64)]
            for text in batch.column("text").to_pylist():
                h = word_hashes(tokens(text))
                for k in (1, 2):
                    w = window_hashes(h, k)
                    hits.append(w[_maybe(bits.value, w)])
            found, total = np.unique(np.concatenate(hits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total.astype(np.int64))], ["pattern", "total"])

    return run


def _announced(bits):
    """What follows the patterns in the texts, outside the base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                h = word_hashes(tokens(text))
                one, two = window_hashes(h, 1), window_hashes(h, 2)
                after = [(i, p) for w, k in ((one, 0), (two, 1)) for i, p in zip((np.nonzero(_maybe(bits.value, w))[0] + k).tolist(), _signed(w[_maybe(bits.value, w)]), strict=True)]
                if not after:
                    continue
                ends = [m.end() for m in TOKEN.finditer(text)]
                taken = sorted((a, b) for a, _, b in base_spans(text))
                starts, upto = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
                for i, p in after:
                    if found := candidate(text, ends[i]):
                        a, b, number = found
                        at = bisect_right(starts, a)
                        if (at == 0 or upto[at - 1] <= a) and (at == len(taken) or starts[at] >= b):
                            rows.append(row)
                            out.append((a, b, number, _instance(text[a:b]), p))
            start, end, number, instance, pattern = zip(*out, strict=True) if out else [()] * 5
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(number, pa.bool_()), pa.array(instance, pa.int64()), pa.array(pattern, pa.int64())],
                ["doc_id", "row", "start", "end", "number", "instance", "pattern"],
            )

    return run


def pattern_scores(seeds: DataFrame, totals: DataFrame, announced: DataFrame, rounds: int) -> DataFrame:
    """(instance, kind_no, score) from the graph of patterns and the strings that they announce.

    ``seeds`` (pattern, kind_no, seeded), ``totals`` (pattern, total) and ``announced`` (pattern, instance, number, n) are counts. A pattern's
    trust in a kind is the mass behind it (seeds, and announced strings by their score) over its occurrences and one more; an instance's score
    is the chance that not all its patterns err. Emails are announced as words, the other kinds as numbers.
    """
    scores = None
    for _ in range(rounds):
        mass = seeds.select("pattern", "kind_no", F.col("seeded").cast("double").alias("mass"))
        if scores is not None:
            mass = mass.unionByName(announced.join(scores, "instance").groupBy("pattern", "kind_no").agg(F.sum(F.col("n") * F.col("score")).alias("mass")))
        trust = mass.groupBy("pattern", "kind_no").agg(F.sum("mass").alias("mass")).join(totals, "pattern").select("pattern", "kind_no", F.least(F.lit(0.999), F.col("mass") / (F.col("total") + 1)).alias("trust"))
        fits = (F.col("kind_no") != KINDS.index("email")) == F.col("number")
        last, scores = scores, save(announced.join(trust, "pattern").where(fits).groupBy("instance", "kind_no").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score")), "pii-scores")
        if last is not None:
            release(last)
    return scores


def find_pii(docs: DataFrame, sure: float = SURE, support: int = SUPPORT, promising: float = PROMISING, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row.

    The counts and the digest are of the base entities; ``spans`` lists those and the ones found by patterns as
    kind:start:end (code points, end exclusive) by start, then kind. A string can be found if it follows a pattern: groups of
    digits, a mail address in words, or a word (up to 254 characters) that holds a digit, an underscore or an at sign. A null text is empty and has none. Whole texts
    are read. Repeated rows repeat; a null doc_id is kept; other columns are not read; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    scanned = save(docs.mapInArrow(_scan, _SCHEMA), "pii-scan")
    edges = scanned.select(F.explode("seeds").alias("s")).select("s.kind_no", "s.instance", F.explode("s.patterns").alias("pattern")).groupBy("pattern", "instance", "kind_no").agg(F.count("*").alias("n"))
    by_kind = edges.groupBy("pattern", "kind_no").agg(F.count("*").alias("distinct"), F.sum("n").alias("seeded"))
    backed = by_kind.groupBy("pattern").agg(F.sum("distinct").alias("distinct")).where(F.col("distinct") >= support).select("pattern")
    seeds = save(by_kind.join(backed, "pattern").select("pattern", "kind_no", "seeded"), "pii-seeds")
    bits = sc.broadcast(collected_bits(seeds, F.col("pattern")))
    counted = docs.select("text").mapInArrow(_occurrences(bits), "pattern long, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    most = seeds.groupBy("pattern").agg(F.max("seeded").alias("most"))
    totals = save(counted.join(most, "pattern").where(F.col("most") >= promising * F.col("total")).select("pattern", "total"), "pii-totals")
    bits = sc.broadcast(collected_bits(totals, F.col("pattern")))
    schema = "doc_id long, row long, start int, end int, number boolean, instance long, pattern long"
    follows = save(docs.mapInArrow(_announced(bits), schema).join(totals.select("pattern"), "pattern", "left_semi"), "pii-follows")
    announced = save(follows.groupBy("pattern", "instance", "number").agg(F.count("*").alias("n")), "pii-announced")
    scores = pattern_scores(seeds, totals, announced, rounds)
    best = scores.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind_no")).alias("k"))).alias("b"))
    found = best.where(F.col("b.score") >= sure).select("instance", (-F.col("b.k")).cast("int").alias("found_no"))
    more = follows.join(found, "instance").groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", F.col("found_no").alias("kind_no"), "end")).alias("more"))
    more = more.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "more")
    joined = scanned.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:int,kind_no:int,end:int>>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")
    for table in (seeds, totals, announced):
        release(table)
    return holding(joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans")), scanned, follows, scores)
