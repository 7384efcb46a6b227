"""Host-level quality rules, in DataFrame functions only.

Rules fail or pass on each document; failures are counted by host; each host's failure rate is drawn towards the rate
of all hosts by a beta prior whose two parameters come from the hosts themselves (moments of the raw rates, weighted by
documents). A host whose drawn-in rate of any rule is too high is blocked; one that is clearly worse than the rest by a rule is
held to that rule. Both verdicts are joined back to the host's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.scratch import save

BLANK = "[ \\t-\\r]+"
#: Rules whose failures are counted by host, as SQL over the base columns.
RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
}
#: A host whose shrunk failure rate of a rule is above this is blocked; one whose rate is above LIFT times the rate of all
#: documents loses the documents that fail that rule.
MAX_RATE, LIFT = 0.5, 1.25


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Each window gives one long: its hash in the upper bits, its position in as many lower bits as the text needs.
    Sorting brings equal windows together. As a long text leaves fewer bits for the hash, the windows with an equal
    neighbour are sorted once more by another hash; in a text of ten million words both agree by chance in less than one text in a thousand.
    Their positions, sorted, each add the words that the next one does not cover.
    """

    def count(w: Column) -> Column:
        n = F.size(w)
        room = F.expr("0") + F.ceil(F.log2(n + F.lit(1))).cast("int")
        step = F.call_function("shiftleft", F.lit(1).cast("long"), room)

        def windows(one: Column) -> Column:
            packed = lambda i, salt: F.xxhash64(*salt, F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.negate(one)).bitwiseOR(i.cast("long"))
            first = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: packed(i, ())))
            again = lambda s: F.sort_array(F.transform(twice(s, one), lambda p: packed(p.bitwiseAND(one - 1).cast("int"), (F.lit(1),))))
            return let(first, lambda s: let(again(s), lambda t: covered(F.sort_array(F.transform(twice(t, one), lambda p: p.bitwiseAND(one - 1))))))

        def twice(s: Column, one: Column) -> Column:
            same = lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.negate(one)) == 0
            return F.filter(s, lambda p, i: F.coalesce(same(F.get(s, i - 1), p), F.lit(False)) | F.coalesce(same(F.get(s, i + 1), p), F.lit(False)))

        def covered(at: Column) -> Column:
            three = F.lit(3).cast("long")
            return let(at, lambda q: F.aggregate(F.transform(q, lambda x, i: F.least(three, F.coalesce(F.get(q, i + 1) - x, three))), F.lit(0).cast("long"), lambda a, x: a + x))

        return F.when(n >= 3, let(step, windows)).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def base_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed) of whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("t"), words.alias("w"), lines.alias("x"))
    return one.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("x") - F.size(F.array_distinct("x"))).cast("long").alias("n_dup_lines"),
        F.size("x").cast("long").alias("n_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def host_rates(base: DataFrame) -> DataFrame:
    """(host, n_docs, and for each rule its failures, shrunk rate and mean of all), one row for each host.

    The prior of a rule has the mean m of all documents and a strength s from the spread v of the hosts' raw rates,
    weighted by documents: s = m(1-m)/v - 1, held between 1 and 1000 (no spread: 1000). The rate is
    (failures + m*s) / (documents + s). Hosts enter with weights, so a host with a third of all rows is one row here.
    """
    hosts = base.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.expr(rule).cast("long")).alias(f"fail_{r}") for r, rule in RULES.items()])
    total = hosts.agg(
        F.sum("n_docs").alias("all_docs"),
        *[F.sum(f"fail_{r}").alias(f"all_{r}") for r in RULES],
        *[F.sum(F.expr(f"cast(fail_{r} as double) * fail_{r} / n_docs")).alias(f"sq_{r}") for r in RULES],
    )
    prior = []
    for r in RULES:
        mean = f"(all_{r} / all_docs)"
        spread = f"(sq_{r} / all_docs - pow({mean}, 2))"
        prior.append(F.expr(f"cast({mean} as double)").alias(f"m_{r}"))
        prior.append(F.expr(f"case when {spread} > 1e-12 then greatest(1D, least(1000D, {mean} * (1 - {mean}) / {spread} - 1)) else 1000D end").alias(f"s_{r}"))
    with_prior = hosts.withColumn("prior", total.select(F.struct(*prior)).scalar())
    rates = [F.expr(f"(fail_{r} + prior.m_{r} * prior.s_{r}) / (n_docs + prior.s_{r})").alias(f"rate_{r}") for r in RULES]
    return with_prior.select("host", "n_docs", *[f"fail_{r}" for r in RULES], *rates, *[F.col(f"prior.m_{r}").alias(f"mean_{r}") for r in RULES])


def host_quality(docs: DataFrame, max_rate: float = MAX_RATE, lift: float = LIFT) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) to the base columns and ``kept``, a row for each row of ``docs``.

    A null or blank text has no words and fails; a null host is a host of its own. A document is kept if it passes the
    base rules, its host is not blocked, and it passes the rules by which its host's shrunk rate is above ``lift`` times the
    rate of all documents. Whole texts are read, however long. Repeated rows count each. Other columns of ``docs`` are not read; an empty
    table gives no rows. Base columns are written once and used for the hosts and for the join back.
    """
    base = save(base_columns(docs), "host-quality")
    blocked = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_rate
    hosts = host_rates(base).select(F.col("host").alias("h"), blocked.alias("blocked"), *[(F.col(f"rate_{r}") > lift * F.col(f"mean_{r}")).alias(f"held_{r}") for r in RULES])
    verdict = base.join(hosts, base["host"].eqNullSafe(hosts["h"]), "left")
    fails = " or ".join(["base_failed", "coalesce(blocked, false)", *(f"(coalesce(held_{r}, false) and {rule})" for r, rule in RULES.items())])
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"not ({fails})").alias("kept"))
