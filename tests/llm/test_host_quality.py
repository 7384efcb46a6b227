from __future__ import annotations

import re
from collections import Counter

from helpers import clashing, docs, odd_docs, plain

from quillspan.llm.host_quality import base_columns, host_quality, host_rates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_columns_equal_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd_docs(spark))
    more = docs(spark, [(20, "a b c a b c a b", "s"), (21, "a a a a", "s"), (22, "x\nx\n x\n\nx", "s"), (23, "#a *b* $|<>", "s"), (24, "a\x1cb\x85c d", "s"), (25, " ".join(str(i % 40_000) for i in range(70_000)), "s")])
    table = table.unionByName(more)
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in host_quality(table).collect()], key=str)
    want = []
    for r in table.collect():
        b = base(r.text)
        want.append((r.doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == sorted(want, key=str)


def test_bad_host_is_blocked_and_small_host_is_drawn_to_the_rest(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, f"good{i % 10}") for i in range(200)] + [(1000 + i, "short", "bad") for i in range(60)] + [(2000, good, "bad"), (3000, "short", "tiny"), (3001, good, "tiny")]
    table = docs(spark, rows)
    got = {r.doc_id: r.kept for r in host_quality(table).collect()}
    assert got[0] and not got[2000] and got[3001]
    rates = {r.host: r for r in host_rates(base_columns(table)).collect()}
    assert rates["tiny"].fail_base == 1 and 0 < rates["tiny"].rate_base < 0.5 < rates["bad"].rate_base < 60 / 61


def test_worse_host_is_held_to_the_rule(spark):
    """A document with many symbols goes where they are common, and stays where they are not."""
    good, marked = " ".join(f"w{i}" for i in range(60)), " ".join(f"#w{i}" for i in range(60))
    rows = [(i, marked if i % 50 == 0 else good, f"fine{i // 100}") for i in range(400)] + [(1000 + i, marked if i % 5 == 0 else good, "worse") for i in range(100)]
    got = {r.doc_id: r.kept for r in host_quality(docs(spark, rows)).collect()}
    assert all(got[i] for i in range(400)) and {i for i in range(1000, 1100) if not got[i]} == set(range(1000, 1100, 5))


def test_the_verdict_depends_on_the_hosts(spark):
    rows = host_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed and not kept").count()
    assert rows > 0


def test_empty_clashing_and_null_host(spark):
    assert host_quality(docs(spark, [])).count() == 0
    table = odd_docs(spark)
    assert plain(host_quality(clashing(table))) == plain(host_quality(table))


def test_no_python_in_the_plan(spark):
    plan = host_quality(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
