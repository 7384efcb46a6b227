from __future__ import annotations

import hashlib

from helpers import clashing, docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import fill_in_middle as M

UNITS = st.text(st.sampled_from("aé́€\U0001f600\n\x00<PSM>"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(UNITS, st.integers(1, 9), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_by_checkpoints_are_those_of_code_points(text, step, h1, h2):
    raw = text.encode()
    n, a, b, at, to = M.cut(raw, h1, h2, step)
    assert n == len(text) and (a, b) == tuple(sorted((h1 % (n + 1), h2 % (n + 1))))
    assert (raw[:at].decode(), raw[at:to].decode(), raw[to:].decode()) == (text[:a], text[a:b], text[b:])


def test_index_is_sparse():
    index = M.checkpoints(("é" * 100_000).encode(), 1024)
    assert len(index.before) == 197 and index.units == 100_000 and index.byte_of(99_999) == 199_998 and index.byte_of(100_000) == 200_000


def brute(doc_id, text):
    """One document's output, by slicing characters."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if form == "spm" else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, n, form, a, b - a, out


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_equals_brute_force_and_rebuilds_the_text(spark):
    odd = odd_docs(spark)
    more = docs(spark, [(100 + i, t, "s") for i, t in enumerate(["<P>", "a<M>b", "<", "<P", "<<S", "S>", ">", "é́<", "<S>x", "\x00"] * 6)])
    both = odd.unionByName(more)
    texts = [(r.doc_id, r.text) for r in both.collect()]
    got = M.fill_in_middle(both)
    want = sorted([brute(*t) for t in texts], key=str)
    assert rows(got) == want and {"psm", "spm", "plain"} == {w[2] for w in want}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows(M.fim_digests(got)) == sorted([(*brute(*t)[:5], sha(brute(*t)[5]), sha(t[1] or "")) for t in texts], key=str)
    assert rows(M.fill_in_middle(clashing(both))) == want
    assert M.draws(1, None)[0] == int(hashlib.sha256(b"1:").hexdigest()[:8], 16)


def test_parameters_and_empty_table(spark):
    table = docs(spark, [(i, "some text", "s") for i in range(50)])
    assert {r.form for r in M.fill_in_middle(table, plain_from=100, spm_below=100).collect()} == {"spm"}
    assert {r.form for r in M.fill_in_middle(table, plain_from=0).collect()} == {"plain"}
    assert M.fill_in_middle(table, seed=2).collect() != M.fill_in_middle(table).collect()
    assert M.fim_digests(M.fill_in_middle(table.limit(0))).count() == 0
