from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import chat_format as C

TEXTS = st.lists(st.sampled_from([*C.CONTROLS, "\\", "<", "[", "/s>", "INST]", " ", "é", "\n", "x"]), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXTS), TEXTS), max_size=12)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_escape_round_trip(text):
    safe = C.escape(text)
    assert C.unescape(safe) == text and not any(c in safe for c in C.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(TURNS, st.sampled_from([None, 1, 2, 5]))
def test_pieces_are_the_whole_and_read_back(turns, window):
    pieces = list(C.render_incrementally(C.bracket_template, iter(turns), window))
    assert "".join(p.text for p in pieces) == C.bracket_template(turns)
    assert [C.read_turn(p.text)[:2] for p in pieces] == turns
    assert [p.start for p in pieces] == [sum(len(q.text) for q in pieces[:i]) for i in range(len(pieces))]
    assert all(p.rewrites_at is None for p in pieces)


def test_template_that_rewrites_history_is_found():
    def hides_thoughts(turns):
        return "".join(f"{r}:{t};" if i == len(turns) - 1 or r != "assistant" else f"{r}:-;" for i, (r, t) in enumerate(turns))

    found = [p.rewrites_at for p in C.render_incrementally(hides_thoughts, iter([("user", "a"), ("assistant", "bc"), ("user", "d")]))]
    assert found == [None, None, len("user:a;assistant:")]


SCHEMA = "conv_id long, turn long, role string, text string"


def digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(C.bracket_template([(r or "", t or "") for r, t in turns])))


def test_digests(spark):
    long = [(5, i, "user" if i % 2 == 0 else "assistant", f"turn {i} </s>") for i in range(500)]
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, "assistant", "é\U0001f600"), (None, 0, "user", "lost"), *long]
    got = {r[0]: tuple(r)[1:] for r in C.chat_digests(C.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1] == digest([("user", ""), ("", "x"), ("assistant", "a"), ("assistant", "a")])
    assert got[2] == digest([("assistant", "é\U0001f600")]) and got[None] == digest([("user", "lost")])
    assert got[5] == digest([r[2:] for r in long]) and len(got) == 4


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", piece string, start long")
    assert C.chat_digests(C.format_chats(empty)).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "a", "p", 3)], SCHEMA + ", piece string, start long")
    assert C.format_chats(one).first().piece == "<s>[INST] a [/INST]"


@pytest.mark.parametrize("window", [1, 3])
def test_window_renders_few_turns_but_for_the_proofs(window):
    sizes = []

    def watching(turns):
        sizes.append(len(turns))
        return C.bracket_template(turns)

    turns = [("user" if i % 2 else "assistant", str(i)) for i in range(600)]
    assert list(C.render_incrementally(watching, iter(turns), window)) == list(C.render_incrementally(C.bracket_template, turns))
    assert sum(n > window + 1 for n in sizes) <= (600).bit_length() + 1


def drops_old(back):
    """Assistant texts stand only in the last ``back`` turns."""
    return lambda turns: "".join(f"{r}:{t};" if r != "assistant" or i >= len(turns) - back else f"{r}:-;" for i, (r, t) in enumerate(turns))


def counts_turns(turns):
    return "".join(f"{i}{r}:{t};" for i, (r, t) in enumerate(turns))


def looks_at_the_first(turns):
    return "".join(f"{r}:{t}{turns[0][1] if i == 40 else ''};" for i, (r, t) in enumerate(turns))


def repeats_itself(turns):
    return "a" * len(turns)


@pytest.mark.parametrize("template", [drops_old(1), drops_old(4), drops_old(10), drops_old(30), counts_turns, looks_at_the_first, repeats_itself, C.bracket_template])
@pytest.mark.parametrize("n", [1, 2, 9, 17, 50, 129])
def test_window_gives_what_full_prefixes_give(template, n):
    turns = [("user" if i % 3 == 0 else "assistant", f"t{i}") for i in range(n)]
    for window in (1, 2, 8):
        assert list(C.render_incrementally(template, iter(turns), window)) == list(C.render_incrementally(template, turns))


def test_window_that_fails_late_falls_back():
    late = lambda turns: C.bracket_template(turns) if len(turns) < 9 else "z" + C.bracket_template(turns[1:])
    assert [p.rewrites_at for p in C.render_incrementally(late, iter([("user", str(i)) for i in range(12)]), 8)] == [None] * 8 + [0] + [None] * 3
    numbered = lambda turns: "".join(t if i or int(t) < 300 else "other" for i, (_, t) in enumerate(turns))
    turns = [("user", str(i)) for i in range(400)]
    assert list(C.render_incrementally(numbered, iter(turns), 8)) == list(C.render_incrementally(numbered, turns))


def test_rewrites_after_many_turns_are_found():
    marks_old = lambda turns: "".join(f"{'old' if len(turns) > 300 and i < len(turns) - 20 else ''}{t};" for i, (_, t) in enumerate(turns))
    turns = [("user", str(i)) for i in range(330)]
    for window in (None, 8):
        pieces = list(C.render_incrementally(marks_old, iter(turns), window))
        assert sum(p.rewrites_at is not None for p in pieces) == 30
        out = ""
        for p in pieces:
            out = out[: p.start] + p.text
        assert out == marks_old(turns)


def test_one_very_long_text(spark):
    row = (1, 0, "assistant", "</s>é" * 200_000)
    assert tuple(C.chat_digests(C.format_chats(spark.createDataFrame([row], SCHEMA))).first())[1:] == digest([row[2:]])


def test_default_finds_rewrites_far_back(spark):
    def hides_thoughts(turns):
        last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=0)
        return "".join(f"{r}:{t};" if r != "assistant" or i > last else f"{r}:-;" for i, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "bc"), *[("tool", str(i)) for i in range(12)], ("user", "d")]
    rows = C.format_chats(spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], SCHEMA), hides_thoughts).collect()
    assert [r.rewrites_at for r in sorted(rows, key=lambda r: r.turn)] == [None] * 14 + [len("user:a;assistant:")]
