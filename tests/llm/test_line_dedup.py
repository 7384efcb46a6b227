from __future__ import annotations

import random

from helpers import clashing, docs, odd_docs, plain

from quillspan.llm.line_dedup import drop_duplicate_lines, duplicate_lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    return head + tail >= max(len(a), len(b)) - 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(rows, least, within_one=within_one):
    lines = []
    for doc_id, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        for no, line in enumerate(text.split("\n")):
            words = line.strip(" \t\n\x0b\x0c\r").split(" ")
            if len(words) >= least:
                lines.append((doc_id, no, words))
    out = []
    for i, (doc_id, no, words) in enumerate(lines):
        first = next(((d, n) for d, n, w in lines[:i] if within_one(words, w)), None)
        if first:
            out.append((doc_id, no, *first))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    random.seed(2)
    rows = []
    for i in range(120):
        lines = []
        for _ in range(random.randint(0, 4)):
            words = [random.choice("ab") for _ in range(random.randint(3, 9))]
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines), "s"))
    got = duplicate_lines(docs(spark, rows), 4, None).drop("row")
    assert plain(got) == brute([(i, t) for i, t, _ in rows], 4)


def test_two_edits_equal_brute_force(spark):
    random.seed(4)
    rows = [(i, "\n".join(" ".join(random.choice("abc") for _ in range(random.randint(3, 9))) for _ in range(random.randint(0, 3))), "s") for i in range(60)]
    rows += [(100 + i, " ".join(str((j * 7 + (i // 9) * (j == i % 9)) % 23) for j in range(12)), "s") for i in range(40)]
    got = duplicate_lines(docs(spark, rows), 4, None, edits=2).drop("row")
    assert plain(got) == brute([(i, t) for i, t, _ in rows], 4, lambda a, b: edits(a, b) <= 2)


LINE = "a b c d e f g h i j k l"


def test_one_edit_each_way_and_chains(spark):
    rows = [(1, LINE, "s"), (2, LINE.replace(" f", " zz"), "s"), (3, LINE.replace(" f", ""), "s"), (4, LINE + " m", "s"), (5, LINE + " m n", "s"), (6, "b a c d e f g h i j k l", "s"), (7, "short line", "s"), (8, f"  {LINE}\r\nnew text here", "s")]
    got = duplicate_lines(docs(spark, rows), 10, None).drop("row")
    assert plain(got) == [(2, 0, 1, 0), (3, 0, 1, 0), (4, 0, 1, 0), (5, 0, 4, 0), (8, 0, 1, 0)]


def test_case_and_white_space_are_folded(spark):
    rows = [(1, LINE, "s"), (2, LINE.replace("c d", "C D").replace("j", "J"), "s"), (3, LINE.replace(" ", "  "), "s"), (4, LINE.replace(" ", "\t"), "s"), (5, LINE.replace(" ", " \x0b\x0c").upper() + "\t\r\nÄ", "s"), (6, LINE.replace(" f", "\tZZ  "), "s"), (7, LINE.replace(" ", "\u00a0"), "s")]
    got = duplicate_lines(docs(spark, rows), 10, None).drop("row")
    assert plain(got) == [(2, 0, 1, 0), (3, 0, 1, 0), (4, 0, 1, 0), (5, 0, 1, 0), (6, 0, 1, 0)]


def test_exact_copies_of_short_lines(spark, tmp_path):
    from quillspan.llm.queries import op9_line_dedup

    rows = [(1, f"Licensed under CC\n\n{LINE}\nown", "s"), (2, "licensed  under CC \n\nLicensed under BY", "s"), (3, "\u6ca1\u6709\u7a7a\u683c", "s"), (4, f"\u6ca1\u6709\u7a7a\u683c\n{LINE} m", "s")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert plain(op9_line_dedup(spark, str(tmp_path))) == [(2, 0, 1, 0), (4, 0, 3, 0), (4, 1, 1, 2)]


def test_text_without_the_copies(spark):
    rows = [(1, f"head\n{LINE}\ntail", "s"), (2, f"{LINE}\nown words", "s"), (3, LINE, "s"), (4, None, "s"), (5, "", "s"), (6, "x\n\ny", "s")]
    got = {r.doc_id: (r.text, r.n_chars) for r in drop_duplicate_lines(docs(spark, rows)).collect()}
    assert got == {1: (f"head\n{LINE}\ntail", len(LINE) + 10), 2: ("own words", 9), 4: (None, 0), 5: ("", 0), 6: ("x\n\ny", 4)}


def test_hot_line_and_many_near_copies(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(words), "s") for i in range(300)]
    rows += [(1000 + i, " ".join([*words[: i % 30], f"x{i}", *words[i % 30 + 1 :]]), "s") for i in range(200)]
    got = duplicate_lines(docs(spark, rows)).collect()
    assert len(got) == 499 and {r.kept_doc_id for r in got} == {0}


def test_odd_rows(spark):
    table = odd_docs(spark)
    got = duplicate_lines(table)
    assert plain(got.drop("row")) == []
    assert plain(drop_duplicate_lines(clashing(table)).select(*table.columns)) == plain(drop_duplicate_lines(table)) and drop_duplicate_lines(table).count() == 10
    assert duplicate_lines(docs(spark, [])).count() == 0 and drop_duplicate_lines(docs(spark, [])).count() == 0
    both = docs(spark, [(None, LINE, "s"), (1, LINE, "s")])
    assert plain(duplicate_lines(both).drop("row")) == [(1, 0, None, 0)]


def test_no_python_in_the_plan(spark):
    plan = duplicate_lines(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
