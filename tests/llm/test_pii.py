from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

from helpers import clashing, docs, odd_docs, plain

from quillspan.llm import pii as I

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and I.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_equals_the_plain_patterns():
    random.seed(3)
    letters = list("0123456789" * 3 + "..@@++--  ()ab\n%é²")
    for _ in range(30_000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        assert I.base_spans(text) == naive(text), text


def test_long_runs_take_linear_time():
    began = time.time()
    I.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "+1" * 100_000 + "1." * 100_000 + "@" * 100_000)
    assert time.time() - began < 5


def test_digest_and_counts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd_docs(spark))
    got = sorted([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in I.find_pii(table).collect()], key=str)
    want = []
    for r in table.collect():
        spans = naive(r.text or "") if len(r.text or "") < 100_000 else []
        want.append((r.doc_id, *[sum(k == i for _, k, _ in spans) for i in range(4)], hashlib.sha256(",".join(f"{I.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"some text contact email: person{i}@mail.example.org thanks", "s") for i in range(12)]
    rows += [(100, "other text contact email: person99123[at]mail7 thanks", "s"), (101, "reference number 123456 stays", "s"), (102, "the year 2020123 and contact 55555", "s")]
    got = {r.doc_id: r.spans for r in I.find_pii(docs(spark, rows)).collect()}
    assert got[100] == "email:26:46" and got[101] == "" and got[102] == "" and got[0] == "email:25:49"


def test_what_patterns_announce():
    cut = lambda text: None if (c := I.candidate(text, 0)) is None else (text[c[0] : c[1]], c[2])
    assert cut(": 020 7946 0958 is") == ("020 7946 0958", True) and cut(" (020) 7946-0958.") == ("020) 7946-0958", True)
    assert cut(" jane.doe(at)example.com,") == ("jane.doe(at)example.com", False) and cut(": jane dot doe at example dot com now") == ("jane dot doe at example dot com", False)
    assert cut(" me at home") is None and cut(" @jane_d!") == ("@jane_d", False) and cut(" 12345abc ") == ("12345abc", False)
    assert cut(" 1234 ") is None and cut(" plain words") is None and cut("") is None and cut(" " + "1" * 300) is None


def test_patterns_far_before_and_long_instances(spark):
    """A pattern far before its seed counts, and long strings that differ late are different instances."""
    far = " " + "-" * 500 + " "
    rows = [(i, f"note {i} user handle{far}person{i}@mail.example.org end", "s") for i in range(12)]
    long = "a" * 230
    rows += [(100 + i, f"note user handle{far}{long}_{i}", "s") for i in range(2)] + [(200, f"other {long}_1 words", "s")]
    got = {r.doc_id: r.spans for r in I.find_pii(docs(spark, rows)).collect()}
    assert got[100] == f"email:{rows[12][1].index(long)}:{len(rows[12][1])}" and got[200] == "" and got[0].startswith("email:")


def brute(rows, sure=I.SURE, support=I.SUPPORT, promising=I.PROMISING, rounds=I.ROUNDS):
    """The whole operator with strings for patterns and instances and plain dictionaries."""
    words = lambda text: [(m[0].lower(), m.end()) for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]

    def before(text, at):
        w = [x for x, end in words(text[:at])]
        return [(x,) for x in w[-1:]] + [tuple(w[-2:])] * (len(w) > 1)

    seeded, distinct, total, loose, places = Counter(), defaultdict(set), Counter(), Counter(), defaultdict(set)
    for _, text in rows:
        for a, k, b in naive(text):
            for p in before(text, a):
                seeded[p, k] += 1
                distinct[p].add((text[a:b], k))
    backed = {p for p, x in distinct.items() if len(x) >= support}
    after = defaultdict(list)
    for n, (_, text) in enumerate(rows):
        w = words(text)
        for i in range(len(w)):
            for p in ((w[i][0],), (w[i - 1][0], w[i][0])) if i else ((w[i][0],),):
                if p in backed:
                    total[p] += 1
                    after[p].append((n, w[i][1]))
    good = {p for p in backed if total[p] and max(seeded[p, k] for k in range(4)) >= promising * total[p]}
    for p in good:
        for n, at in after[p]:
            text = rows[n][1]
            c = I.candidate(text, at)
            if c and all(b <= c[0] or a >= c[1] for a, _, b in naive(text)):
                loose[p, text[c[0] : c[1]], c[2]] += 1
                places[text[c[0] : c[1]]].add((n, c[0], c[1]))
    scores = {}
    for _ in range(rounds):
        mass = Counter({(p, k): float(v) for (p, k), v in seeded.items() if p in good})
        for (p, x, _), n in loose.items():
            for k in range(4):
                mass[p, k] += n * scores.get((x, k), 0.0)
        wrong = defaultdict(lambda: 1.0)
        for (p, x, number), _ in loose.items():
            for k in range(4):
                if mass[p, k] and (k != 0) == number:
                    wrong[x, k] *= 1 - min(0.999, mass[p, k] / (total[p] + 1))
        scores = {key: 1 - v for key, v in wrong.items()}
    out = [set(naive(text)) for _, text in rows]
    for x, where in places.items():
        score, k = max((scores.get((x, k), 0.0), -k) for k in range(4))
        if score >= sure:
            for n, a, b in where:
                out[n].add((a, -k, b))
    return sorted((i, ",".join(f"{I.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))) for (i, _), found in zip(rows, out, strict=True))


def test_whole_operator_equals_brute_force(spark):
    random.seed(11)
    things = [lambda: f"u{random.randint(0, 30)}@mail.example.org", lambda: f"+44 20 {random.randint(1000, 9999)} {random.randint(1000, 9999)}", lambda: f"10.0.{random.randint(0, 9)}.{random.randint(0, 255)}", lambda: f"jane_{random.randint(0, 9)}[at]mail", lambda: f"0{random.randint(10, 14)} {random.randint(1000, 1004)} 5", lambda: random.choice(["nobody", "us", "it", "42"])]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(random.randint(0, 6)):
            cue = random.choice(["mail:", "write to", "call", "Call me", "host", "see", "the", "é fax"])
            likely = {"mail:": 0, "write to": 0, "call": 1, "Call me": 1, "host": 2, "é fax": 1}.get(cue)
            thing = things[likely]() if likely is not None and random.random() < 0.7 else random.choice(things)()
            parts += [random.choice(["so", "then", "and the", "\n"]), cue, thing]
        rows.append((i, " ".join(parts)))
    got = sorted((r.doc_id, r.spans) for r in I.find_pii(docs(spark, [(i, t, "s") for i, t in rows])).collect())
    want = brute(rows)
    assert got == want and sum(s.count(":") // 2 for _, s in want) > sum(len(naive(t)) for _, t in rows) + 20


def test_common_words_are_no_patterns(spark):
    """A word that mostly stands before other things gives no identifier away."""
    rows = [(i, f"the cat saw the dog and the bird near the house at person{i}@mail.example.org at home at night at noon at last", "s") for i in range(12)]
    rows.append((50, "we met at 1234567 today", "s"))
    assert {r.doc_id: r.spans for r in I.find_pii(docs(spark, rows)).collect()}[50] == ""


def test_odd_rows(spark):
    table = odd_docs(spark)
    assert I.find_pii(table).count() == 10
    assert plain(I.find_pii(clashing(table))) == plain(I.find_pii(table))
    assert I.find_pii(docs(spark, [])).count() == 0
