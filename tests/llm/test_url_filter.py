from __future__ import annotations

import math
import time

from helpers import plain

from quillspan.llm import url_filter as U


def probability(url):
    bias, weights = U.fit()
    found = U.grams(url)
    return 1 / (1 + math.exp(-bias - sum(weights.get(b, 0.0) for b in found) / math.sqrt(max(1, len(found)))))


def judged(url):
    host, path = U.split_url(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[2:] if fits else (None, "block" if probability((host, path)) >= 0.5 else "allow")
    return host, path, rule, verdict


ODD = [None, "", "none", "://", "http://", "http://COM/x?y", "http://a.Example.com/en/", "a://x.net?/es/", "http://É://q\n/p#", "http://xcom/", "http://x.com", "http://com/", "HTTP://www.EXAMPLE.com/en/1", "http://a.www.example.com/en/", "http://b.net/fr/", "x://y://z/a", "http://h/" + "p" * 20_000]


def test_equals_brute_force(spark, sf_dir):
    urls = [*ODD, *ODD[5:7], *[r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = U.judge_urls(pages).collect()
    assert {r.page_id: tuple(r)[1:5] for r in got} == {i: judged(u) for i, u in enumerate(urls)}
    assert all(abs(r.score - probability(U.split_url(urls[r.page_id]))) < 1e-9 for r in got)


def test_model_separates_unseen_hosts():
    bad = ["http://spam-farm.example.org/en/9", "https://www.casino-win.example.org/de/4", "http://cheap-pills.example.org/fr/1", "https://ads-track.example.org/en/44", "http://adult-x.example.org/de/3", "https://free-bets.example.org/en/2"]
    good = ["http://www.ththe.example.org/en/9", "https://blog.tionble.example.org/de/4", "http://library.example.org/fr/1", "https://m.museum.example.org/en/44"]
    assert all(probability(U.split_url(u)) >= 0.5 for u in bad) and all(probability(U.split_url(u)) < 0.5 for u in good)


def test_rules_of_equal_length_and_a_ready_plan(spark):
    """The longer host wins among rules of one length; the plan with the model is made in seconds."""
    pages = spark.createDataFrame([(1, "http://a.bc/d/x"), (2, "http://bc/d/x"), (3, "http://zz.bc/d/")], "page_id long, url string")
    rules = (("bc", "/d/x", "block"), ("a.bc", "/d", "allow"), ("zz.bc", "/", "block"))
    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(pages, rules).collect()}
    assert got == {1: ("a.bc/d", "allow"), 2: ("bc/d/x", "block"), 3: ("zz.bc/", "block")} and time.perf_counter() - began < 10


def test_clashing_empty_and_native(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    more = pages.select("*", *[F.lit("clash").alias(c) for c in ("host", "path", "rule", "verdict", "best", "score")])
    assert plain(U.judge_urls(more)) == plain(U.judge_urls(pages))
    assert U.judge_urls(pages.limit(0)).count() == 0
    plan = U.judge_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
