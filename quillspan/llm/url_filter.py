"""URL filtering in DataFrame functions only: rules first, then a logistic regression on hashed character n-grams.

The model is fitted on the driver from the small labelled table below (a fixed number of rows, no corpus data), by plain
gradient descent; the weights become one array literal that the plan looks n-grams up in.
"""

from __future__ import annotations

import math
import string
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# URLs with 1 for block and 0 for allow.
LABELLED = (
    ("http://spam-offers.example.org/win/now", 1), ("https://spam-mail.example.net/promo", 1), ("http://www.spam-links.example.com/1", 1),
    ("https://link-spam.example.org/de/7", 1), ("http://seo-farm.example.net/en/12", 1), ("https://content-farm.example.com/a", 1),
    ("http://click-farm.example.org/es/9", 1), ("https://spam-farm.example.net/en/3", 1), ("http://adult-video.example.org/en/55", 1),
    ("https://www.adult-chat.example.com/live", 1), ("http://adult-x.example.org/en/8", 1), ("https://m.xxx-adult.example.net/pics", 1),
    ("http://porn-tube.example.com/watch", 1), ("https://free-porn.example.net/en/2", 1), ("http://casino-bonus.example.org/play", 1),
    ("https://www.best-casino.example.com/slots", 1), ("http://bet-casino.example.net/en/41", 1), ("https://cheap-pills.example.org/buy", 1),
    ("http://viagra-pills.example.com/order", 1), ("https://phish-login.example.net/verify", 1), ("http://malware-host.example.org/setup.exe", 1),
    ("https://warez-crack.example.com/keygen", 1), ("http://torrent-warez.example.net/dl", 1), ("https://xxx-cams.example.org/en/77", 1),
    ("http://ad-tracker.example.net/pixel", 1), ("https://www.ads-server.example.org/en/4", 1), ("https://ads-tracking.example.com/click", 1),
    ("http://sports-bets.example.com/odds", 1), ("https://free-bets.example.org/bonus", 1), ("http://win-casino.example.net/de/6", 1),
    ("http://www.library.example.org/en/12", 0), ("https://news.example.com/de/2024/report", 0), ("http://blog.garden.example.net/en/311", 0),
    ("https://m.weather.example.org/fr/5?page=2", 0), ("http://museum.example.com/es/900.html", 0), ("https://www.school.example.net/en/77/", 0),
    ("http://recipes.example.org/fr/41#top", 0), ("https://blog.travel.example.com/en/640", 0), ("http://m.theater.example.net/de/8", 0),
    ("https://www.thertion.example.org/en/210", 0), ("http://tionand.example.com/fr/33?page=2&ref=x", 0), ("https://blog.thing.example.net/es/61", 0),
    ("http://ththe.example.org/de/402/", 0), ("https://m.inger.example.com/en/19.html", 0), ("http://www.thereth.example.net/en/88?utm_source=feed", 0),
    ("https://forum.science.example.org/en/5", 0), ("http://docs.python.example.com/en/3/index.html", 0), ("https://blog.hiking.example.net/fr/12", 0),
    ("http://city-council.example.org/de/minutes", 0), ("https://www.farmers-market.example.com/en/1", 0), ("http://health-guide.example.net/en/77", 0),
    ("https://better-homes.example.com/en/4", 0), ("http://train-tracks.example.org/fr/9", 0), ("http://windows-help.example.net/de/15", 0),
    ("https://m.adulteducation.example.org/courses", 0), ("http://tionst.example.org/en/745", 0), ("https://www.tionth.example.com/fr/62", 0),
)

#: Rules (host, path start, verdict) of the production query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rules are matched in the row, so their number is bounded.
MOST_RULES = 1000
GRAM, BUCKETS = 3, 1 << 14
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the plan cuts them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    tail = rest[end:]
    stop = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def grams(url: tuple[str, str]) -> list[int]:
    """Buckets of the n-grams of host and path; each part is marked with its letter and its ends."""
    out = []
    for mark, part in zip("hp", url, strict=True):
        s = f"^{part}$"
        out += [zlib.crc32((mark + s[i : i + GRAM]).encode()) % BUCKETS for i in range(max(0, len(s) - GRAM + 1))]
    return out


@lru_cache(maxsize=4)
def fit(labelled: tuple[tuple[str, int], ...] = LABELLED, rounds: int = 400, rate: float = 0.5, l2: float = 1e-3) -> tuple[float, dict[int, float]]:
    """Bias and weights of a logistic regression on n-gram counts over their root sum, by full-batch gradient descent."""
    rows = []
    for url, label in labelled:
        found = grams(split_url(url))
        rows.append((found, 1 / math.sqrt(max(1, len(found))), label))
    weights: dict[int, float] = {}
    bias = 0.0
    for _ in range(rounds):
        step: dict[int, float] = {}
        step_bias = 0.0
        for found, scale, label in rows:
            error = 1 / (1 + math.exp(-bias - scale * sum(weights.get(b, 0.0) for b in found))) - label
            step_bias += error
            for b in found:
                step[b] = step.get(b, 0.0) + error * scale
        bias -= rate * step_bias / len(rows) * 4
        weights = {b: weights.get(b, 0.0) * (1 - rate * l2) - rate * g for b, g in step.items()}
    return bias, weights


def score(host: Column, path: Column, model: tuple[float, dict[int, float]]) -> Column:
    """The model's probability of block, from array functions over the characters."""
    bias, weights = model
    table = F.split(F.lit(",".join(repr(weights.get(b, 0.0)) for b in range(BUCKETS))), ",").cast("array<double>")  # folded into one literal

    def of(mark: str, part: Column) -> Column:
        chars = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")
        starts = F.when(F.size(chars) >= GRAM, F.sequence(F.lit(0), F.size(chars) - GRAM)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            F.array(chars),
            lambda c: F.transform(starts, lambda i: F.coalesce(F.get(table, F.crc32(F.concat(F.lit(mark), *[F.get(c, i + k) for k in range(GRAM)])) % BUCKETS), F.lit(0.0))),
        )[0]

    both = F.concat(of("h", host), of("p", path))
    total = F.transform(F.array(both), lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.sqrt(F.greatest(F.size(x), F.lit(1))))[0]
    return 1 / (1 + F.exp(-(F.lit(bias) + total)))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, block_at: float = 0.5, labelled: tuple[tuple[str, int], ...] = LABELLED) -> DataFrame:
    """``pages`` (page_id, url, ...) to (page_id, host, path, rule, verdict, score), a row for each row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the rule's; of those that fit, the longest (host
    and path together, then the host) gives the verdict, else the model does: block from ``block_at`` on. A null url,
    or one without ``://``, has an empty host and path and is left to the model. Other columns are not read; repeated
    rows repeat; an empty table gives no rows. At most MOST_RULES rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    shape = "(?s)^.*?://([^/?#]*)([^?#]*)"
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.translate(F.regexp_extract(url, shape, 1), string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract(url, shape, 2).alias("path"),
    )
    fitting = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path),
            F.struct(F.lit(len(host) + len(path)).alias("long"), F.lit(len(host)).alias("host_long"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for host, path, verdict in rules
    ]
    best = F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<long:int,host_long:int,rule:string,verdict:string>")
    judged = parts.withColumn("best", best).withColumn("score", score(F.col("host"), F.col("path"), fit(labelled)))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.col("score") >= block_at, "block").otherwise("allow")).alias("verdict"), "score")
