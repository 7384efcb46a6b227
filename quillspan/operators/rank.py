"""Ranking, deduplication, interleaving, and sampling that is decided by a hash.

Every window ends with a unique key, so results do not depend on partitioning. Random choices of a sampler are the
order of ``md5(seed|id)``: sizes and invariants are exact, and any engine with md5 draws the same members.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import numbers as N
from quillspan.operators.scan import scan
from quillspan.scratch import save


#: Extra rows of a label that are made at once.
DRAWS = 10_000


def hash_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, name: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps at most k per group before the shuffle."""
    return numbered(df, keys, order, name).where(F.col(name) <= k)


def keep_best(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """One row for each key that is not blank, the best by ``order``."""
    keyed = df.withColumn("_key", key).where("_key is not null and _key <> ''")
    return top_per_group(keyed, ["_key"], order).drop("_key", "rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], stamp: Column, seq: str) -> DataFrame:
    """The last write of each key: greatest stamp, then greatest sequence number."""
    return top_per_group(df, keys, [stamp.desc(), F.col(seq).desc()]).drop("rn")


def positions(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Rows with their position from 0 in the table's order; no task sees more than its range of rows.

    Rows are dealt out by range and written with the number of their part, so that counting and numbering see the same
    parts. A row's position is its number within its part after the rows of the parts before. End ``order`` with a unique key.
    """
    dealt = save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "positions")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    placed = within.join(counts.select("_part", before.alias("_before")), "_part")
    return placed.withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long")).drop("_part", "_rn", "_before")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn", size: str | None = None) -> DataFrame:
    """Rank from 1 within the group, as ``numbered`` gives, for groups that may be too large for one task.

    The rank is the row's position in the order of (keys, order) less the group's first position. ``size``, if given, names a column of
    the group's number of rows.
    """
    placed = positions(df, [*[F.col(k) for k in keys], *order], "_pos")
    groups = placed.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min("_pos").alias("_start"), F.count("*").alias(size or "_size"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return placed.join(groups, on).select(*df.columns, (F.col("_pos") - F.col("_start") + 1).alias(name), *([size] if size else []))


def interleave(df: DataFrame, source: str, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Round robin over sources: the first of each, then the second of each, and so on; ``name`` counts from 1."""
    turns = ranked(df, [source], order, "_turn")
    return positions(turns, [F.col("_turn"), F.col(source)], name).withColumn(name, F.col(name) + 1).drop("_turn")


def sample_per_group(df: DataFrame, keys: Sequence[str], key: str, k: int, seed: int) -> DataFrame:
    return top_per_group(df, keys, [hash_order(seed, F.col(key)), F.col(key)], k).drop("rn")


def sample_top_pool(df: DataFrame, keys: Sequence[str], score: str, key: str, k: int, multiple: int, seed: int) -> DataFrame:
    """``k`` rows without replacement from each group's best ``max(k, k * multiple)``; the pool's size is ``pool``."""
    pool = top_per_group(df, keys, [F.col(score).desc(), F.col(key)], max(k, k * multiple), "pool_rank")
    return sample_per_group(pool, keys, key, k, seed)


def cap_per_source(df: DataFrame, source: str, key: str, most: int, seed: int, exempt: Sequence[str] = ()) -> DataFrame:
    """At most ``most`` rows of each source but the exempt ones; nothing is capped for ``most`` <= 0."""
    if most <= 0:
        return df
    free = F.coalesce(F.col(source).isin(*exempt), F.lit(False)) if exempt else F.lit(False)
    return df.where(free).unionByName(sample_per_group(df.where(~free), [source], key, most, seed))


def stratified_split(df: DataFrame, label: str, key: str, train: float, val: float, test: float, seed: int) -> DataFrame:
    """``split`` by label: half-even rounded sizes for train and val, the rest is test."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("fractions must sum to 1")
    rows = ranked(df, [label], [hash_order(seed, F.col(key)), F.col(key)], "_rn", "_n")
    n_train, n_val = F.bround(F.col("_n") * train, 0), F.bround(F.col("_n") * val, 0)
    return rows.withColumn("split", F.when(F.col("_rn") <= n_train, "train").when(F.col("_rn") <= n_train + n_val, "val").otherwise("test")).drop("_rn", "_n")


def oversample(df: DataFrame, label: str, key: str, reference: str, fraction: float, most_repeat: int, seed: int) -> DataFrame:
    """``df`` and repeats of its minority rows, ``copy`` counting from 0.

    A label of n rows is brought to min(int(reference rows * fraction), n * most_repeat); the reference label never grows. Extra row e is the
    label's row of hash rank md5(seed|label|e) mod n.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    target = counts.agg(F.floor(F.greatest(F.lit(1), F.coalesce(F.sum(F.when(F.col(label) == reference, F.col("n"))), F.lit(0))) * fraction).cast("long").alias("t")).scalar()
    wanted = counts.where(F.col(label) != reference).withColumn("extra", F.greatest(F.lit(0), F.least(target, F.col("n") * most_repeat) - F.col("n")))
    # extra rows are made in blocks, dealt out, so that a label's are not one task's work
    blocks = wanted.where("extra > 0").select(F.col(label).alias("_l"), "n", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("extra") - 1) / DRAWS))).alias("_block"))
    copies = F.sequence(F.col("_block") * DRAWS + 1, F.least(F.col("extra"), (F.col("_block") + 1) * DRAWS))
    draws = blocks.repartition("_l", "_block").select("_l", "n", F.explode(copies).alias("copy"))
    digest = F.conv(F.substring(hash_order(seed, F.concat_ws("|", "_l", "copy")), 1, 8), 16, 10).cast("long")
    draws = draws.select("_l", "copy", (F.pmod(digest, F.col("n")) + 1).alias("_rn"))
    rows = ranked(df, [label], [hash_order(seed, F.col(key)), F.col(key)])
    extra = rows.join(draws, (rows[label] == draws["_l"]) & (rows["rn"] == draws["_rn"])).select(*[rows[c] for c in df.columns], "copy")
    return df.withColumn("copy", F.lit(0).cast("long")).unionByName(extra)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(hash_order(seed, F.col(key)), key)


def shard_numbers(df: DataFrame, order: Sequence[Column], rows: int, name: str = "shard") -> DataFrame:
    """Consecutive shards of ``rows`` rows from 0."""
    return positions(df, order, name).withColumn(name, F.floor(F.col(name) / rows).cast("long"))


def zipped(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Rows of two tables by position: the first with the first, and so on; where one is longer, nulls. Columns of the two must differ."""
    a, b = positions(left, left_order, name), positions(right, right_order, name)
    return a.join(b, name, "full")


def restored(rows: DataFrame, chosen: DataFrame, key: str, place: str) -> DataFrame:
    """``rows`` of the chosen keys in the order in which ``chosen`` (key, ``place``) has them; a key that was chosen twice comes twice."""
    return chosen.select(key, place).join(rows, key).orderBy(place)


def by_count(df: DataFrame, value: str, name: str = "place") -> DataFrame:
    """Values with how often they occur, ``n``, and their place from 0: the commonest first, equal ones by value."""
    return positions(df.groupBy(value).agg(F.count("*").alias("n")), [-F.col("n"), F.col(value)], name)


def late_fetch(wide: DataFrame, chosen: DataFrame, key: str, *keep: str) -> DataFrame:
    """Wide rows of the chosen keys, with what to order them by; the choice is made on narrow rows first."""
    return wide.join(chosen.select(key, *keep), key)


def cumulative(df: DataFrame, order: Sequence[Column], weight: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows that come before in ``order``, by range parts as ``positions`` does.

    ``weight`` must not be null; rows that tie share a part, so aggregate equal rows first.
    """
    dealt = save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "cumulative")
    sums = dealt.groupBy("_part").agg(F.sum(weight).alias("_sum"))  # a row for each part
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_within", within).join(sums.select("_part", before.alias("_before")), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def order_statistics(df: DataFrame, value: str, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row with the values at indices of the sorted values, each index a function of their number; one counting pass."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    placed = save(cumulative(counts, [F.col(value)], "_c", "_first"), "order-statistics")
    n = placed.agg(F.sum("_c")).scalar()
    index = {name: f(n).cast("long") for name, f in at.items()}
    return placed.agg(*[F.max(F.when((F.col("_first") <= i) & (i < F.col("_first") + F.col("_c")), F.col(value))).alias(name) for name, i in index.items()])


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by group with linear interpolation, from counts of distinct values, so that no buffer holds a group's values."""
    there = df.where(F.col(value).isNotNull())
    counts = there.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = scan(counts, keys, [F.col(value)], sums={"_upto": F.col("_c")}).withColumn("_at", F.col("_upto") - F.col("_c"))
    groups = there.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count("*").alias("_n"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    both = placed.join(groups, on)
    place = {name: (F.col("_n") - 1) * share for name, share in shares.items()}
    holds = lambda i: (F.col("_at") <= i) & (i < F.col("_at") + F.col("_c"))
    ends = [F.max(F.when(holds(f(p)), F.col(value))).alias(f"_{name}_{side}") for name, p in place.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    got = both.groupBy(*keys).agg(F.max("_n").alias("_n"), *ends)
    return got.select(*keys, *[N.between(F.col(f"_{name}_low"), F.col(f"_{name}_high"), p - F.floor(p)).alias(name) for name, p in place.items()])


def sample_rows(df: DataFrame, key: str, n: int, seed: int, replace: bool = False) -> DataFrame:
    """``n`` rows drawn by hash; where there are fewer, all of them, or with ``replace`` rows drawn again (``draw`` counts the draws)."""
    if not replace:
        return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)
    placed = positions(df, [hash_order(seed, F.col(key)), F.col(key)], "_pos")
    size = df.agg(F.count("*")).scalar()
    digest = F.conv(F.substring(hash_order(seed, F.concat_ws("|", F.lit("draw"), "draw")), 1, 8), 16, 10).cast("long")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_pos", F.when(size >= n, F.col("draw")).otherwise(F.pmod(digest, F.greatest(size, F.lit(1)))))
    return placed.join(draws, "_pos").select(*df.columns, "draw")
