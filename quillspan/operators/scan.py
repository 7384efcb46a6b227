"""Running values along each key's order, for keys that may be too large for one task.

Rows are dealt out by range of (key, order) and written with the number of their part, so a key's rows lie in as many parts as they need.
Where no key has more rows than a task may hold, which is counted first, plain windows give the same without writing anything.
Each part is scanned by itself; what it hands on (its sums, its first and last row) is a row for each key and part, and these are
scanned in turn. Putting both together gives every row what one pass over its key would.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.scratch import save

Named = Mapping[str, Column]

#: Rows of a key, at most, that are scanned by one task.
TASK_ROWS = 1_000_000


def parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` dealt out by range and written, with the number of each row's part in ``_part``."""
    return save(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "scan")


def fits(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether each key's rows are few enough for one task; counts them."""
    return (df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= TASK_ROWS


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Named | None = None, before: Named | None = None, after: Named | None = None, small: bool | None = None) -> DataFrame:
    """``df`` with more columns: ``sums`` up to and with the row, and values of the row ``before`` and the row ``after`` it, null where there is none.

    ``order`` is ascending and ends with a unique key. A null to be summed counts as nothing; rows of a null key are a group. ``small`` is what ``fits`` says, for
    callers that have asked already.
    """
    sums, before, after = sums or {}, before or {}, after or {}
    asked = [(f"_{kind}_{name}", c) for kind, named in (("sum", sums), ("before", before), ("after", after)) for name, c in named.items()]
    placed = df.select("*", *[c.alias(n) for n, c in asked], F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_order"))
    zero = lambda c: F.coalesce(c, F.lit(0))

    if fits(df, keys) if small is None else small:
        line = Window.partitionBy(*keys).orderBy("_order")
        whole = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return placed.select(*df.columns, *[zero(F.sum(f"_sum_{n}").over(whole)).alias(n) for n in sums], *[F.lag(f"_before_{n}").over(line).alias(n) for n in before], *[F.lead(f"_after_{n}").over(line).alias(n) for n in after])

    dealt = parts(placed, keys, [F.col(f"_order.o{i}") for i in range(len(order))])

    within = Window.partitionBy("_part", *keys).orderBy("_order")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", F.row_number().over(within).alias("_rn"), F.lead("_part").over(within).isNull().alias("_is_last"), *[F.sum(f"_sum_{n}").over(upto).alias(f"_local_{n}") for n in sums], *[F.lag(f"_before_{n}").over(within).alias(f"_local_{n}") for n in before], *[F.lead(f"_after_{n}").over(within).alias(f"_local_{n}") for n in after])

    edges = dealt.groupBy("_part", *keys).agg(
        *[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in sums], *[F.max_by(f"_before_{n}", "_order").alias(f"_before_{n}") for n in before], *[F.min_by(f"_after_{n}", "_order").alias(f"_after_{n}") for n in after], F.count("*").alias("_rows")
    )
    along = Window.partitionBy(*keys).orderBy("_part")  # at most a row for each part
    carried = edges.select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_of_{k}") for k in keys], *[F.sum(f"_sum_{n}").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_carry_{n}") for n in sums],
        *[F.lag(f"_before_{n}").over(along).alias(f"_carry_{n}") for n in before], *[F.lead(f"_after_{n}").over(along).alias(f"_carry_{n}") for n in after],
    )
    on = reduce(lambda a, b: a & b, [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]])
    both = local.join(carried, on)
    return both.select(
        *df.columns, *[(zero(F.col(f"_carry_{n}")) + zero(F.col(f"_local_{n}"))).alias(n) for n in sums],
        *[F.when(F.col("_rn") == 1, F.col(f"_carry_{n}")).otherwise(F.col(f"_local_{n}")).alias(n) for n in before],
        *[F.when(F.col("_is_last"), F.col(f"_carry_{n}")).otherwise(F.col(f"_local_{n}")).alias(n) for n in after],
    )


def with_halo(df: DataFrame, pos: str, block: int, ahead: int) -> DataFrame:
    """Rows in blocks of ``block`` positions, ``_block``; the first ``ahead`` positions of a block are there for the block before as well, ``_own`` false."""
    own = F.floor(F.col(pos) / block)
    both = F.when((F.col(pos) % block < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == own)
