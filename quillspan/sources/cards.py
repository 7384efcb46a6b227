"""Dataset cards: Markdown with front matter, from aggregates of the rows that a package holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def front_matter(fields: Mapping[str, str | Sequence[str]]) -> str:
    """YAML front matter: a field and its value, or its list."""
    lines = [f"{k}: {v}" if isinstance(v, str) else "\n".join([f"{k}:", *(f"  - {x}" for x in v)]) for k, v in fields.items()]
    return "\n".join(["---", *lines, "---"])


def listed(rows: DataFrame, line: Column, order: Column) -> DataFrame:
    """One row ``text``: a line for each row, in order. ``rows`` is an aggregate by a small vocabulary."""
    lines = rows.select(order.alias("_o"), F.concat(F.lit("- "), line).alias("_l")).agg(F.array_sort(F.collect_list(F.struct("_o", "_l"))).alias("_a"))
    return lines.select(F.array_join(F.transform("_a", lambda x: x["_l"]), "\n").alias("text"))


def facts(totals: DataFrame, shown: Mapping[str, Column]) -> DataFrame:
    """One row ``text``: a line for each named value of a one-row aggregate."""
    return totals.select(F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), c.cast("string")) for name, c in shown.items()]).alias("text"))


def columns(schema: StructType, said: Mapping[str, str] | None = None) -> str:
    """A line for each column: its type, or what is said of it."""
    return "\n".join(f"- `{f.name}`: {(said or {}).get(f.name, f.dataType.simpleString())}" for f in schema.fields)


def card(title: str, fields: Mapping[str, str | Sequence[str]], about: str, sections: Mapping[str, DataFrame | str]) -> DataFrame:
    """The card in one row: front matter, title, a paragraph, and sections, each a text or a one-row table ``text``."""
    parts = [F.lit(front_matter(fields)), F.lit(f"# {title}"), F.lit(about)]
    some = next(s for s in sections.values() if isinstance(s, DataFrame))
    for name, section in sections.items():
        body = section.scalar() if isinstance(section, DataFrame) else F.lit(section)
        parts.append(F.concat(F.lit(f"## {name}\n\n"), body))
    return some.sparkSession.range(1).select(F.concat_ws("\n\n", *parts).alias("card"))


def sample_card(title: str, fields: Mapping[str, str | Sequence[str]], about: str, picked: DataFrame, pool: DataFrame, group: str, seconds: Column, size: Column, wanted: int, seed: int) -> DataFrame:
    """The card of a sample drawn by group: its totals, how many of each group's rows were taken, and its columns."""
    totals = picked.agg(F.count("*").alias("rows"), (F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600).alias("hours"), (F.coalesce(F.sum(size), F.lit(0)) / 1_000_000).alias("mb"))
    there = pool.groupBy(group).agg(F.count("*").alias("_all")).join(picked.groupBy(group).agg(F.count("*").alias("_some")), group, "left")
    taken = F.format_string("`%s`: %d selected / %d available", group, F.coalesce("_some", F.lit(0)), "_all")
    return card(title, fields, about, {
        "Contents": facts(totals, {"Rows": F.col("rows"), "Rows wanted of each group": F.lit(wanted), "Hours": F.format_string("%.3f", "hours"), "Payload": F.format_string("%.1f MB", "mb"), "Seed": F.lit(seed)}),
        "Groups": listed(there, taken, F.col(group)),
        "Columns": columns(picked.schema),
    })


def unit_card(title: str, fields: Mapping[str, str | Sequence[str]], about: str, units: DataFrame, label: str, seconds: Column) -> DataFrame:
    """The card of a set of labelled units: totals, rows and hours of each label, and its columns."""
    totals = units.agg(F.count("*").alias("rows"), F.count_distinct(label).alias("labels"), (F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600).alias("hours"))
    by_label = units.groupBy(label).agg(F.count("*").alias("n"), (F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600).alias("h"))
    return card(title, fields, about, {
        "Contents": facts(totals, {"Rows": F.col("rows"), "Labels": F.col("labels"), "Hours": F.format_string("%.3f", "hours")}),
        "Labels": listed(by_label, F.format_string("`%s`: %d rows, %.3f hours", label, "n", "h"), F.col(label)),
        "Columns": columns(units.schema),
    })
