"""Consecutive rows packed into groups in one ordered pass, without one task that makes the pass.

Where a group ends depends only on the row that it starts at and the few after it, so the start of the next group is known for every row at
once. Which rows are starts follows by pointer doubling: within a block of rows, jumps are squared until they leave the block, which
gives the block as a map from the offset at which it is entered to that at which the next one is. Maps of blocks are composed in
turn, level by level, and the entries so found are carried back down; only then are groups cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.rank import hash_order, positions
from quillspan.operators.scan import with_halo
from quillspan.scratch import release, save

_MAP = "block long, exits array<int>, kept array<long>"
_ENTRY = "block long, entry int, before long"


def drawn(seed: int, key: str, least: int, most: int) -> Column:
    """How many items a group wants that starts at this row."""
    digest = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("want"), F.col(key).cast("string"))), 1, 8)
    return (F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(most - least + 1)) + least).cast("int")


def lengths(seconds: np.ndarray, want: np.ndarray, least: int, most: int, target: float, longest: float, gap: float) -> np.ndarray:
    """For each row the length of a group that starts there.

    A group closes at the number it wants, or once it has ``least`` items and lasts ``target`` or the next item would bring it over ``longest``.
    """
    n = len(seconds)
    size, lasts, open_ = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
    for k in range(most):
        item = np.append(seconds[k:], np.zeros(min(k, n)))
        adds = item + (gap if k else 0.0)
        ends = (np.arange(n) + k >= n) | (k >= want)
        if k >= least:
            ends |= (lasts >= target) | (lasts + adds > longest)
        open_ &= ~ends
        lasts = np.where(open_, lasts + adds, lasts)
        size += open_
    return size


def jumps(size: np.ndarray, own: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each offset up to ``most`` at which a block of ``own`` rows is entered: the offset past its end, and the groups kept."""
    to = np.arange(own + most)
    to[:own] += np.maximum(1, size[:own])
    kept = np.zeros(own + most, np.int64)
    kept[:own] = size[:own] >= least
    while (to[:own] < own).any():  # twice as far each time
        kept = kept + kept[to]
        to = to[to]
    return to[:most] - own, kept[:most]


def _sorted(table: pa.Table) -> tuple[pa.Table, int]:
    """A block's rows in order, its own first, and how many are its own."""
    table = table.sort_by("pos")
    return table, int(np.count_nonzero(np.asarray(table.column("_own"))))


def _measure(rule: Callable[[pa.Table], np.ndarray], least: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        table, own = _sorted(table)
        exits, kept = jumps(rule(table), own, least, most)
        return pa.table([pa.array([table.column("_block")[0].as_py()], pa.int64()), pa.array([exits.tolist()], pa.list_(pa.int32())), pa.array([kept.tolist()], pa.list_(pa.int64()))], ["block", "exits", "kept"])

    return run


def _compose(fan: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        exits, kept = table.column("exits").to_pylist(), table.column("kept").to_pylist()
        at, total = list(range(len(exits[0]))), [0] * len(exits[0])
        for e, n in zip(exits, kept, strict=True):
            total = [t + n[a] for t, a in zip(total, at, strict=True)]
            at = [e[a] for a in at]
        return pa.table([pa.array([table.column("block")[0].as_py() // fan], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([total], pa.list_(pa.int64()))], ["block", "exits", "kept"])

    return run


def _descend(maps: pa.Table, above: pa.Table) -> pa.Table:
    maps = maps.sort_by("block")
    entry, before = (above.column("entry")[0].as_py(), above.column("before")[0].as_py()) if above.num_rows else (0, 0)
    out = []
    for b, e, n in zip(*[maps.column(c).to_pylist() for c in ("block", "exits", "kept")], strict=True):
        out.append((b, entry, before))
        entry, before = e[entry], before + n[entry]
    columns = list(zip(*out, strict=True)) if out else [()] * 3
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["block", "entry", "before"])


def _entries(maps: DataFrame, fan: int) -> DataFrame:
    """(block, entry, before): where each block is entered if the first is at 0, and the groups kept before it. ``maps`` is written; blocks count from 0."""
    over = F.floor(F.col("block") / fan)
    if maps.count() <= fan:
        nothing = maps.sparkSession.createDataFrame([], _ENTRY)
        return maps.groupBy(over).cogroup(nothing.groupBy("block")).applyInArrow(_descend, _ENTRY)
    above = save(maps.groupBy(over).applyInArrow(_compose(fan), _MAP), "grouping-maps")
    return maps.groupBy(over).cogroup(_entries(above, fan).groupBy("block")).applyInArrow(_descend, _ENTRY)


def _cut(rule: Callable[[pa.Table], np.ndarray], least: int, key: str):
    def run(table: pa.Table, entry: pa.Table) -> pa.Table:
        table, own = _sorted(table)
        if own:
            size, at, number = rule(table).tolist(), entry.column("entry")[0].as_py(), entry.column("before")[0].as_py()
        rows, groups, items = [], [], []
        while own and at < own:
            if size[at] >= least:
                rows += range(at, at + size[at])
                groups += [number] * size[at]
                items += range(size[at])
                number += 1
            at += max(1, size[at])
        took = table.take(pa.array(rows, pa.int64()))
        return pa.table([pa.array(groups, pa.int64()), pa.array(items, pa.int64()), took.column(key), took.column("seconds")], ["group_no", "item_no", key, "seconds"])

    return run


def pack_groups(df: DataFrame, key: str, seconds: str, seed: int, least: int = 2, most: int = 6, target: float = 28.0, longest: float = 55.0, gap: float = 0.08, block: int = 65_536, fan: int = 4096) -> DataFrame:
    """(group_no, item_no, key, seconds): all rows in hash order of a unique ``key``, packed in one pass; numbers count from 0.

    A group wants a number of items between ``least`` and ``most``, drawn by its first row, and closes as ``lengths`` says. A last piece of
    fewer than ``least`` items is dropped. Null seconds count as 0. No task holds more than ``block`` rows and the few that follow them, nor more than
    ``fan`` blocks' maps.
    """
    rows = df.select(F.col(key), F.coalesce(F.col(seconds).cast("double"), F.lit(0.0)).alias("seconds"), drawn(seed, key, least, most).alias("want"), hash_order(seed, F.col(key)).alias("_o"))
    block = max(block, most)  # a group reaches into the next block at most
    placed = save(positions(rows, [F.col("_o"), F.col(key)]).drop("_o"), "grouping-rows")
    rule = lambda t: lengths(np.asarray(t.column("seconds")), np.asarray(t.column("want")), least, most, target, longest, gap)
    blocks = with_halo(placed, "pos", block, most)
    maps = save(blocks.groupBy("_block").applyInArrow(_measure(rule, least, most), _MAP), "grouping-maps")
    entries = save(_entries(maps, fan), "grouping-entries")
    release(maps)
    return blocks.groupBy("_block").cogroup(entries.groupBy("block")).applyInArrow(_cut(rule, least, key), f"group_no long, item_no long, {key} {df.schema[key].dataType.simpleString()}, seconds double")
