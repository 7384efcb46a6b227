"""Benchmark decontamination by greedy string tiling.

Documents and test items become token sequences. Windows of ``least`` tokens that both hold are the seeds: a scan of the documents asks a
bitmap of fixed size which windows an item may hold, and a join by window hash keeps those that one does. A document's tokens outside seeds can
be in no tile, so for each item that shares a seed only the runs of seeds are tiled: running Karp-Rabin hashes find the
longest common stretches of unmarked tokens, these are marked on both sides, and so on down to ``least``. The share of
the item's tokens under tiles, in whatever order they stand in the document, is its coverage.

Seeds carry their tokens, so no document is shuffled, and neither items nor documents are held by a task or the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.bitmap import FILTER_BITS, collected_bits
from quillspan.llm.words import mix, small, window_hashes, word_hashes
from quillspan.scratch import holding, save

#: ASCII letters and digits lowered, all other ASCII bytes to spaces; bytes of other characters stay.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _KarpRabin:
    """Hashes of all stretches of a sequence in constant time each, from one pass of rolling sums."""

    def __init__(self, x: np.ndarray) -> None:
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(x), _BASE, np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(x) * self.power[: len(x)])])

    def at(self, starts: np.ndarray, n: int, top: int) -> np.ndarray:
        """Hashes of the n tokens from each start, brought to the common power ``top``."""
        return (self.sums[starts + n] - self.sums[starts]) * self._lift[top - starts]

    def prepare(self, lift: np.ndarray) -> _KarpRabin:
        self._lift = lift
        return self


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of the stretches of n tokens none of which is marked."""
    if len(marked) < n:
        return np.empty(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.nonzero(sums[n:] == sums[:-n])[0]


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in text, start in item, length), longest first, none overlapping on either side.

    Equal lengths are taken by item position, then text position.
    """
    top = max(len(text), len(item))
    lift = np.cumprod(np.concatenate([[np.uint64(1)], np.full(top, _BASE, np.uint64)]))
    a, b = _KarpRabin(text).prepare(lift), _KarpRabin(item).prepare(lift)
    marked_a, marked_b, tiles = np.zeros(len(text), bool), np.zeros(len(item), bool), []

    def starts(n: int) -> tuple[np.ndarray, ...]:
        """Starts of the free stretches of n tokens that both sides hold, and their hashes."""
        sa, sb = _free(marked_a, n), _free(marked_b, n)
        ha, hb = a.at(sa, n, top), b.at(sb, n, top)
        in_a, in_b = np.isin(ha, hb), np.isin(hb, ha)
        return sa[in_a], ha[in_a], sb[in_b], hb[in_b]

    high = len(item)
    while True:
        low, found = least - 1, None
        while low < high:  # the longest length with a common stretch: if n has one, n - 1 has
            n = (low + high + 1) // 2
            hit = starts(n)
            if len(hit[0]):
                low, found = n, hit
            else:
                high = n - 1
        if found is None:
            return tiles
        sa, ha, sb, hb = found
        order = np.argsort(ha, kind="stable")
        hashes, at = np.unique(ha[order], return_index=True)
        ends = np.append(at[1:], len(order))
        group = np.searchsorted(hashes, hb)
        for j, g in zip(sb.tolist(), group.tolist(), strict=True):
            if marked_b[j] or marked_b[j + low - 1]:  # marks of this round are as long, so the ends tell
                continue
            while at[g] < ends[g]:  # a start passed over is marked, and stays so
                i = int(sa[order[at[g]]])
                if not marked_a[i] and not marked_a[i + low - 1] and (text[i : i + low] == item[j : j + low]).all():
                    marked_a[i : i + low] = marked_b[j : j + low] = True
                    tiles.append((i, j, low))
                    break
                at[g] += 1
        high = low - 1


def _items(least: int):
    """Of each item with tokens: their hashes, the length of its windows, and its distinct windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            hashes = [word_hashes(tokens(t)) for t in batch.column("text").to_pylist()]
            some = pa.array([i for i, h in enumerate(hashes) if len(h)], pa.int64())
            hashes = [h for h in hashes if len(h)]
            n = [min(least, len(h)) for h in hashes]
            windows = [np.unique(window_hashes(h, k)) for h, k in zip(hashes, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("item", "item_id")), _lists(hashes), pa.array(n, pa.int32()), _lists(windows)], ["item", "item_id", "tokens", "n", "windows"])

    return run


def _lists(x: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, x)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64)))


def _seeds(bits, lengths: list[int]):
    """Of each text the windows that an item may hold: (n, pos, w, toks), toks being the window's tokens."""
    names = ["n", "pos", "w", "toks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in small(batches):
            rows, counts, parts = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                h = word_hashes(tokens(text))
                found = []
                for n in lengths:
                    w = window_hashes(h, n)
                    low = w & np.uint64(FILTER_BITS - 1)
                    at = np.flatnonzero(known[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        found.append((np.full(len(at), n), at, w[at], h[at[:, None] + np.arange(n)].ravel()))
                if found:
                    rows.append(row)
                    counts.append(sum(len(f[1]) for f in found))
                    parts += found
            n, pos, w, toks = (np.concatenate([np.empty(0, np.int64 if i < 2 else np.uint64), *(f[i] for f in parts)]) for i in range(4))
            each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(toks.view(np.int64)))
            hits = pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(pos, pa.int32()), pa.array(w.view(np.int64)), each], names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "row")), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), hits)], ["doc_id", "row", "hits"])

    return run


def tiles_of_seeds(starts: np.ndarray, toks: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles, in the text's own positions, of the runs that seeds make: window i, at ``starts[i]``, has the tokens ``toks[i]``."""
    n = toks.shape[1]
    runs = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + n]))  # seeds that meet or overlap are one run
    parts, back = [], []
    for k, (a, b) in enumerate(zip(runs, [*runs[1:], len(starts)], strict=True)):
        first, last = int(starts[a]), int(starts[b - 1]) + n
        run = np.empty(last - first, np.uint64)
        run[(starts[a:b] - first)[:, None] + np.arange(n)] = toks[a:b]
        # runs are laid end to end, with a token between that no text holds
        parts += [run, mix(np.array([k + 1], np.uint64))]
        back += [*range(first, last), -1]
    return [(back[i], j, m) for i, j, m in tile(np.concatenate(parts), item, n)]


def _match(num: int, den: int):
    """Rows (doc_id, row, item_id, tokens, seeds) to those whose item is covered enough, with their tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            rows, covered, sizes, counts, spans = [], [], [], [], []
            for row, (item, seeds) in enumerate(zip(batch.column("tokens"), batch.column("seeds"), strict=True)):
                h, seeds = item.values.to_numpy().view(np.uint64), seeds.values
                starts, toks = seeds.field("pos").to_numpy().astype(np.int64), seeds.field("toks")
                found = tiles_of_seeds(starts, toks.flatten().to_numpy().view(np.uint64).reshape(len(starts), -1), h)
                total = sum(n for _, _, n in found)
                if den * total >= num * len(h):
                    rows.append(row)
                    covered.append(total)
                    sizes.append(len(h))
                    counts.append(len(found))
                    spans.append(",".join(f"{i}:{j}:{n}" for i, j, n in sorted(found)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "row", "item_id")), *(pa.array(x, pa.int64()) for x in (covered, sizes, counts)), pa.array(spans, pa.string())],
                ["doc_id", "row", "item_id", "covered", "item_tokens", "n_tiles", "tiles"],
            )

    return run


def contaminated(docs: DataFrame, items: DataFrame, least: int = 5, num: int = 1, den: int = 2) -> DataFrame:
    """Pairs (doc_id, row, item_id, covered, item_tokens, n_tiles, tiles) with covered/item_tokens >= num/den.

    ``docs`` (doc_id, text, ...), ``items`` (item_id, text, ...). ``row`` is a hash of the text. ``tiles`` lists text:item:length in tokens. An item
    shorter than ``least`` tokens is matched whole; one without tokens, or with a null text, matches nothing, and so
    does a null document. A null doc_id or item_id stays null in the result. Long repetitive texts take time in proportion to their tokens and the item's lengths of tiles.
    A pair of repeated rows repeats. Empty tables give no rows. Other columns are not read. Of items the driver sees a bitmap of fixed size and their windows' lengths, ``least`` at most.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    items = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), text.alias("text"))
    items = save(items.mapInArrow(_items(least), "item long, item_id long, tokens array<long>, n int, windows array<long>"), "items")
    windows = items.select("item", "n", F.explode("windows").alias("w"))
    lengths = sorted(r.n for r in items.select("n").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(collected_bits(windows, F.col("w")))
    found = docs.mapInArrow(_seeds(bits, lengths), "doc_id long, row long, hits array<struct<n:int,pos:int,w:bigint,toks:array<bigint>>>")
    seeded = save(found.withColumn("text_no", F.monotonically_increasing_id()), "seeds")
    each = seeded.select("text_no", F.explode("hits").alias("s")).select("text_no", "s.*")
    pairs = each.join(windows, ["n", "w"]).groupBy("text_no", "item").agg(F.array_sort(F.collect_list(F.struct("pos", "toks"))).alias("seeds"))
    whole = pairs.join(items.select("item", "item_id", "tokens"), "item").join(seeded.select("text_no", "doc_id", "row"), "text_no")
    out = whole.select("doc_id", "row", "item_id", "tokens", "seeds").mapInArrow(_match(num, den), "doc_id long, row long, item_id long, covered long, item_tokens long, n_tiles long, tiles string")
    return holding(out, items, seeded)
