"""Best-fit packing by bin completion.

Texts become pieces of at most ``capacity`` tokens. How the pieces fill sequences depends on their lengths alone, and
there are at most ``capacity`` of those, so the plan is made on the driver from a histogram whose size does not grow
with the corpus: a list of fillings (lengths with multiplicities), each with how many sequences use it. Pieces then
take the plan's slots of their length by rank, in parallel.

The plan: best-fit decreasing on the histogram gives the incumbent. Where it uses more sequences than the least
possible number, branch and bound completes bins: around the largest remaining piece it enumerates the undominated
fillings, prunes those whose waste would reach what the incumbent wastes, and takes each new solution as the incumbent.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.words import small
from quillspan.scratch import save

#: A filling: ((length, times), ...), longest first.
Filling = tuple[tuple[int, int], ...]
#: Fillings that the branch and bound looks at before it settles for the best plan so far.
LOOKS = 50_000


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: the tokens; the pieces by how many of them fit into a bin; and large pieces with what room they leave.

    A piece that is more than k of k + 1 parts of a bin counts for at least k/k bins, and so on for each k (a dual feasible
    function); pieces of more than half a bin take one each, and smaller ones of at least ``low`` only fit where those leave room.
    """
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in range(1, 21):
        share = 0  # in parts of k * (k + 1) * capacity
        for n, c in counts.items():
            parts, rest = divmod((k + 1) * n, capacity)
            share += c * (parts * (k + 1) * capacity if rest else k * (k + 1) * n)
        least = max(least, -(-share // (k * (k + 1) * capacity)))
    table = np.zeros(capacity + 2, np.int64)
    table[[n + 1 for n in counts]] = list(counts.values())
    upto, tokens = np.cumsum(table), np.cumsum(table * (np.arange(capacity + 2) - 1))  # pieces, and their tokens, below a length
    half = capacity // 2
    low = np.arange(1, half + 1)
    alone = upto[-1] - upto[capacity - low + 1]
    large = upto[capacity - low + 1] - upto[half + 1]
    room = large * capacity - (tokens[capacity - low + 1] - tokens[half + 1])
    small = tokens[half + 1] - tokens[low]
    return max(least, int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max(initial=0)))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: pieces of a length go at once to the fullest bins that hold them."""
    room: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(left: int, filling: Filling, bins: int) -> None:
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append((filling, bins))

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                left = rooms[at]
                filling, bins = room[left].pop()
            else:
                left, filling, bins = capacity, (), c
            if left in room and not room[left]:
                del room[left]
                rooms.remove(left)
            each = min(left // n, c)
            used = min(bins, c // each)
            if bins > used and filling:
                put(left, filling, bins - used)
            put(left - n * each, (*filling, (n, each)), used)
            c -= used * each
    return [x for v in room.values() for x in v]


def dominated(filling: list[int], spare: int, counts: dict[int, int], kinds: int) -> bool:
    """Whether one free piece could stand for some of the filling's pieces and leave the bin at least as full.

    ``counts`` has the pieces that the filling was chosen from, itself included; their lengths are the bits of ``kinds``.
    A free piece x that is as long as two or more chosen ones together, or longer than some by no more than the
    ``spare`` room, makes a filling that is never worse: what is packed with x elsewhere can be packed with those pieces instead.
    """
    one = several = 0  # sums of one chosen piece, and of two or more, as bits
    for n in filling:
        several |= (several << n) | (one << n)
        one |= 1 << n
    for n in set(filling):
        if counts[n] <= filling.count(n):
            kinds &= ~(1 << n)
    longer, wide = (one | several) << 1, 1  # sums and 1 to ``wide`` more
    while wide < spare:
        step = min(wide, spare - wide)
        longer |= longer << step
        wide += step
    return bool(kinds & (several | longer if spare else several))


def fillings(counts: dict[int, int], left: int, most_waste: int, looked: list[int]) -> Iterator[tuple[int, list[int]]]:
    """Undominated fillings (waste, lengths) of the room ``left``, least waste first, then the longest pieces first.

    They are made one at a time. For every waste the lengths that can still make up the rest are followed, told by the
    sums that each tail of the lengths reaches, so that no branch ends without a filling. ``looked`` counts down with each filling
    looked at, and with every 200 lengths of a bin to complete; at zero the enumeration ends.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= left), reverse=True)
    looked[0] -= len(lengths) // 200
    full, kinds = (1 << (left + 1)) - 1, sum(1 << n for n in counts)
    below = [-n for n in lengths]
    reach = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        n, c, bits, step = lengths[i], min(counts[lengths[i]], left // lengths[i]), reach[i + 1], 1
        while c:  # so many times in powers of two
            take = min(step, c)
            bits |= (bits << n * take) & full
            c -= take
            step *= 2
        reach[i] = bits

    def exact(at: int, room: int) -> Iterator[list[int]]:
        if not room:
            yield []
            return
        for i in range(max(at, bisect_left(below, -room)), len(lengths)):
            n = lengths[i]
            if not reach[i] >> room & 1:
                return
            for times in range(min(counts[n], room // n), 0, -1):
                if reach[i + 1] >> (room - n * times) & 1:
                    for rest in exact(i + 1, room - n * times):
                        yield [n] * times + rest

    for waste in range(min(left, most_waste) + 1):
        if reach[0] >> (left - waste) & 1:
            for filling in exact(0, left - waste):
                looked[0] -= 1
                if looked[0] < 0:
                    return
                if not dominated(filling, waste, counts, kinds):
                    yield waste, filling


def plan(counts: dict[int, int], capacity: int, looks: int = LOOKS) -> list[tuple[Filling, int]]:
    """Fillings with how many bins use each, together holding the histogram's pieces exactly.

    The bin of the longest piece left is completed by its undominated fillings in turn, each for as many bins as it
    goes, then for fewer. Fillings that came before at the same piece were tried with what follows already. Plans that turn off
    the first choice nowhere come first, then those that do it once, twice, four times and so on, as a first choice high up may be the wrong one. The
    search ends when the bound is met, when nothing is left to try, or after ``looks`` fillings; the best plan so far is returned.
    """
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, capacity)
    total, floor = sum(n * c for n, c in counts.items()), least_bins(counts, capacity)
    bins = sum(m for _, m in best)
    if bins <= floor:
        return best
    left, looked = dict(counts), [looks]  # one table, changed and changed back
    path: list[tuple[Filling, int]] = []

    def change(use: dict[int, int], by: int) -> None:
        for n, u in use.items():
            left[n] = left.get(n, 0) + u * by
            if not left[n]:
                del left[n]

    def choices(wasted: int, after: tuple, looked: list[int]) -> Iterator[tuple[int, dict[int, int], int, tuple]]:
        """(waste, pieces, bins, place in the order) to go on with; the same piece is not completed as before again."""
        top = max(left)
        change({top: 1}, -1)
        around, room = dict(left), capacity - top
        change({top: 1}, 1)
        for waste, f in fillings(around, room, (bins - 1) * capacity - total - wasted, looked):
            if waste > (bins - 1) * capacity - total - wasted:
                return
            place = (top, waste, tuple(-n for n in f))
            if after and after[0] == top and place <= after:
                continue
            use = Counter([top, *f])
            most = min(left[n] // u for n, u in use.items())
            if waste:
                most = min(most, ((bins - 1) * capacity - total - wasted) // waste)
            for times in range(most, 0, -1):
                if wasted + waste * times <= (bins - 1) * capacity - total:
                    yield waste, use, times, place

    def search(turns: int) -> bool:
        """Whether the search went through all there is, with at most ``turns`` choices on a path that are not the first.

        An open node remembers how many of its choices were taken, not the enumeration: that is made again where the search comes back.
        """
        nonlocal best, bins
        stack = [(0, (), 0, turns)]  # open nodes: waste so far, what came before, choices taken, turns left
        whole = True
        while stack and looked[0] >= 0 and bins > floor:
            wasted, after, taken, spare = stack.pop()
            step = None
            if taken and not spare:
                whole = False
            else:
                again = [1 << 60]
                now = choices(wasted, after, again if taken else looked)
                for _ in range(taken):
                    next(now, None)
                looked[0] -= 1
                step = next(now, None)
            if step is None:
                if path:
                    filling, times = path.pop()
                    change(dict(filling), times)
                continue
            waste, use, times, place = step
            change(use, -times)
            path.append((tuple(sorted(use.items(), reverse=True)), times))
            stack.append((wasted, after, taken + 1, spare))
            if left:
                stack.append((wasted + waste * times, place, 0, spare - (taken > 0)))
                continue
            best, bins = list(path), sum(m for _, m in path)
            filling, times = path.pop()
            change(dict(filling), times)
        while path:
            filling, times = path.pop()
            change(dict(filling), times)
        return whole

    turns = 0
    while not search(turns) and looked[0] >= 0 and bins > floor:
        turns = max(1, 2 * turns)
    return best


# How word_bpe_49k cuts texts, and the same cut of lower-cased Latin-1 texts for Python's re.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_LETTERS, LATIN_NUMBERS, LATIN_BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{LATIN_BLANKS}{LATIN_LETTERS}{LATIN_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of a word as little-endian 32-bit integers, found by ``find``; two generations, so that it stays small."""

    def __init__(self, find, most: int = 120_000) -> None:
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.find(word), "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class _Tokens:
    """A tokenizer file's ids of texts, the same as ``encode(text, add_special_tokens=False)`` gives.

    Where the file lower-cases and cuts as word_bpe_49k does, no token crosses a cut, so the ids of a text are those of
    its words in order, and words are remembered. Texts with other than Latin-1 characters, or with an added token's
    string, are cut at spaces and newlines only and given to the tokenizer in these parts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [x["content"] for x in said.get("added_tokens") or []]
        cut = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers") or []]
        self.known = steps == ["NFC", "Replace", "Lowercase"] and cut[0].get("pattern") == {"Regex": CUT} and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        model, letters = self.tokenizer.model, _byte_letters()
        self.parts = _Words(lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids)
        self.words = _Words(lambda w: [x.id for x in model.tokenize(w.encode().decode("latin-1").translate(letters))])

    def __call__(self, text: str) -> bytes:
        if not self.known:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not any(x in text for x in self.added) and (text.isascii() or max(text) < "\u0100"):
            return b"".join(map(self.words.__getitem__, LATIN_CUT.findall(text.lower())))
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str, _Tokens] = {}


def token_bytes(text: str, path: str) -> bytes:
    """The text's ids as little-endian 32-bit integers; the tokenizer is loaded once in a process."""
    if path not in _loaded:
        _loaded[path] = _Tokens(path)
    return _loaded[path](text)


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end], "<u4").tobytes()
        for batch in small(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = token_bytes(text or "", path) + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((row, piece, piece * capacity, len(part) // 4, zlib.crc32(part)))
            row, piece, start, length, crc = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def slots(fills: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """The plan by slot: slots of a length are numbered through the fillings that hold it.

    ``key`` (length << 40 | first slot) ascends; from it on, ``times`` slots in a row share a sequence.
    """
    rows, first, taken = [], 0, Counter()
    for filling, bins in fills:
        offset = 0
        for n, times in filling:
            rows.append((n << 40 | taken[n], times, first, offset))
            taken[n] += times * bins
            offset += n * times
        first += bins
    rows.sort()
    key, times, sequence, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": key, "times": times, "sequence": sequence, "offset": offset}


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            length, slot = (batch.column(c).to_numpy() for c in ("length", "slot"))
            at = np.searchsorted(t["key"], length << 40 | slot, "right") - 1
            into = (length << 40 | slot) - t["key"][at]
            sequence = t["sequence"][at] + into // t["times"][at]
            offset = t["offset"][at] + into % t["times"][at] * length
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, bucket_rows: int = 200_000) -> DataFrame:
    """``docs`` (doc_id, text, ...) to pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A text's tokens and then ``end`` are cut into pieces of ``capacity`` tokens (the last may be shorter); a null or
    empty text is one piece of one token. Every sequence holds at most ``capacity`` tokens, without gaps from 0.
    Repeated rows are packed as often as they occur; a null doc_id is kept; other columns are not read; an empty table
    gives no rows. Ranks within a length are taken in hash buckets of about ``bucket_rows`` pieces, so a length that
    many copies share is not one task's work. ``tokenizer`` is a path that every executor has. The histogram collected has at most ``capacity`` rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = save(docs.mapInArrow(_pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    buckets = max(1, max(counts.values(), default=0) // bucket_rows)
    put = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = put.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = put.withColumn("rank", rank).join(before.drop("n"), ["length", "bucket"])
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"))
    return placed.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
