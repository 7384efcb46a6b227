"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The product A·Aᵀ of the incidence matrix holds, for each pair of documents, how many n-grams they share. Only blocks
that can hold a linked pair are multiplied. Rows are first brought down to one per distinct set.

Which rows can link is told by rare columns. Two sets that reach similarity t = num/den share t of either's n-grams, so
of the n-grams in hash order each misses at most n - tn of the common ones: the first n - tn + r of a set hold the
first r common ones. Of these keys, counted over all sets, each set leaves out as many of the commonest as it can (fewer
than r for the smallest partner it may have); the rarest common one is left out by neither. So linked sets still share
a key, and a passage that many documents hold gives none unless it is a large part of them.

The blocks are multiplied in two steps. Every set has a parent, the least set that it shares a key with: a parent and
its sets are a block of one row by many. Sets that this links are one class. Where keys lead from one class to
another, the sets concerned are read again and all their n-grams counted, and with these counts an exact prefix filter says which
can still link: in the order from rare to common, the smaller of two linked sets of n n-grams shares one of its first n - 2tn/(1+t) + 1 with the first
m - tm + 1 of the larger. So pages that have a template in common but too much of their own share no such n-gram, however many
they are. What this leads together is a block; all but its largest class are multiplied with the whole, in tiles, and large
blocks are cut by size into overlapping spans such that sets of sizes that can be similar share one. So a large group
of near copies is read once. In a tile the overlap counts are accumulated over blocks of columns, pairs whose sizes
alone rule them out are discarded, and the rest are kept if the count reaches the bound that follows from the two
sizes. Nothing is sampled or capped, and no link between different sets is lost but within what is linked already.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.bitmap import maybe_in
from quillspan.llm.components import connected_components
from quillspan.llm.words import mix, mix_int, runs, shingle_set, texts, word_hashes
from quillspan.scratch import holding, release, save

#: Rows and n-grams of a tile of the product on average at most, and columns that are multiplied at once.
TILE, TILE_GRAMS, COLUMNS = 2048, 2_000_000, 2048
#: Rows from which a column is multiplied densely.
DENSE_FROM = 24
#: Keys beyond the fewest that a set gives, so that it may leave out common ones: a share of its n-grams, and at least so many.
MORE_SHARE, MORE_LEAST = 10, 8
#: Sets that a task remembers to give each set's keys once.
REMEMBERED = 500_000


def more_keys(n: int, num: int, den: int) -> int:
    """How many of the first common n-grams the keys of a set of n hold; never falls as n grows."""
    return min(-(-num * n // den), max(MORE_LEAST, n // MORE_SHARE))


def set_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The n-grams of a set, in hash order, that are counted: fewer than all by what a partner must share."""
    n = len(s)
    return s[: n - -(-num * n // den) + more_keys(n, num, den)] if n else s


def left_out(n: Column, num: int, den: int) -> Column:
    """How many of its commonest keys a set of n may leave out: fewer than the keys of its smallest partner hold."""
    share = lambda x: F.floor((x * num + den - 1) / den).cast("int")  # noqa: E731  the share of x rounded up
    least = share(n)
    return F.least(share(least), F.greatest(F.lit(MORE_LEAST), F.floor(least / MORE_SHARE).cast("int"))) - 1


def set_id(s: np.ndarray) -> int:
    """A 64-bit id of the set, from its size and n-grams."""
    return mix_int(int(mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)) ^ mix_int(len(s)))


def _signed(x: list[int]) -> pa.Array:
    return pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in x], pa.int64())


def _sets(k: int, num: int, den: int):
    """Of each text: its set's id and size; of each set that a task has not seen yet, the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        none = np.empty(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, sizes, keys = [], [], []
                for text in texts(part, "text"):
                    s = shingle_set(word_hashes(text.lower().split()), k)
                    node = set_id(s) if len(s) else None
                    fresh = node is not None and node not in seen
                    if fresh:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                    nodes.append(node)
                    sizes.append(len(s))
                    keys.append(set_keys(s, num, den) if fresh else none)
                ends = np.cumsum([0, *map(len, keys)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("row"), _signed(nodes), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([none, *keys]).view(np.int64)))],
                    ["doc_id", "row", "node", "n_shingles", "keys"],
                )

    return run


def _again(k: int):
    """The n-gram sets of the documents that stand for a set; rows whose text gives another set go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(word_hashes(t.lower().split()), k) for t in texts(part, "text")]
                ends = np.cumsum([0, *map(len, sets)])
                grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                same = pa.array([i for i, (s, n) in enumerate(zip(sets, part.column("node").to_pylist(), strict=True)) if len(s) and set_id(s) == n % (1 << 64)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("spots"), grams], ["node", "spots", "grams"]).take(same)

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many n-grams each left set shares with each right set (None: the left sets with each other).

    Columns that one side alone holds are left out. A column of few rows adds its pairs one by one; columns of many
    rows are multiplied as dense blocks. For ``right`` None, only entries off the diagonal are right.
    """
    n, every = len(left), [*left, *(right or ())]
    width = len(right) if right is not None else n
    grams, rows = np.concatenate(every), np.repeat(np.arange(len(every)), [len(x) for x in every])
    order = np.argsort(grams, kind="stable")
    grams, rows = grams[order], rows[order]
    starts = np.nonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))[0]
    ends = np.append(starts[1:], len(grams))
    if right is None:
        use = ends - starts > 1
    else:  # rows ascend within a column
        use = (rows[starts] < n) & (rows[ends - 1] >= n)
    starts, ends = starts[use], ends[use]
    size = ends - starts
    out = np.zeros((n, width), np.float32)
    codes = []
    light = np.nonzero(size <= DENSE_FROM)[0]
    for step in range(1, int(size[light].max(initial=1))):
        light = light[size[light] > step]
        within = size[light] - step
        at = np.repeat(starts[light] - np.concatenate([[0], np.cumsum(within)[:-1]]), within) + np.arange(within.sum())
        i, j = rows[at], rows[at + step]
        if right is not None:
            cross = (i < n) & (j >= n)
            i, j = i[cross], j[cross] - n
        codes.append(i * width + j)
    if codes:
        pairs, times = np.unique(np.concatenate(codes), return_counts=True)
        out.ravel()[pairs] += times
    heavy = np.nonzero(size > DENSE_FROM)[0]
    for k in range(0, len(heavy), COLUMNS):
        some = heavy[k : k + COLUMNS]
        at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(size[some])[:-1]]), size[some]) + np.arange(size[some].sum())
        x = np.zeros((len(every), len(some)), np.float32)
        x[rows[at], np.repeat(np.arange(len(some)), size[some])] = 1
        if right is None:
            out += np.triu(x @ x.T, 1)
        else:
            out += x[:n] @ x[n:].T
    return out + out.T if right is None else out


def links(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which left and right sets link; no product where the sizes of all pairs rule a link out."""
    a, b = np.array([len(x) for x in left])[:, None].astype(np.int32), np.array([len(x) for x in right])[None, :].astype(np.int32)
    near = (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (np.minimum(a, b) > 0)
    if not near.any():
        return near
    some_a, some_b = np.nonzero(near.any(1))[0], np.nonzero(near.any(0))[0]
    shared = overlaps([left[i] for i in some_a], None if right is left else [right[i] for i in some_b])
    need = -(-num * (a[some_a] + b[:, some_b]) // (num + den))  # den * shared >= num * (a + b - shared)
    near[np.ix_(some_a, some_b)] &= shared >= need
    return near


def _block_links(num: int, den: int):
    """Rows sorted by block to a spanning forest of the links between each block's left and right rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for block in runs(batches, BLOCK):
            nodes, once = np.unique(block.column("node").to_numpy(), return_index=True)  # a row may have come twice
            side = block.column("side").to_numpy()[once]
            grams = block.column("grams").combine_chunks().take(pa.array(once))
            sets = [x.values.to_numpy() for x in grams]
            left, right = np.nonzero(side & LEFT)[0], np.nonzero(side & RIGHT)[0]
            if not len(left) or not len(right):
                continue
            rows = [sets[x] for x in left]
            x, y = np.nonzero(links(rows, rows if (side == LEFT | RIGHT).all() else [sets[x] for x in right], num, den))
            x, y = left[x], right[y]
            label = np.arange(len(nodes))
            while True:
                m = label.copy()
                np.minimum.at(m, x, label[y])
                np.minimum.at(m, y, label[x])
                m = m[m]
                if (m == label).all():
                    break
                label = m
            far = np.nonzero(label != np.arange(len(nodes)))[0]
            out_a += nodes[label[far]].tolist()
            out_b += nodes[far].tolist()
            if len(out_a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


#: What tells blocks apart: what they are of, the span of sizes, and the two tiles.
BLOCK = ["root", "span", "i", "j"]
#: Sides of a block that a row stands on.
LEFT, RIGHT = 1, 2
_SPOTS = "array<struct<root:bigint,span:int,i:int,j:int,side:int>>"


def _grams(docs: DataFrame, stand: DataFrame, spots: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, spots, grams) of the sets in ``spots`` (node, spots), read again from the texts that ``stand`` says; and a table to release after use."""
    wanted = save(stand.select("node", "id", "row").join(spots, "node"), "ngram-wanted")
    some = maybe_in(docs, F.xxhash64("doc_id", "row"), wanted, F.xxhash64("id", "row"))
    theirs = wanted.withColumnRenamed("row", "their_row")
    again = some.join(theirs, some["doc_id"].eqNullSafe(theirs["id"]) & (some["row"] == theirs["their_row"])).select("text", "node", "spots")
    return again.mapInArrow(_again(k), f"node long, spots {_SPOTS}, grams array<long>"), wanted


def _multiply(docs: DataFrame, stand: DataFrame, spots: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links (a, b) found in the blocks: ``spots`` (node, spots) says where each set's row goes, ``stand`` whose text has it."""
    grams, wanted = _grams(docs, stand, spots, k)
    dealt = grams.select("node", "grams", F.explode("spots").alias("s")).select("s.*", "node", "grams").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "node")
    found = save(dealt.mapInArrow(_block_links(num, den), "a long, b long"), "ngram-links")
    release(wanted)
    return found


def _shared_keys(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, pivots): of each set that shares a key that it keeps, the least sets that share its keys, in order."""
    keys = sets.select("node", F.col("n_shingles").cast("int").alias("n"), F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("often"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "often")
    shared = save(shared, "ngram-shared")
    thin = maybe_in(keys, F.col("key"), shared, F.col("key"))
    ranked = F.array_sort(F.collect_set(F.struct("often", "key")))
    own = thin.join(shared, "key").groupBy("node").agg(F.max("n").alias("n"), ranked.alias("keys"))
    spare = left_out(F.col("n"), num, den)
    kept = own.select("node", F.explode(F.slice("keys", F.lit(1), F.greatest(F.lit(0), F.size("keys") - spare))).alias("k")).select("node", "k.key")
    kept = save(kept, "ngram-keys")
    release(shared)
    pivots = kept.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "lo")
    out = save(kept.join(pivots, "key").groupBy("node").agg(F.array_sort(F.collect_set("lo")).alias("pivots")), "ngram-pivots")
    release(kept)
    return out


def _star_spots(pivots: DataFrame, stand: DataFrame) -> DataFrame:
    """(node, spots) of the blocks of a parent, the first pivot, by the sets that have it; large ones in several parts."""
    child = pivots.select("node", F.col("pivots")[0].alias("parent")).where("node <> parent").join(stand.select("node", "n"), "node")
    parts = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_GRAMS)).cast("int").alias("parts")
    parents = child.groupBy("parent").agg(parts)
    spot = lambda root, i, side: F.struct(root.alias("root"), F.lit(-2).alias("span"), i.alias("i"), F.lit(0).alias("j"), F.lit(side).alias("side"))
    right = child.join(parents, "parent").select("node", F.array(spot(F.col("parent"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), RIGHT)).alias("spots"))
    left = parents.select(F.col("parent").alias("node"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: spot(F.col("parent"), i, LEFT)).alias("spots"))
    return right.unionByName(left).groupBy("node").agg(F.flatten(F.collect_list("spots")).alias("spots"))  # one or two


def _close(docs: DataFrame, stand: DataFrame, member: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets of one block, in stars, that lead together all sets of different classes that the prefix filter cannot tell apart.

    ``member`` (node, n, class, root) is written. An n-gram that no other member of the block has comes first in the order and leads nowhere.
    """
    grams, wanted = _grams(docs, stand, member.select("node", F.expr(f"cast(array() as {_SPOTS})").alias("spots")), k)
    grams = save(grams.select("node", "grams"), "ngram-grams")
    release(wanted)
    each = grams.join(member, "node").select("root", "node", F.explode("grams").alias("gram"))
    shared = save(each.groupBy("root", "gram").agg(F.count("*").alias("often")).where("often > 1"), "ngram-counts")
    thin = maybe_in(each, F.xxhash64("root", "gram"), shared, F.xxhash64("root", "gram")).join(shared, ["root", "gram"])
    own = thin.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("often", "gram"))).alias("grams")).join(member, "node")
    alone = F.col("n") - F.size("grams")
    up = lambda by, of: F.floor((F.col("n") * by + of - 1) / of)  # noqa: E731  the share of n rounded up
    reach = lambda share: F.greatest(F.lit(0), F.col("n") - share + 1 - alone).cast("int")
    first, longer = reach(up(2 * num, num + den)), reach(up(num, den))
    spread = own.select("root", "node", "class", first.alias("first"), F.posexplode(F.slice("grams", F.lit(1), longer)).alias("at", "g"))
    keys = save(spread.select("root", "node", "class", (F.col("at") < F.col("first")).alias("is_first"), "g.gram"), "ngram-close")
    hub = keys.groupBy("root", "gram").agg(F.max("is_first").alias("any"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.min(F.struct(~F.col("is_first"), "node"))["node"].alias("hub"))
    pairs = keys.join(hub.where("any and lo < hi").select("root", "gram", "hub"), ["root", "gram"]).where("node <> hub")
    out = save(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "ngram-near")
    for table in (grams, shared, keys):
        release(table)
    return out


def _members(stand: DataFrame, classes: DataFrame, rough: DataFrame) -> DataFrame:
    """(node, n, class, root) of the sets in blocks of more than one class, written. ``classes`` (node, root) has sets that are linked already, ``rough``
    (node, root) the blocks of classes."""
    of = stand.select("node", "n").join(classes.select("node", F.col("root").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    return save(of.join(rough.select(F.col("node").alias("class"), "root"), "class").select("node", "n", "class", "root"), "ngram-members")


def _class_spots(member: DataFrame, num: int, den: int) -> DataFrame:
    """(node, spots) of the tiles of the blocks of ``member`` (node, n, class, root): each class but the largest with the whole block."""
    sizes = member.groupBy("root", "class").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    blocks = sizes.groupBy("root").agg(F.max(F.struct("c", "class"))["class"].alias("most"), ((F.sum("c") <= TILE) & (F.sum("n") <= TILE_GRAMS)).alias("small"))
    step = F.floor(F.log("n") / (1.01 * log(den / num))).cast("int")
    spans = F.explode(F.when(F.col("small"), F.array(F.lit(-1))).otherwise(F.array(step, step + 1))).alias("span")
    spread = member.join(blocks, "root").select("node", "root", "n", (F.col("class") == F.col("most")).alias("main"), spans)
    tiles = lambda which: F.ceil(F.greatest(F.count(F.when(which, 1)) / TILE, F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / TILE_GRAMS)).cast("int")
    sized = spread.groupBy("root", "span").agg(tiles(~F.col("main")).alias("rest"), tiles(F.col("main")).alias("mains"))
    placed = spread.join(sized.where("rest > 0"), ["root", "span"])
    mine = F.when(F.col("main"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)

    def spot(other: Column) -> Column:
        side = F.when(other == F.col("mine"), LEFT | RIGHT).when(F.col("mine") < other, LEFT).otherwise(RIGHT)
        return F.struct("root", "span", F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"), side.alias("side"))

    return placed.withColumn("mine", mine).select("node", F.transform(others, spot).alias("spots")).groupBy("node").agg(F.flatten(F.collect_list("spots")).alias("spots"))  # one or two spans


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between the roots that ``labels`` (node, root) gives their ends; those within one root go."""
    for end in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(end), F.col("root").alias("_root")), end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return edges.where("a <> b").distinct()


def ngram_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, n_shingles, component_id, row, class), a row for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, with A-Z lowered; a text's set holds its distinct k-word
    shingles (the whole sequence as one where there are fewer words). Texts link where den * shared >= num * union.
    component_id is the least doc_id that links reach. A null or blank text has no shingle, links with nothing and is
    its own component. Repeated rows each get a row. A null doc_id takes part but never names a component unless
    nothing else is there. ``row`` is a hash of the text, which tells rows of one doc_id apart; ``class`` is the same for
    linked texts, and null without shingles. Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"))
    keyed = save(docs.mapInArrow(_sets(k, num, den), "doc_id long, row long, node long, n_shingles long, keys array<long>"), "ngram-sets")
    pivots = _shared_keys(keyed, num, den)
    sets = save(keyed.drop("keys"), "ngram-nodes")
    release(keyed)  # the keys are only needed for the pivots
    first = F.min(F.struct("doc_id", "row"))
    stand = save(sets.join(pivots.select("node"), "node").groupBy("node").agg(first.alias("f"), F.max("n_shingles").alias("n")).select("node", F.col("f.doc_id").alias("id"), F.col("f.row").alias("row"), "n"), "ngram-stand")
    stars = _multiply(docs, stand, _star_spots(pivots, stand), k, num, den)
    classes = connected_components(stars)
    near = pivots.select(F.col("pivots")[0].alias("a"), F.explode(F.concat(F.array("node"), "pivots")).alias("b")).where("a <> b").distinct()
    rough = connected_components(_labelled(near, classes))
    member = _members(stand, classes, rough)
    close = _close(docs, stand, member, k, num, den)
    blocks = connected_components(close)
    tiles = _multiply(docs, stand, _class_spots(member.drop("root").join(blocks, "node"), num, den), k, num, den)
    merged = connected_components(_labelled(tiles, classes))
    for table in (pivots, stars, stand, rough, member, close, blocks, tiles):
        release(table)
    placed = sets.join(classes, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    placed = placed.join(merged.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("class", F.coalesce("root", "class"))
    least = placed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    out = placed.join(least, "class", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "row", "class")
    return holding(out, sets, classes, merged)
