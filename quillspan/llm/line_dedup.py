"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are copies if their words (lower-cased, cut at ASCII white space) are within one edit of each other (or two, if
asked for): a word put in, left out or replaced. A line is dropped if an earlier line, by (doc_id, line), is a
copy of it; the earliest stays. Lines of fewer than ``min_words`` words have equal lines as copies only, and none if they
have fewer than ``exact_words``; blank lines always stay.

Equal lines are brought together by hash first. The deletion neighbourhood of a line is the set of its variants with
one word left out; lines within one edit share a variant. A variant is emitted as a hashed key only where an equal one
can exist: if a line of n words is cut into segments, an edit leaves all but one of them as they are, so two lines
within one edit agree on the words before and after some segment. That is asked with two segments of all lines, then
with eight of the lines that are left, and variants are emitted for positions in segments so found. Equal variants are joined:

* same length, same position left out: the lines differ in that word alone, so a group's least line is a copy of all;
* a line equal to a longer line's variant: there is one such line for a key, and each longer line joins it.

Either way a key gives as many pairs as it has lines. The edit distance of each pair is then verified on the words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.sequences import edit_distance
from quillspan.llm.bitmap import maybe_in
from quillspan.scratch import holding, release, save

#: Segments of the two rounds.
COARSE, FINE = 2, 8
#: White space within a line that is not a single space.
BLANKS = r" [ \t\x0B\f\r]+|[\t\x0B\f\r][ \t\x0B\f\r]*"


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): lower-cased, the words of a line parted by single spaces; row is the hash of the text as it was."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    odd = reduce(lambda a, b: a | b, [text.contains(x) for x in ("  ", "\t", "\x0b", "\f", "\r")])  # else the pattern finds nothing
    low = F.lower(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.when(odd, F.regexp_replace(low, BLANKS, " ")).otherwise(low).alias("text"))


def _lines(texts: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line, n): all lines of ``_texts`` with their number of words (a blank line has none)."""
    words = lambda x: F.when(x == "", 0).otherwise((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("int"))
    # both are made before the lines are dealt out, so that what is computed from them does not compute them again
    counted = F.transform(F.transform(F.split("text", "\n"), lambda x: F.btrim(x)), lambda x: F.struct(x.alias("line"), words(x).alias("n")))
    return texts.select("doc_id", "row", F.posexplode(counted).alias("line_no", "l")).select("doc_id", "row", "line_no", "l.line", "l.n")


def _segment_keys(line: Column, n: Column, m: int) -> Column:
    """Hashes of the words around each of m segments, for a line of n words seen as one of n and as one of n-1 words."""
    keys = []
    for less in (0, 1):
        length = n - less
        for i in range(m):
            before = F.floor(length * i / m).cast("int")
            after = (length - F.floor(length * (i + 1) / m)).cast("int")
            keys.append(F.struct(F.lit(less).alias("less"), F.lit(i).alias("segment"), F.xxhash64(F.lit(m * i), length, F.call_function("substring_index", line, F.lit(" "), before), F.call_function("substring_index", line, F.lit(" "), -after)).alias("key")))
    return F.array(*keys)


def _shared(keyed: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., less, segment) whose key another line has too; ``keyed`` has (by..., keys)."""
    keys = keyed.select(*by, F.explode("keys").alias("k")).select(*by, "k.*")
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keys.join(several, "key", "left_semi").drop("key")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one word put in, left out or replaced apart."""

    def common(x: Column, y: Column) -> Column:
        differ = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), F.lit(True))
        return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(x), F.size(y)))

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def _one_edit(near: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (h, g, kept, first) of distinct lines that may be within one edit, the earlier as ``kept``; and tables to release after use."""
    around = _shared(near.select("h", "g", _segment_keys(F.col("line"), F.col("n"), FINE).alias("keys")), ["h", "g"])
    length = F.col("n") - F.col("less")
    spans = around.join(near, ["h", "g"]).select(
        "h", "g", "first", "line", "n",
        F.floor(length * F.col("segment") / FINE).cast("int").alias("a"),
        (F.floor(length * (F.col("segment") + 1) / FINE) + F.col("less")).cast("int").alias("b"),
    )
    hashes = F.transform(F.split("line", " "), lambda x: F.xxhash64(x))
    left_out = lambda w: F.transform(
        F.filter(F.sequence("a", F.col("b") - 1), lambda i: F.col("a") < F.col("b")),
        lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(w, F.lit(1), i), F.slice(w, i + 2, F.col("n"))).alias("key")),
    )
    variants = save(
        spans.select("h", "g", "first", "n", F.explode(F.element_at(F.transform(F.array(hashes), left_out), 1)).alias("v")).select("h", "g", "first", "n", "v.*").distinct(),
        "line-variants",
    )
    earliest = variants.groupBy("key", "at", "n").agg(F.min("first").alias("kept"), F.count("*").alias("lines")).where("lines > 1").drop("lines")
    replaced = variants.join(earliest, ["key", "at", "n"]).where("kept < first").select("h", "g", "kept", "first")
    whole = near.select(F.xxhash64(hashes, F.array().cast("array<bigint>")).alias("key"), (F.col("n") + 1).alias("n"), F.col("h").alias("sh"), F.col("g").alias("sg"), F.col("first").alias("short"))
    grown = variants.join(whole, ["key", "n"])
    longer = grown.where("short < first").select("h", "g", F.col("short").alias("kept"), "first")
    shorter = grown.where("first < short").select(F.col("sh").alias("h"), F.col("sg").alias("g"), F.col("first").alias("kept"), F.col("short").alias("first"))
    return replaced.unionByName(longer).unionByName(shorter), [variants]


def _two_edits(near: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (h, g, kept, first) of distinct lines within two edits, the earlier as ``kept``, and tables to release after use; a key gives as many pairs as it has lines.

    Any two lines of a group are within two edits of each other, by what the key says:

    * the same two positions left out of lines of one length: two words replaced;
    * one word left out anywhere of lines of one length: one word put in and one left out, or one replaced;
    * one word left out, and two left out of a line longer by one, with the hole of one of them at the same place: one word
      replaced and one put in;
    * a line equal to a line longer by two with two words left out.
    """
    w = F.transform(F.split("line", " "), lambda x: F.xxhash64(x))
    lines = near.select("h", "g", "first", "n", w.alias("w"))
    rest = F.col("n")
    one = lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("w", F.lit(1), i), F.slice("w", i + 2, rest)).alias("key"))
    both = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.xxhash64(F.slice("w", F.lit(1), i), F.slice("w", i + 2, j - i - 1), F.slice("w", j + 2, rest)).alias("key"))
    ones = save(lines.select("h", "g", "first", "n", F.explode(F.transform(F.sequence(F.lit(0), rest - 1), one)).alias("v")).select("h", "g", "first", "n", "v.*"), "line-one-out")
    pairs_of = F.flatten(F.transform(F.sequence(F.lit(0), rest - 2), lambda i: F.transform(F.sequence(i + 1, rest - 1), lambda j: both(i, j))))
    twos = save(lines.where("n >= 2").select("h", "g", "first", "n", F.explode(pairs_of).alias("v")).select("h", "g", "first", "n", "v.*"), "line-two-out")
    wholes = lines.select("h", "g", "first", (rest + 2).alias("n"), F.xxhash64("w").alias("key"))
    holes = F.explode(F.array(F.col("i"), F.col("j") - 1)).alias("hole")
    longer = twos.select("h", "g", "first", "n", "key", holes)
    shorter = ones.select("h", "g", "first", (F.col("n") + 1).alias("n"), "key", F.col("i").alias("hole"))

    def with_least(rows: DataFrame, of: DataFrame, by: list[str]) -> DataFrame:
        least = of.groupBy(*by).agg(F.min("first").alias("kept"))
        return rows.join(least, by).where("kept < first").select("h", "g", "kept", "first")

    found = [with_least(twos, twos, ["key", "i", "j", "n"]), with_least(ones, ones, ["key", "n"])]
    for x, y, by in ((longer, shorter, ["key", "hole", "n"]), (twos, wholes, ["key", "n"])):
        found += [with_least(x, y, by), with_least(y, x, by)]
    return reduce(DataFrame.unionByName, found), [ones, twos]


def duplicate_lines(docs: DataFrame, min_words: int = 5, exact_words: int | None = 1, edits: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, ...) to the dropped lines (doc_id, row, line_no, kept_doc_id, kept_line_no).

    Lines of ``min_words`` words or more are compared up to an edit, those of ``exact_words`` or more (None: the same) as
    they are. ``edits`` is 1 or 2 words; for 2 a line of n words emits about n * n / 2 variants.

    line_no counts the \\n-split lines of the text from 0; ``row`` is a hash of the text, which tells rows of one doc_id
    apart. kept_* name the earliest line that the dropped one is a copy of (which may itself be a copy of an even
    earlier one that is two edits away). A null or empty text has no lines to judge. Rows that repeat both doc_id and
    text count once: their lines have the same place. A null doc_id comes before all others. Other columns are not
    read; an empty table gives no rows.
    """
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    place = ["doc_id", "row", "line_no"]
    lines = save(
        _lines(_texts(docs)).where(F.col("n") >= max(1, min_words if exact_words is None else min(exact_words, min_words)))
        .select(*place, F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), F.when(F.col("n") >= min_words, _segment_keys(F.col("line"), F.col("n"), COARSE).getField("key")).alias("keys")),
        "lines",
    )
    least = F.struct("doc_id", "line_no", "row")
    classes = save(lines.groupBy("h", "g").agg(F.min(least).alias("first"), F.max(least).alias("last"), F.first("keys").alias("keys")), "line-classes")

    long = classes.where("keys is not null")
    some = _shared(long.select("h", "g", F.transform("keys", lambda k: F.struct(k.alias("key"))).alias("keys")), ["h", "g"]).distinct() if edits == 1 else long.select("h", "g")
    firsts = save(classes.join(some, ["h", "g"], "left_semi").select("h", "g", "first"), "line-firsts")
    names = [F.col(f"first.{c}").alias(f"_{c}") for c in place]
    thin = maybe_in(_texts(docs), F.xxhash64("doc_id", "row"), firsts, F.xxhash64("first.doc_id", "first.row"))
    thin = maybe_in(_lines(thin), F.xxhash64(*place), firsts, F.xxhash64("first.doc_id", "first.row", "first.line_no"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    near = save(thin.join(firsts.select("h", "g", "first", *names), reduce(lambda a, b: a & b, on)).select("h", "g", "first", "line", "n").dropDuplicates(["h", "g"]), "line-near")

    pairs, variants = (_one_edit if edits == 1 else _two_edits)(near)
    pairs = pairs.distinct()
    text = near.select("first", F.split("line", " ").alias("w"))
    checked = pairs.join(text, "first").join(text.select(F.col("first").alias("kept"), F.col("w").alias("kept_w")), "kept").where(within_one_edit(F.col("w"), F.col("kept_w")) if edits == 1 else edit_distance(F.col("w"), F.col("kept_w")) <= edits)
    keepers = checked.groupBy("h", "g").agg(F.min("kept").alias("kept"))
    judged = save(classes.join(keepers, ["h", "g"], "left").where("kept is not null or first < last").select("h", "g", "first", F.coalesce("kept", "first").alias("kept")), "line-judged")
    for table in (classes, firsts, near, *variants):
        release(table)
    out = (
        lines.drop("keys").join(judged, ["h", "g"]).where(~((F.col("kept") == F.col("first")) & (F.struct("doc_id", "line_no", "row") == F.col("first"))))
        .select(*place, F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"))
    )
    return holding(out, lines, judged)


def drop_duplicate_lines(docs: DataFrame, min_words: int = 5, exact_words: int | None = 1, edits: int = 1) -> DataFrame:
    """``docs`` without the lines that are copies of earlier ones; n_chars follows the text, other columns stay.

    A row none of whose lines stays goes, unless its text had no line to drop. Rows that repeat both doc_id and text are
    treated alike. Needs the columns doc_id and text.
    """
    found = duplicate_lines(docs, min_words, exact_words, edits)
    drops = found.groupBy(F.col("doc_id").alias("__dropped_id"), F.col("row").alias("__dropped_row")).agg(F.collect_set("line_no").alias("__dropped_lines"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("__dropped_id")) & (F.xxhash64(text) == F.col("__dropped_row")), "left")
    lines = F.split(F.col("text"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped_lines"))
    kept = F.transform(F.array(lines), lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n"))
    new = F.when(F.col("__dropped_lines").isNull(), F.col("text")).otherwise(F.element_at(kept, 1))
    out = joined.withColumn("text", new).where(F.col("__dropped_lines").isNull() | F.col("text").rlike("[^ \\t-\\r]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__dropped_lines").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return holding(out.select(*docs.columns), *found._holds)
