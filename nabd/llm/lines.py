"""Line dedup by an exact set-similarity join.

A line is the set of its words, lower-cased. Two lines match if the Jaccard similarity of their sets
is at least `threshold`; a line that matches an earlier one (by doc_id, then line number) is
removed. Lines are judged on the input.

Words are ordered by rarity: a word's rarity is the count of its hash slot over the whole corpus,
in logarithmic steps, then its hash; one order for all lines, from a table of fixed size. Lines
with equal sets are folded into the first of them. Each set's rarest words, as many as any matching
set must share one of, are its prefix; prefixes are joined by word under the length filter (the sizes
allow the threshold), the positional filter (so do the words that can still be shared) and a parity
filter: each word flips one of 128 bits, so two sets differ in at least as many words as their bits.
What remains is verified on the words themselves.

Near copies of one line are similar nearly all to all, so their pairs are the square of their number.
Such sets make a family around a centre, the words that most of them have, and most of their links are
counted by distance from it, see `family_links`; no link is lost, whichever sets make a family.

Null and empty texts have no lines; a line without words is kept and matches nothing. Rows without a
doc_id come first and are told apart by nothing but their lines. Rows that repeat a doc_id repeat
its line numbers, so of equal lines of one number none is earlier. As such rows may hold different
texts, sets are known by their digest and never by a place, and `dedup` knows a row by doc_id and
text. Extra columns are ignored or, by `dedup`, kept, whatever their names. Empty tables give empty results. Native: only
column expressions.
"""

import json
import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd.llm.common import packed, unpacked, words
from nabd.plans.staging import stage

THRESHOLD = 0.8
SLOTS = 1 << 16
OTHER_SPACE = "\t\x0b\x0c\r"
#: Sets that make a family, how many parity bits a set of it may differ in from its centre, and its words:
#: sets of no family meet each other in full, so these change the time only.
MANY = 16
FARTHEST = 44
LONGEST = 1000  # longer sets join no family


def _cut(text: str) -> Column:
    """The lines of a text, with no white space in them but spaces."""
    other = reduce(or_, (F.contains(F.col(text), F.lit(c)) for c in OTHER_SPACE))
    plain = F.when(other, F.translate(text, OTHER_SPACE, " " * len(OTHER_SPACE))).otherwise(F.col(text))
    return F.split(plain, "\n", -1)


def _lines(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_no from 0, line) of every line."""
    return docs.filter("text <> ''").select(*keys, F.posexplode(_cut("text")).alias("line_no", "line"))


def _line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), " ", -1), "")  # one character needs no pattern


def slot_ranks(docs: DataFrame) -> list[int]:
    """For each hash slot the logarithm of its number of words, in steps: SLOTS numbers."""
    every = docs.select(F.explode(words(F.lower("text"))).alias("w"))
    slots = every.groupBy(F.pmod(F.xxhash64("w"), F.lit(SLOTS)).alias("slot")).count().collect()
    ranks = [0] * SLOTS
    for row in slots:
        ranks[row["slot"]] = min(126, int(4 * math.log2(row["count"])) + 1)
    return ranks


def _parity(words_of: Column, half: bool) -> Column:
    """64 bits of a set: a word flips the bit its lowest 6 bits name; for `half` only if its seventh is set."""
    one = F.lit(1).cast("long")

    def flip(bits: Column, w: Column) -> Column:
        own = F.shiftright(w, 6).bitwiseAND(one) if half else one
        return bits.bitwiseXOR(F.call_function("shiftleft", own, w.bitwiseAND(63).cast("int")))

    return F.aggregate(words_of, F.lit(0).cast("long"), flip)


def _ordered_set(line: Column, ranks: list[int]) -> Column:
    """The hashes of a line's words, each once, the rarest first."""
    table = F.from_json(F.lit(json.dumps(ranks)), "array<bigint>")
    hashes = F.transform(_line_words(line), lambda w: F.xxhash64(w))
    keys = F.transform(
        hashes,
        lambda h: F.shiftleft(F.get(table, F.pmod(h, F.lit(SLOTS)).cast("int")), 56).bitwiseOR(
            F.shiftrightunsigned(h, 8)
        ),
    )
    return F.sort_array(F.array_distinct(keys))


def _digest_of(ordered: str) -> tuple[Column, Column]:
    return F.xxhash64(ordered).alias("a"), F.xxhash64(F.lit(1), ordered).alias("b")


def _bits(ordered: str) -> tuple[Column, Column]:
    """The 128 parity bits of a set: of all its words, less one half's, and of that half."""
    half = _parity(F.col(ordered), True)
    return half.alias("low"), _parity(F.col(ordered), False).bitwiseXOR(half).alias("high")


def _prefix(ordered: str, threshold: float) -> Column:
    n = F.size(ordered)
    # A partner of another set has at least one word more or less, so both need t / (1 - t) words.
    enough = n >= math.ceil(round(threshold / (1 - threshold), 9))
    least = F.when(enough, n - F.ceil(n * threshold - 1e-9) + 1).otherwise(0)
    words_of = F.slice(ordered, 1, least.cast("int"))
    return F.transform(words_of, lambda w: (w.bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int"))


def line_sets(
    docs: DataFrame, ranks: list[int], threshold: float = THRESHOLD, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """(keys, line_no, a, b, n, low, high, prefix) of each line's set.

    a and b are its digest, n its size, low and high its parity bits, and prefix its rarest words as
    32-bit numbers: two words of one number cost a candidate and lose none.
    """
    ordered = F.explode(F.array(_ordered_set(F.col("line"), ranks))).alias("set")
    rows = _lines(docs, keys).select(*keys, "line_no", ordered)
    return rows.filter(F.size("set") > 0).select(
        *keys,
        "line_no",
        *_digest_of("set"),
        F.size("set").alias("n"),
        *_bits("set"),
        _prefix("set", threshold).alias("prefix"),
    )


def _renamed(df: DataFrame, letter: str, *common: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{letter}_{c}" for c in df.columns if c not in common})


def _differing(x: str, y: str) -> Column:
    """In how many parity bits two sets differ: no more than they differ in words."""
    halves = (F.col(f"{x}_{half}").bitwiseXOR(F.col(f"{y}_{half}")) for half in ("low", "high"))
    return sum((F.bit_count(bits) for bits in halves), F.lit(0))


def _slack(n: Column, threshold: float) -> Column:
    """Two sets are similar if they differ in no more words than their slacks add up to."""
    return n * ((1 - threshold) / (1 + threshold))


def _reach(n: Column, threshold: float) -> Column:
    """In how many parity bits a set may differ from its centre, by the number of both's words."""
    return F.least(2 * _slack(n, threshold), F.lit(FARTHEST))


def class_words(docs: DataFrame, wanted: DataFrame, ranks: list[int]) -> DataFrame:
    """`wanted` (a, b, first and more) with `words`, the words of the set as one text."""
    by_doc = wanted.groupBy(F.col("first.doc_id").alias("_id")).agg(
        F.collect_set("first.line_no").alias("_lines")  # no more than the document has lines
    )
    by_doc = stage(by_doc, "line-places")  # where they are few, Spark then sees it and leaves the texts in place
    texts = docs.filter("text <> ''").join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")))
    found_at = F.transform(F.array(_cut("text")), lambda cut: F.transform("_lines", lambda i: F.get(cut, i)))
    lines = texts.select(F.explode(F.flatten(found_at)).alias("line")).filter("line is not null")
    # A place may hold several lines: rows without a doc_id share theirs, and so do repeated ones.
    ordered = F.explode(F.array(_ordered_set(F.col("line"), ranks))).alias("set")
    found_sets = lines.select("line", ordered).groupBy(*_digest_of("set")).agg(F.min("line").alias("line"))
    # Words are cut once a line and travel as one text, which packs better than an array.
    words_of = F.array_join(F.array_distinct(_line_words(F.col("line"))), " ").alias("words")
    return wanted.join(found_sets, ["a", "b"]).select(*wanted.columns, words_of)


def centres(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(c, n, low, high, prefix) of each family of sets: what most of its sets have.

    Sets whose two prefix words of the smallest numbers are the same make a family, if they are MANY.
    """
    pair = F.xxhash64(F.slice(F.array_sort("prefix"), 1, 2)).alias("family")
    keyed = classes.filter(F.size("prefix") > 0).select("n", "low", "high", "prefix", pair)
    sizes = keyed.groupBy("family").agg(F.count("*").alias("size")).filter(F.col("size") >= MANY)
    kin = stage(keyed.join(sizes, "family"), "line-kin")
    one, bit = F.lit(1).cast("long"), F.col("bit")
    each = kin.select("family", "size", "n", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    halves = ("low", "high")
    held = each.groupBy("family", "size", "bit").agg(
        F.avg("n").alias("n"), *[F.sum(F.call_function("shiftright", h, bit).bitwiseAND(one)).alias(h) for h in halves]
    )
    most = [F.when(F.col(h) * 2 > F.col("size"), F.call_function("shiftleft", one, bit)).otherwise(0) for h in halves]
    bits = held.groupBy("family", "size").agg(
        F.round(F.max("n")).cast("int").alias("n"), *[F.bit_or(m).alias(h) for m, h in zip(most, halves, strict=True)]
    )
    common = kin.select("family", "size", F.explode("prefix").alias("word")).groupBy("family", "size", "word").count()
    prefixes = common.filter("2 * count > size").groupBy("family").agg(F.collect_list("word").alias("prefix"))
    found = bits.join(prefixes, "family").groupBy("low", "high").agg(
        F.min("family").alias("c"), F.sum("size").alias("size"), F.max("n").alias("n"), F.max("prefix").alias("prefix")
    )
    found = stage(found, "line-centres")
    # Of centres that may be similar, those of fewer sets go.
    words_of = found.select("c", "size", "n", "low", "high", F.explode("prefix").alias("word"))
    met = _renamed(words_of, "x", "word").join(_renamed(words_of, "y", "word"), "word")
    less = F.struct("x_size", "x_c") < F.struct("y_size", "y_c")
    met = met.filter(less & (_differing("x", "y") <= _reach(F.col("x_n") + F.col("y_n"), threshold)))
    return found.join(met.select(F.col("x_c").alias("c")).distinct(), "c", "left_anti").drop("size")


def families(classes: DataFrame, middles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, c): the nearest centre, by parity bits, of each set that has one within reach."""
    words_of = classes.filter(F.col("n") <= LONGEST)
    words_of = words_of.select("id", "n", "low", "high", F.explode("prefix").alias("word"))
    centre_words = middles.select("c", "n", "low", "high", F.explode("prefix").alias("word"))
    met = _renamed(words_of, "x", "word").join(_renamed(centre_words, "y", "word"), "word")
    far = _differing("x", "y")
    reach = _reach(F.col("x_n") + F.col("y_n"), threshold)
    nearest = F.min(F.struct(far.alias("far"), F.col("y_c").alias("c")))
    return met.filter(far <= reach).groupBy(F.col("x_id").alias("id")).agg(nearest.alias("at")).select("id", "at.c")


def _near(threshold: float) -> Column:
    """Whether x and y, met by a word, may be similar by their sizes, the word's places and their bits."""
    nx, ny = F.col("x_n"), F.col("y_n")
    need = (nx + ny) * (threshold / (1 + threshold)) - 1e-9
    most = F.least(nx - F.col("x_pos"), ny - F.col("y_pos"))
    length = F.least(nx, ny) >= F.greatest(nx, ny) * threshold - 1e-9
    return length & (most >= need) & (_differing("x", "y") <= nx + ny - 2 * need)


def candidates(classes: DataFrame, members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(x, y): ids of sets that may be similar and are not of one family.

    Sets of one family never meet here: a word of two families brings the two families together, and
    only then the sets of the one and the other.
    """
    sets = classes.select("id", "n", "low", "high", "prefix").filter(F.size("prefix") > 0)
    place = F.posexplode("prefix").alias("pos", "word")
    alone = sets.join(members, "id", "left_anti").select("id", "n", "low", "high", place)
    kept = stage(sets.join(members, "id").select("id", "n", "low", "high", "c", place), "line-family-words")
    x, y = F.col("x_id").alias("x"), F.col("y_id").alias("y")
    near = _near(threshold)
    of_x, of_y = _renamed(kept, "x", "word"), _renamed(kept, "y", "word")
    shared = kept.select("c", "word").distinct()
    shared = _renamed(shared, "x", "word").join(_renamed(shared, "y", "word"), "word").filter("x_c < y_c")
    two = of_x.join(shared, ["word", "x_c"]).join(of_y, ["word", "y_c"]).filter(near).select(x, y)
    alone = _renamed(alone, "x", "word")
    one = alone.join(of_y, "word").filter(near).select(x, y)
    nx, ny = F.col("x_n"), F.col("y_n")
    shorter = (nx < ny) | ((nx == ny) & (F.col("x_id") < F.col("y_id")))
    none = alone.join(alone.withColumnsRenamed({f"x{c}": f"y{c}" for c in ("_id", "_n", "_low", "_high", "_pos")}), "word")
    return none.filter(shorter & near).select(x, y).unionByName(one).unionByName(two).distinct()


def family_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, other): links of sets of one family, and the earliest place linked (or the set's own).

    A family's centre is now made of the words that most of its sets have.
    A set is known by the words in which it differs from its centre. Two sets differ in no more words
    than both do from the centre; where that is little enough they are linked, and such links are
    counted by how far the sets are, without meeting. Others are linked only if they differ from the
    centre in the same words, so they meet by those, each pair at the first word it shares.
    """
    own = F.split("words", " ")
    sizes = members.groupBy("c").agg(F.count("*").alias("size"))
    held = members.select("c", F.explode(own).alias("word")).groupBy("c", "word").count()
    centre = held.join(sizes, "c").filter("2 * count > size").groupBy("c").agg(F.collect_list("word").alias("centre"))
    near = members.join(centre, "c", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<string>")))
    differing = F.concat(F.array_except(own, "centre"), F.array_except("centre", own))
    sets = near.select("c", "id", "first", "low", "high", F.size(own).alias("n"), differing.alias("diff"))
    sets = sets.withColumn("d", F.size("diff"))
    sets = sets.withColumn("room", F.round(_slack(F.col("n"), threshold) - F.col("d"), 9))
    sets = stage(sets, "line-differences")
    levels = sets.groupBy("c", "room").agg(F.count("*").alias("sets"), F.min("first").alias("first"))
    met = levels.select("c", F.col("room").alias("own")).join(levels, "c").filter("own + room >= -1e-8")
    sure = met.groupBy("c", F.col("own").alias("room")).agg(
        F.sum("sets").alias("n_links"), F.min("first").alias("other")
    )
    itself = F.when(F.col("room") * 2 >= -1e-8, 1).otherwise(0)  # a set is among those it counts
    counted = sets.select("c", "id", "room").join(sure, ["c", "room"]).select(
        "id", (F.col("n_links") - itself).alias("n_links"), "other"
    )
    by_word = sets.select("c", "id", "first", "low", "high", "n", "d", "room", "diff", F.explode("diff").alias("word"))
    slack = _slack(F.col("x_n") + F.col("y_n"), threshold) + 1e-8
    shared = F.array_intersect("x_diff", "y_diff")
    linked = (F.col("x_room") + F.col("y_room") < -1e-8) & (F.abs(F.col("x_d") - F.col("y_d")) <= slack)
    linked &= (F.col("x_id") < F.col("y_id")) & (_differing("x", "y") <= slack)
    linked &= (F.col("x_d") + F.col("y_d") - 2 * F.size(shared) <= slack) & (F.get(shared, 0) == F.col("word"))
    met = _renamed(by_word, "x", "c", "word").join(_renamed(by_word, "y", "c", "word"), ["c", "word"]).filter(linked)
    one = F.lit(1).cast("long").alias("n_links")
    ends = [F.struct(F.col(f"{a}_id").alias("id"), one, F.col(f"{b}_first").alias("other")) for a, b in ("xy", "yx")]
    return counted.unionByName(met.select(F.explode(F.array(*ends)).alias("end")).select("end.*"))


def links(docs: DataFrame, classes: DataFrame, ranks: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, other) of sets with links: their number and the earliest place linked; ids may repeat."""
    middles = stage(centres(classes, threshold), "line-middles")
    members = stage(families(classes, middles, threshold), "line-members")
    pairs = stage(candidates(classes, members, threshold), "line-pairs")
    ends = pairs.select(F.explode(F.array("x", "y")).alias("id")).unionByName(members.select("id")).distinct()
    wanted = classes.join(ends, "id", "left_semi").select("id", "a", "b", "low", "high", "first")
    sets = stage(class_words(docs, stage(wanted, "line-firsts"), ranks), "line-sets")
    within = family_links(sets.join(members, "id"), threshold)

    def side(letter: str) -> DataFrame:
        own = sets.select("id", "first", "words")
        return own.withColumnsRenamed({"id": letter, "first": f"{letter}_first", "words": f"{letter}_words"})

    both = pairs.join(side("x"), "x").join(side("y"), "y")
    cut_x, cut_y = (F.split(f"{letter}_words", " ") for letter in "xy")
    shared = F.size(F.array_intersect(cut_x, cut_y))
    near = shared >= (F.size(cut_x) + F.size(cut_y)) * (threshold / (1 + threshold)) - 1e-9
    found = both.filter(near)
    one = F.lit(1).cast("long").alias("n_links")
    for letter, other in ("xy", "yx"):
        within = within.unionByName(
            found.select(F.col(letter).alias("id"), one, F.col(f"{other}_first").alias("other"))
        )
    return within


def judged_lines(
    docs: DataFrame, threshold: float = THRESHOLD, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """(keys, line_no, n_links, removed) of every line with words."""
    texts = docs.select(*keys, "text")
    ranks = slot_ranks(texts)
    every = stage(line_sets(texts, ranks, threshold, keys), "lines")
    folded = every.groupBy("a", "b").agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"),
        *[F.first(c).alias(c) for c in ("n", "low", "high", "prefix")],
    )
    # The id stands for the digest, in half its bytes; staged, it is the same for every reader.
    classes = stage(folded.withColumn("id", F.monotonically_increasing_id()), "line-classes")
    near = links(texts, classes, ranks, threshold).groupBy("id").agg(
        F.sum("n_links").alias("n_links"), F.min("other").alias("other")
    )
    judged = classes.join(near, "id", "left").select(
        "a",
        "b",
        F.least("first", F.coalesce("other", "first")).alias("earliest"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    rows = every.select(*keys, "line_no", "a", "b").join(judged, ["a", "b"])
    return rows.select(
        *keys, "line_no", "n_links", (F.col("earliest") < F.struct("doc_id", "line_no")).alias("removed")
    )


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with later matches removed from the texts."""
    row = {"_nabd_a": F.xxhash64("text"), "_nabd_b": F.xxhash64(F.lit(1), "text")}
    named = packed(docs, "doc_id", "text").withColumns(row)
    judged = judged_lines(named, threshold, ("doc_id", *row))
    gone = judged.filter("removed").groupBy(F.col("doc_id").alias("_id"), *row).agg(
        F.collect_set("line_no").alias("_gone")
    )
    cut = F.split("text", "\n", -1)
    kept = F.filter(cut, lambda line, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    gone = gone.withColumnsRenamed({name: f"{name}2" for name in row})
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    for name in row:
        same &= F.col(name) == F.col(f"{name}2")
    kept = named.join(gone, same, "left").withColumn("text", text)
    return kept.select(*unpacked(docs.columns, "doc_id", "text"))


def digest(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines with words, n_removed, removed line numbers, and n_links of every document."""
    numbers = F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line_no"))))
    judged = judged_lines(docs, threshold).groupBy(F.col("doc_id").alias("_id")).agg(
        F.count("*").alias("n_lines"),
        F.count_if("removed").alias("n_removed"),
        F.array_join(numbers.cast("array<string>"), ",").alias("removed_lines"),
        F.sum("n_links").alias("n_links"),
    )
    zero = F.lit(0).cast("long")
    ids = docs.select("doc_id").distinct()
    return ids.join(judged, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.coalesce("n_lines", zero).alias("n_lines"),
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("removed_lines", F.lit("")).alias("removed_lines"),
        F.coalesce("n_links", zero).alias("n_links"),
    )
