"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of a test item; an item of fewer words is one window. Of
the k-word grams in each window only the smallest hash is kept (winnowing), on both sides, so a
window that a document shares with an item always shares its kept hash. Kept hashes are joined;
in documents that share one, the hits are extended: the windows around it are joined with the
items' windows by their words, and what they cover together is the shared span.

Words are runs of ASCII letters and digits and of anything outside ASCII, with A-Z lower-cased.
Null and empty texts have no words and hit nothing. Repeated rows are judged alike, repeated items
count once, an item without item_id marks words but is not listed. Extra columns are kept by
`clean_documents`. Empty tables give empty results. Native: only column expressions.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd.plans.staging import stage

WINDOW = 10
GRAM = 5
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _LETTERS, _LETTERS.lower())
    return F.filter(F.split(lowered, _BREAK, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_ANY_CASE_WORD)), F.lit(0)).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, though `body` names it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(w: Column, length: int | Column) -> Column:
    """0, 1, ... for each window of `length` words; empty if there is none."""
    last = F.size(w) - length
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _texts(w: Column, length: int | Column) -> Column:
    """The windows of `length` words, joined by one space."""
    return F.transform(_starts(w, length), lambda i: F.array_join(F.slice(w, i + 1, length), " "))


def _winnowed(w: Column, window: int, gram: int) -> Column:
    """For each window its smallest hash of `gram` words."""
    wide = window - gram + 1

    def smallest(h: Column) -> Column:
        grams = F.transform(
            _starts(h, gram), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(gram)])
        )
        return _let(
            grams,
            lambda g: F.transform(_starts(g, wide), lambda i: F.array_min(F.slice(g, i + 1, wide))),
        )

    return _let(F.transform(w, lambda x: F.xxhash64(x)), smallest)


def _keys(w: Column, length: int, window: int, gram: int) -> Column:
    """For each window of `length` words the hash it is joined by."""
    if length == window:
        return _winnowed(w, window, gram)
    return F.transform(_texts(w, length), lambda t: F.xxhash64(t))


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(length, key, words, item_id): every window of every item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window)).alias("length")
    items = items.select("item_id", "w", length)
    short = F.transform(_texts(F.col("w"), F.col("length")), lambda t: F.xxhash64(t))
    keys = F.when(F.col("length") == window, _winnowed(F.col("w"), window, gram)).otherwise(short)
    both = F.arrays_zip(keys.alias("key"), _texts(F.col("w"), F.col("length")).alias("words"))
    each = items.select("item_id", "length", F.explode(both).alias("x"))
    return each.select("length", "x.key", "x.words", "item_id").distinct()


def _identified_columns() -> list[Column]:
    """What tells documents apart; equal rows are one document, and null is an id like any other."""
    return [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.xxhash64(F.lit(1), "text").alias("_text"),
    ]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(*_identified_columns(), "text")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_id, _text, start, length, item_id): each window of an item that a document holds."""
    tests = stage(item_windows(benchmark, window, gram), "item-windows")
    lengths = [r[0] for r in tests.select("length").distinct().collect()]  # `window` numbers at most
    if not lengths:
        lengths = [window]
    rows = _identified(docs)
    tokens = rows.select("_id", "_text", words(F.col("text")).alias("w"))
    # One-row generators keep the words from being split again for every use below.
    tokens = tokens.select("_id", "_text", F.explode(F.array("w")).alias("w"))
    kept = [
        F.transform(
            F.array_distinct(_keys(F.col("w"), n, window, gram)),
            _tagged(n),
        )
        for n in lengths
    ]
    found = tokens.select("_id", "_text", F.explode(F.concat(*kept)).alias("k"))
    wanted = tests.select(F.struct("length", "key").alias("k")).distinct()
    shared = (
        found.join(wanted, "k", "left_semi")
        .groupBy("_id", "_text")
        .agg(F.collect_set("k").alias("shared"))  # no more than the document has windows
    )
    near = rows.join(shared, ["_id", "_text"]).select(
        "_id", "_text", "shared", F.explode(F.array(words(F.col("text")))).alias("w")
    )
    around = [
        F.filter(
            F.arrays_zip(
                _keys(F.col("w"), n, window, gram).alias("key"),
                _texts(F.col("w"), n).alias("words"),
                _starts(F.col("w"), n).alias("start"),
                F.transform(_starts(F.col("w"), n), _constant(n)).alias("length"),
            ),
            lambda x: F.array_contains(F.col("shared"), F.struct(x["length"].alias("length"), x["key"].alias("key"))),
        )
        for n in lengths
    ]
    extended = near.select("_id", "_text", F.explode(F.concat(*around)).alias("x")).select(
        "_id", "_text", "x.start", "x.length", "x.words"
    )
    return extended.join(tests.select("length", "words", "item_id").distinct(), ["length", "words"]).select(
        "_id", "_text", "start", "length", "item_id"
    )


def _tagged(length: int) -> Callable[[Column], Column]:
    return lambda key: F.struct(F.lit(length).alias("length"), key.alias("key"))


def _constant(value: int) -> Callable[[Column], Column]:
    return lambda _: F.lit(value)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(_id, _text, n_hit, items): documents with hits, the words covered and the sorted item ids."""
    covered = F.flatten(
        F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    )
    return (
        hits(docs, benchmark, **options)
        .groupBy("_id", "_text")
        .agg(
            F.collect_set(F.struct("start", "length")).alias("spans"),
            F.collect_set(F.col("item_id").cast("string")).alias("items"),
        )
        .select(
            "_id",
            "_text",
            F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
            F.sort_array("items").alias("items"),
        )
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with the columns of `docs`."""
    marks = ["_id", "_text"]
    bad = contamination(docs, benchmark, **options).select(*marks)
    marked = docs.select(F.struct(*docs.columns).alias("_row"), *_identified_columns())
    return marked.join(bad, marks, "left_anti").select("_row.*")


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    counted = docs.select("doc_id", word_count(F.col("text")).alias("n_words"), *_identified_columns())
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    joined = counted.join(contamination(docs, benchmark, **options), ["_id", "_text"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
