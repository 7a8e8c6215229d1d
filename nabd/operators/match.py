"""Keyword and date selection: one request, or many requests over one scan."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd.functions import text as tx
from nabd.functions.dates import in_range, post_day, request_day_text
from nabd.operators.dedup import dedup_by_hash, text_hash

# Keywords meet texts by their first so many characters, which are the whole of most keywords.
_LONGEST = 16
# A place of a text is kept when its first characters, so many or fewer, are those of some keyword.
_NEAR = 3
# The filter of wanted grams: so many 64-bit words, whatever the number of keywords.
_FILTER_WORDS = 1 << 13
# A class of more characters than these is searched as any character.
_MOST_CHARACTERS = 256


def keyword_filter(posts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Posts whose text contains any keyword, ignoring case, short vowels and letter variants."""
    usable = [k for k in keywords or [] if k and k.strip()]
    if not usable:
        return posts
    table = str.maketrans(fv.SEARCH_LETTERS) | {ord(c): None for c in fv.SEARCH_MARKS}
    text = tx.search_key(F.col("text"))
    found = F.lit(False)
    for keyword in dict.fromkeys(k.translate(table).lower() for k in usable):
        found = found | F.contains(text, F.lit(keyword))
    return posts.filter(found)


def date_filter(posts: DataFrame, date_from=None, date_to=None, strict=False) -> DataFrame:
    """Posts within the days, both ends included; posts without a readable day pass."""
    if not date_from and not date_to:
        return posts
    first, last = (
        F.lit(str(d)[:10]).cast("date") if d else F.lit(None).cast("date")
        for d in (date_from, date_to)
    )
    return posts.filter(in_range(post_day(F.col("created_at"), strict), first, last))


def full_filter(
    posts: DataFrame, keywords: Sequence[str], date_from=None, date_to=None, deduplicate=True
) -> DataFrame:
    """Dedup, keyword and date selection for one request.

    Copies have equal text, so the keyword filter may run first, in the scan. The date filter may
    not: copies differ in date and the survivor decides.
    """
    posts = keyword_filter(posts, keywords)
    if deduplicate:
        posts = dedup_by_hash(posts)
    return date_filter(posts, date_from, date_to)


def _optional(requests: DataFrame, name: str, type_name: str) -> Column:
    return F.col(name) if name in requests.columns else F.lit(None).cast(type_name)


def prepare_requests(
    requests: DataFrame, default_dataset_ids: Sequence[str] | None = None
) -> DataFrame:
    """request_id, normalized keywords, day range, datasets and scope of each request.

    `any_text` marks requests that match every post: no usable keyword, or one that normalizes
    to nothing. `bad_dates` marks requests whose bounds cannot be read. `datasets` is null for
    requests over everything; `scope` names the set of datasets.
    """
    strings = "array<string>"
    usable = F.filter(
        F.coalesce(_optional(requests, "keywords", strings), F.array().cast(strings)),
        lambda k: tx.strip(k) != "",
    )
    default = F.array(*map(F.lit, default_dataset_ids)) if default_dataset_ids else F.lit(None)
    chosen = _optional(requests, "dataset_ids", strings)
    datasets = F.when(F.size(chosen) > 0, chosen).otherwise(default.cast(strings))
    columns = {
        "kws": F.array_distinct(F.transform(usable, tx.search_key)),
        "datasets": F.sort_array(F.array_distinct(datasets)),
    }
    for bound in ("date_from", "date_to"):
        columns[f"_{bound}"] = request_day_text(_optional(requests, bound, "string"))
    df = requests.withColumns(columns)
    from_day, to_day = F.try_to_date("_date_from"), F.try_to_date("_date_to")
    return df.select(
        "request_id",
        "kws",
        ((F.size("kws") == 0) | F.array_contains("kws", "")).alias("any_text"),
        from_day.alias("from_day"),
        to_day.alias("to_day"),
        (
            (F.col("_date_from").isNotNull() & from_day.isNull())
            | (F.col("_date_to").isNotNull() & to_day.isNull())
        ).alias("bad_dates"),
        "datasets",
        F.coalesce(F.concat_ws("\u0001", "datasets"), F.lit("")).alias("scope"),
    )


@dataclass(frozen=True)
class Selection:
    """The posts that some request selects, and who selects them.

    Posts that the same requests select share a `set_id`; `sets` has a row (set_id, request_id) for
    each request of a set, so a post that a thousand requests share is one row of `posts`. Requests
    that ask for the same are one in `sets`; `twins` (request_id, twin) tells which stands for which.
    """

    posts: DataFrame
    sets: DataFrame
    twins: DataFrame

    def pairs(self) -> DataFrame:
        """One row per (request, post)."""
        by_twin = self.sets.withColumnRenamed("request_id", "twin")
        return self.posts.join(by_twin.join(self.twins, "twin").drop("twin"), "set_id").drop("set_id")


def _bit(gram: Column) -> tuple[Column, Column]:
    h = F.xxhash64(gram)
    return F.pmod(h, F.lit(_FILTER_WORDS)).cast("int"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")


def _filter_words(grams: DataFrame) -> DataFrame:
    """A Bloom filter of the grams, of fixed size."""
    word, bit = _bit(F.col("gram"))
    own = grams.select(word.alias("word"), bit.alias("bit"))
    own = own.select("word", F.expr("shiftleft(1L, bit)").alias("bits"))
    none = grams.sparkSession.range(_FILTER_WORDS)
    none = none.select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = own.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return words.agg(F.transform(listed, lambda w: w["bits"]).alias("bits"))


def _passes(gram: Column) -> Column:
    word, bit = _bit(gram)
    return F.getbit(F.get(F.col("_wanted"), word), bit) == 1


def _one_of(characters: Sequence[str]) -> str:
    """A class of the characters, or of all that can begin one when they are many."""
    if len(characters) > _MOST_CHARACTERS:
        return r"[^\x{DC00}-\x{DFFF}]"
    return tx.one_of("".join(rf"\x{{{ord(c):x}}}" for c in sorted(characters)))


def _shape(keywords: DataFrame) -> tuple[list[int], dict[int, list[Sequence[str]]], bool]:
    """The lengths of the grams, which characters stand at the first places of keywords of two
    characters and of longer ones, and whether some keyword is longer than its gram."""
    size = F.length("k")
    sets = {
        (n, i): F.when(F.least(size, F.lit(_NEAR)) == n, F.substring("k", i, 1))
        for n in (2, _NEAR)
        for i in range(1, n + 1)
    }
    found = keywords.agg(
        F.sort_array(F.collect_set(F.least(size, F.lit(_LONGEST)))),
        F.coalesce(F.max(size) > _LONGEST, F.lit(False)),
        *[F.slice(F.collect_set(c), 1, _MOST_CHARACTERS + 1) for c in sets.values()],
    ).first()
    characters = dict(zip(sets, found[2:], strict=True))
    return found[0], {n: [characters[n, i] for i in range(1, n + 1)] for n in (2, _NEAR)}, found[1]


def _grams(texts: DataFrame, keywords: DataFrame, sizes: Sequence[int], characters) -> DataFrame:
    """(post_id, gram): what the texts `_key` have of the first characters of keywords, in every length of `sizes`."""

    def places(n: int, most: int) -> Column:
        """What stands at each place of a text where a keyword may begin."""
        first = "".join(_one_of(c) for c in characters[n])
        return F.regexp_extract_all("_key", F.lit(f"(?s)(?=({first}.{{0,{most - n}}}))"), F.lit(1))

    parts = [F.array().cast("array<string>")]
    if 1 in sizes:
        parts.append(F.array_distinct(F.split("_key", "")))
    if 2 in sizes:
        parts.append(F.array_distinct(places(2, 2)))
    if sizes and sizes[-1] >= _NEAR:
        parts.append(places(_NEAR, sizes[-1]))
    # Only places where more than the near characters is wanted differ by what follows them.
    begun = keywords.select(F.explode(F.array(F.substring("k", 1, _NEAR), F.substring("k", 1, _NEAR + 1))).alias("gram"))
    # Taken apart into rows first: rows are hashed in generated code, elements of an array are not.
    filtered = texts.withColumn("_wanted", _filter_words(begun.distinct()).scalar())
    rows = filtered.select("post_id", "_wanted", F.explode(F.concat(*parts)).alias("_place"))
    near = F.substring("_place", 1, _NEAR)
    rows = rows.filter(_passes(near))
    place = F.when(_passes(F.substring("_place", 1, _NEAR + 1)), F.col("_place")).otherwise(near)
    rows = rows.select("post_id", place.alias("_place")).distinct()
    cuts = [F.when(F.length("_place") >= n, F.substring("_place", 1, n)) for n in sizes if n >= _NEAR]
    short = F.length("_place") < _NEAR
    grams = F.when(short, F.array("_place")).otherwise(F.array(*cuts)) if cuts else F.array("_place")
    return rows.select("post_id", F.explode(grams).alias("gram")).filter("gram IS NOT NULL")


def post_words(posts: DataFrame, keywords: DataFrame, strict_days=False) -> DataFrame:
    """One row per post: source_dataset, `_h` (hash of its text), `_day`, and `_words`, those of the
    keywords `k` (search keys, not empty) that its text contains.

    The places of a text are cut in its task to those where some keyword may begin; what stands there
    meets the keywords by equi-join on their first `_LONGEST` characters. That decides on all but longer
    keywords: for those alone the texts are moved. Which lengths and characters are in use is asked of
    the keywords when this is called.
    """
    sizes, characters, longer = _shape(keywords)
    about = posts.select(
        "post_id",
        "source_dataset",
        text_hash(F.coalesce(F.col("text"), F.lit(""))).alias("_h"),
        post_day(F.col("created_at"), strict_days).alias("_day"),
    )
    texts = posts.select("post_id", tx.search_key(F.col("text")).alias("_key"))
    wanted = keywords.select("k", F.substring("k", 1, _LONGEST).alias("gram"))
    held = _grams(texts, keywords, sizes, characters).join(wanted, "gram").select(F.col("post_id").alias("_id"), "k")
    if longer:
        inside = (F.col("post_id") == F.col("_id")) & F.contains("_key", F.col("k"))
        unsure = held.filter(F.length("k") > _LONGEST).distinct()
        sure = texts.join(unsure, inside).select("_id", "k")
        held = held.filter(F.length("k") <= _LONGEST).unionByName(sure)
    # As many words as the text has places for: every one listed occurs in it.
    return about.join(held.distinct(), F.col("post_id") == F.col("_id"), "left").groupBy("post_id").agg(
        *[F.first(c).alias(c) for c in ("source_dataset", "_h", "_day")],
        F.sort_array(F.collect_set("k")).alias("_words"),
    )


def wanted_keywords(usable: DataFrame) -> DataFrame:
    """One row per request and keyword; a request that matches any text has the empty keyword."""
    words = F.when(F.col("any_text"), F.array(F.lit(""))).otherwise(F.col("kws"))
    return usable.select("request_id", "scope", "from_day", "to_day", "datasets", F.explode(words).alias("k"))


def _digest(*parts) -> Column:
    """128 bits that tell values apart."""
    return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32))


def same_requests(prepared: DataFrame) -> DataFrame:
    """(request_id, twin): of requests that ask for the same, the smallest stands for all."""
    asked = _digest(F.sort_array("kws").alias("k"), "any_text", "from_day", "to_day", "bad_dates", "datasets")
    known = prepared.select("request_id", asked.alias("asked"))
    first = known.groupBy("asked").agg(F.min("request_id").alias("twin"))
    return known.join(first, "asked").select("request_id", "twin")


def standing(prepared: DataFrame, twins: DataFrame) -> DataFrame:
    """The requests that stand for others, or for themselves alone."""
    return prepared.join(twins.filter("request_id = twin").select("request_id"), "request_id")


def match_requests(posts: DataFrame, prepared: DataFrame, strict_days=False) -> DataFrame:
    """What decides on the posts: post_id, `_h`, `_day`, `_words`, source_dataset and `_class`.

    Posts with the same words and dataset are of one class, which every request matches or not. Posts
    without any requested word are left out, unless some request matches any text.
    """
    wanted = wanted_keywords(prepared.filter(~F.col("bad_dates")))
    keywords = wanted.filter("k <> ''").select("k").distinct()
    every = wanted.agg(F.coalesce(F.bool_or(F.col("k") == ""), F.lit(False))).scalar()
    any_text = F.when(every, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    found = post_words(posts, keywords, strict_days).withColumn("_words", F.concat(any_text, "_words"))
    found = found.filter(F.size("_words") > 0)
    return found.withColumn("_class", _digest(F.col("_words"), F.col("source_dataset")))


def class_requests(matched: DataFrame, prepared: DataFrame) -> DataFrame:
    """(_class, request_id, scope, from_day, to_day): the requests whose keywords and datasets a
    class matches."""
    wanted = wanted_keywords(prepared.filter(~F.col("bad_dates")))
    classes = matched.select("_class", "_words", "source_dataset").distinct()
    held = classes.select("_class", "source_dataset", F.explode("_words").alias("k")).join(wanted, "k")
    named = F.col("datasets").isNull() | F.array_contains("datasets", F.col("source_dataset"))
    return held.filter(named).select("_class", "request_id", "scope", "from_day", "to_day").distinct()


def survivors_per_scope(matched: DataFrame, wanting: DataFrame) -> DataFrame:
    """(post_id, _scopes): the scopes in which a post is the first copy of its text (hash `_h`).

    Scopes are the distinct sets of datasets that requests name (usually one), so the pairs that
    are grouped are far fewer than (request, post) pairs.
    """
    scopes = wanting.select("_class", "scope").distinct()
    return (
        matched.select("_h", "post_id", "_class")
        .join(scopes, "_class")
        .groupBy("scope", "_h")
        .agg(F.min("post_id").alias("post_id"))
        .groupBy("post_id")
        .agg(F.sort_array(F.collect_set("scope")).alias("_scopes"))
    )


def select_posts(
    posts: DataFrame,
    prepared: DataFrame,
    deduplicate=True,
    strict_days=False,
    staged: Callable[[DataFrame], DataFrame] | None = None,
) -> Selection:
    """The posts that any request selects, folded by the set of requests that do.

    Order of steps: keywords, then dedup, then dates (the surviving copy decides). What requests
    select is decided per class of posts (words, dataset, scopes and day), not per post, and without
    the posts themselves: these are read once more at the end. `staged` writes what is read several
    times: requests that stand for others, posts with their words, requests per class, sets per class, the
    set of each post.
    """
    keep = staged or (lambda df: df)
    twins = keep(same_requests(prepared))
    prepared = keep(standing(prepared, twins))
    found = keep(match_requests(posts, prepared, strict_days))
    wanting = keep(class_requests(found, prepared))
    in_scope = F.lit(True)
    if deduplicate:
        found = found.join(survivors_per_scope(found, wanting), "post_id")
        in_scope = F.array_contains("_scopes", F.col("scope"))
    else:
        found = found.withColumn("_scopes", F.array().cast("array<string>"))
    kind = _digest("_class", "_scopes", F.col("_day").cast("string"))
    found = found.withColumn("_kind", kind)
    kinds = found.select("_kind", "_class", "_scopes", "_day").distinct()
    chosen = kinds.join(wanting, "_class").filter(in_scope & in_range(F.col("_day"), F.col("from_day"), F.col("to_day")))
    chosen = keep(chosen.select("_kind", "request_id").distinct())
    # A set is known by its size and 128 bits of its members' hashes.
    marks = (F.xxhash64("request_id"), F.xxhash64(F.lit(1), "request_id"))
    mark = F.concat_ws("-", F.count("*"), *[F.bit_xor(m) for m in marks])
    ids = chosen.groupBy("_kind").agg(mark.alias("set_id"))
    sets = chosen.join(ids, "_kind").select("set_id", "request_id").distinct()
    kept = keep(found.join(ids, "_kind").select("post_id", "set_id"))
    return Selection(posts.join(kept, "post_id"), keep(sets), twins)
