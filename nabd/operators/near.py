"""Near-duplicate removal: greedy first-wins over TF-IDF cosine similarity.

A post is removed when an earlier kept post is at least `threshold` similar. The answer is exact:

* a term that only one text holds adds to no cosine. Where such terms carry more than 1 - threshold^2
  of a post's squared length, the post is similar to nothing and kept at once: terms are counted, a
  post's squared length is summed where its terms meet their counts, and only the posts that are left
  get a vector, of the terms they share. Terms are known by 96 bits of a hash, and never moved;
* posts with equal vectors are one row from the start (the first one stands for all);
* two vectors can only be similar when they share a term of their prefix, the few rarest terms
  that carry more than 1 - threshold^2 of the squared length (published prefix filtering);
* a fixed number of rounds thins dense groups without pairing them with themselves: open posts are
  compared with the first `width` undecided posts of each shared term. A post that is among those
  first ones for all its terms has met every earlier candidate and is decided; a post similar to an
  undecided earlier one waits for it and sends nothing;
* what is undecided then is similar to no kept post, as chains of drifting texts are. Its similar
  pairs are found once; a connected part with few of them is decided by one pass in post order, a
  larger one by rounds that keep every post without an undecided earlier neighbour.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd.functions import text as tx
from nabd.functions.unicode import with_search_text
from nabd.functions.values import let, with_computed
from nabd.operators.dedup import text_hash
from nabd.operators.graph import component_labels
from nabd.operators.grouping import MAX_BROADCAST_ROWS, attach, bounded, global_rank, top_k
from nabd.plans.staging import release, stage

#: Similar pairs of one connected part that one task may walk; larger parts are decided by joins.
WALKED_PAIRS = 1 << 20
_ROUNDS_A_PART = 8
_FIRST_WIDTH = 16
_GROWTH = 4
_ROUNDS = 3
_GRID = 64
_MARGIN = 1e-9
_DIGITS = 12
#: Texts whose terms are counted together in Python.
_TEXTS_AT_ONCE = 128


def _terms() -> Column:
    return tx.one_and_two_grams(tx.words(F.col("_norm")))


def _near_vocabulary(texts: DataFrame, size: int | None) -> DataFrame:
    """term, t (position, rarest first), idf. `copies` weighs each text by how often it occurs."""
    entries = texts.select("copies", F.inline(tx.term_occurrences(_terms())))
    stats = entries.groupBy("term").agg(
        F.sum(F.when(F.col("last"), F.col("copies"))).alias("df"), F.sum("copies").alias("cf")
    )
    if size is not None:
        stats = top_k(stats, (), [F.desc("cf"), F.asc("term")], size).drop("rank")
    best = attach(stats, texts.agg(F.sum("copies").alias("n")), ())
    ordered = global_rank(best, [F.asc("df"), F.asc("term")], "t")
    return ordered.select("term", "t", _idf(F.col("n"), F.col("df")).alias("idf"))


def _idf(n, df: Column) -> Column:
    return F.ln((F.lit(1) + n) / (F.lit(1) + df)) + F.lit(1.0)


def _entries(texts: DataFrame) -> DataFrame:
    """(post_id, copies, a, b, tf): the distinct terms of texts cut in `words`; a and b are a term's hash.

    A word has 128 bits of BLAKE2b; a pair of words has those of both words, multiplied and added.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            coded = words.flatten().dictionary_encode()
            names = coded.dictionary.cast(pa.binary()).to_pylist()
            digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in names)
            own = np.frombuffer(bytes(16) + digests, np.uint64).reshape(-1, 2)  # the first: no word
            codes, n = coded.indices.to_numpy(), len(names)
            sizes = words.value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for start in range(0, len(sizes), _TEXTS_AT_ONCE):
                few = sizes[start : start + _TEXTS_AT_ONCE]
                code = codes[ends[start] : ends[start + len(few)]].astype(np.int64)
                text = np.repeat(np.arange(len(few)), few)
                inside = text[1:] == text[:-1]
                # Terms are numbers here: a word its code, a pair more than any word.
                pairs = ((code[:-1] + 1) * n + code[1:])[inside]
                width = n * (n + 1)
                keys = np.concatenate([text * width + code, text[1:][inside] * width + pairs])
                keys, tf = np.unique(keys, return_counts=True)
                text, term = np.divmod(keys, max(width, 1))
                before, last = np.divmod(term, max(n, 1))
                a = own[last + 1, 0] + own[before, 0] * np.uint64(0x9E3779B97F4A7C15)
                b = own[last + 1, 1] + own[before, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
                columns = [batch.column(c).take(pa.array(start + text)) for c in ("post_id", "copies")]
                columns += [pa.array(a.view(np.int64)), pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                columns.append(pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["post_id", "copies", "a", "b", "tf"])

    id_type = dict(texts.dtypes)["post_id"]
    schema = f"post_id {id_type}, copies long, a long, b int, tf int"
    return texts.select("post_id", "copies", "words").mapInArrow(cut, schema)


def open_vectors(texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Vectors of the posts that may be similar to another, and post_id of those that have terms.

    Vectors are (post_id, ts, ws) over the terms that two such posts share, scaled by the length over
    all terms, with what tells equal ones: `_s1`, `_s2`, and `_own` where no other can be equal.
    """
    n = texts.agg(F.sum("copies")).first()[0]
    term = ["a", "b"]
    again = not texts.groupBy("post_id").count().filter("count > 1").isEmpty()

    def entries(of: DataFrame) -> DataFrame:
        found = _entries(of)
        if again:  # rows of one post_id are one post
            sums = F.sum("copies").alias("copies"), F.sum("tf").alias("tf")
            found = found.groupBy("post_id", *term).agg(*sums)
        return found

    every = entries(texts)
    shared = every.groupBy(*term).agg(F.sum("copies").alias("df"), F.count("*").alias("posts"))
    shared = stage(shared.filter("posts > 1").drop("posts"), "near_shared")
    weight = F.col("tf") * _idf(n, F.coalesce("df", "copies"))
    squares = every.join(shared, term, "left").select("post_id", "df", (weight * weight).alias("w2"))
    lengths = squares.groupBy("post_id").agg(
        F.sum("w2").alias("all"), F.sum(F.when(F.col("df").isNotNull(), F.col("w2"))).alias("met"),
        F.count("*").alias("terms"),
    )
    lengths = stage(lengths, "near_lengths")
    least = threshold * threshold - _MARGIN
    some = lengths.filter(F.coalesce("met", F.lit(0.0)) >= least * F.col("all"))
    held = entries(texts.join(some.select("post_id"), "post_id", "left_semi")).join(shared, term)
    held = stage(held.select("post_id", *term, "tf", "df"), "near_entries")
    common = held.groupBy(*term, "df").agg(F.count("*").alias("posts")).filter("posts > 1")
    vocab = global_rank(common.drop("posts"), [F.asc("df"), F.asc("a"), F.asc("b")], "t")
    packed = (
        held.join(vocab.select(*term, "t", _idf(n, F.col("df")).alias("idf")), term)
        .groupBy("post_id")
        .agg(F.sort_array(F.collect_list(F.struct("t", "tf", "idf"))).alias("v"))
    )
    ws = let(F.sqrt("all"), lambda m: F.transform("v", lambda x: x["tf"] * x["idf"] / m))
    vectors = packed.join(lengths, "post_id").select(
        "post_id", F.col("v.t").alias("ts"), ws.alias("ws"), F.col("v.tf").alias("_tf"), "terms"
    )
    # An equal vector would share all terms. Lengths are sums in any order, so the counts are compared.
    own = F.when(F.size("ts") < F.col("terms"), F.col("post_id"))
    vectors = vectors.filter(F.aggregate("ws", F.lit(0.0), lambda m, w: m + w * w) >= least).select(
        "post_id", "ts", "ws", own.alias("_own"),
        F.xxhash64("ts", "_tf").alias("_s1"), F.xxhash64(F.lit(1), "_tf", "ts").alias("_s2"),
    )
    vectors = stage(vectors, "near_vectors")
    for table in (shared, held):
        release(table)
    return vectors, lengths.select("post_id")


def near_vectors(texts: DataFrame, size: int | None = None) -> DataFrame:
    """Unit vectors: post_id, ts (term positions ascending), ws. Posts without terms are absent."""
    vocab = _near_vocabulary(texts, size)
    vocab = vocab if size is None else bounded(vocab, (), size)
    counts = (
        texts.select("post_id", F.explode(_terms()).alias("term"))
        .join(vocab, "term")
        .groupBy("post_id", "t", "idf")
        .agg(F.count("*").alias("tf"))
    )
    packed = counts.groupBy("post_id").agg(
        F.sort_array(F.collect_list(F.struct("t", (F.col("tf") * F.col("idf")).alias("w")))).alias("v")
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return packed.withColumn("norm", norm).select(
        "post_id",
        F.col("v.t").alias("ts"),
        let(F.col("norm"), lambda n: F.transform("v", lambda x: x["w"] / n)).alias("ws"),
    )


def _prefix_length(ws: Column, threshold: float) -> Column:
    length = F.aggregate(ws, F.lit(0.0), lambda s, w: s + w * w)
    start = F.struct(length.alias("rest"), F.lit(0).alias("k"))
    bound = threshold * threshold - _MARGIN

    def step(s: Column, w: Column) -> Column:
        more = F.struct((s["rest"] - w * w).alias("rest"), (s["k"] + 1).alias("k"))
        return F.when(s["rest"] >= bound, more).otherwise(s)

    return F.aggregate(ws, start, step)["k"]


def _profiles(vectors: DataFrame, threshold: float, positions: int) -> DataFrame:
    """post_id, k (prefix length), last (position where the prefix ends), and how much squared
    length lies at or before each of `_GRID` evenly spaced positions."""
    step = max(1, -(-positions // _GRID))
    squares = F.zip_with("ts", "ws", lambda t, w: F.struct(t.alias("t"), (w * w).alias("q")))

    # One pass over the terms: the running sum is closed once for every cell that a term passes.
    empty = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("mass"))

    def add(s: Column, x: Column) -> Column:
        passed = F.ceil(x["t"] / step).cast("int") - F.size(s["mass"])
        closed = F.concat(s["mass"], F.array_repeat(s["sum"], F.greatest(passed, F.lit(0))))
        return F.struct((s["sum"] + x["q"]).alias("sum"), closed.alias("mass"))

    def filled(s: Column) -> Column:
        return F.concat(s["mass"], F.array_repeat(s["sum"], F.lit(_GRID + 1) - F.size(s["mass"])))

    grid = F.aggregate("_sq", empty, add, filled)
    return (
        with_computed(vectors, "_sq", squares)
        .withColumn("k", _prefix_length(F.col("ws"), threshold))
        .select(
            "post_id",
            "k",
            F.element_at("ts", F.col("k")).alias("last"),
            F.floor(F.element_at("ts", F.col("k")) / step).cast("int").alias("cell"),
            grid.alias("mass"),
        )
    )


def _candidates(
    heads: DataFrame, followers: DataFrame, profiles: DataFrame, threshold: float
) -> DataFrame:
    """(head, post_id) with head earlier, a common prefix term, and a chance to be similar.

    Up to where the shorter prefix ends, all common terms are known and give the shared part of
    the cosine. What comes later is at most the product of the two remaining lengths.

    The shared part is whole when the head is listed for all its terms (so for every newly kept
    head), or the later post is (every earlier post of a term is then listed too). Those are the
    pairs that decide anything; another pair left out here only spares no waiting.
    """
    met = followers.join(heads.withColumnsRenamed({"post_id": "head", "w": "head_w"}), "t")
    shared = (
        met.filter("head < post_id")
        .groupBy("head", "post_id")
        .agg(F.sum(F.col("w") * F.col("head_w")).alias("shared"))
    )
    own = profiles.select("post_id", "cell", "mass")
    theirs = own.withColumnsRenamed({"post_id": "head", "cell": "head_cell", "mass": "head_mass"})
    cell = F.least("cell", "head_cell")
    later = [F.element_at(m, -1) - F.get(m, cell) for m in ("mass", "head_mass")]
    left = F.greatest(later[0], F.lit(0.0)) * F.greatest(later[1], F.lit(0.0))
    bound = F.col("shared") + F.sqrt(left)
    paired = shared.join(own, "post_id").join(theirs, "head")
    return paired.filter(bound >= threshold - _MARGIN).select("head", "post_id")


def _similar(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs (head, post_id) whose vectors reach the threshold. Only vectors in a pair are taken apart."""
    pairs = stage(pairs, "pairs")

    def entries(end: str, weight: str) -> DataFrame:
        paired = pairs.select(F.col(end).alias("post_id")).distinct()
        apart = F.inline(F.arrays_zip(F.col("ts").alias("t"), F.col("ws").alias(weight)))
        return vectors.join(paired, "post_id", "left_semi").select(F.col("post_id").alias(end), apart)

    own, theirs = entries("post_id", "w"), entries("head", "head_w")
    cosine = F.sum(F.col("w") * F.col("head_w"))  # sums in any order, so compare all but the last digits
    return (
        pairs.join(own, "post_id")
        .join(theirs, ["head", "t"])
        .groupBy("head", "post_id")
        .agg(F.round(cosine, _DIGITS).alias("cosine"))
        .filter(F.col("cosine") >= threshold)
        .select("head", "post_id")
    )


def _walked(dealt: DataFrame) -> DataFrame:
    """post_id of what first-wins removes among `dealt` (component, post_id, head), part by part.

    Pairs arrive by connected part and post. A task holds the ids removed in one part, and no pairs.
    """
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "component")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, removed = None, set()
        for frame in frames:
            out = []
            for component, post, head in zip(frame["component"], frame["post_id"], frame["head"]):
                if component != part:
                    part, removed = component, set()
                if head not in removed and post not in removed:
                    removed.add(post)
                    out.append(post)
            yield pd.DataFrame({"post_id": pd.Series(out, dtype="int64")})

    ordered = dealt.sortWithinPartitions("component", "post_id", "head")
    return ordered.select("component", "post_id", "head").mapInPandas(walk, "post_id long")


def _round(open_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over all parts at once: what it removes, and the pairs that are still open.

    A post without an undecided earlier neighbour is kept, and its neighbours go. A pair is open as
    long as neither of its posts has gone.
    """
    heads = open_pairs.select("head").distinct()
    later = open_pairs.select(F.col("post_id").alias("head")).distinct()
    kept = heads.join(later, "head", "left_anti")
    gone = stage(open_pairs.join(kept, "head", "left_semi").select("post_id").distinct(), "gone")
    left = open_pairs.join(gone, "post_id", "left_anti")
    left = left.join(gone.withColumnRenamed("post_id", "head"), "head", "left_anti")
    return gone, left.select("head", "post_id")


def _resolve(similar: DataFrame, walked_pairs: int) -> DataFrame:
    """post_id of all posts of `similar` (head, post_id) that first-wins removes.

    Connected parts of up to `walked_pairs` pairs are walked, each within a task. Larger ones are
    decided in rounds of joins, which also break them into smaller parts; a part of which nothing but
    one long chain is left takes a round for every two of its posts until it is short enough.
    """
    removed = []
    open_pairs = similar
    while True:
        ends = open_pairs.select(F.explode(F.array("head", "post_id")).alias("id")).distinct()
        pairs = open_pairs.select(F.col("head").alias("a"), F.col("post_id").alias("b"))
        labels = component_labels(ends, pairs).select(F.col("id").alias("post_id"), "component")
        dealt = stage(open_pairs.join(labels, "post_id"), "parts")
        large = dealt.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > walked_pairs)
        large = stage(large.select("component"), "large")
        small = dealt.join(large, "component", "left_anti")
        removed.append(stage(_walked(small), "walked"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, removed)
        open_pairs = dealt.join(large, "component", "left_semi").select("head", "post_id")
        for _ in range(_ROUNDS_A_PART):
            gone, open_pairs = _round(open_pairs)
            open_pairs = stage(open_pairs, "open")
            removed.append(gone)


def first_wins(
    vectors: DataFrame, threshold: float, walked_pairs: int = WALKED_PAIRS
) -> DataFrame:
    """post_id of the vectors kept by the greedy rule. `vectors` holds distinct vectors."""
    return _decided(stage(vectors, "vectors"), threshold, walked_pairs)


def _decided(vectors: DataFrame, threshold: float, walked_pairs: int) -> DataFrame:
    """`first_wins` over a staged table."""
    positions = vectors.agg(F.coalesce(F.max(F.array_max("ts")), F.lit(0))).first()[0]
    profiles = stage(_profiles(vectors, threshold, positions), "profiles")
    weighted = F.arrays_zip(
        F.slice("ts", 1, F.col("k")).alias("t"), F.slice("ws", 1, F.col("k")).alias("w")
    )
    postings = stage(
        vectors.join(profiles.select("post_id", "k"), "post_id").select(
            "post_id", "k", F.inline(weighted)
        ),
        "postings",
    )
    state = profiles.select("post_id", F.lit(None).cast("bigint").alias("waits_for"))
    kept_rounds = []
    width = _FIRST_WIDTH
    for _ in range(_ROUNDS):
        undecided = postings.join(state, "post_id")
        heads = top_k(
            undecided, ["t"], [F.asc("post_id")], width, spread_by="post_id"
        ).select("post_id", "k", "t", "w")
        heads = stage(heads, "heads")
        few_heads = heads.select("post_id", "t", "w")
        if width * positions <= MAX_BROADCAST_ROWS:
            few_heads = F.broadcast(few_heads)
        open_posts = undecided.filter("waits_for IS NULL").select("post_id", "t", "w")
        pairs = _candidates(few_heads, open_posts, profiles, threshold)
        similar = stage(_similar(pairs, vectors, threshold), "similar")

        # Met every earlier candidate, and none of them is similar: kept.
        complete = heads.groupBy("post_id", "k").agg(F.count("*").alias("seen")).filter("seen = k")
        kept = (
            complete.join(state.filter("waits_for IS NULL"), "post_id", "left_semi")
            .join(similar, "post_id", "left_anti")
            .select("post_id")
        )
        kept = stage(kept, "kept")
        kept_rounds.append(kept)

        # Waiting posts have not been compared this round: compare them with the new kept ones.
        waiting = undecided.filter("waits_for IS NOT NULL").select("post_id", "t", "w")
        kept_postings = postings.join(kept, "post_id", "left_semi").select("post_id", "t", "w")
        pairs = _candidates(kept_postings, waiting, profiles, threshold)
        late = _similar(pairs, vectors, threshold)
        new_heads = kept.withColumnRenamed("post_id", "head")
        removed = (
            similar.join(new_heads, "head", "left_semi")
            .unionByName(late)
            .select("post_id")
            .distinct()
        )
        removed = stage(removed, "removed")

        earliest = similar.groupBy("post_id").agg(F.min("head").alias("met"))
        decided = kept.unionByName(removed)
        gone = removed.select(F.col("post_id").alias("waits_for"), F.lit(True).alias("gone"))
        state = (
            state.join(decided, "post_id", "left_anti")
            .join(earliest, "post_id", "left")
            .select("post_id", F.coalesce("waits_for", "met").alias("waits_for"))
            .join(gone, "waits_for", "left")
            .select(
                "post_id", F.when(F.col("gone").isNull(), F.col("waits_for")).alias("waits_for")
            )
        )
        state = stage(state, "state")
        release(heads)
        release(similar)
        if state.isEmpty():
            break
        width *= _GROWTH
    else:  # no post left is similar to a kept one; decide the rest among themselves
        rest = postings.join(state.select("post_id"), "post_id").select("post_id", "t", "w")
        left = stage(_similar(_candidates(rest, rest, profiles, threshold), vectors, threshold), "left")
        kept_rounds.append(state.select("post_id").join(_resolve(left, walked_pairs), "post_id", "left_anti"))
    result = kept_rounds[0]
    for more in kept_rounds[1:]:
        result = result.unionByName(more)
    return result


def dedup_near(
    posts: DataFrame,
    threshold: float = fv.NEAR_THRESHOLD,
    max_features: int | None = None,
    text: Column | None = None,
    walked_pairs: int = WALKED_PAIRS,
) -> DataFrame:
    """Keep each post unless an earlier kept one is near-identical; empty texts are dropped.

    All terms count unless `max_features` keeps only the most frequent ones. Posts without any
    vocabulary term are similar to nothing and are all kept.
    """
    if text is None:
        text = tx.analysis_text() if "cleaned_text" in posts.columns else F.col("text")
    keyed = with_search_text(posts.select("*", text.alias("_text")), F.col("_text"), "_norm")
    keyed = stage(
        keyed.filter("_norm <> ''").select("post_id", "_norm", text_hash(F.col("_norm")).alias("_h")),
        "near_texts",
    )
    groups = keyed.groupBy("_h").agg(F.min("post_id").alias("post_id"), F.count("*").alias("copies"))
    texts = keyed.join(groups.drop("_h"), "post_id")
    if max_features is None:
        texts = texts.select("post_id", "_h", "copies", tx.words(F.col("_norm")).alias("words"))
    texts = stage(texts, "near_distinct")
    if max_features is None:
        vectors, with_terms = open_vectors(texts, threshold)
    else:
        vectors = near_vectors(texts, max_features).withColumn("_own", F.lit(None).cast("long"))
        same = [F.xxhash64("ts", "ws").alias("_s1"), F.xxhash64(F.lit(1), "ws", "ts").alias("_s2")]
        vectors = stage(vectors.select("*", *same), "near_vectors")
        with_terms = vectors.select("post_id")
    first = vectors.groupBy("_own", "_s1", "_s2").agg(F.min("post_id").alias("post_id")).select("post_id")
    distinct = stage(vectors.select("post_id", "ts", "ws").join(first, "post_id", "left_semi"), "vectors")
    # Texts without a term of the vocabulary, each copy, and posts that are similar to nothing.
    without_terms = texts.join(with_terms, "post_id", "left_anti").select("_h")
    unlike_any = keyed.join(without_terms, "_h", "left_semi").select("post_id")
    alone = with_terms.join(vectors, "post_id", "left_anti")
    unlike_any = stage(unlike_any.unionByName(alone), "unlike_any")
    # From here on only distinct vectors are read: texts and all vectors need no room beside the rounds.
    for table in (vectors, with_terms, texts, keyed):
        release(table)
    kept = _decided(distinct, threshold, walked_pairs)
    return posts.join(kept.unionByName(unlike_any), "post_id", "left_semi")
