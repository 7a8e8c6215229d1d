"""Key phrases by TF-IDF over one- and two-word terms, and topics from clusters."""

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nabd.functions import text as tx
from nabd.functions.unicode import with_search_text
from nabd.functions.values import let, round_exact, with_computed
from nabd.operators.density import density_clusters
from nabd.operators.grouping import (
    SharedRows,
    as_list,
    attach,
    bounded,
    combined,
    row_keys,
    top_k,
)
from nabd.plans.staging import stage

SLOTS = 1 << 20  # of one table of counts, whatever the number of groups


def topic_documents(
    posts: DataFrame, text: Column, keep: Sequence[str], normalize_stopwords=False
) -> DataFrame:
    """`keep` columns plus `document`: topic tokens joined by spaces; empty documents dropped."""
    df = with_search_text(posts, text, "_norm")
    tokens = tx.topic_document(F.col("_norm"), normalize_stopwords)
    df = with_computed(df.select(*keep, "_norm"), "document", tokens)
    return df.select(*keep, "document").filter("document <> ''")


def with_words(documents: DataFrame) -> DataFrame:
    """`words` in place of `document`."""
    if "words" in documents.columns:
        return documents
    return with_computed(documents, "words", tx.words(F.col("document"))).drop("document")


def with_terms(documents: DataFrame) -> DataFrame:
    """`terms` in place of `document` or `words`: each distinct term of the document and its count."""
    if "terms" in documents.columns:
        return documents
    words = F.col("words") if "words" in documents.columns else tx.words(F.col("document"))
    return with_computed(documents, "terms", tx.term_counts(tx.one_and_two_grams(words))).drop("document", "words")


def term_statistics(documents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Document frequency and corpus frequency per term.

    Terms are counted within their document, and tasks combine them before the shuffle, so a
    frequent term costs one row per task.
    """
    entries = with_terms(documents).select(*row_keys(keys), F.inline("terms"))
    counts = {"df": (F.count("*"), F.sum), "cf": (F.sum("tf"), F.sum)}
    return combined(entries, keys, ["term"], counts)


def _group_limits(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, _min_df): the documents of a group, and in how many a term has to be.

    That is max(2, n div 100); the terms of a single document need no second one.
    """
    totals = combined(documents, keys, (), {"n": (F.count("*"), F.sum)}).filter("n > 0")
    wanted = F.when(F.col("n") > 1, F.greatest(F.lit(2), F.floor(F.col("n") / 100))).otherwise(F.lit(1))
    return totals.dropna(subset=list(keys) or None).select(*keys, "n", wanted.cast("bigint").alias("_min_df"))


def _lacking(limits: DataFrame, reached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The groups in which no term reached the limit; one document is enough there."""
    if keys:
        lacking = limits.join(reached.select(*keys).distinct(), list(keys), "left_anti")
    else:
        lacking = limits if reached.isEmpty() else limits.limit(0)
    return lacking.filter("_min_df > 1").withColumn("_min_df", F.lit(1).cast("bigint"))


def _enough(documents: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    terms = attach(term_statistics(documents, keys), limits, keys)
    return terms.filter(F.col("df") >= F.col("_min_df")).drop("_min_df")


def _slot(keys: Sequence[str], *words: Column) -> Column:
    return F.pmod(F.xxhash64(*keys, *words), F.lit(SLOTS)).cast("int")


def _step(count: Column) -> Column:
    """A count in 255 logarithmic steps, as two hex digits; a larger count never has a lower step."""
    step = F.least(F.lit(255), F.floor(F.log2(F.greatest(count, F.lit(1))) * 8) + 1)
    return F.lpad(F.hex(F.when(count > 0, step).otherwise(0)), 2, "0")


def _slot_steps(documents: DataFrame, keys: Sequence[str]) -> bytes:
    """For each hash slot of the terms, in steps, how often terms of the slot occur: SLOTS bytes."""
    following = F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))
    pairs = documents.select(*keys, F.inline(F.arrays_zip("words", following)).alias("w", "next"))
    # The last word has none behind it and is counted twice, as a pair of it and a null.
    slots = F.explode(F.array(_slot(keys, F.col("w")), _slot(keys, F.col("w"), F.col("next"))))
    every = documents.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    found = pairs.select(slots.alias("slot")).unionByName(every)
    counts = found.groupBy("slot").agg(_step(F.count("*") - 1).alias("step"))
    part = F.shiftright("slot", 10).alias("part")
    items = F.sort_array(F.collect_list(F.struct("slot", "step")))
    parts = counts.groupBy(part).agg(F.array_join(items["step"], "").alias("steps")).collect()
    return bytes.fromhex("".join(p["steps"] for p in sorted(parts, key=lambda p: p["part"])))


def _likely_terms(documents: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`terms` in place of `words`: those that may be in as many documents as their group asks for.

    A term is in no more documents than its slot has occurrences, so none of a vocabulary is lost;
    the others are neither put together nor counted. Rows that groups share serve the lowest limit.
    """
    if isinstance(keys, SharedRows):
        least = keys.sets.join(limits, list(keys)).groupBy("set_id").agg(F.min("_min_df").alias("_least"))
        slot_keys = ()
    else:
        least = limits.select(*keys, F.col("_min_df").alias("_least"))
        slot_keys = tuple(keys)
    least = stage(least.withColumn("_least", F.unhex(_step(F.col("_least")))), "limits")
    limited = attach(documents, least, row_keys(keys))
    words = F.col("words")

    def frequent(steps: Column) -> Column:
        def often(*term: Column) -> Column:
            return F.substr(steps, _slot(slot_keys, *term) + 1, F.lit(1)) >= F.col("_least")

        ones = F.filter(words, lambda w: often(w))
        starts = F.filter(
            F.sequence(F.lit(0), F.size(words) - 2),
            lambda i: often(F.get(words, i), F.get(words, i + 1)),
        )
        pairs = F.transform(starts, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
        return F.when(F.size(words) > 1, F.concat(ones, pairs)).otherwise(ones)

    found = let(F.lit(_slot_steps(documents, slot_keys)), frequent)
    return with_computed(limited, "terms", tx.term_counts(found)).drop("words", "_least")


def frequent_terms(documents: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents with those of their terms that may belong to a vocabulary, and the terms that do.

    `documents` (document, words or all terms) are read three times. Those of groups without a term
    in enough of them are read once more, for all their terms.
    """
    limits = stage(_group_limits(documents, keys), "limits")
    counted = "terms" in documents.columns
    documents = documents if counted else with_words(documents)
    likely = documents if counted else stage(_likely_terms(documents, limits, keys), "likely-terms")
    enough = stage(_enough(likely, limits, keys), "frequent-terms")
    lacking = stage(_lacking(limits, enough, keys), "limits")
    if lacking.isEmpty():
        return likely, enough
    if counted:
        return likely, enough.unionByName(_enough(likely, lacking, keys))
    if keys:
        named = keys.sets.join(lacking, list(keys)) if isinstance(keys, SharedRows) else lacking
        rows = stage(named.select(*row_keys(keys)).distinct(), "lacking")
        others = likely.join(rows, row_keys(keys), "left_anti")
        documents = documents.join(rows, row_keys(keys), "left_semi")
    else:
        others = likely.limit(0)
    full = stage(with_terms(documents), "all-terms")
    return others.unionByName(full), enough.unionByName(_enough(full, lacking, keys))


def _weighted_terms(enough: DataFrame, keys: Sequence[str], size: int | None) -> DataFrame:
    if size is None:
        best = enough.withColumn("term_id", F.col("term"))
    else:
        best = top_k(
            enough, keys, [F.desc("cf"), F.asc("term")], size, rank="term_id", spread_by="term"
        )
    idf = F.ln((F.lit(1) + F.col("n")) / (F.lit(1) + F.col("df"))) + F.lit(1.0)
    return best.select(*keys, "term", "term_id", "df", "cf", "n", idf.alias("idf"))


def vocabulary(
    documents: DataFrame, keys: Sequence[str] = (), size: int | None = None
) -> DataFrame:
    """The terms in enough documents; with `size` only so many, by corpus frequency.

    A term needs max(2, n div 100) documents. When no term has that many, one is enough.
    """
    return _weighted_terms(frequent_terms(documents, keys)[1], keys, size)


def term_weights(
    documents: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str] = (),
    size: int | None = None,
) -> DataFrame:
    """Unit-length TF-IDF weights per (post_id, term_id).

    Only the vocabulary's terms, counted per document, are shuffled, once and by document; a document
    is then one row and is scaled there. A vocabulary cut to `size` may be broadcast, and its terms
    travel as numbers. Documents that groups share are handed out here, after their terms are counted.
    """
    entries = with_terms(documents).select(*row_keys(keys), "post_id", F.inline("terms"))
    ids = vocab.select(*keys, "term", "term_id", "idf")
    if isinstance(keys, SharedRows):
        ids = keys.sets.join(ids, list(keys))
    elif size is not None:
        ids = bounded(ids, keys, size)
    weight = (F.col("tf") * F.col("idf")).alias("w")
    found = entries.join(ids, [*row_keys(keys), "term"]).select(*keys, "post_id", F.struct("term_id", weight).alias("t"))
    whole = found.groupBy(*keys, "post_id").agg(F.collect_list("t").alias("_t"))
    squares = F.aggregate("_t", F.lit(0.0), lambda sum_, t: sum_ + t["w"] * t["w"])
    scaled = whole.withColumn("_norm", F.sqrt(squares)).select(*keys, "post_id", "_norm", F.explode("_t").alias("t"))
    return scaled.select(*keys, "post_id", "t.term_id", (F.col("t.w") / F.col("_norm")).alias("weight"))


def phrase_scores(
    documents: DataFrame, keys: Sequence[str] = (), size: int | None = None
) -> DataFrame:
    """Score of every vocabulary term: its summed weight over all documents."""
    likely, terms = frequent_terms(documents, keys)
    vocab = stage(_weighted_terms(terms, keys, size), "vocabulary")
    weights = term_weights(likely, vocab, keys, size)
    scores = weights.groupBy(*keys, "term_id").agg(F.sum("weight").alias("score"))
    return scores.join(vocab.select(*keys, "term_id", "term"), [*keys, "term_id"])


def _prune_overlaps(ranked_terms: Column, n_topics: int) -> Column:
    """Walk terms by score; skip one that contains a chosen term or is contained in one."""

    def step(chosen: Column, item: Column) -> Column:
        clash = F.exists(
            chosen,
            lambda c: F.contains(c["term"], item["term"]) | F.contains(item["term"], c["term"]),
        )
        return F.when(clash | (F.size(chosen) >= n_topics), chosen).otherwise(
            F.concat(chosen, F.array(item))
        )

    empty = F.array().cast("array<struct<term:string,score:double>>")
    return F.aggregate(ranked_terms, empty, step)


def top_phrases(scores: DataFrame, keys: Sequence[str] = (), n_topics: int = 8) -> DataFrame:
    """At most `n_topics` non-overlapping phrases per group: rank, label, weight 0-100."""
    # Sums arrive in any order, so scores that are equal on paper differ in the last bits.
    steady = scores.withColumn("score", F.round("score", 9))
    best = top_k(steady, keys, [F.desc("score"), F.asc("term")], 3 * n_topics)
    listed = as_list(best, keys, F.struct("term", "score"), "rank", "_terms")
    chosen = listed.select(*keys, _prune_overlaps(F.col("_terms"), n_topics).alias("_terms"))
    largest = F.element_at("_terms", 1)["score"]
    exploded = chosen.filter(F.size("_terms") > 0).select(
        *keys,
        F.when(largest == 0, F.lit(1.0)).otherwise(largest).alias("_largest"),
        F.posexplode("_terms").alias("_pos", "_t"),
    )
    return exploded.select(
        *keys,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_t.term").alias("label"),
        round_exact(F.lit(100.0) * F.col("_t.score") / F.col("_largest"), 0)
        .cast("int")
        .alias("weight"),
    )


def extract_topics(
    posts: DataFrame,
    keys: Sequence[str] = (),
    n_topics: int = 8,
    method: str = "tfidf",
    text: Column | None = None,
    normalize_stopwords=False,
    embedding: str = "embedding",
    vocabulary_size: int | None = None,
    **density,
) -> DataFrame:
    """Topics per group by `method`: "tfidf" phrases, or clusters of an embedding column: "cluster"
    (k-means, over all posts) or "density" (outliers belong to no topic, any `keys`)."""
    text = F.col("cleaned_text") if text is None else text
    if method == "cluster":
        if keys:
            raise ValueError("clusters are found over all posts; filter the posts of a group instead")
        return cluster_topics(posts, n_topics, text, embedding, normalize_stopwords)
    if method == "density":
        return density_topics(posts, keys, n_topics, text, embedding, normalize_stopwords, **density)
    if method != "tfidf":
        raise ValueError(f"unknown topic method: {method}")
    documents = topic_documents(posts, text, [*keys, "post_id"], normalize_stopwords)
    documents = stage(with_words(documents), "documents")  # read three times
    return top_phrases(phrase_scores(documents, keys, vocabulary_size), keys, n_topics)


def class_terms(clustered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Class-based TF-IDF: how typical each term is of its cluster, within its group."""
    counts = (
        clustered.select(*keys, "cluster", F.explode(tx.words(F.col("document"))).alias("term"))
        .groupBy(*keys, "cluster", "term")
        .agg(F.count("*").alias("tf"))
    )
    counts = stage(counts, "class-counts")  # read four times, and the texts once
    per_term = counts.groupBy(*keys, "term").agg(F.sum("tf").alias("_f"))
    sizes = counts.groupBy(*keys, "cluster").agg(F.sum("tf").alias("_words"))
    average = sizes.groupBy(*keys).agg(F.avg("_words").alias("_average"))
    known = counts.join(per_term, [*keys, "term"]).join(sizes, [*keys, "cluster"])
    weighted = attach(known, average, keys)
    weight = F.col("tf") / F.col("_words") * F.ln(1 + F.col("_average") / F.col("_f"))
    return weighted.select(*keys, "cluster", "term", weight.alias("weight"))


def density_topics(
    posts: DataFrame,
    keys: Sequence[str],
    n_topics: int,
    text: Column,
    embedding: str = "embedding",
    normalize_stopwords=False,
    **density,
) -> DataFrame:
    """The largest density clusters per group, labelled by their two most typical words.

    Outliers, and posts without a vector, belong to no topic. A cluster without words is labelled "".
    """
    rows = posts.select(*keys, "post_id", text.alias("_text"), F.col(embedding).alias("_e"))
    rows = stage(rows, "vectors")  # read twice
    found = density_clusters(rows.drop("_text"), keys, vector="_e", **density)
    clustered = stage(found.join(rows.drop("_e"), [*keys, "post_id"]), "clusters")
    documents = topic_documents(clustered, F.col("_text"), [*keys, "cluster"], normalize_stopwords)
    weights = class_terms(documents, keys).withColumn("weight", F.round("weight", 9))
    group = [*keys, "cluster"]
    typical = top_k(weights, group, [F.desc("weight"), F.asc("term")], 2)
    labels = as_list(typical, group, F.col("term"), "rank", "_words")
    sizes = clustered.groupBy(*group).agg(F.count("*").alias("posts"))
    label = F.coalesce(F.array_join("_words", " "), F.lit(""))
    named = sizes.join(labels, group, "left").select(*group, label.alias("label"), "posts")
    best = top_k(named, keys, [F.desc("posts"), F.asc("label"), F.asc("cluster")], n_topics)
    largest = best.groupBy(*keys).agg(F.max("posts").alias("_largest"))
    weight = round_exact(F.lit(100.0) * F.col("posts") / F.col("_largest"), 0).cast("int")
    return attach(best, largest, keys).select(*keys, "rank", "label", weight.alias("weight"))


def cluster_topics(
    posts: DataFrame,
    n_topics: int,
    text: Column,
    embedding: str = "embedding",
    normalize_stopwords=False,
    seed: int = 1,
) -> DataFrame:
    """Topics from clusters of an embedding column, whatever the number of posts.

    A post without a vector joins the cluster whose typical words its words weigh most for; with no
    such word it belongs to no topic. Each cluster is labelled by its two most typical words, and
    weighted by its size.
    """
    vector = F.col(embedding).cast("array<double>")
    rows = stage(posts.select("post_id", text.alias("_text"), vector.alias("_e")), "vectors")
    vectors = rows.filter("_e IS NOT NULL").withColumn("_v", array_to_vector("_e"))
    model = KMeans(k=n_topics, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors)
    assigned = stage(model.transform(vectors).select("cluster", "_text"), "clusters")
    documents = topic_documents(assigned, F.col("_text"), ["cluster"], normalize_stopwords)
    weights = stage(class_terms(documents), "class-terms")
    others = topic_documents(
        rows.filter("_e IS NULL"), F.col("_text"), ["post_id"], normalize_stopwords
    )
    words = F.explode(F.array_distinct(tx.words(F.col("document")))).alias("term")
    votes = (
        others.select("post_id", words)
        .join(weights, "term")
        .groupBy("post_id", "cluster")
        .agg(F.round(F.sum("weight"), 9).alias("vote"))
    )
    joined = votes.groupBy("post_id").agg(
        F.max_by("cluster", F.struct("vote", -F.col("cluster"))).alias("cluster")
    )
    members = assigned.select("cluster").unionByName(joined.select("cluster"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("posts"))
    typical = top_k(weights, ["cluster"], [F.desc("weight"), F.asc("term")], 2)
    labels = as_list(typical, ["cluster"], F.col("term"), "rank", "_words")
    named = sizes.join(labels, "cluster").select(
        F.array_join("_words", " ").alias("label"), "posts"
    )
    best = top_k(named, (), [F.desc("posts"), F.asc("label")], n_topics)
    largest = best.agg(F.max("posts").alias("_largest"))
    return attach(best, largest, ()).select(
        "rank",
        "label",
        round_exact(F.lit(100.0) * F.col("posts") / F.col("_largest"), 0).cast("int").alias("weight"),
    )
