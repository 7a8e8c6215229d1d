"""The whole analysis: any number of requests over one set of posts, one result row each."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd import schema
from nabd.functions import text as tx
from nabd.functions.unicode import with_search_text
from nabd.operators import report
from nabd.operators.clean import clean_posts, valid_posts
from nabd.operators.grouping import SharedRows, as_list
from nabd.operators.influence import detect_influencers
from nabd.operators.match import Selection, prepare_requests, select_posts
from nabd.operators.network import interaction_network
from nabd.operators.sentiment import (
    CLASSES,
    sentiment_shares,
    sentiment_timeline,
    with_lexicon_sentiment,
)
from nabd.operators.stats import breakdown_map, overall_stats
from nabd.operators.topics import phrase_scores, top_phrases, with_terms, with_words
from nabd.plans.staging import stage

KEY = "request_id"


def enriched_posts(
    posts: DataFrame, prepared: DataFrame, deduplicate=True, score=with_lexicon_sentiment, tokens=with_terms
) -> Selection:
    """Selected, cleaned, valid and scored posts, each once, with the set of requests that share it.

    Work that depends on the post alone (cleaning, sentiment, tokens, term counts) happens here,
    however many requests share the post. `tokens` says what stands for a post's document: its counted
    terms, or `with_words` for topics, which count only those that can matter.
    """
    selected = select_posts(posts, prepared, deduplicate, staged=stage)
    scored = score(valid_posts(clean_posts(selected.posts)))
    normalized = with_search_text(scored, F.col("cleaned_text"), "_norm")
    enriched = normalized.select(
        "post_id",
        "set_id",
        "created_at",
        "user_id",
        "user_handle",
        "user_followers",
        "likes",
        "retweets",
        "replies",
        "source_dataset",
        "mentions",
        "sentiment",
        "score",
        tx.topic_document(F.col("_norm")).alias("document"),
    )
    return Selection(stage(tokens(enriched), "posts"), selected.sets, selected.twins)


def request_twins(sets: DataFrame) -> DataFrame:
    """(request_id, twin): of requests that share the same sets, the smallest stands for all."""
    marks = (F.xxhash64("set_id"), F.xxhash64(F.lit(1), "set_id"))
    same = sets.groupBy(KEY).agg(F.count("*").alias("n"), *[F.bit_xor(m).alias(f"m{i}") for i, m in enumerate(marks)])
    twins = same.groupBy("n", "m0", "m1").agg(F.min(KEY).alias("twin"))
    return same.join(twins, ["n", "m0", "m1"]).select(KEY, "twin")


def collection_state(posts: DataFrame, prepared: DataFrame, selected: DataFrame) -> DataFrame:
    """For requests that are not among `selected`: did their datasets have rows, and valid ones?

    The posts are read again only when there are such requests: per named dataset, and for
    requests over everything just until one row, and one valid row, is found in each task.
    """
    usable = prepared.filter(~F.col("bad_dates"))
    empty = usable.join(selected, KEY, "left_anti")
    kinds = empty.agg(
        F.count_if(F.col("datasets").isNull()).alias("whole"),
        F.count_if(F.col("datasets").isNotNull()).alias("listed"),
    ).first()
    valid = tx.is_valid_text(tx.analysis_text())
    parts = [empty.filter("false").select(KEY, *_state(F.lit(None), F.lit(None)))]
    if kinds["whole"]:
        any_row = posts.limit(1).agg((F.count("*") > 0).alias("v"))
        any_valid = clean_posts(posts.select("text")).filter(valid).limit(1)
        any_valid = any_valid.agg((F.count("*") > 0).alias("v"))
        whole = empty.filter(F.col("datasets").isNull()).withColumns(
            {"_r": any_row.scalar(), "_v": any_valid.scalar()}
        )
        parts.append(whole.select(KEY, *_state(F.col("_r"), F.col("_v"))))
    if kinds["listed"]:
        listed = empty.select(KEY, F.explode("datasets").alias("source_dataset"))
        named = posts.select("text", "source_dataset").join(
            listed.select("source_dataset").distinct(), "source_dataset", "left_semi"
        )
        per_dataset = clean_posts(named).groupBy("source_dataset").agg(F.bool_or(valid).alias("_ok"))
        some = listed.join(per_dataset, "source_dataset", "left").groupBy(KEY).agg(
            F.bool_or(F.col("_ok").isNotNull()).alias("_r"), F.bool_or("_ok").alias("_v")
        )
        parts.append(some.select(KEY, *_state(F.col("_r"), F.col("_v"))))
    return reduce(DataFrame.unionByName, parts)


def _state(has_rows: Column, has_valid: Column) -> list[Column]:
    return [
        F.coalesce(has_rows.cast("boolean"), F.lit(False)).alias("_has_rows"),
        F.coalesce(has_valid.cast("boolean"), F.lit(False)).alias("_has_valid"),
    ]


def _status(min_posts: int) -> tuple[Column, Column]:
    too_few = F.col("total_posts") < min_posts
    message = (
        F.when(F.col("bad_dates"), fv.ERROR_PREFIX + "date_from / date_to")
        .when(~F.coalesce("_has_rows", F.lit(True)), fv.ERROR_NO_ROWS)
        .when(~F.coalesce("_has_valid", F.lit(True)), fv.ERROR_NO_VALID_ROWS)
        .when(
            too_few,
            report._fill(
                fv.ERROR_TOO_FEW,
                posts=F.col("total_posts").cast("string"),
                minimum=F.lit(str(min_posts)),
            ),
        )
    )
    return F.when(message.isNull(), "completed").otherwise("failed"), message


def analyze(
    posts: DataFrame,
    requests: DataFrame,
    *,
    default_dataset_ids: Sequence[str] | None = None,
    deduplicate=True,
    min_posts: int = fv.MIN_POSTS,
    n_topics: int = 8,
    top_n: int = 10,
    max_nodes: int = 50,
    max_edges: int = 200,
    vocabulary_size: int | None = None,
    score=with_lexicon_sentiment,
) -> DataFrame:
    """One result row per request: counts, shares, lists, summary, advice, status.

    Requests below `min_posts` keep their numbers but are marked failed, with the reason;
    `completed_results` gives the rows to publish.
    """
    prepared = stage(prepare_requests(requests, default_dataset_ids), "requests")
    enriched = enriched_posts(posts, prepared, deduplicate, score, with_words)
    matched = enriched.posts
    known = enriched.sets.join(matched.select("set_id").distinct(), "set_id", "left_semi")
    shared = stage(request_twins(known), "twins")
    alone = shared.filter(F.col(KEY) == F.col("twin")).select(KEY)
    asked = enriched.twins.withColumnRenamed("twin", "_asked")
    twins = asked.join(shared.withColumnRenamed(KEY, "_asked"), "_asked").drop("_asked")
    keys = SharedRows((KEY,), prepared.count(), stage(known.join(alone, KEY).select("set_id", KEY), "sets"))

    stats = overall_stats(matched, keys)
    documents = matched.filter(F.size("words") > 0).select("set_id", "post_id", "words")
    topics = top_phrases(phrase_scores(documents, keys, vocabulary_size), keys, n_topics)
    influencers = detect_influencers(matched, keys, top_n)
    nodes, edges = interaction_network(matched, keys, max_nodes, max_edges)
    timeline = sentiment_timeline(matched, keys)

    person = F.struct("handle", "followers", "influence", "total_posts", "avg_engagement")
    lists = {
        "top_topics": (as_list(topics, keys, F.struct("label", "weight"), "rank", "v"), schema.TOPICS),
        "top_influencers": (as_list(influencers, keys, person, "rank", "v"), schema.INFLUENCERS),
        "sentiment_timeline": (
            as_list(timeline, keys, F.struct("day", *CLASSES), "day", "v"),
            schema.TIMELINE,
        ),
        "network_nodes": (
            as_list(nodes, keys, F.struct("id", "handle", "size", "group"), "rank", "v"),
            schema.NODES,
        ),
        "network_edges": (
            as_list(edges, keys, F.struct("source", "target", "weight"), "rank", "v"),
            schema.EDGES,
        ),
    }
    result = prepared.select("request_id", "bad_dates")
    if "keywords" in requests.columns:
        given = requests.select("request_id", "keywords")
        result = result.join(given, "request_id")
    else:
        result = result.withColumn("keywords", F.array().cast("array<string>"))
    result = result.join(twins, KEY, "left")

    def with_part(result: DataFrame, part: DataFrame) -> DataFrame:
        return result.join(part.withColumnRenamed(KEY, "twin"), "twin", "left")

    result = with_part(with_part(result, stats), sentiment_shares(matched, keys))
    for name, (frame, kind) in lists.items():
        listed = F.coalesce(F.col(name).cast(kind), F.array().cast(kind))
        result = with_part(result, frame.withColumnRenamed("v", name)).withColumn(name, listed)
    result = with_part(result, breakdown_map(matched, keys))
    result = result.join(collection_state(posts, prepared, twins.select(KEY)), KEY, "left")
    zero = F.lit(0).cast("bigint")
    result = result.withColumns(
        {
            **{c: F.coalesce(c, zero) for c in ("total_posts", "total_users", "total_reach")},
            **{f"sentiment_{c}": F.coalesce(f"sentiment_{c}", F.lit(0.0)) for c in CLASSES},
            "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
            "datasets_used": F.coalesce(
                "datasets_used", F.create_map().cast("map<string,bigint>")
            ),
        }
    )
    status, message = _status(min_posts)
    return result.select(
        "request_id",
        status.alias("status"),
        message.alias("error_message"),
        "total_posts",
        "total_users",
        "total_reach",
        *[f"sentiment_{c}" for c in CLASSES],
        *lists,
        report.summary().alias("summary"),
        report.recommendations().alias("recommendations"),
        "datasets_used",
    )


def completed_results(results: DataFrame) -> DataFrame:
    """The rows and columns to publish."""
    return results.filter("status = 'completed'").drop("status", "error_message", "datasets_used")
