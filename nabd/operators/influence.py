"""Influencer ranking."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd.functions.text import handle_display, handle_key
from nabd.functions.values import first_present, present, round_exact
from nabd.operators.grouping import SharedRows, attach, combined, row_keys, top_k


def mention_counts(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many posts mention each handle (`posts.mentions` holds each handle once per post)."""
    named = posts.select(*row_keys(keys), F.explode("mentions").alias("handle"))
    return combined(named, keys, ["handle"], {"mentions": (F.count("*"), F.sum)})


def user_stats(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Posts, engagement, followers and last handle per user (user_id, else user_handle).

    Grouping by (user, handle) first keeps the string out of the aggregation buffer, so the pass
    over the posts is a hash aggregation; the second one sees a row or two per user.
    """
    uid = first_present(F.col("user_id"), F.col("user_handle"))
    zero = F.lit(0).cast("bigint")
    authored = posts.select(
        *row_keys(keys),
        uid.alias("uid"),
        F.coalesce(present(F.col("user_handle")), uid).alias("handle"),
        "post_id",
        "user_followers",
        "likes",
        "retweets",
        "replies",
    ).filter(F.col("uid").isNotNull())
    by_handle = combined(
        authored,
        keys,
        ["uid", "handle"],
        {
            "posts": (F.count("*"), F.sum),
            **{c: (F.sum(c), F.sum) for c in ("likes", "retweets", "replies")},
            "followers": (F.max("user_followers"), F.max),
            "_last": (F.max("post_id"), F.max),
        },
    )
    return by_handle.groupBy(*keys, "uid").agg(
        F.max_by("handle", "_last").alias("handle"),
        F.greatest(zero, F.coalesce(F.max("followers"), zero)).alias("followers"),
        F.sum("posts").alias("posts"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("likes", "retweets", "replies")],
    )


def group_flags(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """has_users and has_followers per group."""
    known = first_present(F.col("user_id"), F.col("user_handle")).isNotNull()
    flags = {
        "has_users": (F.coalesce(F.bool_or(known), F.lit(False)), F.bool_or),
        "has_followers": (F.coalesce(F.bool_or(F.col("user_followers") > 0), F.lit(False)), F.bool_or),
    }
    return combined(posts, keys, (), flags)


def _at_least_one(column) -> Column:
    return F.greatest(F.coalesce(F.max(column), F.lit(0)), F.lit(1)).cast("bigint")


def scored_users(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Influence score of every user."""
    mentions = mention_counts(posts, keys).withColumnsRenamed(
        {"handle": "_handle_key", "mentions": "mentions_in"}
    )
    users = (
        user_stats(posts, keys)
        .withColumn("_handle_key", handle_key(F.col("handle")))
        .join(mentions, [*keys, "_handle_key"], "left")
        .withColumn("mentions_in", F.coalesce("mentions_in", F.lit(0).cast("bigint")))
    )
    largest = users.groupBy(*keys).agg(
        _at_least_one("followers").alias("_max_followers"),
        _at_least_one("posts").alias("_max_posts"),
        _at_least_one("mentions_in").alias("_max_mentions"),
        F.coalesce(F.bool_or(F.col("followers") > 0), F.lit(False)).alias("_any_followers"),
    )
    # A post with followers but no author also switches the formula, hence the flags of all posts.
    flags = group_flags(posts, keys).select(*keys, "has_followers")
    users = attach(attach(users, largest, keys), flags, keys)

    rate = (F.col("likes") + F.col("retweets") + F.col("replies")) / F.greatest(
        F.col("followers"), F.lit(1)
    )
    f = F.col("followers") / F.col("_max_followers")
    e = F.least(rate, F.lit(1.0))
    p = F.col("posts") / F.col("_max_posts")
    m = F.col("mentions_in") / F.col("_max_mentions")
    with_followers = F.lit(0.35) * f + F.lit(0.40) * e + F.lit(0.15) * p + F.lit(0.10) * m
    without = F.lit(0.50) * p + F.lit(0.30) * e + F.lit(0.20) * m
    influence = F.when(F.col("has_followers"), with_followers).otherwise(without)
    return users.select(
        *keys,
        F.col("uid"),
        handle_display(F.col("handle")).alias("handle"),
        F.col("followers"),
        round_exact(F.least(F.lit(1.0), influence), 3).alias("influence"),
        F.col("posts").alias("total_posts"),
        round_exact(rate, 2).alias("avg_engagement"),
    )


def mentioned_authors(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Stand-in ranking for groups without any author: the handles their posts mention."""
    flags = group_flags(posts, keys).select(*keys, "has_users")
    if isinstance(keys, SharedRows):
        nobody = flags.filter(~F.col("has_users"))
        counts = mention_counts(posts, keys).join(nobody.select(*keys), list(keys), "left_semi")
    elif keys:
        # Usually no group qualifies: adaptive execution then drops this whole branch.
        anonymous = posts.join(flags.filter(~F.col("has_users")), list(keys), "left_semi")
        counts = mention_counts(anonymous, keys)
    else:
        counts = mention_counts(attach(posts, flags, keys).filter(~F.col("has_users")), keys)
    largest = counts.groupBy(*keys).agg(_at_least_one("mentions").alias("_max"))
    return attach(counts, largest, keys).select(
        *keys,
        F.col("handle").alias("uid"),
        F.concat(F.lit("@"), "handle").alias("handle"),
        F.lit(0).cast("bigint").alias("followers"),
        round_exact(F.col("mentions") / F.col("_max"), 3).alias("influence"),
        F.col("mentions").alias("total_posts"),
        F.lit(0.0).alias("avg_engagement"),
    )


def detect_influencers(posts: DataFrame, keys: Sequence[str] = (), top_n: int = 10) -> DataFrame:
    """Top users by influence per group, with their rank. Ties go to the smaller user key."""
    users = top_k(
        scored_users(posts, keys), keys, [F.desc("influence"), F.asc("uid")], top_n
    )
    # Mentions rank by count, not by the rounded score.
    mentioned = top_k(
        mentioned_authors(posts, keys), keys, [F.desc("total_posts"), F.asc("uid")], top_n
    )
    return users.unionByName(mentioned).drop("uid")
