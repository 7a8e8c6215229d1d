"""Counts, users, reach and rows per dataset."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd.functions.dates import iso_day, post_day
from nabd.operators.grouping import SharedRows, combined, handed_out, row_keys

#: Base-2 logarithm of a user sketch's buckets; its standard error is about 1.04 / sqrt(2^LOG_BUCKETS).
LOG_BUCKETS = 12


def user_sketch() -> tuple[Column, Callable]:
    """A HyperLogLog sketch of the users, and how sketches are merged."""
    return F.hll_sketch_agg("user_id", F.lit(LOG_BUCKETS)), F.hll_union_agg


def overall_stats(posts: DataFrame, keys: Sequence[str] = (), approximate=False) -> DataFrame:
    """total_posts, total_users, total_reach per group.

    Without any user id the number of posts stands in for users; without any followers ten
    times the engagement stands in for reach.
    """
    def total(column: str) -> tuple[Column, Callable]:
        return F.sum(column), F.sum

    sums = {
        "total_posts": (F.count("*"), F.sum),
        "_followers": total("user_followers"),
        **{f"_{c}": total(c) for c in ("likes", "retweets", "replies")},
    }
    if approximate:
        sums["_sketch"] = user_sketch()
        totals = combined(posts, keys, (), sums)
        totals = totals.withColumn("_users", F.hll_sketch_estimate("_sketch"))
    elif isinstance(keys, SharedRows):
        people = handed_out(posts.select(*row_keys(keys), "user_id").distinct(), keys)
        users = people.groupBy(*keys).agg(F.countDistinct("user_id").alias("_users"))
        totals = combined(posts, keys, (), sums).join(users, list(keys))
    else:
        first = [column.alias(name) for name, (column, _) in sums.items()]
        totals = posts.groupBy(*keys).agg(*first, F.countDistinct("user_id").alias("_users"))
    zero = F.lit(0).cast("bigint")
    engagement = sum(
        (F.coalesce(F.col(c), zero) for c in ("_likes", "_retweets", "_replies")), start=zero
    )
    return totals.select(
        *keys,
        "total_posts",
        F.when(F.col("_users") == 0, F.col("total_posts"))
        .otherwise(F.col("_users"))
        .alias("total_users"),
        F.when(F.coalesce(F.col("_followers"), zero) == 0, engagement * 10)
        .otherwise(F.col("_followers"))
        .alias("total_reach"),
    )


def dataset_breakdown(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Posts per source dataset; unnamed sources are left out."""
    named = posts.filter(F.col("source_dataset") != "")
    return combined(named, keys, ["source_dataset"], {"posts": (F.count("*"), F.sum)})


def breakdown_map(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The breakdown as one map per group (as many entries as there are datasets)."""
    counts = dataset_breakdown(posts, keys)
    entries = F.collect_list(F.struct("source_dataset", "posts"))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias("datasets_used"))


def daily_user_sketches(posts: DataFrame, keys: Sequence[str] = (), strict=False) -> DataFrame:
    """A sketch of the users per group and day (`users`), to be kept and merged for any span of days.

    Posts without a readable day are left out.
    """
    dated = posts.withColumn("_day", post_day(F.col("created_at"), strict)).filter("_day is not null")
    daily = combined(dated, keys, ["_day"], {"users": user_sketch()})
    return daily.select(*keys, iso_day(F.col("_day")).alias("day"), "users")


def users_between(sketches: DataFrame, keys: Sequence[str] = (), first=None, last=None) -> DataFrame:
    """Estimated number of distinct users per group from its daily sketches, both days included."""
    inside = sketches
    if first is not None:
        inside = inside.filter(F.col("day") >= first)
    if last is not None:
        inside = inside.filter(F.col("day") <= last)
    merged = inside.groupBy(*keys).agg(F.hll_union_agg("users").alias("_all"))
    return merged.select(*keys, F.coalesce(F.hll_sketch_estimate("_all"), F.lit(0)).alias("users"))
