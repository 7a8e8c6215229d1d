"""Duplicate removal by text: one survivor per key, the smallest post_id."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd.functions import text as tx
from nabd.functions.unicode import with_search_text


def text_hash(column) -> Column:
    """SHA-256 of the text as 32 bytes."""
    return F.unhex(F.sha2(column, 256))


def first_ids(keyed: DataFrame, key: Column) -> DataFrame:
    """Smallest post_id per key; rows with a null key are left out.

    Only (hash, post_id) pairs are grouped, and they are combined before the shuffle, so a text
    that makes up a third of the table costs one row per task.
    """
    pairs = keyed.select("post_id", key.alias("_key")).filter(F.col("_key").isNotNull())
    return pairs.groupBy("_key").agg(F.min("post_id").alias("post_id")).select("post_id")


def keep_first(posts: DataFrame, key: Column) -> DataFrame:
    """Keep the post with the smallest post_id per key; posts with a null key are dropped.

    The wide rows are shuffled once, by post_id, which cannot be skewed.
    """
    return posts.join(first_ids(posts, key), "post_id", "left_semi")


def dedup_by_hash(posts: DataFrame, mode: str = "raw") -> DataFrame:
    """Hash dedup on the raw text, or on its light search key (`mode='normalized'`)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = {"raw": text, "normalized": tx.search_key(text)}
    return keep_first(posts, text_hash(keys[mode]))


def dedup_exact(
    posts: DataFrame,
    text: Column | None = None,
    staged: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Dedup on the full search normalization; posts whose key is empty are dropped.

    The posts are read twice, for their keys and for the rows. When their columns are expensive
    (cleaned text), pass `nabd.plans.staging.stage` as `staged` to compute them only once.
    """
    if text is None:
        text = tx.analysis_text() if "cleaned_text" in posts.columns else F.col("text")
    keyed = with_search_text(posts, text, "_norm")
    key = F.when(F.col("_norm") != "", text_hash(F.col("_norm")))
    keyed = keyed.withColumn("_hash", key).drop("_norm")
    if staged:
        keyed = staged(keyed)
        posts = keyed.drop("_hash")
    return posts.join(first_ids(keyed, F.col("_hash")), "post_id", "left_semi")
