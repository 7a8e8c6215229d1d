"""Post cleaning and validity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd.functions import text as tx
from nabd.functions.unicode import with_nfc, with_unescaped
from nabd.functions.values import with_computed


def with_clean_text(
    df: DataFrame,
    source: str,
    target: str = "cleaned_text",
    *,
    remove_emojis=True,
    keep_hashtag_text=True,
    keep_mention_text=False,
) -> DataFrame:
    """Add display-ready text: entities, prefixes, links, mentions, emojis and noise removed."""
    df = df.withColumn(target, F.coalesce(F.col(source), F.lit("")))
    df = with_unescaped(df, target)
    df = with_computed(
        df,
        target,
        tx.remove_markup(
            F.col(target),
            remove_emojis=remove_emojis,
            keep_hashtag_text=keep_hashtag_text,
            keep_mention_text=keep_mention_text,
        ),
    )
    df = with_nfc(df, target, fv.NFC_MAYBE_AFTER_CLEANING)
    return with_computed(df, target, tx.collapse_whitespace(F.col(target)))


def clean_posts(posts: DataFrame, **options) -> DataFrame:
    """Posts plus `raw_text, mentions, hashtags, is_retweet, cleaned_text`."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    posts = posts.withColumns(
        {
            "raw_text": raw,
            "mentions": tx.mentions(raw),
            "hashtags": tx.hashtags(raw),
            "is_retweet": tx.is_retweet(raw),
        }
    )
    return with_clean_text(posts, "raw_text", **options)


def valid_posts(
    posts: DataFrame, min_chars=fv.MIN_CLEAN_CHARS, min_arabic=fv.MIN_ARABIC_CHARS
) -> DataFrame:
    """Keep cleaned posts with enough text and enough Arabic characters."""
    return posts.filter(tx.is_valid_text(tx.analysis_text(), min_chars, min_arabic))
