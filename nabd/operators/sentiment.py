"""Sentiment per post, shares and the daily timeline."""

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nabd import fixed_values as fv
from nabd.functions.dates import iso_day, post_day
from nabd.functions.text import analysis_text, strip
from nabd.functions.values import round_exact, with_computed
from nabd.operators.grouping import combined
from nabd.plans.staging import stage

CLASSES = ("positive", "neutral", "negative")


def sentiment_class(label: Column) -> Column:
    """Class for a model's label text."""
    s = F.lower(strip(label))
    return (
        F.when(F.coalesce(label, F.lit("")) == "", "neutral")
        .when(s.contains("pos") | s.isin("label_2", "2"), "positive")
        .when(s.contains("neg") | s.isin("label_0", "0"), "negative")
        .otherwise("neutral")
    )


def _hits(text: Column, words: Sequence[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), start=F.lit(0))


def with_lexicon_sentiment(df: DataFrame, text: Column | None = None) -> DataFrame:
    """Add `sentiment` and `score` from the word lists (substring matches, each word once)."""
    # The text is lowered and searched once, however often the lead is asked for.
    df = with_computed(df, "_lower", F.lower(analysis_text() if text is None else text))
    hits = _hits(F.col("_lower"), fv.POSITIVE_WORDS) - _hits(F.col("_lower"), fv.NEGATIVE_WORDS)
    df = with_computed(df, "_lead", hits).drop("_lower")
    lead = F.col("_lead")
    strength = F.least(F.lit(0.5) + F.lit(0.1) * F.abs(lead), F.lit(0.95))
    return df.withColumns(
        {
            "sentiment": F.when(lead > 0, "positive").when(lead < 0, "negative").otherwise("neutral"),
            "score": F.when(lead == 0, F.lit(0.55)).otherwise(strength),
        }
    ).drop("_lead")


def with_model_sentiment(
    df: DataFrame,
    make_predict: Callable,
    text: Column | None = None,
    batch_size: int = 32,
    staged: Callable[[DataFrame], DataFrame] = stage,
) -> DataFrame:
    """Add `sentiment` and `score` from a model, with the word lists as a stand-in.

    `make_predict()` runs once per Python worker and returns a function from an array of texts to
    a list of (label, score). If any batch fails, every row gets the word-list result, as a mix
    of two scorers would not be comparable, and `model_error` says why; it is null otherwise. Scores
    and reasons are written once by `staged`, so the model runs once per row.
    """
    text = analysis_text() if text is None else text

    def guarded():
        broken = ""
        try:
            predict = make_predict()
        except Exception as error:
            broken = f"{type(error).__name__}: {error}"

        def run(texts):
            labels, scores, reason = [""] * len(texts), [float("nan")] * len(texts), broken
            if not reason:
                try:
                    answers = list(predict([t or "" for t in texts]))
                    if len(answers) != len(texts):
                        raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
                    labels, scores = zip(*answers, strict=True)
                    scores = [float(s) for s in scores]
                except Exception as error:
                    labels, scores = [""] * len(texts), [float("nan")] * len(texts)
                    reason = f"{type(error).__name__}: {error}"
            return {
                "label": np.array([str(v) for v in labels], dtype=object),
                "score": np.array(scores, dtype="float64"),
                "error": np.array([reason] * len(texts), dtype=object),
            }

        return run

    answer = T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("error", T.StringType()),
        ]
    )
    scored = predict_batch_udf(guarded, return_type=answer, batch_size=batch_size)
    df = staged(with_lexicon_sentiment(df, text).withColumn("_model", scored(text)))
    # Arrow may turn a NaN into a null.
    no_score = F.isnan(F.coalesce("_model.score", F.lit(float("nan"))))
    reason = F.when(F.col("_model.error") != "", F.col("_model.error")).when(no_score, "no score")
    failed = df.agg(F.max(reason).alias("reason"))
    by_model = F.col("model_error").isNull()
    return (
        df.withColumn("model_error", failed.scalar())
        .withColumns(
            {
                "sentiment": F.when(by_model, sentiment_class(F.col("_model.label"))).otherwise(F.col("sentiment")),
                "score": F.when(by_model, F.col("_model.score")).otherwise(F.col("score")),
            }
        )
        .drop("_model")
    )


def _class_counts() -> dict:
    return {c: (F.count_if(F.col("sentiment") == c), F.sum) for c in CLASSES}


def sentiment_shares(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Percent of posts per class, two decimals."""
    counts = combined(scored, keys, (), {**_class_counts(), "_n": (F.count("*"), F.sum)})
    total = F.greatest(F.col("_n"), F.lit(1))
    return counts.select(
        *keys,
        *[
            round_exact(F.lit(100.0) * F.col(c) / total, 2).alias(f"sentiment_{c}")
            for c in CLASSES
        ],
    )


def sentiment_timeline(scored: DataFrame, keys: Sequence[str] = (), strict=False) -> DataFrame:
    """Posts per day and class; posts without a readable day are left out."""
    dated = scored.withColumn("_day", post_day(F.col("created_at"), strict))
    dated = dated.filter(F.col("_day").isNotNull())
    daily = combined(dated, keys, ["_day"], _class_counts())
    return daily.select(*keys, iso_day(F.col("_day")).alias("day"), *CLASSES)


def per_post_sentiment(scored: DataFrame) -> DataFrame:
    """Preview text, class and score of each post."""
    preview = F.substring(analysis_text(), 1, fv.POST_PREVIEW_CHARS)
    return scored.select("post_id", preview.alias("text"), F.col("sentiment").alias("label"), "score")


def dominant_sentiment(positive: Column, neutral: Column, negative: Column) -> Column:
    """Largest share; ties go to positive, then neutral."""
    return (
        F.when((positive >= neutral) & (positive >= negative), "positive")
        .when(neutral >= negative, "neutral")
        .otherwise("negative")
    )
