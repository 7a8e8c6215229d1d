"""Summary sentence and recommendations as columns over one row per request."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd.functions.values import format_fixed
from nabd.operators.sentiment import dominant_sentiment


def _fill(template: str, **parts: Column) -> Column:
    """The template with each {name} replaced by its column."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        pieces += [F.lit(before), parts[name]]
    return F.concat(*pieces, F.lit(rest))


def join_topics(labels: Column, max_n: int = 5) -> Column:
    """Labels joined by the Arabic comma, with "and" before the last one."""
    kept = F.filter(F.slice(labels, 1, max_n), lambda s: s != "")
    head = F.array_join(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), fv.ARABIC_COMMA)
    last = F.element_at(kept, -1)
    return (
        F.when(F.size(kept) == 0, "")
        .when(F.size(kept) == 1, last)
        .otherwise(F.concat(head, F.lit(fv.ARABIC_AND), last))
    )


def _share(name: str) -> Column:
    return F.col(f"sentiment_{name}")


def summary() -> Column:
    """Up to four sentences on counts, tone, topics and the leading account."""
    quoted = F.transform(F.slice("keywords", 1, 5), lambda k: F.concat(F.lit('"'), k, F.lit('"')))
    keywords = F.when(
        F.size("keywords") > 0, F.array_join(quoted, fv.ARABIC_COMMA)
    ).otherwise(fv.SUMMARY_NO_KEYWORDS)
    tone = dominant_sentiment(_share("positive"), _share("neutral"), _share("negative"))
    names = F.when(tone == "positive", fv.TONE_NAMES["positive"])
    for name in ("neutral", "negative"):
        names = names.when(tone == name, fv.TONE_NAMES[name])
    topics = join_topics(F.col("top_topics.label"))
    leader = F.get("top_influencers", F.lit(0))
    sentences = [
        _fill(
            fv.SUMMARY_COUNTS,
            posts=F.format_number("total_posts", 0),
            keywords=keywords,
            users=F.format_number("total_users", 0),
        ),
        _fill(
            fv.SUMMARY_TONE,
            tone=names,
            pos=format_fixed(_share("positive"), 1),
            neg=format_fixed(_share("negative"), 1),
            neu=format_fixed(_share("neutral"), 1),
        ),
        F.when(topics != "", _fill(fv.SUMMARY_TOPICS, topics=topics)),
        F.when(
            F.size("top_influencers") > 0,
            _fill(
                fv.SUMMARY_INFLUENCER,
                handle=leader["handle"],
                influence=format_fixed(leader["influence"], 2),
            ),
        ),
    ]
    return F.when(F.col("total_posts") == 0, fv.SUMMARY_EMPTY).otherwise(
        F.concat_ws(" ", *sentences)
    )


def recommendations() -> Column:
    """Advice that applies, in a fixed order; a default when none does."""
    negative, positive = _share("negative"), _share("positive")
    labels = F.col("top_topics.label")
    main_topic = F.coalesce(F.get(labels, F.lit(0)), F.lit(fv.ADVICE_MAIN_TOPIC))
    handles = F.array_join(
        F.filter(F.slice(F.col("top_influencers.handle"), 1, 3), lambda h: h != ""), fv.ARABIC_COMMA
    )
    focus = F.array_join(F.filter(F.slice(labels, 1, 3), lambda s: s != ""), ", ")
    advice = F.array(
        F.when(F.col("total_posts") < 100, fv.ADVICE_FEW_POSTS),
        F.when(
            negative > 35,
            _fill(fv.ADVICE_NEGATIVE, neg=format_fixed(negative, 1), topic=main_topic),
        ).when(positive > 60, _fill(fv.ADVICE_POSITIVE, pos=format_fixed(positive, 1))),
        F.when(handles != "", _fill(fv.ADVICE_INFLUENCERS, handles=handles)),
        F.when(F.size(labels) >= 3, _fill(fv.ADVICE_FOCUS, topics=focus)),
        F.when(F.size("sentiment_timeline") >= 3, fv.ADVICE_TREND),
    )
    given = F.filter(advice, lambda a: a.isNotNull())
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(fv.ADVICE_DEFAULT)))
