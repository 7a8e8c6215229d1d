"""Days from the text timestamps of posts and requests."""

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_FORMATS = ("yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d")


def post_day(created_at, strict=False) -> Column:
    """Calendar day of a post, null when it cannot be read."""
    if not strict:
        return F.try_to_date(created_at)
    head = F.substring(created_at, 1, 25)
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)).cast("date") for f in STRICT_FORMATS])


def iso_day(day) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def request_day_text(value) -> Column:
    """First ten characters of a date or text; empty counts as not given."""
    return F.nullif(F.substring(value.cast("string"), 1, 10), F.lit(""))


def in_range(day: Column, first: Column, last: Column) -> Column:
    """Both ends included; a null bound is open and a null day always passes."""
    return (
        day.isNull()
        | ((first.isNull() | (day >= first)) & (last.isNull() | (day <= last)))
    )
