"""The two text steps Spark has no function for: NFC and HTML entities.

Each runs in one Arrow pass. Rows that need nothing send a null instead of their text, so the
pass moves almost no data for them, and the table is still scanned once.
"""

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd.functions import text as tx
from nabd.functions.values import with_computed


def _converted(df: DataFrame, column: str, convert, needed: Column) -> DataFrame:
    # A nested function is shipped to the Python workers by value: they need no copy of this package.
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else convert(v))

    value = F.col(column)
    converted = F.pandas_udf(apply, "string")(F.when(needed, value))
    return df.withColumn(column, F.coalesce(converted, value))


def with_nfc(df: DataFrame, column: str, may_change: str = fv.NFC_MAYBE) -> DataFrame:
    """`column` in NFC. `may_change` is a pattern every text that NFC changes must match."""
    needed = F.col(column).rlike(may_change)
    return _converted(df, column, lambda v: unicodedata.normalize("NFC", v), needed)


def with_unescaped(df: DataFrame, column: str) -> DataFrame:
    """`column` with HTML entities decoded."""
    return _converted(df, column, html.unescape, F.col(column).rlike(fv.ENTITY_START))


def with_search_text(df: DataFrame, source: Column, target: str) -> DataFrame:
    """Add the full search normalization of `source`."""
    df = df.withColumn(target, F.coalesce(source, F.lit("")))
    df = with_nfc(df, target, fv.NFC_MAYBE_FOR_SEARCH)
    return with_computed(df, target, tx.fold_for_search(F.col(target)))


def with_display_text(df: DataFrame, source: Column, target: str) -> DataFrame:
    df = df.withColumn(target, F.coalesce(source, F.lit("")))
    df = with_nfc(df, target)
    return with_computed(df, target, tx.collapse_whitespace(F.col(target)))
