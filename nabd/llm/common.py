"""Small helpers shared by the training-data operators."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; `bytes.split()` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
BREAK = r"[\x20\x09-\x0D]+"

#: Rows of long text that one Arrow batch may hold in Python at a time.
ROWS_AT_ONCE = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK, -1), "")


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name (in any case) is replaced."""
    taken = {name.lower() for name in columns}
    return df.drop(*[c for c in df.columns if c.lower() in taken]).withColumns(columns)


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns `own`, and the others as one struct `rest`, so that no name can clash with theirs."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in own]
    return docs.select(*own, F.struct(F.lit(True).alias("c"), *others).alias("rest"))


def unpacked(columns: list[str], *own: str) -> list[Column]:
    """The columns that `packed` put away, in their order."""
    return [F.col(c) if c in own else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(columns)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that a batch of very long texts is not held twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
