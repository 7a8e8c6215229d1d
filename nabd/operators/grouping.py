"""Helpers shared by the analytics: every analytic takes `keys`, the columns it groups by.

`keys` is empty for one answer over all rows, or for example ("request_id",).
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nabd.plans.staging import stage

# Above this k Spark no longer cuts each task's rows to k before the shuffle of a ranked window.
_SINGLE_WINDOW_K = 1000
_SPREAD = 64
MAX_BROADCAST_ROWS = 1_000_000


class FewGroups(tuple):
    """Keys whose number of groups was counted. It bounds what may be broadcast per group."""

    def __new__(cls, columns: Sequence[str], groups: int):
        keys = super().__new__(cls, columns)
        keys.groups = groups
        return keys


class SharedRows(FewGroups):
    """Keys of groups that share rows.

    A row stands for all groups of its `set_id`; `sets` (set_id and the keys) names them. Rows are
    aggregated per set first, and only these aggregates are handed out to the groups.
    """

    def __new__(cls, columns: Sequence[str], groups: int, sets: DataFrame):
        keys = super().__new__(cls, columns, groups)
        keys.sets = sets
        return keys


def row_keys(keys: Sequence[str]) -> list[str]:
    """The columns by which rows are told apart."""
    return ["set_id"] if isinstance(keys, SharedRows) else list(keys)


def handed_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of sets as rows of the groups that share them."""
    return df.join(keys.sets, "set_id").drop("set_id") if isinstance(keys, SharedRows) else df


def combined(
    df: DataFrame, keys: Sequence[str], by: Sequence[str], aggregates: dict[str, tuple[Column, Callable]]
) -> DataFrame:
    """Aggregate rows per group and `by`; each aggregate comes with the function that merges it."""
    first = [column.alias(name) for name, (column, _) in aggregates.items()]
    per_rows = df.groupBy(*row_keys(keys), *by).agg(*first)
    if not isinstance(keys, SharedRows):
        return per_rows
    merged = [merge(name).alias(name) for name, (_, merge) in aggregates.items()]
    return handed_out(per_rows, keys).groupBy(*keys, *by).agg(*merged)


def bounded(values: DataFrame, keys: Sequence[str], rows_per_group: int = 1) -> DataFrame:
    """Mark `values` for broadcast when its size is known to be small; else leave it to Spark.

    Without keys there is one group. With plain keys the number of groups is unknown: adaptive
    execution then decides from the measured size.
    """
    groups = 1 if not keys else getattr(keys, "groups", None)
    if groups is not None and groups * rows_per_group <= MAX_BROADCAST_ROWS:
        return F.broadcast(values)
    return values


def attach(
    df: DataFrame, values: DataFrame, keys: Sequence[str], row_weight: int = 1
) -> DataFrame:
    """Add the per-group columns of `values` (one row per group) to the rows of `df`.

    Without keys the one row is a scalar subquery. With keys it is an equi-join: a broadcast when
    the number of groups was counted, else adaptive execution broadcasts the aggregate if it
    turns out small, and splits a hot group if not. `row_weight` counts rows that hold a list.
    """
    if keys:
        return df.join(bounded(values, keys, row_weight), list(keys), "left")
    added = [c for c in values.columns if c not in df.columns]
    packed = values.select(F.struct(*added).alias("v"))
    return df.withColumn("_group", packed.scalar()).select(
        *df.columns, *[F.col("_group")[c].alias(c) for c in added]
    )


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window))


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    spread_by: str | None = None,
) -> DataFrame:
    """First k rows per group, with their rank from 1.

    Small k relies on the ranked-window limit (each task keeps k rows before the shuffle). Large
    k first cuts the group in `_SPREAD` slices by a hash of `spread_by`, so that no task sorts a
    whole hot group.
    """
    if not keys:
        best = df.orderBy(*order).limit(k)
        return ranked(best, keys, order, rank)
    if k > _SINGLE_WINDOW_K and spread_by:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(_SPREAD)))
        sliced = ranked(sliced, [*keys, "_slice"], order, rank)
        df = sliced.filter(F.col(rank) <= k).drop("_slice", rank)
    return ranked(df, keys, order, rank).filter(F.col(rank) <= k)


def as_list(df: DataFrame, keys: Sequence[str], item: Column, order: str, name: str) -> DataFrame:
    """One array per group, in the order of column `order`. For bounded lists (a top-k) only."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def global_rank(df: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """Add the rank from 1 over all rows without one task for all of them.

    Rows are cut into sorted ranges, ranked within their range, and shifted by the rows ahead of it;
    the shifts are one row per range. The ranges are written first, so a retry cannot move them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_shift")
    )
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = ranged.withColumn(rank, own).join(F.broadcast(shifts), "_part")
    return placed.withColumn(rank, F.col(rank) + F.col("_shift")).drop("_part", "_shift")
