"""Density clusters of vectors: core points, what they reach, and outliers that belong to none.

A vector is a core point when at least `min_neighbours` vectors of its group, itself included, lie
within `radius` of it (cosine distance). Core points within the radius of each other share a cluster;
another vector joins its nearest core point within the radius, and the rest are outliers.

Neighbours are found by an exact bucket index. Every vector lives in the cell of its nearest pivot,
and looks for neighbours in each cell that its distances cannot rule out (the triangle inequality).
A cell is cut in blocks of about `_BLOCK` vectors; a block and a bounded slice of those that visit it
are one group of a task, which multiplies them in chunks and gives counts and spanning links, never
all pairs. A cell holds about a block of the largest group, so a vector is sent to at most as many
blocks as its group has. Equal vectors are one weighted point. Pivots only steer the work; any choice
gives the same clusters. Where the radius is wide for the data, few cells can be ruled out and the
products near all vectors against all, in bounded memory.
Rows whose key is null, and vectors without a direction, are in no cluster.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from nabd.operators.graph import component_labels
from nabd.plans.staging import stage

#: Pivots are at most so many rows on the driver and in each task; vectors of a block, about; visitors
#: that a task multiplies at once; numbers of the visitors in one group of a task, about.
MAX_PIVOTS = 1024
_BLOCK = 4096
_CHUNK = 1024
_VISITING = 1 << 23
_MARGIN = 1e-9


def _unit(vector: Column) -> Column:
    """The vector at length one; null when it has no direction or holds a null or no number."""
    values = vector.cast("array<double>")
    square = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)
    usable = (square > 0) & (square < float("inf"))
    return F.when(usable, F.transform(values, lambda x: x / F.sqrt(square)))


def _helpers() -> tuple[Callable, Callable]:
    """Nested functions are shipped to the Python workers by value: they need no copy of this package."""

    def matrix(column: pa.Array) -> np.ndarray:
        """Lists of one length as the rows of a matrix."""
        if len(column.value_lengths().unique()) > 1:
            raise ValueError("vectors differ in length")
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def chunks(n: int) -> Iterator[slice]:
        return (slice(i, i + _CHUNK) for i in range(0, n, _CHUNK))

    return matrix, chunks


_matrix, _chunks = _helpers()


def _pivots(points: DataFrame, wanted: int) -> np.ndarray:
    """So many points, the same for the same data."""
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("u").collect()
    return np.array([r["u"] for r in drawn], np.float64)


def _placed(points: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """The points with `home`, their own cell, and `cells`, all in which neighbours can live."""
    schema = StructType(points.schema.fields + StructType.fromDDL("home int, cells array<int>").fields)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            units = _matrix(batch.column("u"))
            away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * units @ pivots.T))
            near = away.min(axis=1)
            cells = [np.flatnonzero(a <= d + 2 * reach + _MARGIN).tolist() for a, d in zip(away, near, strict=True)]
            home = pa.array(away.argmin(axis=1), pa.int32())
            arrays = [*batch.columns, home, pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return points.mapInArrow(batches, schema)


def _met(asking: DataFrame, living: DataFrame, keys: list[str], slices: int, each: Callable, schema: str) -> DataFrame:
    """What `each(ids, units, living ids, weights, units)` yields for the visitors of every block.

    Visitors and those who live there come in the order of their ids.
    """
    place = [*keys, "cell"]
    sizes = living.groupBy(*place).agg(F.ceil(F.count("*") / _BLOCK).alias("_n"))
    own = F.pmod(F.xxhash64("id"), F.col("_n")).alias("_block")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_block")
    own_slice = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(slices)).cast("int").alias("_slice")
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice")
    visitors = asking.join(sizes, place).select(*place, every_block, own_slice, F.lit(True).alias("_asks"), "id", "w", "u")
    at_home = living.join(sizes, place).select(*place, own, every_slice, F.lit(False).alias("_asks"), "id", "w", "u")
    met = visitors.unionByName(at_home)
    out = StructType([met.schema[k] for k in keys] + StructType.fromDDL(schema).fields)

    def side(rows: pa.Table) -> tuple:
        rows = rows.sort_by("id").combine_chunks()
        ids, weights, units = (rows.column(c).combine_chunks() for c in ("id", "w", "u"))
        return ids.to_numpy(), weights.to_numpy(), _matrix(units)

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        asks = rows.column("_asks")
        asked, settled = rows.filter(asks), rows.filter(pc.invert(asks))
        found = []
        if len(asked) and len(settled):
            ids, _, units = side(asked)
            found = list(each(ids, units, *side(settled)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[] for _ in out.names[len(keys) :]]
        named = [pa.repeat(k, len(columns[0])) for k in key[: len(keys)]]
        return pa.table([*named, *map(pa.array, columns)], out.names).cast(to_arrow_schema(out))

    return met.groupBy(*place, "_block", "_slice").applyInArrow(block, out)


def density_clusters(
    vectors: DataFrame,
    keys: Sequence[str] = (),
    radius: float = 0.2,
    min_neighbours: int = 5,
    vector: str = "embedding",
) -> DataFrame:
    """(keys, post_id, cluster) of all vectors that are no outliers; the cluster is its smallest core id."""
    keys = list(keys)
    reach = (2.0 * radius) ** 0.5  # cosine distance as the distance of unit vectors
    known = F.col("u").isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    usable = vectors.select(*keys, "post_id", _unit(F.col(vector)).alias("u")).filter(known)
    usable = stage(usable, "unit-vectors")
    points = usable.groupBy(*keys, "u").agg(F.min("post_id").alias("id"), F.count("*").alias("w"))
    points = stage(points, "points")
    group = points.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("u")).alias("length"))
    largest, length = group.agg(F.max("n"), F.max("length")).first()
    if not largest:
        return usable.select(*keys, "post_id", F.lit(None).cast("long").alias("cluster")).limit(0)
    pivots = _pivots(points, min(MAX_PIVOTS, -(-largest // _BLOCK)))
    slices = -(-largest * length // _VISITING)
    placed = stage(_placed(points, pivots, reach), "placed")
    asking = placed.select(*keys, "id", "w", "u", F.explode("cells").alias("cell"))
    living = placed.select(*keys, "id", "w", "u", F.col("home").alias("cell"))
    least = 1.0 - radius - _MARGIN

    def counted(ids, units, _ids, weights, others):
        weights = weights.astype(np.float64)  # whole numbers, for which doubles are exact and fast
        for c in _chunks(len(ids)):
            yield ids[c], ((units[c] @ others.T >= least) @ weights).astype(np.int64)

    counts = _met(asking, living, keys, slices, counted, "id long, n long")
    counts = counts.groupBy(*keys, "id").agg(F.sum("n").alias("n"))
    core = stage(counts.filter(F.col("n") >= min_neighbours).select(*keys, "id"), "core")
    core_living = living.join(core, [*keys, "id"], "left_semi")

    def linked(ids, units, other_ids, _weights, others):
        """Each core point with the smallest of those it is found to hang together with."""
        theirs, big = other_ids.copy(), np.iinfo(np.int64).max
        for c in _chunks(len(ids)):
            close = units[c] @ others.T >= least
            mine, before = ids[c].copy(), theirs
            while True:
                down = np.minimum(theirs, np.where(close, mine[:, None], big).min(axis=0))
                up = np.minimum(mine, np.where(close, down[None, :], big).min(axis=1))
                if (down == theirs).all() and (up == mine).all():
                    break
                mine, theirs = up, down
            # What a block's point was linked to before is kept: the change alone is a new link.
            a, b = np.concatenate((mine, theirs)), np.concatenate((ids[c], before))
            yield a[a != b], b[a != b]

    def nearest(ids, units, other_ids, _weights, others):
        for c in _chunks(len(ids)):
            likeness = np.round(units[c] @ others.T, 12)
            best = likeness.argmax(axis=1)  # ties: the smallest id
            value = likeness[np.arange(len(best)), best]
            near = value >= least
            yield ids[c][near], other_ids[best][near], value[near]

    core_asking = asking.join(core, [*keys, "id"], "left_semi")
    links = _met(core_asking, core_living, keys, slices, linked, "a long, b long")
    links = stage(links.distinct(), "links")
    labels = component_labels(core, links, keys).select(*keys, "id", "component")
    others = asking.join(core, [*keys, "id"], "left_anti")
    border = _met(others, core_living, keys, slices, nearest, "id long, core long, likeness double")
    border = border.groupBy(*keys, "id").agg(F.max_by("core", F.struct("likeness", -F.col("core"))).alias("core"))
    joined = border.join(labels.withColumnRenamed("id", "core"), [*keys, "core"]).select(*keys, "id", "component")
    named = labels.unionByName(joined).join(points.select(*keys, "id", "u"), [*keys, "id"])
    clusters = named.select(*keys, "u", F.col("component").alias("cluster"))
    return usable.join(clusters, [*keys, "u"]).select(*keys, "post_id", "cluster")
