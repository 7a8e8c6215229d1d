"""Metrics of an undirected simple graph: density, average clustering, connected components.

`nodes` has (keys, id); `edges` has (keys, source, target). Both directions of an edge are one
edge and self-loops are ignored.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nabd.functions.values import round_exact
from nabd.operators.grouping import attach
from nabd.plans.staging import release, stage


def simple_edges(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (
        edges.select(
            *keys,
            F.least("source", "target").alias("a"),
            F.greatest("source", "target").alias("b"),
        )
        .filter(F.col("a") != F.col("b"))
        .distinct()
    )


def degrees(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ends = pairs.select(*keys, F.explode(F.array("a", "b")).alias("id"))
    return ends.groupBy(*keys, "id").agg(F.count("*").alias("degree"))


def triangles(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Triangles per node.

    Each edge points from its lower-degree end to its higher-degree end, so a hub has few
    outgoing edges: no node has more than sqrt(2m) of them, and wedges stay within O(m^1.5).
    """
    degree = degrees(pairs, keys)
    low = degree.withColumnsRenamed({"id": "a", "degree": "_da"})
    high = degree.withColumnsRenamed({"id": "b", "degree": "_db"})
    forward = F.struct("_da", "a") < F.struct("_db", "b")
    arcs = (
        pairs.join(low, [*keys, "a"])
        .join(high, [*keys, "b"])
        .select(
            *keys,
            F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"),
            F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"),
        )
    )
    wedges = arcs.join(arcs.withColumnRenamed("v", "w"), [*keys, "u"]).filter("v < w")
    closing = pairs.withColumnsRenamed({"a": "v", "b": "w"})
    closed = wedges.join(closing, [*keys, "v", "w"], "left_semi")
    corners = closed.select(*keys, F.explode(F.array("u", "v", "w")).alias("id"))
    return corners.groupBy(*keys, "id").agg(F.count("*").alias("triangles"))


def average_clustering(nodes: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean local clustering over all nodes; nodes of degree below 2 count 0."""
    d = F.coalesce("degree", F.lit(0))
    t = F.coalesce("triangles", F.lit(0))
    local = F.when(d < 2, F.lit(0.0)).otherwise(F.lit(2.0) * t / (d * (d - 1)))
    per_node = (
        nodes.join(degrees(pairs, keys), [*keys, "id"], "left")
        .join(triangles(pairs, keys), [*keys, "id"], "left")
        .select(*keys, local.alias("c"))
    )
    return per_node.groupBy(*keys).agg(F.avg("c").alias("avg_clustering"))


def component_labels(nodes: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest node id of each node's connected component, as `component`.

    Alternating large-star and small-star steps (a published method for clusters): every step
    is a group minimum, combined before the shuffle, and a join. The number of rounds is
    logarithmic, and each round is written out, so lost executors cost one round at most.
    """
    name = list(keys)

    def smallest(df: DataFrame, group: str, value: str) -> DataFrame:
        lowest = df.groupBy(*name, group).agg(F.min(value).alias("_m"))
        return lowest.select(*name, group, F.least(group, "_m").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(*name, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(*name, F.col("b").alias("u"), F.col("a").alias("v"))
        )
        joined = both.join(smallest(both, "u", "v"), [*name, "u"]).filter("v > u")
        return joined.select(*name, F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(*name, F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        low = smallest(down, "u", "v")
        moved = down.join(low, [*name, "u"]).select(*name, F.col("m").alias("a"), F.col("v").alias("b"))
        own = low.select(*name, F.col("m").alias("a"), F.col("u").alias("b"))
        return moved.unionByName(own).filter("a <> b").distinct()

    def fingerprint(e: DataFrame):
        hashes = (F.xxhash64(*name, "a", "b"), F.xxhash64("b", F.lit(1), "a", *name))
        return e.agg(F.count("*"), *map(F.bit_xor, hashes)).first()

    current = stage(pairs, "components")
    before = fingerprint(current)
    while True:
        previous, current = current, stage(small_star(large_star(current)), "components")
        release(previous)
        after = fingerprint(current)
        if after == before:
            break
        before = after
    label = current.select(*name, F.col("b").alias("id"), F.col("a").alias("component"))
    return nodes.join(label, [*name, "id"], "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def graph_metrics(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """density, avg_clustering (four decimals) and components; all 0 without edges."""
    nodes = stage(nodes.select(*keys, "id").distinct(), "nodes")  # every metric reads both
    pairs = stage(simple_edges(edges, keys), "pairs")
    n = nodes.groupBy(*keys).agg(F.count("*").alias("_n"))
    m = pairs.groupBy(*keys).agg(F.count("*").alias("_m"))
    parts = component_labels(nodes, pairs, keys).groupBy(*keys).agg(
        F.countDistinct("component").alias("_parts")
    )
    all_values = n
    for values in (m, average_clustering(nodes, pairs, keys), parts):
        all_values = attach(all_values, values, keys)
    edges_found = F.coalesce("_m", F.lit(0)) > 0
    density = F.lit(2.0) * F.col("_m") / (F.col("_n") * (F.col("_n") - 1))
    return all_values.select(
        *keys,
        F.when(edges_found, round_exact(density, 4)).otherwise(F.lit(0.0)).alias("density"),
        F.when(edges_found, round_exact(F.col("avg_clustering"), 4))
        .otherwise(F.lit(0.0))
        .alias("avg_clustering"),
        F.when(edges_found, F.col("_parts")).otherwise(F.lit(0)).cast("bigint").alias("components"),
    )
