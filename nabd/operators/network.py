"""Mention network: node activity, edges among the most active handles, node and edge records."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nabd.functions.text import handle_key
from nabd.functions.values import first_present, let, present, round_exact
from nabd.operators.grouping import SharedRows, attach, combined, handed_out, row_keys, top_k


def author_key() -> Column:
    """Author's handle, else user id, without @ and in lower case; null when there is none."""
    return present(handle_key(first_present(F.col("user_handle"), F.col("user_id"))))


def node_activity(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Authored posts plus mentions received, per handle. One pass over the posts."""
    names = F.concat(F.array(author_key()), F.coalesce("mentions", F.array().cast("array<string>")))
    seen = posts.select(*row_keys(keys), F.explode(names).alias("handle"))
    seen = seen.filter(present(F.col("handle")).isNotNull())
    return combined(seen, keys, ["handle"], {"activity": (F.count("*"), F.sum)})


def top_nodes(posts: DataFrame, keys: Sequence[str] = (), max_nodes: int = 50) -> DataFrame:
    order = [F.desc("activity"), F.asc("handle")]
    return top_k(node_activity(posts, keys), keys, order, max_nodes, spread_by="handle")


def mention_edges(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All author -> mentioned edges with the number of posts; no self-mentions."""
    pairs = posts.select(
        *row_keys(keys), author_key().alias("src"), F.explode("mentions").alias("dst")
    ).filter(F.col("src").isNotNull() & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return combined(pairs, keys, ["src", "dst"], {"weight": (F.count("*"), F.sum)})


def edges_among(
    posts: DataFrame, nodes: DataFrame, keys: Sequence[str] = (), double_count=True
) -> DataFrame:
    """Edges whose two ends are in `nodes` (a short top list per group).

    The list travels as one array per group and mentions are cut to it inside each row, before
    any pair is built: a post gives at most |nodes| edges, or |nodes|^2/2 co-occurrence pairs, and
    the aggregation sees at most |nodes|^2 keys per group however many posts there are.
    """
    kept = nodes.groupBy(*keys).agg(F.sort_array(F.collect_list("handle")).alias("_top"))
    authored = posts.select(*row_keys(keys), author_key().alias("_author"), "mentions")
    if isinstance(keys, SharedRows):  # posts of a set that name the same handles are one row
        named = authored.filter(F.size("mentions") > 0)
        alike = named.groupBy("set_id", "_author", "mentions").agg(F.count("*").alias("_n"))
        authored = handed_out(alike, keys)
    else:
        authored = authored.withColumn("_n", F.lit(1).cast("bigint"))
    rows = attach(authored, kept, keys, row_weight=50).select(
        *keys,
        "_n",
        "_author",
        F.array_contains("_top", F.col("_author")).alias("_author_kept"),
        F.sort_array(F.array_intersect("mentions", "_top")).alias("_named"),
    )

    def edge(src: Column, dst: Column, weight: int) -> Column:
        return F.struct(
            src.alias("src"), dst.alias("dst"), F.lit(weight).cast("bigint").alias("weight")
        )

    def from_author(named: Column) -> Column:
        others = F.filter(named, lambda m: m != F.col("_author"))
        return F.transform(others, lambda m: edge(F.col("_author"), m, 1))

    def together(named: Column) -> Column:
        # Each unordered pair is met from both sides, so it counts twice unless told otherwise.
        weight = 2 if double_count else 1
        return F.flatten(
            F.transform(
                named,
                lambda a: F.transform(F.filter(named, lambda b: b > a), lambda b: edge(a, b, weight)),
            )
        )

    found = (
        F.when(F.col("_author").isNull(), let(F.col("_named"), together))
        .when(F.col("_author_kept"), let(F.col("_named"), from_author))
    )
    edges = rows.filter(F.size("_named") > 0).select(*keys, "_n", F.explode(found).alias("e"))
    weight = F.sum(F.col("e.weight") * F.col("_n")).alias("weight")
    return edges.groupBy(*keys, F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(weight)


def top_edges(edges: DataFrame, keys: Sequence[str] = (), max_edges: int = 200) -> DataFrame:
    order = [F.desc("weight"), F.asc("src"), F.asc("dst")]
    return top_k(edges, keys, order, max_edges)


def weighted_degree(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ends = edges.select(*keys, "weight", F.explode(F.array("src", "dst")).alias("handle"))
    return ends.groupBy(*keys, "handle").agg(F.sum("weight").alias("degree"))


def node_records(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """id, handle, size 1-5 and group for the top nodes; `rank` gives the order."""
    largest = nodes.groupBy(*keys).agg(F.greatest(F.max("activity"), F.lit(1)).alias("_max"))
    sized = attach(nodes, largest, keys).join(weighted_degree(edges, keys), [*keys, "handle"], "left")
    size = round_exact(F.lit(5.0) * F.col("activity") / F.col("_max"), 0).cast("int")
    return sized.select(
        *keys,
        "rank",
        F.col("rank").cast("string").alias("id"),
        F.concat(F.lit("@"), "handle").alias("handle"),
        F.greatest(F.lit(1), size).alias("size"),
        F.when(F.col("degree") >= 5, "influencer").otherwise("user").alias("group"),
    )


def edge_records(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """source id, target id and weight of the top edges; `rank` gives the order."""
    ids = nodes.select(*keys, "handle", F.col("rank").cast("string").alias("id"))
    source = ids.withColumnsRenamed({"handle": "src", "id": "source"})
    target = ids.withColumnsRenamed({"handle": "dst", "id": "target"})
    return (
        edges.join(source, [*keys, "src"])
        .join(target, [*keys, "dst"])
        .select(*keys, "rank", "source", "target", "weight")
    )


def interaction_network(
    posts: DataFrame,
    keys: Sequence[str] = (),
    max_nodes: int = 50,
    max_edges: int = 200,
    double_count=True,
) -> tuple[DataFrame, DataFrame]:
    """Node records and edge records of the network among the most active handles."""
    nodes = top_nodes(posts, keys, max_nodes)
    edges = top_edges(edges_among(posts, nodes, keys, double_count), keys, max_edges)
    return node_records(nodes, edges, keys), edge_records(nodes, edges, keys)
