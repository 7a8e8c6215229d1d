"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of about `SHARD_ROWS` by a hash of their id. Each shard's graph is built
in one task and stored as one row: ids, vectors, and for each layer flat neighbour arrays. Queries
go in blocks; every block is searched in every shard's graph, and the shards' results are merged.

Nearness is the largest inner product. A graph needs a metric, so each vector gets one more
component that makes all of a shard's vectors equally long; the nearest of those are the largest
products. Nodes enter a layer in a seeded order, each linked to the best diverse ones among those
before it, so early nodes keep long links; a node's links are then cut to the best diverse ones. In
place of a beam search for each insertion the candidates come from exact blocks within the shard.

Equal vectors are one node; their ids are spread out after the search.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without a vec_id. Of rows that repeat a vec_id the smallest vector counts. Only vectors of one
dimension are compared. Ties go to the smaller vec_id. Extra columns are ignored, empty tables give
empty results. A shard with no more than `EF` vectors is searched from all its nodes, hence whole.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nabd.plans.staging import stage

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LINKS = 16
CANDIDATES = 64
EF = 192
SEED = 7
_AT_ONCE = 256
_STEPS = 4  # nodes of a query's list that are expanded together


# --- one shard's graph ----------------------------------------------------------------------------


def _diverse(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """For each node up to `links` candidates that are nearer to it than to any chosen before.

    cand is (rows, k), best first, -1 where there is none; free places take the best left over.
    """
    rows, k = cand.shape
    vectors = x[np.maximum(cand, 0)]
    mutual = np.matmul(vectors, vectors.transpose(0, 2, 1))
    chosen = np.zeros((rows, k), bool)
    nearest = np.full((rows, k), -np.inf, np.float32)
    count = np.zeros(rows, int)
    for i in range(k):
        take = (cand[:, i] >= 0) & (sims[:, i] > nearest[:, i]) & (count < links)
        chosen[:, i] = take
        count += take
        nearest = np.where(take[:, None], np.maximum(nearest, mutual[:, i, :]), nearest)
    # chosen ones first, then the others by nearness
    rank = np.argsort(np.where(cand < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :links]
    return np.take_along_axis(cand, rank, axis=1)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest in each row, best first."""
    k = min(k, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    values = np.take_along_axis(sims, top, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1), np.take_along_axis(values, order, axis=1)


def _layer(x: np.ndarray, links: int, most: int) -> np.ndarray:
    """Neighbour array (n, most) of one layer whose nodes are the rows of x in order of entry."""
    n = len(x)
    forward = np.full((n, links), -1, np.int32)
    done = 0
    while done < n:
        end = min(n, done + min(_AT_ONCE, max(1, done)))
        sims = x[done:end] @ x[:end].T
        sims[np.arange(end - done), np.arange(done, end)] = -np.inf
        cand, values = _best(sims, CANDIDATES)
        cand = np.where(np.isfinite(values), cand, -1)
        found = _diverse(x, np.arange(done, end), cand, values, links)
        forward[done:end, : found.shape[1]] = found
        done = end
    source, place = np.nonzero(forward >= 0)
    target = forward[source, place]
    ends = np.concatenate([source, target]), np.concatenate([target, source])
    pairs = np.unique(np.stack(ends, axis=1), axis=0)
    near = np.einsum("ij,ij->i", x[pairs[:, 0]], x[pairs[:, 1]])
    order = np.lexsort((pairs[:, 1], -near, pairs[:, 0]))
    pairs, near = pairs[order], near[order]
    start = np.searchsorted(pairs[:, 0], np.arange(n))
    place = np.arange(len(pairs)) - start[pairs[:, 0]]
    keep = place < 2 * CANDIDATES
    cand = np.full((n, 2 * CANDIDATES), -1, np.int32)
    sims = np.full((n, 2 * CANDIDATES), -np.inf, np.float32)
    cand[pairs[keep, 0], place[keep]] = pairs[keep, 1]
    sims[pairs[keep, 0], place[keep]] = near[keep]
    out = np.full((n, most), -1, np.int32)
    for a in range(0, n, _AT_ONCE):
        b = min(n, a + _AT_ONCE)
        width = max(1, int((cand[a:b] >= 0).sum(axis=1).max()))
        found = _diverse(x, np.arange(a, b), cand[a:b, :width], sims[a:b, :width], most)
        out[a:b, : found.shape[1]] = found
    return out


def build_graph(vectors: np.ndarray, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top: (nodes, neighbours as node numbers); the last holds every node."""
    norms = (vectors**2).sum(axis=1)
    x = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]).astype(np.float32)
    random = np.random.default_rng(seed)
    entry = random.permutation(len(x))
    level = (-np.log(1 - random.random(len(x))) / np.log(LINKS)).astype(int)
    layers = []
    for depth in range(level.max(), -1, -1):
        nodes = entry[level[entry] >= depth].astype(np.int32)
        local = _layer(x[nodes], LINKS, LINKS if depth else 2 * LINKS)
        layers.append((nodes, np.where(local >= 0, nodes[np.maximum(local, 0)], -1).astype(np.int32)))
    return layers


def _beam(v: np.ndarray, place: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int):
    """The ef best nodes found for each query from its start nodes, best first; -1 where none.

    place: row of a node in `near`; start: (queries, any number) of distinct nodes.
    """
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(v)), bool)
    seen[rows, start] = True
    ids, scores = start, np.einsum("qd,qkd->qk", q, v[start])
    open_ = np.ones(ids.shape, bool)
    while open_.any():
        waiting = np.where(open_, scores, -np.inf)
        width = min(_STEPS, ids.shape[1])
        pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
        live = np.take_along_axis(open_, pick, axis=1)
        np.put_along_axis(open_, pick, False, axis=1)
        nodes = np.take_along_axis(ids, pick, axis=1)
        after = near[place[np.maximum(nodes, 0)]]
        after = np.where((live & (nodes >= 0))[:, :, None], after, -1).reshape(len(q), -1)
        after.sort(axis=1)
        fresh = (after >= 0) & ~seen[rows, np.maximum(after, 0)]
        fresh[:, 1:] &= after[:, 1:] != after[:, :-1]
        r, c = np.nonzero(fresh)
        seen[r, after[r, c]] = True
        found = np.full(after.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", q[r], v[after[r, c]])
        ids = np.concatenate([ids, np.where(fresh, after, -1)], axis=1)
        scores = np.concatenate([scores, found], axis=1)
        open_ = np.concatenate([open_, fresh], axis=1)
        top, scores = _best(scores, ef)
        ids = np.take_along_axis(ids, top, axis=1)
        open_ = np.take_along_axis(open_, top, axis=1) & np.isfinite(scores)
    return ids, scores


def search_graph(vectors: np.ndarray, layers: list, queries: np.ndarray, ef: int = EF) -> np.ndarray:
    """(queries, up to ef) node numbers, -1 where none."""
    v = vectors.astype(np.float32)
    out = []
    for a in range(0, len(queries), _AT_ONCE):
        q = queries[a : a + _AT_ONCE].astype(np.float32)
        if len(v) <= ef:
            start = np.broadcast_to(np.arange(len(v)), (len(q), len(v)))
        else:
            start = np.full((len(q), 1), layers[0][0][0])
        for depth, (nodes, near) in enumerate(layers):
            last = depth == len(layers) - 1
            if len(v) <= ef and not last:
                continue
            place = np.zeros(len(v), np.int64)
            place[nodes] = np.arange(len(nodes))
            found, _ = _beam(v, place, near, q, start, ef if last else 1)
            start = found
        full = np.full((len(q), ef), -1, np.int64)
        full[:, : found.shape[1]] = found
        out.append(full)
    return np.concatenate(out)


# --- Spark ------------------------------------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, dim) of the vectors that take part, one for each vec_id."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    rows = embeddings.filter("vec_id is not null and embedding is not null").filter(~bad).filter(some)
    rows = rows.select("vec_id", doubles).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.withColumn("dim", F.size("embedding"))


def _dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of each dimension dealt to parts of about `size` by a hash of the id."""
    parts = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).alias("parts"))
    own = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.col("parts")).cast("int")
    return rows.join(parts, "dim").withColumn(name, own).drop("parts")


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its ids, vectors and layers as flat arrays."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        v = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        layers = build_graph(v)
        row = {
            "dim": int(part["dim"].iloc[0]),
            "shard": int(part["shard"].iloc[0]),
            "ids": part["vec_id"].to_numpy(np.int64).tobytes(),
            "vectors": v.tobytes(),
            "nodes": [n.tobytes() for n, _ in layers],
            "neighbours": [g.tobytes() for _, g in layers],
        }
        return pd.DataFrame([row])

    schema = "dim int, shard int, ids binary, vectors binary, nodes array<binary>, neighbours array<binary>"
    # A number of partitions that is given is not merged again, so shards are built side by side.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(vectors, shard_rows, "shard").repartition(parts, "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInPandas(build, schema)


def _blocks(queries: DataFrame) -> DataFrame:
    """One row per block of queries."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        key = {"dim": int(part["dim"].iloc[0]), "block": int(part["block"].iloc[0])}
        ids = part["vec_id"].to_numpy(np.int64).tobytes()
        return pd.DataFrame([key | {"query_ids": ids, "queries": v.tobytes()}])

    dealt = _dealt(queries, QUERY_ROWS, "block")
    return dealt.groupBy("dim", "block").applyInPandas(
        pack, "dim int, block int, query_ids binary, queries binary"
    )


def search(
    index: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF, itself: bool = False
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found; the query's own id only if `itself`."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in part.itertuples():
            ids = np.frombuffer(row.ids, np.int64)
            v = np.frombuffer(row.vectors, np.float64).reshape(len(ids), row.dim)
            asked = np.frombuffer(row.query_ids, np.int64)
            q = np.frombuffer(row.queries, np.float64).reshape(len(asked), row.dim)
            layers = [
                (np.frombuffer(n, np.int32), np.frombuffer(g, np.int32).reshape(len(n) // 4, -1))
                for n, g in zip(row.nodes, row.neighbours, strict=True)
            ]
            found = search_graph(v, layers, q, max(ef, k + 1))
            r, c = np.nonzero(found >= 0)
            node = found[r, c]
            score = np.einsum("ij,ij->i", q[r], v[node])
            frame = pd.DataFrame({"query_id": asked[r], "vec_id": ids[node], "score": score})
            if not itself:
                frame = frame[ids[node] != asked[r]]
            frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(frame.groupby("query_id").head(k))
        return pd.concat(out)

    blocks = stage(_blocks(queries), "queries")
    pairs = index.select("dim", "shard").join(blocks.select("dim", "block"), "dim")
    keys = ["dim", "shard", "block"]
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(index, ["dim", "shard"]).join(blocks, ["dim", "block"]).repartition(parts, *keys)
    found = both.groupBy(*keys).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among the other vectors.

    Equal vectors are one point of the graph, named by their smallest id; a group of copies would
    otherwise link to itself alone. Points are searched for points, and what is found is spread out
    to ids at the end: of a point no more than the k + 1 smallest ids can be among the first k.
    `queries` are some of `vectors`; both are as `usable` returns them.
    """
    same = ["dim", "embedding"]
    points = stage(vectors.groupBy(*same).agg(F.min("vec_id").alias("vec_id")), "points")
    index = stage(build_index(points), "hnsw")
    named = points.withColumnRenamed("vec_id", "point")
    asked = stage(queries.join(named, same).select("vec_id", "point"), "asked")
    once = asked.select(F.col("point").alias("vec_id")).distinct()
    found = search(index, points.join(once, "vec_id", "left_semi"), k + 1, itself=True)
    found = found.select(F.col("query_id").alias("asked"), F.col("vec_id").alias("point"), "score")

    by_id = F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))
    members = vectors.withColumn("n", by_id).filter(F.col("n") <= k + 1)
    members = members.join(named, same).select("point", "vec_id")
    by_score = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    spread = found.join(members, "point").withColumn("n", F.row_number().over(by_score))
    spread = stage(spread.filter(F.col("n") <= k + 1).select("asked", "vec_id", "score"), "spread")

    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("point").alias("asked")).join(spread, "asked")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.filter("query_id <> vec_id").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest found of each vector whose id is divisible by `every`."""
    vectors = stage(usable(embeddings), "vectors")
    return nearest(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
