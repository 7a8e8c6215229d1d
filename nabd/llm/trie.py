"""Conversation prefix trie: ternary search trees per range shard, merged along their edges.

A node of the trie is a distinct sequence of first turns (role and text); its members are the
conversations that start with it. Turns become 128-bit keys and a code point count before anything
is moved, and a prefix is known by 128 bits of a running XOR over its turns' hashes with their
places. Numbering and XOR run over ranges of (conversation, turn) and are carried over from range
to range, so that one conversation with very many turns is spread over tasks.

Only a prefix that two conversations share needs a tree; the rest of a conversation is a chain of
nodes with one member, written down as it is. Conversations that leave the shared part at the same
node are folded into one weighted path. Paths are sorted into range shards of a bounded number of
turns. A shard encodes its turn keys by a dictionary, inserts its paths into a ternary search tree,
the median first, so that the tree is balanced, and accumulates members, children, leaves and
savings in an iterative traversal. Nodes on a shard's first or last path may have members in other
shards; they are merged by prefix, and what lies below them is added up along these paths.

Rows without a conversation id belong to no conversation and have no node. Turns are ordered by turn
number, null first, equal numbers by their key; repeated rows are repeated turns. A null role or
text is empty. Very long texts are hashed where they are read. Extra columns are ignored. Without a
conversation there is no node, not even a root.

The digest of a node's ids is one SHA-256 over them all, which no one can split: ids are gathered in
pieces of bounded ranges, and the pieces of a node pass through one task as a stream.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nabd.plans.staging import stage

#: Turns that one shard's tree may hold, about.
SHARD_TURNS = 1 << 18
#: Ids that one piece of a node's id list may hold.
PIECE_IDS = 1 << 12

NODE = ["depth", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _carried(rows: DataFrame, order: list[str], value, add, empty: int) -> DataFrame:
    """Add the columns of `value` (name: aggregate) taken over a conversation's rows up to each row.

    `part` tells which range a row is in; ranges follow each other in the order of the rows.
    """
    here = Window.partitionBy("part", "conv_id").orderBy(*order)
    here = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("part", "conv_id").agg(*[of(name).alias(f"_{name}") for name, (of, _) in value.items()])
    before = ranges.select(
        "part", "conv_id", *[over(f"_{name}").over(earlier).alias(f"_{name}") for name, (_, over) in value.items()]
    )
    within = rows.withColumns({name: of(name).over(here) for name, (of, _) in value.items()})
    return within.join(before, ["part", "conv_id"]).withColumns(
        {name: add(F.col(name), F.coalesce(f"_{name}", F.lit(empty).cast("long"))) for name in value}
    )


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, pos, key, chars): each turn's place in its conversation from 1, its 128-bit
    key and the code points of its text. Staged."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id is not null").select(
        "conv_id",
        "turn",
        F.unhex(F.left(F.sha2(named, 256), F.lit(32))).alias("key"),
        F.length(text).cast("long").alias("chars"),
    )
    # The row's number only spreads rows that are alike in all else; they may change places.
    ranged = turns.repartitionByRange("conv_id", "turn", "key", F.monotonically_increasing_id())
    ranged = stage(ranged.withColumn("part", F.spark_partition_id()).withColumn("pos", F.lit(1).cast("long")), "turns")
    placed = _carried(
        ranged, ["turn", "key"], {"pos": (F.count, F.sum)}, lambda here, before: here + before, 0
    )
    return stage(placed.select("conv_id", "part", "pos", "key", "chars"), "numbered")


def with_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, key, chars): the prefix that ends with each numbered turn. Staged."""
    hashed = turns.select(
        "conv_id",
        "part",
        F.col("pos").alias("depth"),
        F.xxhash64("pos", "key").alias("p1"),
        F.xxhash64("key", "pos").alias("p2"),
        "key",
        "chars",
    )
    value = {name: (F.bit_xor, F.bit_xor) for name in ("p1", "p2")}
    known = _carried(hashed, ["depth"], value, lambda here, before: here.bitwiseXOR(before), 0)
    return stage(known.select("conv_id", *NODE, "key", "chars"), "prefixes")


def _shard_tree(rows):
    """The trie of one shard's sorted paths, as rows of nodes."""
    table = pa.Table.from_batches(list(rows)) if (rows := list(rows)) else None
    if table is None or not table.num_rows:
        return
    paths = table.column("path").combine_chunks()
    lengths = pc.list_value_length(paths).to_numpy()
    turns = paths.flatten()
    coded = turns.field("key").dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    ids = rank[coded.indices.to_numpy()].tolist() if len(coded) else []
    starts = np.concatenate(([0], np.cumsum(lengths))).tolist()

    # Node 0 is the root; `same` leads to the middle one of a node's children, `less` and `more` on.
    turn, less, same, more, up, at = [-1], [-1], [-1], [-1], [-1], [-1]

    def grown(key: int, parent: int, place: int) -> int:
        for column, value in ((turn, key), (less, -1), (same, -1), (more, -1), (up, parent), (at, place)):
            column.append(value)
        return len(turn) - 1

    def insert(first: int, last: int) -> int:
        node = 0
        for place in range(first, last):
            key, child = ids[place], same[node]
            if child < 0:
                child = same[node] = grown(key, node, place)
            while turn[child] != key:
                side = less if key < turn[child] else more
                if side[child] < 0:
                    side[child] = grown(key, node, place)
                child = side[child]
            node = child
        return node

    ends = [0] * table.num_rows
    waiting = [(0, table.num_rows)]
    while waiting:  # medians first
        low, high = waiting.pop()
        if low < high:
            middle = (low + high) // 2
            ends[middle] = insert(starts[middle], starts[middle + 1])
            waiting += [(low, middle), (middle + 1, high)]

    chars = np.concatenate((turns.field("chars").to_numpy(zero_copy_only=False), [0])).astype(np.int64)[at].tolist()
    members, children, leaves, saved = ([0] * len(turn) for _ in range(4))
    least: list[int | None] = [None] * len(turn)
    weights = (table.column(c).to_pylist() for c in ("members", "tails", "first"))
    for node, n, tails, first in zip(ends, *weights, strict=True):
        members[node], children[node], leaves[node], least[node] = n, tails, tails, first
    edge = [0] * len(turn)  # 1: on the first path, 2: on the last
    for bit, node in ((1, ends[0]), (2, ends[-1])):
        while node >= 0:
            edge[node] |= bit
            node = up[node]

    order, waiting = [], [0]
    while waiting:  # a node comes after the one it continues
        node = waiting.pop()
        order.append(node)
        waiting += [n for n in (less[node], more[node], same[node]) if n >= 0]
    for node in sorted(order, reverse=True):  # children are younger than what they continue
        parent = up[node]
        if not edge[node]:
            leaves[node] = leaves[node] or int(not children[node])
            saved[node] += (members[node] - 1) * chars[node]
        if parent >= 0:
            members[parent] += members[node]
            if least[parent] is None or least[node] < least[parent]:
                least[parent] = least[node]
            if not edge[node]:
                children[parent] += 1
                leaves[parent] += leaves[node]
                saved[parent] += saved[node]

    depths = np.concatenate((turns.field("depth").to_numpy(zero_copy_only=False), [0])).astype(np.int64)[at]
    prefix = {}
    for name in ("p1", "p2"):
        values = np.concatenate((turns.field(name).to_numpy(zero_copy_only=False), [0])).astype(np.int64)
        own = values[at]
        prefix[name], prefix[f"up_{name}"] = own, np.where(np.array(up) < 0, 0, own[up])
    over = [None if u < 0 or edge[u] else least[u] for u in up]
    shard = TaskContext.get().partitionId() if TaskContext.get() else 0
    long = pa.int64()
    columns = {
        "depth": pa.array(depths, long),
        **{name: pa.array(values, long) for name, values in prefix.items()},
        "conv_id": pa.array(least, long),
        "parent_conv_id": pa.array(over, long),
        "n_convs": pa.array(members, long),
        "n_children": pa.array(children, long),
        "n_leaves": pa.array(leaves, long),
        "saved_tokens": pa.array(saved, long),
        "chars": pa.array(chars, long),
        "edge": pa.array(edge, pa.int32()),
        "shard": pa.array([shard] * len(turn), pa.int32()),
    }
    yield from pa.table(columns).to_batches(max_chunksize=1 << 16)


_TREE = (
    "depth long, p1 long, up_p1 long, p2 long, up_p2 long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, chars long, edge int, shard int"
)
_SUMS = ["n_children", "n_leaves", "saved_tokens"]


def _merged(edges: DataFrame) -> DataFrame:
    """Nodes on first and last paths, each once, with what lies below them in every shard."""
    whole = edges.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        *[F.max(c).alias(c) for c in ("up_p1", "up_p2", "chars")],
        *[F.sum(c).alias(c) for c in ("n_convs", *_SUMS)],
    )
    below = (
        whole.filter("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p1").alias("p1"), F.col("up_p2").alias("p2"))
        .agg(F.count("*").alias("more"))
    )
    whole = whole.join(below, NODE, "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    # What a node adds to itself and to every node above it.
    whole = whole.withColumns(
        {
            "n_leaves": F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"),
        }
    ).drop("more", "chars")
    whole = stage(whole, "edges")
    # A path holds all nodes above any of its own, so each node is added along one of its paths.
    path = F.explode(F.filter(F.array(*[_path(bit) for bit in (1, 2)]), lambda p: p.isNotNull()))
    paths = edges.select(*NODE, path.alias("path"))
    owner = paths.groupBy(*NODE).agg(F.min("path").alias("owner"))
    upward = Window.partitionBy("path").orderBy(F.desc("depth"))
    upward = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = ["n_leaves", "saved_tokens"]
    own = paths.join(whole.join(owner, NODE).select(*NODE, "owner", *added), NODE)
    summed = own.select(
        *NODE,
        *[F.sum(F.when(F.col("path") == F.col("owner"), F.col(c)).otherwise(0)).over(upward).alias(c) for c in added],
    )
    totals = summed.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in added])
    return whole.drop(*added).join(totals, NODE)


def _path(bit: int) -> Column:
    return F.when(F.col("edge").bitwiseAND(bit) != 0, 2 * F.col("shard").cast("long") + bit - 1)


def _hashed(rows):
    """Stream the sorted pieces of ids through one SHA-256 per node."""
    node, running = None, None

    def batch_of(done):
        columns = zip(*done, strict=True) if done else [[] for _ in range(4)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [*NODE, "ends_sha256"])

    for batch in rows:
        done = []
        columns = (batch.column(c).to_pylist() for c in (*NODE, "ids"))
        for *this, ids in zip(*columns, strict=True):
            if this != node:
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = this, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield batch_of(done)
    if node is not None:
        yield batch_of([(*node, running.hexdigest())])


def _ends(convs: DataFrame) -> DataFrame:
    """The digest of the ids of the conversations that end at a shared node."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = (
        convs.filter("n = depth")
        .groupBy(*NODE, F.floor(F.col("conv_id") / PIECE_IDS).alias("piece"))
        .agg(ids.alias("ids"))
    )
    sorted_pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return sorted_pieces.mapInArrow(_hashed, "depth long, p1 long, p2 long, ends_sha256 string")


def nodes(members: DataFrame, prefixes: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    `members` names every conversation once (conv_id), also those without turns; `prefixes` are
    their turns as `with_prefixes` returns them.
    """
    least = members.agg(F.min("conv_id")).first()[0]
    # Staged, so that adaptive execution can split a first turn that many conversations share.
    shared = prefixes.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    shared = stage(shared.filter("n > 1").drop("n"), "shared")
    last = F.when(F.col("least").isNotNull(), F.struct(*NODE, "least"))
    known = prefixes.select("conv_id", *NODE).join(shared, NODE, "left")
    left = known.groupBy("conv_id").agg(F.max("depth").alias("n"), F.max(last).alias("last"))
    nothing = F.lit(0).cast("long")
    convs = members.join(left, "conv_id", "left").select(
        "conv_id",
        F.coalesce("n", nothing).alias("n"),
        *[F.coalesce(f"last.{c}", nothing).alias(c) for c in NODE],
        F.coalesce("last.least", F.lit(least).cast("long")).alias("least"),
    )
    convs = stage(convs, "conversations")

    ends = convs.groupBy(*NODE).agg(
        F.count("*").alias("members"),
        F.count(F.when(F.col("n") > F.col("depth"), 1)).alias("tails"),
        F.min("conv_id").alias("first"),
    )
    ends = stage(ends, "weights")
    turn = F.struct(*NODE, "key", "chars")
    along = ends.select(F.col("first").alias("conv_id"), F.col("depth").alias("end")).join(prefixes, "conv_id")
    path = along.filter("depth <= end").groupBy(F.col("conv_id").alias("first"))
    path = path.agg(F.sort_array(F.collect_list(turn)).alias("path"))
    weights = ends.select("members", "tails", "first").join(path, "first", "left")
    paths = stage(
        weights.withColumn("path", F.coalesce("path", F.array().cast(path.schema["path"].dataType))), "paths"
    )
    turns = paths.agg(F.sum(F.size("path"))).first()[0] or 0
    keys = F.transform("path", lambda t: t["key"])
    ranged = paths.repartitionByRange(max(1, math.ceil(turns / shard_turns)), keys)
    tree = stage(ranged.sortWithinPartitions(keys).mapInArrow(_shard_tree, _TREE), "tree")

    merged = stage(_merged(tree.filter("edge > 0")), "merged")
    columns = [*NODE, "conv_id", "n_convs", *_SUMS]
    inner = tree.filter("edge = 0").select(*columns, "parent_conv_id", "up_p1", "up_p2")
    outer = merged.withColumn("parent_conv_id", F.lit(None).cast("long"))
    above = merged.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("p1").alias("up_p1"),
        F.col("p2").alias("up_p2"),
        F.col("conv_id").alias("above"),
    )
    found = inner.unionByName(outer.select(*inner.columns)).join(above, ["depth", "up_p1", "up_p2"], "left")
    found = found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    found = found.join(_ends(convs), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))

    own = F.col("conv_id")
    chains = (
        prefixes.select("conv_id", F.col("depth").alias("at"))
        .join(convs.select("conv_id", "n", "depth", "least"), "conv_id")
        .filter("at > depth")
        .select(
            "conv_id",
            F.col("at").alias("depth"),
            F.when(F.col("at") == F.col("depth") + 1, F.col("least")).otherwise(own).alias("parent_conv_id"),
            F.lit(1).cast("long").alias("n_convs"),
            (F.col("at") < F.col("n")).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"),
            F.when(F.col("at") == F.col("n"), F.sha2(own.cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
        )
    )
    return found.select(*chains.columns).unionByName(chains)


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the conversations as they are."""
    members = conversations.filter("conv_id is not null").select("conv_id").distinct()
    return nodes(members, with_prefixes(numbered(conversations)), shard_turns)


def rebuilt(members: DataFrame, turns: DataFrame) -> DataFrame:
    """Numbered turns in which each conversation c begins like conversation c - c % 100.

    c takes the first h turns of that one (all if it has fewer) for its own first h, where h is the
    CRC of c modulo 6.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("long")
    head = turns.filter("conv_id % 100 = 0 and pos <= 5").select(
        F.col("conv_id").alias("base"), "pos", "key", "chars"
    )
    sizes = head.groupBy("base").agg(F.count("*").alias("size"))
    plan = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"))
    plan = plan.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("size", F.lit(0).cast("long"))))
    plan = stage(plan, "plan")
    borrowed = (
        plan.join(head, "base")
        .filter("pos <= taken")
        .select("conv_id", F.lit(-1).alias("part"), "pos", "key", "chars")  # before any range of its own
    )
    own = (
        turns.join(plan.select("conv_id", "h", "taken"), "conv_id")
        .filter("pos > h")
        .select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "chars")
    )
    return borrowed.unionByName(own)


def digest(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the rebuilt conversations."""
    members = conversations.filter("conv_id is not null").select("conv_id").distinct()
    return nodes(members, with_prefixes(rebuilt(members, numbered(conversations))), shard_turns)
