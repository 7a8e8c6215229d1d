"""Sharding by extendible hashing.

The directory is indexed by leading bits of a seeded 64-bit hash of the document id. A bucket
whose texts exceed `max_bytes` splits on its next bit; all others stay as they are, until every
bucket fits. Sums are taken `STEP` bits at a time for the oversized buckets alone, so the number of
passes grows with the logarithm of the data, and no bucket is ever gathered in one task.

Rows whose ids have the same hash cannot be told apart by bits. If they exceed the limit together,
they are cut into pieces by their running size: small ones into half limits, so that a piece with
its last row still fits, larger ones each on their own. Equal rows are folded to one with a count
before that, and running sums are taken over buckets of the texts' hash, then inside each bucket,
on numbers alone. A document larger than the limit is a shard of its own, and only such a shard
exceeds the limit. A null text has 0 bytes; a null id is hashed like any other. Rows of one id and
text that differ in other columns may change places between runs. Extra columns of any name are
kept; columns named `shard` or `shard_bytes` are replaced. Empty tables give empty results.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nabd.llm.common import packed, unpacked, with_columns
from nabd.plans.staging import stage

MAX_BYTES = 4 << 20
SEED = 29
STEP = 8
BITS = 64
#: Directory entries that any data can have up to a depth of 16 bits: a broadcast of proven size.
_FEW = 2 * STEP
#: Buckets of one hash's texts, over which running sizes are taken first.
PIECE_BITS = 12
#: Copies of one row that are written out again by one task.
COPIES = 1 << 14


def _prefix(depth: int) -> Column:
    """The first `depth` bits of the hash, as a number."""
    return F.shiftrightunsigned("_hash", BITS - depth) if depth else F.lit(0).cast("long")


def _split(max_bytes: int, depth: int):
    """The part of the directory below one oversized bucket, from sums by its next STEP bits.

    At most 2**STEP rows in. One row out for each: the shard it belongs to, or null where the
    bucket at the end of these bits is still too large and holds more than one hash.
    """
    top = 1 << STEP

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        size, low, high = [0] * (2 * top), [None] * (2 * top), [None] * (2 * top)
        for row in rows.itertuples():
            node = top + int(row.path) % top
            size[node], low[node], high[node] = int(row.bytes), int(row.low), int(row.high)
        for node in range(top - 1, 0, -1):
            halves = [n for n in (2 * node, 2 * node + 1) if low[n] is not None]
            if halves:
                size[node] = sum(size[n] for n in halves)
                low[node] = min(low[n] for n in halves)
                high[node] = max(high[n] for n in halves)
        base = int(rows["path"].iloc[0]) >> STEP
        out = []
        for path in map(int, rows["path"]):
            for bits in range(1, STEP + 1):
                node = (top + path % top) >> (STEP - bits)
                one = low[node] == high[node]
                if size[node] <= max_bytes or one:
                    own = (base << bits) | (node - (1 << bits))
                    name = format(own % (1 << BITS), f"0{depth + bits}b")
                    out.append((path, name, size[node], size[node] > max_bytes))
                    break
            else:
                out.append((path, None, size[node], False))
        return pd.DataFrame(out, columns=["path", "shard", "shard_bytes", "over"])

    return split


def directory(sizes: DataFrame, max_bytes: int) -> list[tuple[int, DataFrame]]:
    """(depth, entries): entries (path, shard, shard_bytes, over) for each STEP bits of depth."""
    parts, depth, rows = [], 0, sizes
    while True:
        ahead = depth + STEP
        sums = rows.groupBy(_prefix(ahead).alias("path")).agg(
            F.sum("_size").alias("bytes"), F.min("_hash").alias("low"), F.max("_hash").alias("high")
        )
        schema = "path long, shard string, shard_bytes long, over boolean"
        entries = sums.groupBy(F.shiftright("path", STEP).alias("base") if depth else F.lit(0).alias("base"))
        entries = stage(entries.applyInPandas(_split(max_bytes, depth), schema), "directory")
        parts.append((ahead, entries.filter("shard is not null")))
        still = entries.filter("shard is null").select("path")
        if still.isEmpty():
            return parts
        rows = rows.join(still, _prefix(ahead) == F.col("path"), "left_semi")
        depth = ahead


def with_shard(docs: DataFrame, max_bytes: int = MAX_BYTES, seed: int = SEED) -> DataFrame:
    """`docs` with `shard`, the bits of its directory entry, and `shard_bytes`."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "shard_bytes")])
    keys = {
        "_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
        "_hash": F.xxhash64(F.lit(seed), "doc_id"),
    }
    columns = docs.columns
    rows = packed(docs, "doc_id", "text").withColumns(keys)
    total = rows.agg(F.sum("_size")).first()[0] or 0
    if total <= max_bytes:  # the directory is one bucket of depth 0
        return docs.withColumns({"shard": F.lit(""), "shard_bytes": F.lit(total).cast("long")})
    placed = None
    for depth, entries in directory(rows.select("_size", "_hash"), max_bytes):
        entries = entries.select(
            F.col("path").alias("_path"), F.struct("shard", "shard_bytes", "over").alias(f"_at{depth}")
        )
        entries = F.broadcast(entries) if depth <= _FEW else entries
        rows = rows.join(entries, _prefix(depth) == F.col("_path"), "left").drop("_path")
        found = F.col(f"_at{depth}")
        placed = found if placed is None else F.coalesce(placed, found)
    rows = rows.withColumn("_at", placed).select("doc_id", "text", "rest", "_size", "_hash", "_at.*")
    out = rows.filter("not over").drop("over", "_size", "_hash")
    out = out.unionByName(_pieces(rows.filter("over"), max_bytes))
    return out.select(*unpacked(columns, "doc_id", "text"), "shard", "shard_bytes")


def _pieces(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Rows of one hash that exceed the limit together, in pieces that fit."""
    half = max(1, max_bytes // 2)
    folded = rows.groupBy("doc_id", "text", "rest", "shard", "_hash", "_size").agg(F.count("*").alias("n"))
    # Staged, so that the numbers are the same for every reader.
    folded = stage(folded.withColumn("_id", F.monotonically_increasing_id()), "oversized")
    large = F.col("_size") > half
    amount = F.when(large, F.col("n")).otherwise(F.col("n") * F.col("_size"))
    order = F.xxhash64("text")
    narrow = folded.select(
        "_id", "_hash", large.alias("large"), amount.alias("amount"), order.alias("order"),
        F.shiftrightunsigned(order, 64 - PIECE_BITS).alias("bucket"),
    )
    narrow = stage(narrow, "oversized-sizes")
    group = ["_hash", "large"]
    # At most 2 ** PIECE_BITS rows for each hash.
    ahead = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = narrow.groupBy(*group, "bucket").agg(F.sum("amount").alias("all"))
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("all").over(ahead), F.lit(0)))
    inside = Window.partitionBy(*group, "bucket").orderBy("order", "_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("amount").over(inside), F.lit(0))
    starts = narrow.join(buckets, [*group, "bucket"]).select("_id", "large", before.alias("before"))
    last = F.col("n") - 1
    first = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long")))
    copies = folded.join(starts, "_id").withColumn("first", first).repartition("_id", "first")
    one = F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES - 1, last)))
    copies = copies.withColumn("k", one)
    own = F.concat(F.lit("l"), (F.col("before") + F.col("k") + 1).cast("string"))
    shared = F.concat(F.lit("s"), F.floor((F.col("before") + F.col("k") * F.col("_size")) / half).cast("string"))
    named = copies.withColumn("shard", F.concat_ws(".", "shard", F.when(F.col("large"), own).otherwise(shared)))
    sizes = named.groupBy("shard").agg(F.sum("_size").alias("shard_bytes"))
    return named.select("doc_id", "text", "rest", "shard").join(sizes, "shard")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the documents as Parquet, one folder per shard."""
    sharded = with_shard(docs, **options)
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, bytes, shard and shard_bytes of every document."""
    sharded = with_shard(docs.select("doc_id", "text"), **options)
    size = {"bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")}
    return with_columns(sharded, size).select("doc_id", "bytes", "shard", "shard_bytes")
