"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a share of words by its weight, no more than `most` times its own size; the excess
is shared again among the rest. A source takes all its documents as often as its target allows. The
rest of its budget is fitted on counts of documents by exact length: long lengths first, each gets
its proportional number, down to a reserve of `WINDOW` words, and bounded-knapsack dynamic
programming over the lengths left fills the reserve as closely as any choice can. Documents of a
length are then taken in the order of a seeded hash of id and text, rows of one id and text in
that of their other columns, so a rerun takes the same ones in whatever order the rows come.

Counts by length are made by grouped aggregation; a hot source or length is spread over hash
buckets, and only the one bucket in which a length's number ends is ranked.

A null text has size 0 and is never taken; a null source is a source of its own, last in order.
Repeated rows are separate documents of one size. Extra columns are kept; output columns replace
input columns of the same name. Empty tables give empty results.
"""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nabd.llm.common import WORD, packed, unpacked, with_columns
from nabd.plans.staging import stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
SEED = 17
#: Words of a budget that are left to dynamic programming.
WINDOW = 1 << 16
_BUCKET_BITS = 10


def with_size(docs: DataFrame) -> DataFrame:
    """`docs` with `size`, the number of words of the text."""
    count = F.regexp_count("text", F.lit(f"({WORD})"))
    return with_columns(docs, {"size": F.coalesce(count, F.lit(0)).cast("long")})


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target): one row per source, weights in the sources' code-point order."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    spark = sized.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A global rank without one task for all sources: sorted ranges, and an offset for each range.
    ranged = sizes.repartitionByRange(parts, F.col("source").asc_nulls_last())
    ranged = stage(ranged.withColumn("part", F.spark_partition_id()), "sources")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")
    )
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    place = F.pmod(F.col("own") - 1 + F.col("offset"), F.lit(len(weights))).cast("int") + 1
    # One offset for each range, so no more rows than shuffle partitions.
    weighed = ranged.withColumn("own", own).join(F.broadcast(offsets), "part").select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place).alias("weight"),
    )
    weighed = stage(weighed, "weights")
    cap = F.lit(float(most)) * F.col("source_size")
    pool = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, capped = None, -1
    while True:  # each pass is one aggregate; a source that was cut stays cut
        over = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > cap
        row = weighed.agg(
            F.sum(F.when(over, cap)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"),
            F.count_if(over).alias("n"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped = row["n"]
        rate = (pool - (row["fixed"] or 0.0)) / row["open"]
    target = cap if rate is None else F.least(F.col("weight") * F.lit(rate), cap)
    return weighed.select("source", "source_size", target.alias("target"))


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take so that their words come closest below `budget`."""
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    total = sum(lengths[i] * counts[i] for i in order)
    taken = [0] * len(lengths)
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return [c if n > 0 else 0 for n, c in zip(lengths, counts, strict=True)]
    goal, due = max(0, budget - window), 0
    for i in order:  # proportional numbers; what a length leaves over goes to the shorter ones
        due += counts[i] * lengths[i] * goal  # in units of 1 / total words
        taken[i] = min(counts[i], due // (lengths[i] * total))
        due -= taken[i] * lengths[i] * total
    rest = budget - sum(taken[i] * lengths[i] for i in order)
    # Bounded knapsack: bit s of `sums` says that s words can be made of the chunks so far.
    sums, steps = 1, []
    full = (1 << (rest + 1)) - 1
    for i in order:
        left, size = min(counts[i] - taken[i], rest // lengths[i]), 1
        while left and not sums >> rest & 1:
            size = min(size, left)
            steps.append((i, size, sums))
            sums |= (sums << (size * lengths[i])) & full
            left -= size
            size *= 2
    reached = sums.bit_length() - 1
    for i, size, before in reversed(steps):
        if not before >> reached & 1:
            taken[i] += size
            reached -= size * lengths[i]
    return taken


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    window: int = WINDOW,
) -> DataFrame:
    """`docs` with size, source_size, target, and copies: how often the mix takes the document."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("source_size", "target", "copies")])
    sized = with_size(docs)
    targets = stage(source_targets(sized.select("source", "size"), weights, share, most), "targets")
    key = F.when(F.col("source").isNotNull(), F.concat(F.lit("="), "source")).otherwise("")
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    # Texts are known by their digest from here on, so they move only if the caller wants them.
    rows = sized.withColumns(
        {"_nabd_key": key, "_nabd_draw": draw, "_nabd_a": F.xxhash64("text"), "_nabd_b": F.xxhash64(F.lit(1), "text")}
    )
    rows = rows.withColumn("_nabd_bucket", F.shiftrightunsigned("_nabd_draw", 64 - _BUCKET_BITS).cast("int"))
    group = ["_nabd_key", "size"]
    counts = stage(rows.groupBy(*group, "_nabd_bucket").agg(F.count("*").alias("n")), "lengths")
    goals = targets.select(
        key.alias("_nabd_key"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("every"),
    ).withColumn("budget", F.round(F.col("target") - F.col("every") * F.col("source_size")).cast("long"))
    lengths = counts.groupBy(*group).agg(F.sum("n").alias("n")).join(goals, "_nabd_key")

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        budget = int(part["budget"].iloc[0])
        part["extra"] = fit_counts(part["size"].tolist(), part["n"].tolist(), budget, window)
        return part[["_nabd_key", "size", "extra", "every", "source_size", "target"]]

    # One row per source and distinct length, so a group is as long as a source has lengths.
    chosen = lengths.groupBy("_nabd_key").applyInPandas(
        fitted, "_nabd_key string, size long, extra long, every long, source_size long, target double"
    )
    chosen = stage(chosen, "chosen")
    ahead = Window.partitionBy(*group).orderBy("_nabd_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(ahead), F.lit(0))
    plan = (
        counts.withColumn("_nabd_left", before)
        .join(chosen, group)
        .withColumn("_nabd_left", F.col("extra") - F.col("_nabd_left"))
        .select(
            *group, "_nabd_bucket", "source_size", "target",
            F.col("every").alias("_nabd_every"),
            "_nabd_left",
            (F.col("_nabd_left") >= F.col("n")).alias("_nabd_all"),
        )
    )
    planned = rows.join(plan, [*group, "_nabd_bucket"])
    split = ~F.col("_nabd_all") & (F.col("_nabd_left") > 0)
    whole = planned.filter(~split).withColumn("_nabd_more", F.col("_nabd_all").cast("long"))
    # Written only for the rows of the bucket that is split; rows of equal digests are equal rows.
    others = F.to_json(F.struct(*[c for c in docs.columns if c.lower() != "text"]))
    order = Window.partitionBy(*group, "_nabd_bucket").orderBy(
        "_nabd_draw", "doc_id", "_nabd_a", "_nabd_b", F.xxhash64(others), F.xxhash64(F.lit(1), others)
    )
    ranked = planned.filter(split).withColumn("_nabd_more", F.row_number().over(order))
    ranked = ranked.withColumn("_nabd_more", (F.col("_nabd_more") <= F.col("_nabd_left")).cast("long"))
    copies = F.col("_nabd_every") + F.col("_nabd_more")
    out = whole.unionByName(ranked)
    out = with_columns(out, {"copies": F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long")})
    return out.select(*[c for c in out.columns if not c.startswith("_nabd_")])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of `docs`."""
    own = ("doc_id", "text", "source")
    again = F.sequence(F.lit(1), F.col("copies").cast("int"))
    taken = mix(packed(docs, *own), **options).filter("copies > 0")
    return taken.select(*own, "rest", F.explode(again)).select(*unpacked(docs.columns, *own))


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, and taken: the words the mix takes of the document."""
    return mix(docs.select("doc_id", "text", "source"), **options).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
