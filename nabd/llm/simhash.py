"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two fingerprints that differ in at most d bits are cut into d segments,
one fewer than equality of one segment needs: a segment is equal, or every segment differs in one
bit. An equal segment leaves d bits at most in the rest, of whose d + 1 parts one is equal: each
segment is indexed with each part. If every segment differs in one bit, the first is equal with that
bit left out (a one-wildcard variant), and so is one half of the second and one of the third: each
variant is indexed with each choice of halves. Long keys keep unrelated fingerprints apart. An
equality join of the keys finds every pair, and the whole distance is verified inside the join.

Copies are folded first: all work is on distinct fingerprints. Fingerprints that differ in one bit
share a 63-bit variant, where a link to the variant's smallest member stands for all pairs; the
classes this gives are contracted before segments are compared, and within a bucket only members
outside its first class are compared with the rest, so a group of near copies is never paired with
itself.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and ties
share a fingerprint, hence a component. Rows without a doc_id link others and have the component_id
of theirs, null if no row of the component has a doc_id. Extra columns are kept; columns named `fingerprint` or
`component_id` are replaced. Empty tables give empty results.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nabd.llm.common import slices
from nabd.operators.graph import component_labels
from nabd.plans.staging import stage

BITS = 64
SEED = 42
_HASHES_AT_ONCE = 1 << 14


def fingerprint_of(text: bytes | None, shingle: int = 4) -> int:
    """Majority bit of the XXH64 of all word shingles, as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # both touch ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = (digest(g, SEED) for g in grams)
    for start in range(0, n, _HASHES_AT_ONCE):
        count = min(_HASHES_AT_ONCE, n - start)
        block = np.fromiter(hashes, np.uint64, count).astype(">u8").view(np.uint8)
        ones += np.unpackbits(block.reshape(count, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row per document with its fingerprint as a signed long."""

    def batches(rows):
        for batch in slices(rows):
            texts = batch.column("text").cast(pa.binary())
            fps = [fingerprint_of(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"]
            )

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of `parts` equal runs of the given bit positions."""
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[low:high]) for low, high in zip(edges, edges[1:], strict=False)]


def _positions(mask: int) -> list[int]:
    return [b for b in range(BITS) if mask >> b & 1]


def index_masks(max_distance: int) -> tuple[list[int], list[list[int]]]:
    """The masks of the index and, for each, masks that must differ for a pair to be taken there.

    A pair meets under every mask its difference avoids. It is taken at its first equal segment and
    the first equal part of the rest; pairs without an equal segment meet under one mask alone.
    """
    whole = (1 << BITS) - 1
    segments = _cut(list(range(BITS)), max_distance)
    masks, before = [], []
    for i, segment in enumerate(segments):
        rest = _positions(whole & ~segment)
        parts = _cut(rest, max_distance + 1) if rest else []
        for j, part in enumerate(parts):
            masks.append(segment | part)
            before.append(segments[:i] + parts[:j])
    halves = [_cut(_positions(s), 2) for s in segments[1:3]]
    for bit in _positions(segments[0]):
        for chosen in itertools.product(*halves):
            masks.append(segments[0] & ~(1 << bit) | sum(chosen))
            before.append(segments)
    return masks, before


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def _variants(fp: Column, masks: list[int]) -> Column:
    return F.posexplode(F.array(*[fp.bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("bit", "part")


def one_bit_links(classes: DataFrame) -> DataFrame:
    """(a, b): each member of a 63-bit variant linked to the variant's smallest fingerprint."""
    whole = (1 << BITS) - 1
    masks = [whole & ~(1 << bit) for bit in range(BITS)]
    return (
        classes.select("fp", _variants(F.col("fp"), masks))
        .groupBy("bit", "part")
        .agg(F.min("fp").alias("a"), F.max("fp").alias("b"))  # a 63-bit variant has two members at most
        .filter("a < b")
        .select("a", "b")
        .distinct()
    )


def segment_links(classes: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): links between different components of `classes` (fp, component).

    Spark sizes the keyed table by that of `classes`, though it has a row for each mask: where that
    looks small enough for a broadcast, all keys would go through the driver. So both joins merge.
    """
    masks, before = index_masks(max_distance)
    keyed = classes.select("fp", "component", _variants(F.col("fp"), masks))
    keys = ["bit", "part"]
    # One component of each bucket needs no comparison with itself; buckets within one component go.
    first = keyed.groupBy(*keys).agg(
        F.min("component").alias("first"), F.max("component").alias("last")
    ).filter("first < last").drop("last")
    mixed = keyed.join(first.hint("merge"), keys)
    left = mixed.select(*keys, "fp", "component")
    right = mixed.filter("component <> first").select(
        *keys, F.col("fp").alias("fp2"), F.col("component").alias("component2")
    )
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    near = F.bit_count(differ) <= max_distance
    once = F.lit(True)
    for i in range(max(map(len, before))):
        earlier = _longs([b[i] if i < len(b) else -1 for b in before])  # -1: every pair differs there
        once &= differ.bitwiseAND(F.get(earlier, F.col("bit"))) != 0
    return (
        left.join(right.hint("merge"), keys)
        .filter(near & once & (F.col("component") != F.col("component2")))
        .select(
            F.least("component", "component2").alias("a"),
            F.greatest("component", "component2").alias("b"),
        )
        .distinct()
    )


def with_components(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of near fingerprints."""
    if not 1 <= max_distance <= 16:
        raise ValueError(f"max_distance must be 1 to 16: {max_distance}")
    fps = stage(with_fingerprint(docs, shingle), "fingerprints")
    # Classes are linked by fingerprint, which is never null; a doc_id may be.
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    near = component_labels(classes.withColumn("id", F.col("fp")), one_bit_links(classes)).drop("id")
    near = stage(near, "one-bit")
    links = stage(segment_links(near, max_distance), "links")
    parts = near.groupBy("component").agg(F.min("least").alias("least"))
    nodes = parts.select(F.col("component").alias("id"), "least")
    top = component_labels(nodes, links).select("id", "least", F.col("component").alias("whole"))
    top = stage(top, "parts")
    named = top.groupBy("whole").agg(F.min("least").alias("component_id"))
    names = top.join(named, "whole").select(F.col("id").alias("component"), "component_id")
    labels = near.join(names, "component").select("fp", "component_id")
    return fps.join(labels, "fp", "left")


def dedup(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """The documents with the smallest doc_id of their component, one row for each.

    Of rows that repeat a doc_id the one with the smallest text stays (null first). Rows without
    a doc_id have no identity to compare and stay.
    """
    found = stage(with_components(docs, shingle, max_distance), "components")
    per_id = found.filter("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("component_id").alias("component_id")
    )
    copies = per_id.filter("doc_id <> component_id").select("doc_id")
    repeated = per_id.filter("doc_id = component_id and n > 1").select("doc_id")
    once = docs.join(copies.unionByName(repeated), "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c != "text"])
    rest = docs.join(repeated, "doc_id", "left_semi").withColumn("_nabd_n", F.row_number().over(order))
    first = rest.filter("_nabd_n = 1").drop("_nabd_n")
    return once.unionByName(first).select(*docs.columns)


def digest(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return with_components(docs, shingle, max_distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
