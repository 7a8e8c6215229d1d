"""Dataset files to canonical posts."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nabd.functions.text import strip
from nabd.functions.values import safe_int_number, safe_int_text
from nabd.plans.staging import release, stage
from nabd.schema import CANONICAL_POST, COUNTERS
from nabd.sources.catalog import Dataset, resolve

_RANGES = 4096


def read_csv(spark: SparkSession, path: str, multiline=True) -> DataFrame:
    """CSV with a header, plain or .gz, quotes doubled inside quotes; every column is text.

    `multiline` keeps line breaks inside quotes, which makes a file one task. Turn it off for
    corpora without such breaks to let Spark split their files. A folder is read under the header
    of its first file, and reading fails if another file has other columns or another order.
    """
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON value per line as a variant column `v`; blank and malformed lines are skipped."""
    lines = spark.read.option("lineSep", "\n").text(path)
    parsed = lines.select(F.try_parse_json(F.make_valid_utf8("value")).alias("v"))
    return parsed.filter(F.col("v").isNotNull())


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _canonical(text: Column, values: dict, meta: Dataset) -> list[Column]:
    columns = {**values, "text": strip(text), "source_dataset": F.lit(meta.id)}
    return [columns[f.name].cast(f.dataType).alias(f.name) for f in CANONICAL_POST.fields]


def to_canonical(raw: DataFrame, meta: Dataset) -> DataFrame:
    """Rename a dataset's own columns to the canonical ones; rows without text are dropped."""
    kinds = {f.name: f.dataType for f in raw.schema.fields}

    def value(name: str) -> Column:
        source = meta.fields.get(name)
        if source is None or source not in kinds:
            return F.lit(meta.language if name == "lang" else None)
        column = F.col(f"`{source}`")
        if name not in COUNTERS:
            return column.cast("string")
        is_text = isinstance(kinds[source], T.StringType)
        return safe_int_text(column) if is_text else safe_int_number(column)

    values = {
        f.name: value(f.name)
        for f in CANONICAL_POST.fields
        if f.name not in ("text", "source_dataset")
    }
    for name in COUNTERS:
        values[name] = F.coalesce(values[name].cast("bigint"), F.lit(0))
    source = meta.fields["text"]
    has_text = isinstance(kinds.get(source), T.StringType)
    text = F.col(f"`{source}`") if has_text else F.lit(None).cast("string")
    return raw.select(*_canonical(text, values, meta)).filter("text <> ''")


def variant_to_canonical(raw: DataFrame, meta: Dataset) -> DataFrame:
    """The same for JSON lines, where every line has its own types."""
    v = F.col("v")

    def path(source: str) -> str:
        quoted = source.replace("\\", "\\\\").replace("'", "\\'")
        return f"$['{quoted}']"

    def kind(source: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path(source), "variant"))

    def value(name: str) -> Column:
        source = meta.fields.get(name)
        if source is None:
            return F.lit(meta.language if name == "lang" else None)
        if name not in COUNTERS:
            found = F.try_variant_get(v, path(source), "string")
            if name == "lang":
                missing = F.try_variant_get(v, path(source), "variant").isNull()
                return F.when(missing, F.lit(meta.language)).otherwise(found)
            return found
        as_text = safe_int_text(F.try_variant_get(v, path(source), "string"))
        number = safe_int_number(F.try_variant_get(v, path(source), "double"))
        whole = F.try_variant_get(v, path(source), "bigint")
        return F.when(kind(source) == "STRING", as_text).otherwise(F.coalesce(whole, number))

    values = {
        f.name: value(f.name)
        for f in CANONICAL_POST.fields
        if f.name not in ("text", "source_dataset")
    }
    for name in COUNTERS:
        values[name] = F.coalesce(values[name].cast("bigint"), F.lit(0))
    source = meta.fields["text"]
    text = F.when(kind(source) == "STRING", F.try_variant_get(v, path(source), "string"))
    return raw.select(*_canonical(text, values, meta)).filter("text <> ''")


def read_dataset(spark: SparkSession, meta: Dataset, multiline=True) -> DataFrame:
    """Canonical posts of one dataset, by its file format."""
    if not meta.path:
        raise ValueError(f"dataset {meta.id} has no path")
    kind = (meta.file_format or "").lower()
    if kind == "csv":
        return to_canonical(read_csv(spark, meta.path, multiline), meta)
    if kind == "jsonl":
        return variant_to_canonical(read_jsonl(spark, meta.path), meta)
    if kind == "parquet":
        return to_canonical(read_parquet(spark, meta.path), meta)
    raise ValueError(f"unsupported file_format: {kind}")


def with_post_id(posts: DataFrame) -> DataFrame:
    """Add `post_id` in reading order: input split first, then position in the split."""
    return posts.select(F.monotonically_increasing_id().alias("post_id"), "*")


def union_datasets(
    spark: SparkSession,
    catalog: Sequence[Dataset],
    dataset_ids: Sequence[str] | None = None,
    max_total_rows: int | None = None,
    max_rows_per_dataset: int | None = None,
    skipped: list | None = None,
) -> DataFrame:
    """Posts of several datasets in list order, with post ids in that order.

    A dataset that cannot be opened stops the union, unless a list `skipped` is given: then it is
    left out, and its id and the error go there. Caps are off unless given, and zero means not given.
    """
    chosen = resolve(catalog, dataset_ids)
    frames = []
    for meta in chosen:
        try:
            frames.append(read_dataset(spark, meta))
        except Exception as error:
            if skipped is None:
                raise
            skipped.append((meta.id, str(error)))
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField("post_id", T.LongType()), *CANONICAL_POST.fields]))
    posts = with_post_id(reduce(DataFrame.unionByName, frames))
    if max_total_rows or max_rows_per_dataset:
        order = [meta.id for meta in chosen]
        posts = capped(posts, order, max_total_rows or None, max_rows_per_dataset or None)
    return posts


def _cutoffs(ids: DataFrame, wanted: dict[str, tuple[int, int, int]]) -> dict[str, int]:
    """The n-th smallest post_id of each dataset, where `wanted` gives (n, smallest, largest).

    Ids are counted in ranges, then in ranges of the one range that holds the n-th, and so on, so that
    no id is ever sorted. Ids are numbered within input splits, which leaves most ranges of the first
    pass empty; later passes see full ones.
    """
    found: dict[str, int] = {}
    state = "source_dataset string, need long, lo long, hi long"
    while wanted:
        rows = [(name, *values) for name, values in wanted.items()]
        open_ = F.broadcast(ids.sparkSession.createDataFrame(rows, state))  # one row per dataset of the list
        width = F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(_RANGES))
        inside = ids.join(open_, "source_dataset").filter("post_id between lo and hi")
        ranges = inside.groupBy(
            "source_dataset", "need", F.floor((F.col("post_id") - F.col("lo")) / width).alias("_range")
        ).agg(F.count("*").alias("n"), F.min("post_id").alias("first"), F.max("post_id").alias("last"))
        earlier = Window.partitionBy("source_dataset").orderBy("_range")
        upto = F.sum("n").over(earlier)
        placed = ranges.withColumn("before", upto - F.col("n")).filter("before < need and need <= before + n")
        wanted = {}
        for r in placed.collect():
            left = r["need"] - r["before"]
            if left == r["n"]:
                found[r["source_dataset"]] = r["last"]
            elif left == 1:
                found[r["source_dataset"]] = r["first"]
            else:
                wanted[r["source_dataset"]] = (left, r["first"], r["last"])
    return found


def capped(
    posts: DataFrame,
    dataset_order: Sequence[str],
    max_total_rows: int | None = None,
    max_rows_per_dataset: int | None = None,
) -> DataFrame:
    """The first rows of each dataset by post_id, and of all datasets in list order.

    Only ids are counted, to find the last one of each dataset; the posts themselves are filtered by
    it, in the scan and without a shuffle. Post ids are unique.
    """
    ids = stage(posts.select("source_dataset", "post_id"), "ids")
    sizes = ids.filter("source_dataset is not null").groupBy("source_dataset").agg(
        F.count("*").alias("n"), F.min("post_id").alias("lo"), F.max("post_id").alias("hi")
    )
    place = {name: i for i, name in enumerate(dataset_order)}
    total = max_total_rows or float("inf")
    last, wanted = {}, {}
    for r in sorted(sizes.collect(), key=lambda r: (place.get(r["source_dataset"], -1), r["source_dataset"])):
        take = min(r["n"], max_rows_per_dataset or r["n"], total)
        total -= take
        if take == r["n"]:
            last[r["source_dataset"]] = r["hi"]
        elif take > 0:
            wanted[r["source_dataset"]] = (int(take), r["lo"], r["hi"])
    last |= _cutoffs(ids, wanted)
    release(ids)
    bounds = posts.sparkSession.createDataFrame(list(last.items()), "source_dataset string, _last long")
    kept = posts.join(F.broadcast(bounds), "source_dataset").filter("post_id <= _last")
    return kept.select(*posts.columns)


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input is small but sits in too few splits.

    Large inputs already come in more splits than cores and are returned as they are.
    """
    context = df.sparkSession.sparkContext
    cores = context.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores * 2) if size < cores * (128 << 20) else df
