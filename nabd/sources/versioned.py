"""Small keyed tables that are changed in place of readers: bucketed files behind a manifest.

Rows are dealt into a fixed number of buckets by the hash of their key, so the number of files does
not grow with the keys. A change writes new files for the buckets it touches and then a manifest
that names the files of every bucket; renaming the manifest to its number commits the change at
once. A reader sees the last committed version, a failed change leaves it as it was, and a change
that is repeated gives the same rows. One writer at a time: a second one finds its number taken.

Rows without a key are left out. The file system must rename atomically, as HDFS does.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nabd.plans.staging import exists, release, stage

BUCKETS = 64
#: Versions whose files stay for readers that began with them.
KEPT_VERSIONS = 10
_MANIFESTS = "_manifests"


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, f"{path}/{_MANIFESTS}"):
        return []
    fs, folder = _fs(spark, f"{path}/{_MANIFESTS}")
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name[0].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """bucket -> folder of its files."""
    text = spark.read.text(f"{path}/{_MANIFESTS}/{version}.json", wholetext=True).first()[0]
    return {int(bucket): folder for bucket, folder in json.loads(text).items()}


def _commit(spark: SparkSession, path: str, version: int, folders: dict[int, str]) -> None:
    fs, target = _fs(spark, f"{path}/{_MANIFESTS}/{version}.json")
    _, waiting = _fs(spark, f"{path}/{_MANIFESTS}/_{uuid.uuid4().hex}")
    stream = fs.create(waiting, False)
    stream.write(bytearray(json.dumps(folders), "utf-8"))
    stream.close()
    if fs.exists(target) or not fs.rename(waiting, target):
        fs.delete(waiting, False)
        raise RuntimeError(f"version {version} of {path} was committed by another writer")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Replace the rows of exactly the keys in `rows`; rows of other keys stay."""
    spark = rows.sparkSession
    fresh = stage(rows.filter(F.col(key).isNotNull()).withColumn("_bucket", _bucket(key, buckets)), "upsert")
    touched = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]
    versions = _versions(spark, path)
    folders = _manifest(spark, path, versions[-1]) if versions else {}
    merged = fresh
    before = [folders[b] for b in touched if b in folders]
    if before:
        old = spark.read.schema(rows.schema).parquet(*before)
        kept = old.join(fresh.select(key), key, "left_anti").withColumn("_bucket", _bucket(key, buckets))
        merged = merged.unionByName(kept)
    if touched:
        name = f"{path}/v-{uuid.uuid4().hex}"
        merged.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(name)
        folders |= {b: f"{name}/_bucket={b}" for b in touched}
    if touched or not versions:
        _commit(spark, path, versions[-1] + 1 if versions else 0, folders)
        _forget(spark, path)
    release(fresh)


def _forget(spark: SparkSession, path: str) -> None:
    """Delete manifests, and files that only they name, of versions that are no longer kept."""
    versions = _versions(spark, path)
    kept = [_manifest(spark, path, v) for v in versions[-KEPT_VERSIONS:]]
    named = {folder for manifest in kept for folder in manifest.values()}
    for version in versions[:-KEPT_VERSIONS]:
        for folder in set(_manifest(spark, path, version).values()) - named:
            fs, target = _fs(spark, folder)
            fs.delete(target, True)
        fs, target = _fs(spark, f"{path}/{_MANIFESTS}/{version}.json")
        fs.delete(target, False)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The last committed version; empty when there is none."""
    versions = _versions(spark, path)
    folders = list(_manifest(spark, path, versions[-1]).values()) if versions else []
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)
