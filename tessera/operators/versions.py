"""A keyed store in versions: a version is a manifest that names the folder of each bucket of keys.

A commit reads and rewrites only the buckets that it touches; the manifest is written last, so readers see the old
version or the new one. Earlier versions stay readable. The manifest holds for each bucket an order-free fingerprint of the keys that
have text, from which a reader tells whether an index on them has to be fitted anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.operators.tables import written

BUCKETS = 64
MANIFEST = "bucket int, folder string, n long, n_texts long, sum_of_ids decimal(38,0), xor_of_ids long"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions: folders of manifests with their success marker. Bounded by commits, not by rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at)]
    done = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(x.removeprefix("v")) for x in done)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row per bucket of a version, by default the last."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no version {version or ''}".rstrip())
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{known[-1] if version is None else version}")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The store's rows as of a version, by default the last."""
    folders = [r.folder for r in manifest(spark, path, version).select("folder").distinct().collect()]
    return spark.read.parquet(*folders).drop("bucket")


def fingerprint(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, int, int]:
    """Of the keys that have text, whatever the order of rows and buckets: number, sum and exclusive or of their hashes."""
    got = manifest(spark, path, version).agg(F.sum("n_texts"), F.sum("sum_of_ids"), F.bit_xor("xor_of_ids")).first()
    return int(got[0] or 0), int(got[1] or 0), int(got[2] or 0)


def commit(new: DataFrame, path: str, key: str = "item_id", text: str | None = None, buckets: int = BUCKETS) -> int:
    """Merge rows (one per key, as of store.observed) into the store; the number of the new version.

    text: the column whose blank values have no part in the fingerprint. Two commits at once are not for this store: the second
    manifest of one number fails, as its folder exists.
    """
    spark = new.sparkSession
    known = versions(spark, path)
    number = known[-1] + 1 if known else 0
    new = written(new.withColumn("bucket", _bucket(key, buckets)), "commit")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
    folder = f"{path}/data/v{number}-{uuid.uuid4().hex}"
    if known:
        before = manifest(spark, path)
        old = before.where(F.col("bucket").isin(touched)).select("bucket", "folder").collect()
        kept = before.where(~F.col("bucket").isin(touched))
    else:
        old, kept = [], None
    rows = new.drop("bucket")
    if old:
        rows = store.upsert(spark.read.parquet(*[f"{r.folder}" for r in old]).drop("bucket"), rows, key)
    rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    if not touched:
        now = spark.createDataFrame([], MANIFEST)
    else:
        has = F.trim(F.coalesce(F.col(text).cast("string"), F.lit(""))) != "" if text else F.lit(True)
        back = spark.read.schema(rows.schema).parquet(*[f"{folder}/bucket={b}" for b in touched])
        hashed = F.xxhash64(key)
        stats = back.groupBy(_bucket(key, buckets).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(has).alias("n_texts"), F.coalesce(F.sum(F.when(has, hashed).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("sum_of_ids"), F.coalesce(F.bit_xor(F.when(has, hashed)), F.lit(0)).cast("long").alias("xor_of_ids"))
        now = stats.select("bucket", F.concat(F.lit(f"{folder}/bucket="), F.col("bucket").cast("string")).alias("folder"), "n", "n_texts", "sum_of_ids", "xor_of_ids")
    (now if kept is None else kept.unionByName(now)).coalesce(1).write.parquet(f"{path}/manifest/v{number}")
    return number
