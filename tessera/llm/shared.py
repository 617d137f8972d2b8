"""Shared folder handling for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset on one machine (a local master, as in tests) a temporary folder is chosen once and stored in the
    session; on a cluster that raises, as executors would write to their own disks.
    """
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def fresh_name(df: DataFrame, tag: str = "key") -> str:
    """A column name that df has not, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{tag}"
    while name in taken:
        name += "_"
    return name


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got.written_to = path
    return got


def release(*tables: DataFrame) -> None:
    """Delete what materialise wrote for these tables; only once nothing that is still to run reads them."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(conf).delete(path, True)
