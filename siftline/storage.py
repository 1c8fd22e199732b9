"""Tables cut from their lineage: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it; a folder of its own only where it is unset on a local master, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def settle(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder. What reads it neither plans nor computes it again, and it outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more."""
    for df in settled:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
