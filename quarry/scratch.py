"""Tables in the shared folder that a session names, for what is computed once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset in local mode (tests), a new local one is set and used."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a scratch table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        at = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if at.getName().startswith("quarry-"):
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a scratch table; as it is on a cluster that names no folder, or if it is a stream."""
    spark = df.sparkSession
    if df.isStreaming or not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local")):
        return df
    return materialize(df, name)
