"""Vector tables on disk, with a manifest of their metric and dimension; export bundles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def save(rows: DataFrame, path: str, metric: str, dimension: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    manifest = rows.sparkSession.createDataFrame([(metric, dimension)], "metric string, dimension int")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and the manifest; FileNotFoundError where there is none."""
    try:
        manifest = spark.read.json(f"{path}/manifest").first()
        return spark.read.parquet(f"{path}/rows"), manifest.asDict()
    except AnalysisException as missing:
        raise FileNotFoundError(path) from missing


def export(rows: DataFrame, path: str, metric: str, dimension: int, settings: dict | None = None, model: str | None = None) -> None:
    """An index with the settings it was built with, a copy of the folder of a model, and a manifest of what is there."""
    save(rows, f"{path}/index", metric, dimension)
    given = sorted((str(k), str(v)) for k, v in (settings or {}).items())
    rows.sparkSession.createDataFrame(given, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
    spark, parts = rows.sparkSession, ["index", "settings"]
    if model:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        start, end = (jvm.org.apache.hadoop.fs.Path(p) for p in (model, f"{path}/model"))
        jvm.org.apache.hadoop.fs.FileUtil.copy(start.getFileSystem(conf), start, end.getFileSystem(conf), end, False, True, conf)
        parts.append("model")
    listed = spark.createDataFrame([(parts, metric, dimension)], "parts array<string>, metric string, dimension int")
    listed.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
