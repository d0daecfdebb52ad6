"""Stage tables: Parquet reads and writes, load-or-build, lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}

#: Spark's setting to delete a query's shuffle files once it has run.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path``, on any file system that Spark knows."""
    fs, p = _path(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(p)


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, by: Sequence[str], buckets: int, sort_by: Sequence[str]) -> DataFrame:
    """Write a table of the session's catalogue at ``path`` in ``buckets`` files by the hash of ``by``, sorted within each, and
    read it back. Tables with equal buckets of the same columns join and group without an exchange.

    The rows are dealt by the bucket's own hash first, so that a bucket is one file however many tasks wrote.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*sort_by).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def load_or_build(spark: SparkSession, paths: Sequence[str], build: Callable[[], Sequence[DataFrame]], force: bool = False) -> list[DataFrame]:
    """Read the tables if all are complete, else build, write and read them back."""
    if force or not all(complete(spark, p) for p in paths):
        for df, p in zip(build(), paths, strict=True):
            write(df, p)
    return [read(spark, p) for p in paths]


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode (tests) and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: this cuts the lineage, so that a
    lost executor costs one stage at most, and lets several readers share one computation. The shuffle files of
    the write are deleted with its end, rather than when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/matchloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        write(df, path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no later plan reads."""
    if path := getattr(df, "_scratch", None):
        fs, p = _path(df.sparkSession, path)
        fs.delete(p, True)
