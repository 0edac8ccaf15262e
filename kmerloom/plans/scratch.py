"""Intermediate tables in the shared folder, which cut lineage and survive a lost executor.

The folder is the one named by ``spark.checkpoint.dir``; where that is unset (tests), one under the SQL warehouse.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            warnings.warn("spark.checkpoint.dir is not set: intermediate tables go to the warehouse, which all executors must share", stacklevel=3)
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kmerloom_scratch"
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back; the table goes when the JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/kmerloom-{uuid.uuid4().hex}"
    old = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # what the write has shuffled goes when it ends, not when the driver collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if old is None else spark.conf.set(CLEAN, old)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def local_root(spark: SparkSession) -> str | None:
    """The shared folder as a path that Python can open, or None where it is on another file system."""
    root = scratch_root(spark)
    if root.startswith("file:"):
        return "/" + root[5:].lstrip("/")
    if "://" in root:
        return None
    fs, p = _path(spark, root)
    return str(p.toString()) if root.startswith("/") and fs.getScheme() == "file" else None


def remove_at_exit(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, f"file://{path}")
    fs.deleteOnExit(p)


def release(df: DataFrame | None) -> None:
    """Delete the scratch table behind a frame that :func:`cut` returned and nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        fs, p = _path(df.sparkSession, path)
        fs.delete(p, True)
