"""Tables that grow from run to run: folders of segments, each written once and counted when complete.

A segment is a folder of its own that holds the engine's commit mark once its job has ended. A failed or
repeated job leaves nothing that counts twice, and writers don't touch each other's segments; two of
them may hold the same key, so readers take one row per key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.session import shared_dir


def kept_dir(spark: SparkSession, name: str) -> str:
    """Where a table that outlives its run lies: beside the checkpoints, in the folder that
    spark.checkpoint.dir names; in a session without one, in the session's own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or shared_dir(spark)
    return f"{named.rstrip('/')}/quire-kept/{name}"


def segments(spark: SparkSession, path: str) -> list[str]:
    """The complete segments under path, in order of name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    own = [s.getPath().toString() for s in fs.listStatus(folder) if s.isDirectory()]
    mark = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
    return sorted(p for p in own if fs.exists(mark(p)))


def read_segments(spark: SparkSession, paths: list[str], schema) -> DataFrame | None:
    return spark.read.schema(schema).parquet(*paths) if paths else None


def add_segment(df: DataFrame, path: str, name: str | None = None) -> str:
    """Writes df as a segment; one of the same name that was broken off is replaced."""
    own = f"{path}/{name or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(own)
    return own
