"""Session set-up and the shared folder that survives the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "quire", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings the session."""
    n = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, and pins the zone that every query assumes."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the context's checkpoint folder, which lies in the one that
    spark.checkpoint.dir names unless the caller set another.

    Only a local session without either gets a folder of its own; elsewhere its absence is an error,
    because a folder of one machine is lost with that machine.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table into the shared folder and reads it back: lineage ends there.

    The table goes when the application ends, or with sweep().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes the stored tables of this application, which nothing may read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/quire")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """What the engine's statistics say about the size of df: file sizes, for tables as they are read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


SMALL = 16 << 20  # bytes that spread() may move
RANGE = 64 << 20  # bytes of input for one range


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, columns of source, dealt out to all cores if source is a small table (at most SMALL bytes by the
    engine's statistics), which would be one task's work; a larger one stays in the splits it is read in."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if input_bytes(source) <= SMALL else df


def ranges(df: DataFrame) -> int:
    """How many ranges to sort df in: one for RANGE bytes, at least as many as the session's shuffles have."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return own if size >= 1 << 62 else max(own, -(-size // RANGE))  # without statistics the engine says 2^63


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or the next name like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
