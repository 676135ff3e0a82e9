"""Session helpers: shared checkpoints, size-checked broadcasts, table access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few fixed-width columns) may be broadcast after its rows were counted.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: the session's spark.checkpoint.dir. Only a local session (tests) gets one of its own; on a
    cluster a folder of one machine would lose what other machines write, so there a missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not (sc.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(configured or "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """A result as a Parquet table in the shared checkpoint folder: like cut_lineage, for results that are read more than once by different
    columns. The tables of a session are removed when the driver ends; checkpoints are removed by spark.cleaner.referenceTracking.cleanCheckpoints."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session has ended before
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a result once in the shared checkpoint folder, so that several readers reuse it and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only if the counted rows stay below BROADCAST_ROWS; otherwise the join shuffles. ``df`` must be narrow."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
