"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder only where it is unset and the master is local (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="lattice-")
        spark.sparkContext.setCheckpointDir(configured)
        configured = spark.sparkContext.getCheckpointDir() or configured
    return configured.rstrip("/")


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of at most ``most`` bytes: long texts must not add up to what a worker cannot hold.

    Only a larger or unbounded setting is lowered, for the rest of the session, as plans run later than they are
    made; the user's smaller one stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the files."""
    path = f"{shared_dir(spark)}/lattice-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattice_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables written by :func:`stored` that no plan reads any more."""
    for table in tables:
        path = getattr(table, "_lattice_path", None)
        if path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
