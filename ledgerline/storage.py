"""Where intermediate tables live.

Ordered scans and iterative operators cut their lineage by writing a table
once into the shared folder the session names in ``spark.checkpoint.dir``.
The written rows (with their row numbers) stay fixed when executors are lost.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CONF = "spark.checkpoint.dir"
_written: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one only in local mode."""
    root = spark.conf.get(_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="ledgerline-")
    spark.conf.set(_CONF, root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates of the rows gathered by the same job while they are written."""
    observed = Observation()
    written = materialize(df.observe(observed, *[c.alias(name) for name, c in counts.items()]))
    return written, observed.get


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables this process has written; call it after the last sink."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
