"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch on its way to Python.
BATCH_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder is set on a
    local master; on a cluster, ValueError."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not held.isDefined():
        master = spark.sparkContext.master
        if not found and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="memloom-"))
    return found or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, its batches bounded by bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what is used several times is computed once, and survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/memloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete_stored(df: DataFrame) -> None:
    """Delete a ``stored`` table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
