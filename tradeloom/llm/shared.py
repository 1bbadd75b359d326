"""What the operators share: reading tables, cutting lineage, sizing partitions, parquet by Spark only."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


#: Rows that Spark hands to Python at once. Texts are long, and the default of 10,000 holds their bytes twice, outside
#: the heap and in the worker.
BATCH_ROWS = 1000
#: Seconds in which Python's references to frames get to the JVM.
RELEASE_S = 1.0


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands BATCH_ROWS rows at most to Python at once; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from whatever store the path names."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset and the master is local (tests) a local folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-", dir=os.environ.get("TMPDIR")))
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df written to the cluster's checkpoint folder and read from there: later jobs survive lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more; it looks when the driver collects garbage.

    Python gives its references to the JVM's frames back in a thread of its own, some time after they end; a collection before that
    finds every frame in use. Nothing depends on the files going: where they stay, they only take room for longer."""
    gc.collect()
    time.sleep(RELEASE_S)
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
