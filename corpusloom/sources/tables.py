"""Table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    The session's setting wins. Where it is unset, a folder of this machine is used if all executors are on it (local
    masters), and refused on a cluster, whose executors would not share it. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go with their frames; the local folder is removed at exit.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corpusloom-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager)


def release(spark: SparkSession) -> None:
    """Lets go the shuffle files and checkpoints of frames that are no longer held. Spark deletes them when the driver's
    garbage is collected, which a small heap may not need for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
