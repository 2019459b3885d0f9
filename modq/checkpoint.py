"""Reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    The folder comes from ``spark.checkpoint.dir`` (shared storage on a cluster).  Only a local master may do without: there a
    folder under the warehouse directory is used; on a cluster a missing setting is an error, as executors could not read each
    other's files.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Remove the shuffle files and checkpoints of frames that are no longer referenced.

    They stay until the driver collects its garbage, and its listeners and scheduler hold the last query until another one ends.
    """
    for _ in range(2):
        gc.collect()
        spark.range(1).collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
