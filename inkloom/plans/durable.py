"""Cutting lineage with tables written to the folder that all executors share.

Iterative operators write their state as Parquet under `spark.checkpoint.dir`
and read it again: the result outlives any executor, nothing is computed twice
and the files are compressed. Only where that setting is absent and the master is
this machine (tests) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster, or one of our own without one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="inkloom-")
    return "file://" + _own[sc.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table, if the session is still there."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder is the cluster's
        pass


class Scratch:
    """The written tables of one call; drop() deletes those not needed again."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/inkloom-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(remove, spark, self.base)

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._inkloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_inkloom_path", None):
            remove(self.spark, path)

    def release(self) -> None:
        """Has Spark delete the shuffle files of the steps that have ended, which it
        does when the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()
