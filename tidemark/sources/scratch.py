"""Tables written between the steps of an iterative or streaming job, in the folder the cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and everything runs on one machine, as in tests.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DIR
    return base.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the Python process ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df through Parquet: its lineage ends here, and lost executors lose nothing."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, at: str) -> None:
    try:
        jvm = spark._jvm
        for p in (at, f"{at}-checkpoint"):
            place = jvm.org.apache.hadoop.fs.Path(p)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass
