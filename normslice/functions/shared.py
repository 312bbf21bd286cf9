"""Tables in the folder that driver and executors share: written once, read again, so lineage is cut and lost executors cost nothing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def show_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster, ship it with ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def in_arrow(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """``df.mapInArrow``, on workers that find this package."""
    show_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it. Unset, a local session gets a temporary folder and a cluster an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), f"normslice-{context.applicationId}")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver's Python ends."""
    path = f"{checkpoint_root(spark)}/normslice-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder; at the end of a session, what cannot be reached any more stays there."""
    if spark.sparkContext._jsc is None:
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM is going down
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
