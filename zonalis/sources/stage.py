"""Intermediate results kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made here, by application id.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset, a local session uses a temporary folder and a cluster the warehouse, which all
    of it can reach.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = tempfile.mkdtemp(prefix="zonalis-") if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return _FOLDERS[app]


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint, so that a lost executor costs a reread."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is None or jsc.sc().isStopped():
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
