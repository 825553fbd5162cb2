"""Shared plumbing: the shared work folder, written tables and column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where this session's tables go, by application id.
_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """Folder for written tables that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a local session uses
    a temporary folder and a cluster the warehouse, which all of it can reach.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and spark.sparkContext.master.startswith("local["):
            base = tempfile.mkdtemp(prefix="zonalis-")
        elif not base:
            base = spark.conf.get("spark.sql.warehouse.dir")
        _FOLDERS[app] = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a session's folder when the driver ends, if Spark still runs."""
    jsc = spark.sparkContext._jsc
    if jsc is None or jsc.sc().isStopped():
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage at a reliable copy: a lost executor costs a reread.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put after it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bytes_of(column) -> list:
    """The UTF-8 bytes of each text of an Arrow column, None for null."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
