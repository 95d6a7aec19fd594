"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidelens-"))
    return _own[0]


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, so a lost executor costs no recomputation.

    ``done`` are tables of this kind that nothing needs after this one; they are deleted. Spark's cleaner then sees that
    the shuffles of the finished job are no longer held, so their files go before the next job's come.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    release(*done)
    spark._jvm.System.gc()
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the columns of ``df`` (whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
