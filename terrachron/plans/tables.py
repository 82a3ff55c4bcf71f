"""Tables written to the shared folder, to cut lineage.

A cluster names a folder that the driver and all executors share in
``spark.checkpoint.dir``. Everything that several jobs read is written there as
Parquet, so that a lost executor costs one re-read and no recomputation. A lazy result
may read such a table long after the call that made it, so tables that nobody drops
earlier go when the session's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a local one of our own, which only a local master can use."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="terrachron-")
    return _OWN[app]


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    p, fs = _handle(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrachron_path = path
    return out


def _handle(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Deletes a table that :func:`written` made and that no later result reads."""
    path = getattr(df, "_terrachron_path", None)
    if path:
        p, fs = _handle(df.sparkSession, path)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)
