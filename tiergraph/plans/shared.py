"""Intermediate tables in the folder that driver and executors share.

Iterative and multi-phase operators cut their lineage by writing a table there
and reading it back, so that a lost executor costs a re-read and not a replay.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's own checkpoint folder.

    Where neither is set a local one serves a local master; on a cluster that is an
    error, as executors would each write to their own disk."""
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{_CONF} must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tiergraph-"))
    return "file://" + _own[0]


def written(df: DataFrame, label: str = "part", by: str | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read from there; ``by``: a column
    whose values lie in folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, data: dict[str, bytes]) -> str:
    """Files by name in a new folder of the shared one; its path."""
    path = f"{shared_dir(spark)}/put-{uuid.uuid4().hex}"
    for name, content in data.items():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
    atexit.register(_remove, spark, path)
    return path


def dropped(table: DataFrame, part: str = "") -> None:
    """Removes the files of a written table that nothing reads any more, or of its folder ``part``."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if folder.endswith(part):
            _remove(table.sparkSession, folder)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended first
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more.

    Called between phases once their output is a written table: Spark's cleaner
    acts on garbage collection, whose own interval is half an hour.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def where_once(df: DataFrame, condition) -> DataFrame:
    """Filter that stays above the projection below it.

    The optimiser would otherwise move the condition down with the expressions
    it reads, and a costly column would be evaluated again for the filter, or
    inside a lambda for each element.
    """
    from pyspark.sql import functions as F

    held = df.withColumn("_once", F.monotonically_increasing_id())
    return held.where(condition & (F.col("_once") >= 0)).drop("_once")
