"""Intermediate tables on storage that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark then removes the shuffle files of a statement as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode, where none is set."""
    set_one = spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared checkpoint folder and read it back, which cuts its lineage.

    The files survive the loss of any executor. They are deleted by `release`, or when the driver's Python ends. The
    shuffle files of the statement that wrote them are of no more use and go with it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` gave and that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone at exit; the folder is scratch space
        pass
