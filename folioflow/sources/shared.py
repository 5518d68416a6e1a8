"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a local session gets a temporary
    folder, and a cluster an error, since its machines share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


_SEEN: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/folioflow-{spark.sparkContext.applicationId}"
    if folder not in _SEEN:
        _SEEN.add(folder)
        atexit.register(_delete_at_exit, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    return folder


def _delete_at_exit(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    Later jobs then start from files that outlive any executor. They stay until ``discard_written`` or
    the end of the driver's process.
    """
    path = new_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """``df`` as Parquet files of little room. What its plan has shuffled is deleted once they are there;
    else it lies beside them until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANED)
    conf.set(_CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANED, before)


def is_there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def discard_written(spark: SparkSession) -> bool:
    """Deletes all tables that this application has written; results that read them are void then."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
