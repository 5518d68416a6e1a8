"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.sources.shared import new_path
from folioflow.sources.snapshots import Snapshots


def _folder(spark: SparkSession) -> str:
    return new_path(spark, "stream")


def last_versions(turns: DataFrame) -> DataFrame:
    """One row per (session_id, turn_index): the latest ``created_at`` wins."""
    w = Window.partitionBy("session_id", "turn_index").orderBy(F.desc_nulls_last("created_at"), F.desc_nulls_last("content"))
    return turns.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def drain_turns(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Reads all chat turns under ``path`` as a stream into a snapshot table and returns that.

    Each batch appends its own versions; reading settles which version of a turn holds, so a batch
    that is delivered twice changes nothing and no earlier row is rewritten. Rows without session
    or turn are left out. A later call with the same ``folder`` takes up only new files.
    """
    folder = folder or _folder(spark)
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    is_file = name.endswith(".parquet") and not _is_folder(spark, path)
    stream = source.option("pathGlobFilter", name).parquet(parent) if is_file else source.parquet(path)
    store = Snapshots(spark, f"{folder}/turns")

    def upsert(batch: DataFrame, number: int) -> None:
        wanted = batch.where("session_id IS NOT NULL AND turn_index IS NOT NULL")
        store.append(last_versions(wanted), f"batch-{number}")

    job = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    job.awaitTermination()
    return last_versions(store.read(schema))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
