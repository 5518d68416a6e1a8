"""Manifests, change plans and quality reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import CHUNK_SIZE, EMBEDDING_WIDTH
from folioflow.functions import text as T


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last writer wins: one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def source_hashes(chunks: DataFrame) -> DataFrame:
    """(novel, chunk_count, content_hash): an order-free digest of a book's chunks."""
    part = F.conv(F.substring(F.md5(F.concat(F.col("chunk_id").cast("string"), F.lit(":"), F.col("text"))), 1, 12), 16, 10).cast("decimal(20,0)")
    return chunks.groupBy("novel").agg(F.count("*").alias("chunk_count"), F.sum(part).cast("string").alias("content_hash"))


def pipeline_hash(**settings: object) -> str:
    """Fingerprint of the settings that an index was built with, in any order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def change_plan(directory: DataFrame, manifest: DataFrame, indexed: DataFrame, pipeline: str | Column, force: bool = False) -> DataFrame:
    """(novel, change) of ``directory(novel, source_hash)`` against ``manifest(novel, source_hash,
    pipeline_hash)`` and the books of ``indexed(novel)``.

    A book of the index without manifest is ``modified`` (it is taken over); one that lacks either is
    ``added``; another hash of its source or of the pipeline, or ``force``, makes it ``modified``; what
    the directory lacks is ``deleted``. NULL hashes differ from all others. A row a book on all sides.
    """
    d = directory.select("novel", F.col("source_hash").alias("new"), F.lit(True).alias("there"))
    m = manifest.select("novel", F.col("source_hash").alias("old"), F.col("pipeline_hash").alias("made_by"), F.lit(True).alias("known"))
    i = indexed.select("novel").distinct().withColumn("published", F.lit(True))
    pipeline = F.lit(pipeline) if isinstance(pipeline, str) else pipeline
    same = F.coalesce((F.col("new") == F.col("old")) & (F.col("made_by") == pipeline), F.lit(False)) & F.lit(not force)
    change = (
        F.when(F.col("there").isNull(), "deleted")
        .when(F.col("known").isNull() & F.col("published").isNotNull(), "modified")
        .when(F.col("known").isNull() | F.col("published").isNull(), "added")
        .when(~same, "modified")
        .otherwise("unchanged")
    )
    return d.join(m, "novel", "full_outer").join(i, "novel", "full_outer").select("novel", change.alias("change"))


def contextual_decision(books: DataFrame, most_chunks: int, mode: str = "auto", backend: bool = True) -> DataFrame:
    """(novel, builds, skipped_because) of ``books(novel, chunks)``: contexts are built unless the mode is
    ``off``, the book has over ``most_chunks`` chunks, or the mode is ``auto`` and no backend is there."""
    reason = F.when(F.lit(mode == "off"), "off").when(F.col("chunks") > most_chunks, "too many chunks").when(F.lit(mode == "auto" and not backend), "no backend")
    return books.select("novel", reason.isNull().alias("builds"), reason.alias("skipped_because"))


def report(chunks: DataFrame, limit: int = CHUNK_SIZE, width: int = EMBEDDING_WIDTH) -> DataFrame:
    """One row per book over all its deliveries: counts of what blocks publication (errors) and of
    what does not (warnings)."""
    text, v = F.col("text"), F.col("embedding")
    per_text = chunks.where(~T.is_blank(text)).groupBy("novel", F.sha2(text, 256).alias("h")).agg((F.count("*") - 1).alias("extra"))
    dup = per_text.groupBy("novel").agg(F.sum("extra").alias("duplicates"))
    lost = F.char_length(text) - F.char_length(F.replace(text, F.lit("�"), F.lit("")))
    control = F.regexp_count(text, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    counts = chunks.groupBy("novel").agg(
        F.count("*").alias("chunks"),
        F.count_if(T.is_blank(text)).alias("empty"),
        F.count_if(F.char_length(text) > limit).alias("over_limit"),
        F.count_if(F.col("chapter_title").isNotNull()).alias("titled"),
        F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("replacement_chars"),
        F.coalesce(F.sum(control), F.lit(0)).cast("long").alias("control_chars"),
        F.count_if(v.isNull()).alias("no_vector"),
        F.count_if(F.size(v) != width).alias("wrong_width"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("not_finite"),
    )
    return counts.join(dup, "novel", "left").na.fill(0, ["duplicates"]).withColumn(
        "passes", (F.col("empty") + F.col("over_limit") + F.col("no_vector") + F.col("wrong_width") + F.col("not_finite")) == 0
    )
