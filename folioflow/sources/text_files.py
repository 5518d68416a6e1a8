"""Books as text files, evaluation sets as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(content: bytes) -> tuple[str, str, bool, int]:
    """(text, encoding, fell back, lost characters): strict UTF-8, else strict GB18030, else UTF-8
    without what can't be read."""
    for name in ("utf-8", "gb18030"):
        try:
            return content.decode(name), name, False, 0
        except UnicodeDecodeError:
            continue
    lost = content.decode("utf-8", "replace").count("�")
    return content.decode("utf-8", "ignore"), "utf-8", True, lost


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [decode(bytes(c)) for c in batch["content"]]
        out = batch[["novel", "path", "source_hash"]].copy()
        for i, name in enumerate(("text", "encoding", "fallback", "lost")):
            out[name] = [g[i] for g in got]
        yield out


def books(spark: SparkSession, folder: str) -> DataFrame:
    """(novel, path, source_hash, text, encoding, fallback, lost) of every ``*.txt`` in ``folder``;
    the book's name is the file's, the hash that of its bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    name = F.regexp_replace(F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1), "\\.txt$", "")
    keyed = files.select(name.alias("novel"), "path", F.sha2("content", 256).alias("source_hash"), "content")
    return keyed.mapInPandas(_decoded, "novel string, path string, source_hash string, text string, encoding string, fallback boolean, lost int")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON array that have a ``retrieval`` label."""
    return spark.read.option("multiLine", True).json(path).where("retrieval IS NOT NULL")
