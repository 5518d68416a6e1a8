"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_tokens(texts: list[str], path: str) -> list[int]:
    return [len(x) for x in _model(path).encode(texts, num_threads=1)] if texts else []


def _sized(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        keep = [n for n in batch.schema.names if n != "text"]
        sizes: list[int] = []
        for lo in range(0, len(texts), 256):
            sizes += count_tokens(texts[lo : lo + 256], path)
        yield batch.select(keep).append_column("tokens", pa.array(sizes, pa.int64()))


def sized(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, tokens): documents with an id and at least one token of the vocabulary file at
    ``path``, which every worker must have; it is never copied."""
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in keep], F.col(text_col).cast("string").alias("text")
    ).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)
    schema = "doc_id long, " + (kept + ", " if kept else "") + "tokens long"
    return docs.mapInArrow(lambda it: _sized(it, path), schema).where("tokens > 0")
