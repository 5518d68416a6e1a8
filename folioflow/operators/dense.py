"""Cosine search: within a scope by a join, over everything in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

BLOCK, NEAR_QUERIES = 8_192, 20_000


def scoped(queries: DataFrame, chunks: DataFrame, k: int, scope: str = "novel") -> DataFrame:
    """(qid, novel, chunk_id, score, rank) among chunks of the query's own scope."""
    hits = queries.select("qid", scope, F.col("vec").alias("q")).join(chunks.select(scope, "chunk_id", F.col("embedding").alias("e")), scope)
    scored = hits.select("qid", scope, "chunk_id", F.round(T.cosine(F.col("q"), F.col("e")), 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, keys: list[str], vec: str, size: int) -> DataFrame:
    """Rows gathered in arrays of about ``size``."""
    numbered = rows.withColumn("_b", F.floor(F.monotonically_increasing_id() / size))
    return numbered.groupBy("_b").agg(F.collect_list(F.struct(*keys, vec)).alias("rows")).drop("_b")


def _unpacked(rows: pa.ListArray, i: int, vec: str) -> tuple[pa.StructArray, np.ndarray]:
    own = rows.slice(i, 1).flatten()
    flat = own.field(vec).flatten().to_numpy(zero_copy_only=False)
    return own, flat.astype(np.float64).reshape(len(own), -1)


def _top(batches: Iterator[pa.RecordBatch], k: int, per_book: bool) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of a block for each query, or of each book in it, with everything that ties."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked, q = _unpacked(batch.column("asked"), i, "vec")
            rows, e = _unpacked(batch.column("rows"), i, "embedding")
            score = np.round((q @ e.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(e, axis=1)[None], 6)
            book = np.unique(np.array(rows.field("novel").to_pylist(), object), return_inverse=True)[1] if per_book else np.zeros(len(rows), np.int64)
            for n in range(len(q)):
                order = np.lexsort((-score[n], book))
                first = np.searchsorted(book[order], np.arange(book.max() + 1))
                last = np.minimum(first + k, np.r_[first[1:], len(order)]) - 1
                least = score[n][order[last]]  # each book's k-th score
                near = np.flatnonzero(score[n] >= least[book])
                picked = rows.take(pa.array(near))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(near), asked.field("qid")[n].as_py(), np.int64)), picked.field("novel"), picked.field("chunk_id"), pa.array(score[n][near])],
                    names=["qid", "novel", "chunk_id", "score"],
                )


def _near(batches: Iterator[pa.RecordBatch], shared, k: int, per_book: bool) -> Iterator[pa.RecordBatch]:
    """As ``_top``, for queries that every worker holds and rows as they are scanned."""
    ids, q = shared.value
    unit = q / np.linalg.norm(q, axis=1)[:, None]
    for batch in batches:
        if not batch.num_rows:
            continue
        e = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        e /= np.linalg.norm(e, axis=1)[:, None]
        books = batch.column("novel").dictionary_encode().indices.to_numpy() if per_book else np.zeros(batch.num_rows, np.int64)
        order = np.argsort(books, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(books[order]) != 0])
        for lo in range(0, len(ids), 256):
            score = np.round(unit[lo : lo + 256] @ e.T, 6)[:, order]
            asked, row = [], []
            for a, b in zip(first, [*first[1:], len(order)], strict=True):
                own = score[:, a:b]
                least = np.partition(own, max(0, b - a - k), axis=1)[:, max(0, b - a - k)]  # the k-th score
                n, m = np.nonzero(own >= least[:, None])
                asked.append(n)
                row.append(m + a)
            n, m = np.concatenate(asked), np.concatenate(row)
            at = pa.array(order[m])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo + n]), batch.column("novel").take(at), batch.column("chunk_id").take(at), pa.array(score[n, m])],
                names=["qid", "novel", "chunk_id", "score"],
            )


def _scored(queries: DataFrame, chunks: DataFrame, k: int, block: int, per_book: bool, near_queries: int = NEAR_QUERIES) -> DataFrame:
    """A stated query set against all chunks. A set of a checked size goes to where the chunks are
    scanned, and only the best of each batch leave; a larger one meets them block by block."""
    schema = "qid long, novel string, chunk_id int, score double"
    rows = chunks.select("novel", "chunk_id", "embedding")
    small = queries.select("qid", "vec").limit(near_queries + 1).toArrow()
    if small.num_rows <= near_queries:
        if not small.num_rows:
            return rows.sparkSession.createDataFrame([], schema)
        vec = small.column("vec").combine_chunks()
        vec = pa.concat_arrays(vec.chunks) if isinstance(vec, pa.ChunkedArray) else vec
        ids = small.column("qid").to_numpy()
        q = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        shared = rows.sparkSession.sparkContext.broadcast((ids, q))
        return rows.mapInArrow(lambda it: _near(it, shared, k, per_book), schema)
    asked = _blocks(queries.select("qid", "vec"), ["qid"], "vec", 1_024).select(F.col("rows").alias("asked"))
    blocks = _blocks(rows, ["novel", "chunk_id"], "embedding", block)
    return blocks.join(asked, F.lit(True)).mapInArrow(lambda it: _top(it, k, per_book), schema)


def exact(queries: DataFrame, chunks: DataFrame, k: int, block: int = BLOCK, near_queries: int = NEAR_QUERIES) -> DataFrame:
    """(qid, novel, chunk_id, score, rank): the ``k`` nearest chunks of each query."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "novel", "chunk_id")
    return _scored(queries, chunks, k, block, False, near_queries).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def per_book(queries: DataFrame, chunks: DataFrame, k: int, block: int = BLOCK, near_queries: int = NEAR_QUERIES) -> DataFrame:
    """(qid, novel, chunk_id, score): the ``k`` nearest chunks of every book for each query."""
    best = Window.partitionBy("qid", "novel").orderBy(F.desc("score"), "chunk_id")
    return _scored(queries, chunks, k, block, True, near_queries).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
