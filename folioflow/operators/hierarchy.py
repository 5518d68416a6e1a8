"""Summary nodes of chapters and books: building, searching, going back to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import HIERARCHY_TOP_K, SUMMARY_MAX_CHARS, UNTITLED_CHUNKS
from folioflow.functions import text as T
from folioflow.operators import dense as D


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """The latest delivery of every (novel, level, node_id)."""
    w = Window.partitionBy("novel", "level", "node_id").orderBy(F.desc("summary_id"))
    return nodes.where(F.col("level").isin("chapter", "novel")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def even_places(n: Column, most: int) -> Column:
    """At most ``most`` places of 0..n-1, evenly spread with both ends, half-way cases to even."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / (most - 1)).cast("int"))
    return F.when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(F.array_distinct(spread))


def summary(title: Column, texts: Column, limit: int = SUMMARY_MAX_CHARS, most: int = 5) -> Column:
    """Evenly sampled texts under a title, each cut to its share of ``limit``."""
    kept = F.filter(F.transform(texts, T.compact), lambda t: t != "")
    prefix = F.concat(title, F.lit("："))
    places = even_places(F.size(kept), most)
    share = F.greatest(F.lit(40), F.floor((limit - F.char_length(prefix) - 8) / F.size(places)).cast("int"))
    body = F.array_join(F.transform(places, lambda i: F.substring(F.element_at(kept, i + 1), F.lit(1), share)), " … ")
    return F.substring(F.when(F.size(kept) == 0, title).otherwise(F.concat(prefix, body)), F.lit(1), F.lit(limit))


def chapter_runs(chunks: DataFrame, window: int = UNTITLED_CHUNKS) -> DataFrame:
    """(novel, run, chunk_id, chapter_title, filled): ``run`` numbers runs of neighbours with one
    title; runs without title are cut every ``window`` chunks. ``filled`` chunks have a text."""
    order = Window.partitionBy("novel").orderBy("chunk_id")
    title = F.col("chapter_title")
    fresh = (F.row_number().over(order) == 1) | ~F.lag(title).over(order).eqNullSafe(title)
    slim = chunks.select("novel", "chunk_id", "chapter_title", (~T.is_blank(F.col("text"))).alias("filled"))
    runs = slim.select("*", fresh.cast("int").alias("fresh"))
    runs = runs.withColumn("whole", F.sum("fresh").over(order))
    inside = F.row_number().over(Window.partitionBy("novel", "whole").orderBy("chunk_id")) - 1
    step = F.when(title.isNull(), (inside % window == 0).cast("int")).otherwise(F.col("fresh"))
    return runs.withColumn("step", step).withColumn("run", F.sum("step").over(order)).drop("fresh", "whole", "step")


def chapter_nodes(chunks: DataFrame, most: int = 5) -> DataFrame:
    """(novel, node_order, node_id, title, start_chunk_id, end_chunk_id, chunks, summary) of chapters.

    Runs are found without texts. Of a run only the chunks at even places of those with text are
    gathered, and no more of each than a summary takes.
    """
    runs = chapter_runs(chunks)
    spans = runs.groupBy("novel", F.col("run").alias("node_order")).agg(
        F.first("chapter_title").alias("t"), F.min("chunk_id").alias("start_chunk_id"), F.max("chunk_id").alias("end_chunk_id"), F.count("*").alias("chunks")
    )
    filled = runs.where("filled")
    place = F.row_number().over(Window.partitionBy("novel", "run").orderBy("chunk_id")) - 1
    number = filled.groupBy("novel", "run").agg(F.count("*").cast("int").alias("n"))
    picked = filled.withColumn("place", place).join(number, ["novel", "run"]).where(F.array_contains(even_places(F.col("n"), most), F.col("place")))
    head = F.substring(T.compact(F.col("text")), 1, SUMMARY_MAX_CHARS)
    texts = (
        picked.select("novel", "run", "chunk_id")
        .join(chunks.select("novel", "chunk_id", head.alias("text")), ["novel", "chunk_id"])
        .groupBy("novel", F.col("run").alias("node_order"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]).alias("texts"))
    )
    made = spans.join(texts, ["novel", "node_order"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    order = F.col("node_order") - 1
    a, b = F.col("start_chunk_id").cast("string"), F.col("end_chunk_id").cast("string")
    title = F.coalesce("t", F.concat(F.lit("未命名章节（片段 "), a, F.lit("–"), b, F.lit("）")))
    return made.select(
        "novel", order.alias("node_order"), F.concat(F.lit("chapter:"), order.cast("string"), F.lit(":"), a, F.lit("-"), b).alias("node_id"),
        title.alias("title"), "start_chunk_id", "end_chunk_id", "chunks", summary(title, F.col("texts")).alias("summary"),
    )


def book_nodes(chapters: DataFrame, most: int = 12) -> DataFrame:
    """(novel, title, start_chunk_id, end_chunk_id, chapters, summary) from evenly sampled chapters."""
    n = F.count("*").over(Window.partitionBy("novel"))
    place = F.col("node_order").cast("int")
    sampled = chapters.withColumn("n", n).where(F.array_contains(even_places(F.col("n").cast("int"), most), place))
    told = F.struct("node_order", F.concat_ws(" ", "title", "summary").alias("told"))
    texts = sampled.groupBy("novel").agg(F.transform(F.sort_array(F.collect_list(told)), lambda x: x["told"]).alias("texts"))
    spans = chapters.groupBy("novel").agg(F.min("start_chunk_id").alias("start_chunk_id"), F.max("end_chunk_id").alias("end_chunk_id"), F.count("*").alias("chapters"))
    title = F.concat(F.lit("《"), F.col("novel"), F.lit("》全书概览"))
    return spans.join(texts, "novel").select(
        "novel", title.alias("title"), "start_chunk_id", "end_chunk_id", "chapters", summary(title, F.col("texts")).alias("summary")
    )


def back_to_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(novel, node_id, chunk_id, node_order): first, middle and last chunk of each node."""
    s, e = F.col("start_chunk_id"), F.col("end_chunk_id")
    wide = nodes.select("novel", "node_id", "node_order", F.explode(F.array_distinct(F.array(s, F.floor((s + e) / 2).cast("int"), e))).alias("chunk_id"))
    return wide.join(chunks.select("novel", "chunk_id"), ["novel", "chunk_id"]).select("novel", "node_id", "chunk_id", "node_order")


def retrieve(asked: DataFrame, nodes: DataFrame, chunks: DataFrame, top: int = HIERARCHY_TOP_K, books: int = 2) -> DataFrame:
    """(qid, novel, chunk_id, rank): for ``asked(qid, vec)`` the ``books`` nearest book nodes, of each
    ``max(2, ceil(top / books))`` nearest chapter nodes, of all these the best ``max(top, 2 * books)``,
    and of each its first, middle and last chunk."""
    heads = nodes.where("level = 'novel'").select("novel", F.col("summary_id").cast("int").alias("chunk_id"), "embedding")
    near = D.exact(asked, heads, books).select("qid", "novel").distinct()
    n = F.count("*").over(Window.partitionBy("qid"))
    parts = nodes.where("level = 'chapter'").select("novel", F.col("summary_id").alias("node"), "start_chunk_id", "end_chunk_id", F.col("embedding").alias("e"))
    met = near.withColumn("n", n).join(asked.select("qid", "vec"), "qid").join(parts, "novel")
    scored = met.withColumn("score", F.round(T.cosine(F.col("vec"), F.col("e")), 6)).drop("vec", "e")
    of_book = F.row_number().over(Window.partitionBy("qid", "novel").orderBy(F.desc("score"), "node"))
    some = scored.withColumn("k", of_book).where(F.col("k") <= F.greatest(F.lit(2), F.ceil(F.lit(top) / F.col("n"))))
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "node")))
    best = best.where(F.col("r") <= F.greatest(F.lit(top), 2 * F.col("n")))
    s, e = F.col("start_chunk_id"), F.col("end_chunk_id")
    wide = best.select("qid", "novel", "r", F.explode(F.array_distinct(F.array(s, F.floor((s + e) / 2).cast("int"), e))).alias("chunk_id"))
    there = chunks.select("novel", "chunk_id")
    return wide.join(there, ["novel", "chunk_id"]).groupBy("qid", "novel", "chunk_id").agg(F.min("r").alias("rank"))
