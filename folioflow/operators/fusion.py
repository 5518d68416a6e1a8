"""Channels, reciprocal rank fusion, reranking, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import RRF_K, SCORE_GAP_LOW, TERM_COVERAGE_MIN
from folioflow.functions import text as T


def channels(named: list[tuple[str, DataFrame]]) -> DataFrame:
    """(qid, novel, chunk_id, channel, place, rank) of ranked channels, in the order given."""
    parts = [
        df.select("qid", "novel", "chunk_id", F.lit(name).alias("channel"), F.lit(i).alias("place"), F.col("rank").cast("int"))
        for i, (name, df) in enumerate(named)
    ]
    return reduce(DataFrame.unionByName, parts)


def rrf(ranked: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, novel, chunk_id, score, rank): sum of 1 / (rrf_k + rank) over channels. Ties keep the
    order of first appearance: channel, then rank in it."""
    fused = ranked.groupBy("qid", "novel", "chunk_id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 6).alias("score"), F.min(F.struct("place", "rank")).alias("seen")
    )
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "seen", "novel", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("seen")


def rerank(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, novel, chunk_id, score, rank, previous_rank): candidates by the share of the question's
    terms that their text has; ties keep the earlier order. Texts join after the candidates are few."""
    asked = questions.select("qid", T.query_terms(F.col("question")).alias("terms"))
    wide = candidates.select("qid", "novel", "chunk_id", F.col("rank").alias("previous_rank")).join(asked, "qid").join(
        chunks.select("novel", "chunk_id", "text"), ["novel", "chunk_id"]
    )
    covered = F.size(F.filter("terms", lambda t: F.col("text").contains(t)))
    scored = wide.withColumn("score", F.when(F.size("terms") > 0, F.round(covered / F.size("terms"), 6)).otherwise(F.lit(0.0)))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "previous_rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "qid", "novel", "chunk_id", "score", "rank", "previous_rank"
    )


def dominant_books(hits: DataFrame) -> DataFrame:
    """(qid, novel, n): books with at least half as many hits as the question's top book."""
    counted = hits.groupBy("qid", "novel").agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy("qid"))
    return counted.withColumn("most", top).where(F.col("n") * 2 >= F.col("most")).drop("most")


def confidence(ranked: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, score_gap, term_coverage, dispersion, is_low) from candidates with ``score`` and ``rank``."""
    s = T.sigmoid(F.col("score"))
    per = ranked.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, s)).alias("s1"), F.max(F.when(F.col("rank") == 2, s)).alias("s2"), F.countDistinct("novel").alias("dispersion")
    )
    asked = questions.select("qid", F.explode(T.query_terms(F.col("question"))).alias("term"))
    seen = (
        asked.join(ranked.select("qid", "novel", "chunk_id"), "qid")
        .join(chunks.select("novel", "chunk_id", "text"), ["novel", "chunk_id"])
        .groupBy("qid", "term")
        .agg(F.max(F.col("text").contains(F.col("term")).cast("int")).alias("there"))
        .groupBy("qid")
        .agg(F.avg("there").alias("coverage"))
    )
    gap, cover = F.round(F.coalesce(F.col("s1") - F.col("s2"), F.lit(1.0)), 6), F.round(F.coalesce("coverage", F.lit(1.0)), 6)
    low = (cover < TERM_COVERAGE_MIN) | ((gap < SCORE_GAP_LOW) & (F.col("dispersion") <= 1))
    return per.join(seen, "qid", "left").select("qid", gap.alias("score_gap"), cover.alias("term_coverage"), "dispersion", low.alias("is_low"))


def merged_pool(pools: list[DataFrame]) -> DataFrame:
    """(qid, novel, chunk_id, place, rank) of candidates of several searches ``(qid, novel, chunk_id,
    rank)``: each chunk once per question, from the first search that found it."""
    named = [df.select("qid", "novel", "chunk_id", F.lit(i).alias("place"), F.col("rank").cast("int").alias("rank")) for i, df in enumerate(pools)]
    seen = reduce(DataFrame.unionByName, named).groupBy("qid", "novel", "chunk_id").agg(F.min(F.struct("place", "rank")).alias("s"))
    return seen.select("qid", "novel", "chunk_id", "s.place", "s.rank")


def rescue(candidates: DataFrame, signals: DataFrame, found: list[DataFrame], questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, novel, chunk_id, score, rank, rescued): ``candidates`` of questions that ``signals(qid,
    is_low)`` call low are merged with what their variants ``found`` and ranked once more; the others
    stay as they are. A rescue that finds nothing new leaves the candidates."""
    low = signals.where("is_low").select("qid")
    pool = merged_pool([candidates, *found]).join(low, "qid", "left_semi")
    order = Window.partitionBy("qid").orderBy("place", "rank", "novel", "chunk_id")
    again = rerank(pool.withColumn("rank", F.row_number().over(order)), questions, chunks, k)
    kept = candidates.join(low, "qid", "left_anti").where(F.col("rank") <= k)
    cols = ["qid", "novel", "chunk_id", "score", "rank"]
    return kept.select(*cols, F.lit(False).alias("rescued")).unionByName(again.select(*cols, F.lit(True).alias("rescued")))
