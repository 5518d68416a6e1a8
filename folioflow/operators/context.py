"""From hits to evidence: neighbours, chapters, positions, whole short books."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import CHAPTER_MAX_TOKENS, CONTEXT_NEIGHBORS, FULL_TEXT_MAX_CHARS
from folioflow.functions import text as T
from folioflow.functions import words


def neighbours(hits: DataFrame, chunks: DataFrame, n: int = CONTEXT_NEIGHBORS) -> DataFrame:
    """(qid, novel, chunk_id, hit_rank): hits and the chunks at most ``n`` ids away, each once,
    under its best hit."""
    wide = hits.select("qid", "novel", "rank", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_id") - n), F.col("chunk_id") + n)).alias("chunk_id"))
    there = chunks.select("novel", "chunk_id")
    return wide.join(there, ["novel", "chunk_id"]).groupBy("qid", "novel", "chunk_id").agg(F.min("rank").alias("hit_rank"))


def chapters_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, novel, chapter_title, chunk_id, group_rank): all chunks of each hit's chapter; hits
    without a title stand alone."""
    titled = chunks.select("novel", "chunk_id", "chapter_title")
    found = hits.join(titled, ["novel", "chunk_id"])
    groups = found.where("chapter_title IS NOT NULL").groupBy("qid", "novel", "chapter_title").agg(F.min("rank").alias("group_rank"))
    whole = groups.join(titled, ["novel", "chapter_title"])
    single = found.where("chapter_title IS NULL").withColumnRenamed("rank", "group_rank")
    cols = ["qid", "novel", "chapter_title", "chunk_id", "group_rank"]
    return whole.select(*cols).unionByName(single.select(*cols))


def _kept(ranks: list[int], tokens: list[int], hit: list[bool], budget: int) -> tuple[list[int], bool]:
    """Places of the members that are taken, and whether anything is left out. Members of one group are
    in order of their chunks."""
    groups: dict[int, list[int]] = {}
    for i, g in enumerate(ranks):
        groups.setdefault(g, []).append(i)
    kept: list[int] = []
    left, cut = budget - sum(t for t, h in zip(tokens, hit, strict=True) if h), False
    if left < 0:
        left, cut = 0, True
    for _, own in sorted(groups.items()):
        cost, hits = [tokens[i] for i in own], [k for k, i in enumerate(own) if hit[i]]
        lo, hi = hits[0], hits[-1]
        grown = [0, 0]
        while True:
            sides = []
            if lo > 0 and cost[lo - 1] <= left:
                sides.append((cost[lo - 1], grown[0], 0))
            if hi < len(own) - 1 and cost[hi + 1] <= left:
                sides.append((cost[hi + 1], grown[1], 1))
            if not sides:
                break
            c, _, side = min(sides)
            left -= c
            grown[side] += 1
            lo, hi = (lo - 1, hi) if side == 0 else (lo, hi + 1)
        cut = cut or lo > 0 or hi < len(own) - 1
        kept += own[lo : hi + 1]
    return kept, cut


_GROWN = ["qid", "novel", "chunk_id", "group_rank", "tokens"]


def grow(members: pd.DataFrame, budget: int) -> pd.DataFrame:
    """One question's groups, grown outwards from their hits until the shared budget is used: each
    round the side that fits and costs least, then has grown least, then comes first."""
    kept, cut = _kept(members["group_rank"].tolist(), members["tokens"].tolist(), members["hit"].tolist(), budget)
    return members.iloc[kept][_GROWN].assign(truncated=cut).reset_index(drop=True)


def _grow(members: pa.Table, budget: int) -> pa.Table:
    """The same of a table, without pandas, whose frames cost more than the work on a few rows."""
    own = members.sort_by([("group_rank", "ascending"), ("chunk_id", "ascending")])
    kept, cut = _kept(*(own.column(c).to_pylist() for c in ("group_rank", "tokens", "hit")), budget)
    return own.take(pa.array(kept, pa.int64())).select(_GROWN).append_column("truncated", pa.array([cut] * len(kept), pa.bool_()))


def chapter_budget(hits: DataFrame, chunks: DataFrame, budget: int = CHAPTER_MAX_TOKENS) -> DataFrame:
    """(qid, novel, chunk_id, group_rank, tokens, truncated): chapters grown within a budget of
    tokens; a question's hits are few (top k), so its chapters fit one task."""
    members = chapters_of(hits, chunks).join(chunks.select("novel", "chunk_id", F.char_length("text").alias("tokens")), ["novel", "chunk_id"])
    marked = members.join(hits.select("qid", "novel", "chunk_id", F.lit(True).alias("hit")), ["qid", "novel", "chunk_id"], "left").na.fill(False, ["hit"])
    # chunks further from the nearest hit than the budget reaches can't be picked
    near = Window.partitionBy("qid", "group_rank").orderBy("chunk_id")
    hit_id = F.when(F.col("hit"), F.col("chunk_id"))
    before = F.last(hit_id, True).over(near)
    after = F.first(hit_id, True).over(near.rowsBetween(0, Window.unboundedFollowing))
    far = F.least(F.coalesce(F.col("chunk_id") - before, F.lit(1 << 30)), F.coalesce(after - F.col("chunk_id"), F.lit(1 << 30)))
    close = marked.withColumn("far", far).where(F.col("far") <= budget).select("qid", "novel", "chunk_id", "group_rank", "tokens", "hit")
    return close.groupBy("qid").applyInArrow(
        lambda members: _grow(members, budget),
        "qid long, novel string, chunk_id int, group_rank int, tokens int, truncated boolean",
    )


def endings(chunks: DataFrame, markers: tuple[str, ...] = words.ENDING_MARKERS[:4]) -> DataFrame:
    """(novel, anchor): the last chunk with an ending marker."""
    return chunks.where(T.contains_any(F.col("text"), markers)).groupBy("novel").agg(F.max("chunk_id").alias("anchor"))


def positional(chunks: DataFrame, tail: bool, quota: int) -> DataFrame:
    """(novel, chunk_id, rank): the first or last ``quota`` chunks of every book; the last ones are
    those up to its ending marker, if it has one."""
    if not tail:
        order, pool = F.asc("chunk_id"), chunks
    else:
        order = F.desc("chunk_id")
        pool = chunks.join(endings(chunks), "novel", "left").where("anchor IS NULL OR chunk_id <= anchor")
    w = Window.partitionBy("novel").orderBy(order)
    return pool.select("novel", "chunk_id", F.row_number().over(w).alias("rank")).where(F.col("rank") <= quota)


def short_books(chunks: DataFrame, most: int = FULL_TEXT_MAX_CHARS) -> DataFrame:
    """(novel, chunk_id, chars): all chunks of books short enough to be read whole."""
    small = chunks.groupBy("novel").agg(F.sum(F.char_length("text")).alias("chars")).where((F.col("chars") > 0) & (F.col("chars") <= most))
    return chunks.select("novel", "chunk_id").join(small, "novel")


def prompt_blocks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, prompt): numbered blocks of a question's evidence in order of rank."""
    parts = hits.join(chunks.select("novel", "chunk_id", "chapter_title", "text"), ["novel", "chunk_id"])
    title = F.element_at(T.titles(F.col("novel")), 1)
    chapter = F.coalesce(F.concat(F.lit(" · "), F.col("chapter_title")), F.lit(""))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 《"), title, F.lit("》"), chapter, F.lit(" · 片段 #"), F.col("chunk_id").cast("string"), F.lit("\n"), F.col("text"))
    return parts.groupBy("qid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n---\n").alias("prompt")
    )


def around(asked: DataFrame, chunks: DataFrame, radius: int = 1, most: int = 3) -> DataFrame:
    """(qid, novel, chunk_id): the chunks at most ``radius`` (0 to ``most``) ids from ``asked(qid, novel, chunk_id)``."""
    r = max(0, min(radius, most))
    wide = asked.select("qid", "novel", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_id") - r), F.col("chunk_id") + r)).alias("chunk_id"))
    return wide.join(chunks.select("novel", "chunk_id"), ["novel", "chunk_id"]).select("qid", "novel", "chunk_id")


def chapter_like(asked: DataFrame, chunks: DataFrame, limit: int = 8, most: int = 12) -> DataFrame:
    """(qid, novel, chunk_id, complete): the first ``limit`` (1 to ``most``) chunks of a book whose
    chapter title has what ``asked(qid, novel, title)`` names, without case; ``%`` and ``_`` in it are
    wildcards. One chunk more is looked for, so ``complete`` tells whether there are no others."""
    n = max(1, min(limit, most))
    like = F.expr("chapter_title ILIKE concat('%', title, '%')")
    hits = asked.select("qid", "novel", "title").join(chunks.select("novel", "chunk_id", "chapter_title"), "novel").where(like).select("qid", "novel", "chunk_id")
    first = hits.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id"))).where(F.col("r") <= n + 1)
    complete = F.max("r").over(Window.partitionBy("qid")) <= n
    return first.withColumn("complete", complete).where(F.col("r") <= n).drop("r")


def cached_contexts(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reused, pending)``: chunks whose text has a context in ``cache(text_hash, context)``, with it,
    and those that have none."""
    keyed = chunks.withColumn("text_hash", F.md5("text"))
    known = cache.where(~T.is_blank(F.col("context"))).groupBy("text_hash").agg(F.min("context").alias("cached"))
    return keyed.join(known, "text_hash"), keyed.join(known.select("text_hash"), "text_hash", "left_anti")
