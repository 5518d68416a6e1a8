"""Queries of retrieval. Chapter nodes are the questions: their title is what is asked, their
vector the question's, their book and chunks the right answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.config import EMBEDDING_WIDTH
from folioflow.functions import text as T
from folioflow.functions import words
from folioflow.operators import context as X
from folioflow.operators import dense as D
from folioflow.operators import fusion
from folioflow.operators import hierarchy as H
from folioflow.operators import lexical as L
from folioflow.operators import understand as U
from folioflow.plans import sql as S
from folioflow.plans.register import query
from folioflow.plans.texts import chunks, latest_turns, shelf, vectors
from folioflow.session import table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest_nodes(table(spark, sf_dir, "hierarchy_summaries"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question, vec, novel): the stated question set, every chapter node of fifty."""
    chapter = nodes(spark, sf_dir).where("level = 'chapter' AND summary_id % 50 = 0 AND title IS NOT NULL")
    return chapter.select(F.col("summary_id").alias("qid"), F.col("title").alias("question"), F.col("embedding").alias("vec"), "novel", "start_chunk_id", "end_chunk_id")


ASKED = f"{S.NODES}, q AS (SELECT summary_id AS qid, title AS question, embedding AS vec, novel, start_chunk_id, end_chunk_id FROM h WHERE level = 'chapter' AND summary_id % 50 = 0 AND title IS NOT NULL)"


def with_vector(q: DataFrame) -> DataFrame:
    return q.where(T.usable_vector(F.col("vec"), EMBEDDING_WIDTH))


@query(f"WITH {S.CHUNKS} SELECT count(*) AS n, round(avg(len({S.terms('text')})), 6) AS avgdl FROM c")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf(spark, sf_dir).docs.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


_DF = f"WITH {S.CHUNKS}, d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT novel, chunk_id, unnest({S.terms('text')}) AS term FROM c) GROUP BY term)"


@query(_DF + " SELECT term, df FROM d")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf(spark, sf_dir).frequencies


@query(_DF + ", s AS (SELECT count(*) AS n FROM c) SELECT term, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM d, s")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = chunks(spark, sf_dir).agg(F.count("*").alias("n"))
    return document_frequency(spark, sf_dir).join(F.broadcast(n), F.lit(True)).select("term", F.round(L.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {S.CHUNKS}, {S.QUESTIONS}, {S.bm25('q')} SELECT qid, novel, chunk_id, score, rank::INT AS rank FROM b")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bm25(shelf(spark, sf_dir), U.questions(table(spark, sf_dir, "chat_turns")), 20)


_NAMED = f"""n AS (SELECT DISTINCT novel FROM c),
ti AS (SELECT novel, unnest(CASE WHEN len(regexp_extract_all(novel, '《([^》]+)》', 1)) > 0 THEN regexp_extract_all(novel, '《([^》]+)》', 1) ELSE [{S.strip("regexp_replace(novel, '（.*$|作者.*$', '', 'g')")}] END) AS title FROM n),
nb AS (SELECT DISTINCT qid, novel FROM (SELECT qid, unnest(regexp_extract_all(question, '《([^》]+)》', 1)) AS title FROM q) JOIN ti USING (title))"""


@query(f"WITH {S.CHUNKS}, {S.QUESTIONS}, {_NAMED}, qs AS (SELECT qid, question, novel FROM q JOIN nb USING (qid)), {S.bm25('qs', 'novel')} SELECT qid, novel, chunk_id, score, rank::INT AS rank FROM b")
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name books, with statistics of those books only."""
    c, q = chunks(spark, sf_dir), U.questions(table(spark, sf_dir, "chat_turns"))
    return L.bm25(shelf(spark, sf_dir), q.join(U.named_books(q, c.select("novel").distinct()), "qid"), 20, ["novel"])


_DENSE = f"""dn AS (SELECT qid, c.novel, chunk_id, {S.cosine('vec', 'embedding')} AS score FROM q, c WHERE {S.usable('vec')} AND {S.usable('embedding')}),
dk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, novel, chunk_id) AS rank FROM dn QUALIFY rank <= 20)"""


@query(f"WITH {S.CHUNKS}, {ASKED}, {_DENSE} SELECT qid, novel, chunk_id, score, rank::INT AS rank FROM dk")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact(with_vector(asked(spark, sf_dir)), vectors(spark, sf_dir), 20)


@query(
    f"""WITH {S.CHUNKS}, {S.NODES} SELECT qid, novel, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM
(SELECT summary_id AS qid, novel, chunk_id, {S.cosine('h.embedding', 'c.embedding')} AS score FROM h JOIN c USING (novel) WHERE level = 'novel' AND {S.usable('h.embedding')} AND {S.usable('c.embedding')})) WHERE rank <= 20"""
)
def cosine_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book node against the chunks of its own book."""
    book = nodes(spark, sf_dir).where("level = 'novel'").select(F.col("summary_id").alias("qid"), "novel", F.col("embedding").alias("vec"))
    return D.scoped(with_vector(book), vectors(spark, sf_dir), 20)


@query(f"WITH {S.CHUNKS}, {ASKED}, {_DENSE} SELECT qid, novel, chunk_id, score FROM dn QUALIFY row_number() OVER (PARTITION BY qid, novel ORDER BY score DESC, chunk_id) <= 2")
def cosine_per_book_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest chunks of every book."""
    return D.per_book(with_vector(asked(spark, sf_dir)), vectors(spark, sf_dir), 2)


_TAIL = f"""an AS (SELECT novel, max(chunk_id) AS anchor FROM c WHERE {S.any_of('text', words.ENDING_MARKERS[:4])} GROUP BY novel),
tl AS (SELECT c.novel, chunk_id, row_number() OVER (PARTITION BY c.novel ORDER BY chunk_id DESC) AS rank FROM c LEFT JOIN an USING (novel) WHERE anchor IS NULL OR chunk_id <= anchor QUALIFY rank <= 3)"""
_HEAD = "hd AS (SELECT novel, chunk_id, row_number() OVER (PARTITION BY novel ORDER BY chunk_id) AS rank FROM c QUALIFY rank <= 3)"


@query(f"WITH {S.CHUNKS}, {_TAIL} SELECT novel, chunk_id, rank::INT AS rank FROM tl")
def positional_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.positional(chunks(spark, sf_dir), True, 3)


@query(f"WITH {S.CHUNKS}, {_HEAD} SELECT novel, chunk_id, rank::INT AS rank FROM hd")
def positional_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.positional(chunks(spark, sf_dir), False, 3)


_CHANNELS = f"""{S.CHUNKS}, {ASKED}, {_DENSE}, {S.bm25('q')}, {_HEAD},
ch AS (SELECT qid, novel, chunk_id, 'dense' AS channel, 0 AS place, rank FROM dk UNION ALL SELECT qid, novel, chunk_id, 'keyword', 1, rank FROM b
  UNION ALL SELECT qid, novel, chunk_id, 'positional', 2, hd.rank FROM q JOIN hd USING (novel))"""
_FUSED = _CHANNELS + """, fu AS (SELECT qid, novel, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min((place, rank)) AS seen FROM ch GROUP BY 1, 2, 3),
rf AS (SELECT qid, novel, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, novel, chunk_id) AS rank FROM fu QUALIFY rank <= 20)"""
_RERANKED = _FUSED + f""", rr AS (SELECT qid, rf.novel, rf.chunk_id, rf.rank AS previous_rank, list_distinct({S.terms('question')}) AS ts, text FROM rf JOIN q USING (qid) JOIN c ON c.novel = rf.novel AND c.chunk_id = rf.chunk_id),
r2 AS (SELECT qid, novel, chunk_id, previous_rank, CASE WHEN len(ts) > 0 THEN round(len(list_filter(ts, lambda t: contains(text, t)))::DOUBLE / len(ts), 6) ELSE 0.0::DOUBLE END AS score FROM rr),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, previous_rank) AS rank FROM r2 QUALIFY rank <= 10)"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = chunks(spark, sf_dir), asked(spark, sf_dir)
    head = q.select("qid", "novel").join(X.positional(c, False, 3), "novel")
    return fusion.channels([("dense", cosine_topk(spark, sf_dir)), ("keyword", L.bm25(shelf(spark, sf_dir), q.select("qid", "question"), 20)), ("positional", head)])


@query(f"WITH {_CHANNELS} SELECT qid, novel, chunk_id, channel, rank::INT AS rank FROM ch")
def channel_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir).drop("place")


@query(f"WITH {_FUSED} SELECT qid, novel, chunk_id, score, rank::INT AS rank FROM rf")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_channels(spark, sf_dir), 20)


@query(f"WITH {_RERANKED} SELECT qid, novel, chunk_id, score, rank::INT AS rank, previous_rank::INT AS previous_rank FROM rk")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank(rrf_fuse(spark, sf_dir), asked(spark, sf_dir), chunks(spark, sf_dir), 10)


@query(f"WITH {_RERANKED} SELECT qid, novel, chunk_id, rank::INT AS rank FROM rk WHERE rank <= 3")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank_lexical(spark, sf_dir).where("rank <= 3").select("qid", "novel", "chunk_id", "rank")


@query(f"WITH {_RERANKED} SELECT qid, novel, chunk_id, rank::INT AS rank, previous_rank::INT AS previous_rank, rank <= 3 AS selected, score FROM rk")
def trace_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten candidates with their rank before reranking and whether they were taken."""
    return rerank_lexical(spark, sf_dir).withColumn("selected", F.col("rank") <= 3)


@query(f"WITH {_FUSED}, db AS (SELECT qid, novel, count(*) AS n FROM rf GROUP BY 1, 2) SELECT qid, novel, n FROM db QUALIFY 2 * n >= max(n) OVER (PARTITION BY qid)")
def dominant_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dominant_books(rrf_fuse(spark, sf_dir))


@query(
    f"""WITH {_RERANKED}, t1 AS (SELECT qid, unnest(list_distinct({S.terms('question')})) AS term FROM q),
cv AS (SELECT qid, avg(there) AS coverage FROM (SELECT qid, term, max(contains(c.text, term)::INT) AS there FROM t1 JOIN rk USING (qid) JOIN c ON c.novel = rk.novel AND c.chunk_id = rk.chunk_id GROUP BY 1, 2) GROUP BY qid),
g AS (SELECT qid, max(1 / (1 + exp(-score))) FILTER (WHERE rank = 1) AS s1, max(1 / (1 + exp(-score))) FILTER (WHERE rank = 2) AS s2, count(DISTINCT novel) AS dispersion FROM rk GROUP BY qid)
SELECT qid, round(coalesce(s1 - s2, 1), 6) AS score_gap, round(coalesce(coverage, 1), 6) AS term_coverage, dispersion,
  round(coalesce(coverage, 1), 6) < 0.5 OR (round(coalesce(s1 - s2, 1), 6) < 0.05 AND dispersion <= 1) AS is_low FROM g LEFT JOIN cv USING (qid)"""
)
def confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.confidence(rerank_lexical(spark, sf_dir), asked(spark, sf_dir), chunks(spark, sf_dir))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best chunks by words alone for every chapter title, as hits for what follows retrieval."""
    chapter = nodes(spark, sf_dir).where("level = 'chapter' AND title IS NOT NULL")
    return L.bm25(shelf(spark, sf_dir), chapter.select(F.col("summary_id").alias("qid"), F.col("title").alias("question")), 3)


_TOP = f"{S.CHUNKS}, {ASKED.replace(' AND summary_id % 50 = 0', '')}, {S.bm25('q', k=3)}"


@query(f"WITH {_TOP} SELECT qid, c.novel, c.chunk_id, min(rank)::INT AS hit_rank FROM b JOIN c ON c.novel = b.novel AND c.chunk_id BETWEEN b.chunk_id - 1 AND b.chunk_id + 1 GROUP BY 1, 2, 3")
def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.neighbours(_top(spark, sf_dir), chunks(spark, sf_dir))


_GROUPS = f"""{_TOP}, ht AS (SELECT qid, b.novel, b.chunk_id, rank, chapter_title FROM b JOIN c ON c.novel = b.novel AND c.chunk_id = b.chunk_id),
gr AS (SELECT qid, novel, chapter_title, min(rank)::INT AS group_rank FROM ht WHERE chapter_title IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"WITH {_GROUPS} SELECT qid, gr.novel, gr.chapter_title, c.chunk_id, group_rank FROM gr JOIN c ON c.novel = gr.novel AND c.chapter_title = gr.chapter_title UNION ALL SELECT qid, novel, chapter_title, chunk_id, rank::INT FROM ht WHERE chapter_title IS NULL")
def chapter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chapters_of(_top(spark, sf_dir), chunks(spark, sf_dir))


@query()
def chapter_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chapter_budget(_top(spark, sf_dir), chunks(spark, sf_dir))


@query(f"WITH {S.CHUNKS}, sb AS (SELECT novel, sum(length(text))::BIGINT AS chars FROM c GROUP BY novel HAVING sum(length(text)) BETWEEN 1 AND 8000) SELECT novel, chunk_id, chars FROM c JOIN sb USING (novel)")
def full_text_shortcircuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.short_books(chunks(spark, sf_dir))


_BLOCK = f"""'[' || rank || '] 《' || CASE WHEN len(regexp_extract_all(b.novel, '《([^》]+)》', 1)) > 0 THEN regexp_extract(b.novel, '《([^》]+)》', 1) ELSE {S.strip("regexp_replace(b.novel, '（.*$|作者.*$', '', 'g')")} END || '》' ||
  coalesce(' · ' || chapter_title, '') || ' · 片段 #' || b.chunk_id || chr(10) || text"""


@query(f"WITH {_TOP} SELECT qid, md5(string_agg({_BLOCK}, chr(10) || '---' || chr(10) ORDER BY rank)) AS digest FROM b JOIN c ON c.novel = b.novel AND c.chunk_id = b.chunk_id GROUP BY qid")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.prompt_blocks(_top(spark, sf_dir), chunks(spark, sf_dir)).select("qid", F.md5("prompt").alias("digest"))


_RUNS = f"""{S.CHUNKS}, r0 AS (SELECT *, row_number() OVER w = 1 OR lag(chapter_title) OVER w IS DISTINCT FROM chapter_title AS fresh FROM c WINDOW w AS (PARTITION BY novel ORDER BY chunk_id)),
r1 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY novel ORDER BY chunk_id) AS whole FROM r0),
r2 AS (SELECT *, CASE WHEN chapter_title IS NULL THEN ((row_number() OVER (PARTITION BY novel, whole ORDER BY chunk_id) - 1) % 12 = 0)::INT ELSE fresh::INT END AS step FROM r1),
r3 AS (SELECT *, sum(step) OVER (PARTITION BY novel ORDER BY chunk_id)::BIGINT AS run FROM r2),
nd AS (SELECT novel, run - 1 AS node_order, any_value(chapter_title) AS t, min(chunk_id) AS start_chunk_id, max(chunk_id) AS end_chunk_id, count(*) AS chunks FROM r3 GROUP BY novel, run),
ns AS (SELECT novel, node_order, 'chapter:' || node_order || ':' || start_chunk_id || '-' || end_chunk_id AS node_id, coalesce(t, '未命名章节（片段 ' || start_chunk_id || '–' || end_chunk_id || '）') AS title, start_chunk_id, end_chunk_id, chunks FROM nd)"""


@query(f"WITH {_RUNS} SELECT novel, node_order, node_id, title, start_chunk_id, end_chunk_id, chunks FROM ns")
def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.chapter_nodes(chunks(spark, sf_dir)).drop("summary")


def _summary_sql(title: str, texts: str, limit: int = 800) -> str:
    """The summary of the texts in the order of a list, at most five of them, evenly spread."""
    picked = f"list_transform(CASE WHEN len({texts}) <= 5 THEN range(len({texts})) ELSE list_sort(list_distinct(list_transform(range(5), lambda i: round_even(i * (len({texts}) - 1) / 4.0, 0)::BIGINT))) END, lambda i: {texts}[i + 1])"
    share = f"greatest(40, (({limit} - length({title}) - 9) // least(len({texts}), 5))::BIGINT)"
    body = f"array_to_string(list_transform({picked}, lambda x: substring(x, 1, {share})), ' … ')"
    return f"substring(CASE WHEN len({texts}) = 0 THEN {title} ELSE {title} || '：' || {body} END, 1, {limit})"


_COMPACT = S.strip(f"regexp_replace(text, '{S.BLANK}+', ' ', 'g')")
_SUMMARIES = f"""{_RUNS}, tx AS (SELECT novel, run - 1 AS node_order, list({_COMPACT} ORDER BY chunk_id) FILTER (WHERE {_COMPACT} <> '') AS tl FROM r3 GROUP BY 1, 2),
sm AS (SELECT ns.*, {_summary_sql('title', "coalesce(tl, []::VARCHAR[])")} AS summary FROM ns JOIN tx USING (novel, node_order)),
bs AS (SELECT novel, '《' || novel || '》全书概览' AS title, min(start_chunk_id) AS start_chunk_id, max(end_chunk_id) AS end_chunk_id,
  list({S.strip(f"regexp_replace(title || ' ' || summary, '{S.BLANK}+', ' ', 'g')")} ORDER BY node_order) AS y FROM sm GROUP BY novel),
bt AS (SELECT *, list_transform(CASE WHEN len(y) <= 12 THEN range(len(y)) ELSE list_sort(list_distinct(list_transform(range(12), lambda i: round_even(i * (len(y) - 1) / 11.0, 0)::BIGINT))) END, lambda i: y[i + 1]) AS tl FROM bs)"""


@query(f"WITH {_SUMMARIES} SELECT novel, 'chapter' AS level, title, start_chunk_id, end_chunk_id, md5(summary) AS digest FROM sm UNION ALL SELECT novel, 'novel', title, start_chunk_id, end_chunk_id, md5({_summary_sql('title', 'tl')}) FROM bt")
def hierarchy_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = H.chapter_nodes(chunks(spark, sf_dir))
    cols = ["novel", "level", "title", "start_chunk_id", "end_chunk_id", F.md5("summary").alias("digest")]
    return made.withColumn("level", F.lit("chapter")).select(*cols).unionByName(H.book_nodes(made).withColumn("level", F.lit("novel")).select(*cols))


@query(
    f"""WITH {S.NODES}, hs AS (SELECT a.summary_id AS qid, b.summary_id AS node, a.novel, {S.cosine('a.embedding', 'b.embedding')} AS score FROM h a JOIN h b USING (novel) WHERE a.level = 'novel' AND b.level = 'chapter' AND {S.usable('a.embedding')} AND {S.usable('b.embedding')})
SELECT qid, node, novel, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, node))::INT AS rank FROM hs QUALIFY rank <= 6"""
)
def hierarchy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six chapter nodes of each book that are nearest to its book node."""
    h = nodes(spark, sf_dir).where(T.usable_vector(F.col("embedding"), EMBEDDING_WIDTH))
    book = h.where("level = 'novel'").select(F.col("summary_id").alias("qid"), "novel", F.col("embedding").alias("a"))
    part = h.where("level = 'chapter'").select(F.col("summary_id").alias("node"), "novel", F.col("embedding").alias("b"))
    scored = book.join(part, "novel").select("qid", "node", "novel", F.round(T.cosine(F.col("a"), F.col("b")), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "node")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 6")


@query(f"WITH {_RUNS}, bt AS (SELECT DISTINCT novel, node_id, node_order, unnest([start_chunk_id, (start_chunk_id + end_chunk_id) // 2, end_chunk_id])::INT AS chunk_id FROM ns) SELECT novel, node_id, chunk_id, node_order FROM bt JOIN c USING (novel, chunk_id)")
def hierarchy_backtrace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return H.back_to_chunks(H.chapter_nodes(c), c)


_ROUTE = f"""CASE WHEN {S.any_of('question', words.EXPLICIT_FREE)} THEN 'free'
 WHEN (contains(question, '《') AND contains(question, '》')) OR {S.any_of('question', words.GROUNDED_SIGNALS)} THEN 'grounded'
 WHEN regexp_matches(lower(question), '{words.GREETING}') OR regexp_matches(question, '{words.ASSISTANT}') THEN 'free'
 WHEN {S.any_of('lower(question)', words.GENERAL_SIGNALS)} OR regexp_matches(question, '{words.CREATIVE}') THEN 'free' ELSE 'grounded' END"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.questions(table(spark, sf_dir, "chat_turns"))


@query(f"WITH {S.QUESTIONS} SELECT qid, {_ROUTE} AS route FROM q")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("qid", U.route(F.col("question")).alias("route"))


@query(
    f"""WITH {S.QUESTIONS} SELECT qid, {S.any_of('question', words.GLOBAL_SIGNALS)} AS is_global,
 CASE WHEN {S.any_of('question', words.TAIL_WORDS)} THEN 'tail' WHEN {S.any_of('question', words.HEAD_WORDS)} THEN 'head' END AS kind,
 (contains(question, '小说') AND regexp_matches(question, '{words.CATALOGUE}')) OR (contains(question, '书架') AND regexp_matches(question, '(?:有|包含|多少|几|哪些|全部)')) AS catalogue,
 CASE WHEN regexp_matches(question, '{words.CATALOGUE}') AND NOT regexp_matches(question, '章节|片段|段落') THEN 'catalog' WHEN regexp_matches(question, '章节|片段|段落') AND regexp_matches(question, '{words.EXHAUSTIVE}') THEN 'library'
  WHEN regexp_matches(question, '{words.EXHAUSTIVE}') THEN 'exhaustive' ELSE 'open' END AS scope FROM q"""
)
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return _questions(spark, sf_dir).select(
        "qid", U.is_global(q).alias("is_global"), U.structural_kind(q).alias("kind"), U.is_catalogue(q).alias("catalogue"), U.scope(q).alias("scope")
    )


_RELATION = "CASE " + " ".join(f"WHEN {S.any_of('question', v)} THEN '{k}'" for k, v in words.RELATION_QUESTIONS.items()) + " END"


@query(f"WITH {S.QUESTIONS} SELECT qid, {_RELATION} AS relation FROM q")
def relation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("qid", U.relation_asked(F.col("question")).alias("relation"))


@query(f"WITH {S.TURNS} SELECT session_id, turn_index, turn_index > 0 AND (length({S.strip('content')}) <= 8 OR {S.any_of('content', words.REFERRING)}) AS rewrite, translate({S.strip('content')}, '{words.IGNORABLE}', '') AS bare FROM t WHERE lower(trim(role)) = 'user' AND content IS NOT NULL")
def needs_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.strip(F.col("content"))
    turns = latest_turns(spark, sf_dir).where("lower(trim(role)) = 'user' AND content IS NOT NULL")
    return turns.select("session_id", "turn_index", U.needs_rewrite(q, F.col("turn_index") > 0).alias("rewrite"), U.normalised(q).alias("bare"))


@query(f"WITH {S.CHUNKS}, {S.QUESTIONS}, {_NAMED} SELECT qid, novel FROM nb")
def named_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.named_books(_questions(spark, sf_dir), chunks(spark, sf_dir).select("novel").distinct())
