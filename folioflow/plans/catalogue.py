"""Queries over books, titles and contexts: what a question names, reading on, comparing runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.config import EMBEDDING_WIDTH, HIERARCHY_TOP_K, TOP_K
from folioflow.functions import text as T
from folioflow.functions import words
from folioflow.operators import chunks as C
from folioflow.operators import context as X
from folioflow.operators import dense as D
from folioflow.operators import evaluation as E
from folioflow.operators import fusion
from folioflow.operators import graph as G
from folioflow.operators import hierarchy as H
from folioflow.operators import lexical as L
from folioflow.operators import understand as U
from folioflow.plans import evaluate as P
from folioflow.plans import retrieve as R
from folioflow.plans import sql as S
from folioflow.plans.register import query
from folioflow.plans.texts import chunks, latest_turns, shelf
from folioflow.session import table
from folioflow.sources.shared import new_path
from folioflow.sources.snapshots import Snapshots

_TITLES = f"""n AS (SELECT DISTINCT novel FROM c),
ti AS (SELECT novel, unnest(ts) AS title, unnest(range(len(ts))) AS place FROM (SELECT novel, CASE WHEN len(regexp_extract_all(novel, '《([^》]+)》', 1)) > 0 THEN regexp_extract_all(novel, '《([^》]+)》', 1) ELSE [{S.strip("regexp_replace(novel, '（.*$|作者.*$', '', 'g')")}] END AS ts FROM n)),
mb AS (SELECT DISTINCT qid, novel FROM q JOIN ti ON title <> '' AND contains(question, title))"""


def _novels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("novel").distinct()


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.questions(table(spark, sf_dir, "chat_turns"))


@query(f"WITH {S.CHUNKS}, {S.QUESTIONS}, {_TITLES} SELECT qid, novel FROM mb")
def mentioned_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that a question names, in brackets or not."""
    return U.mentioned_books(_questions(spark, sf_dir), _novels(spark, sf_dir))


@query()
def fuzzy_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that a question names, also with a typing error, anywhere in it."""
    return U.fuzzy_books(_questions(spark, sf_dir), _novels(spark, sf_dir))


@query()
def resolved_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one book that each title in brackets stands for."""
    said = _questions(spark, sf_dir).select(F.explode(T.named_titles(F.col("question"))).alias("question")).distinct()
    return U.resolve_books(said.select(F.md5("question").alias("qid"), "question"), _novels(spark, sf_dir))


_STRIPPED = f"""{_TITLES}, tq AS (SELECT qid, list(title ORDER BY novel, place) AS ts FROM mb JOIN ti USING (novel) WHERE title <> '' GROUP BY qid),
st AS (SELECT qid, list_reduce(ts, lambda x, t: replace(replace(x, '《' || t || '》', ' '), t, ' '), question) AS question FROM q JOIN tq USING (qid))"""


def _stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question, novel) of the questions that name books, a row a book, without the titles."""
    q, novels = _questions(spark, sf_dir), _novels(spark, sf_dir)
    named = U.mentioned_books(q, novels)
    titles = novels.select("novel", F.posexplode(T.titles(F.col("novel"))).alias("place", "title")).where("title <> ''")
    listed = named.join(titles, "novel").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("novel", "place", "title"))).alias("t"))
    bare = q.join(listed, "qid").select("qid", U.strip_titles(F.col("question"), F.transform("t", lambda x: x["title"])).alias("question"))
    return bare.join(named, "qid")


@query(f"WITH {S.CHUNKS}, {S.QUESTIONS}, {_STRIPPED} SELECT qid, question FROM st")
def stripped_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stripped(spark, sf_dir).select("qid", "question").distinct()


@query(f"WITH {S.CHUNKS}, {S.QUESTIONS}, {_STRIPPED}, qs AS (SELECT qid, question, novel FROM st JOIN mb USING (qid)), {S.bm25('qs', 'novel')} SELECT qid, novel, chunk_id, score, rank::INT AS rank FROM b")
def bm25_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within the books that a question names, for what it says besides their titles."""
    return L.bm25(shelf(spark, sf_dir), _stripped(spark, sf_dir), 20, ["novel"])


_KIND = f"CASE WHEN {S.any_of('question', words.TAIL_WORDS)} THEN 'tail' WHEN {S.any_of('question', words.HEAD_WORDS)} THEN 'head' END"
_TARGETS = f"""{_TITLES}, kd AS (SELECT qid, {_KIND} AS kind FROM q), nn AS (SELECT count(*) AS k FROM n), nm AS (SELECT qid, count(*) AS k FROM mb GROUP BY qid),
tg AS (SELECT kd.qid, kind, novel, greatest(1, {TOP_K} // k) AS quota FROM kd JOIN mb USING (qid) JOIN nm USING (qid) WHERE kind IS NOT NULL
  UNION ALL SELECT kd.qid, kind, novel, greatest(1, {TOP_K} // k) FROM kd CROSS JOIN n CROSS JOIN nn WHERE kind IS NOT NULL AND qid NOT IN (SELECT qid FROM mb))"""


@query(
    f"""WITH {S.CHUNKS}, {S.QUESTIONS}, {_TARGETS}, an AS (SELECT novel, max(chunk_id) AS anchor FROM c WHERE {S.any_of('text', words.ENDING_MARKERS[:4])} GROUP BY novel),
ps AS (SELECT 'tail' AS kind, c.novel, chunk_id, row_number() OVER (PARTITION BY c.novel ORDER BY chunk_id DESC) AS rank FROM c LEFT JOIN an USING (novel) WHERE anchor IS NULL OR chunk_id <= anchor
  UNION ALL SELECT 'head', novel, chunk_id, row_number() OVER (PARTITION BY novel ORDER BY chunk_id) FROM c)
SELECT qid, novel, chunk_id, rank::INT AS rank FROM tg JOIN ps USING (kind, novel) WHERE rank <= quota"""
)
def positional_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a question asks for an end or a beginning: the last or first chunks of the books it
    names, else of all, so many that they share the places."""
    c, q = chunks(spark, sf_dir), _questions(spark, sf_dir)
    kinds = q.select("qid", U.structural_kind(F.col("question")).alias("kind")).where("kind IS NOT NULL")
    novels = _novels(spark, sf_dir)
    named = kinds.join(U.mentioned_books(q, novels), "qid")
    rest = kinds.join(named.select("qid").distinct(), "qid", "left_anti")
    number = F.count("*").over(Window.partitionBy("qid"))
    # questions without a book are answered for every book; what they are asked for is the same for all
    every = rest.join(F.broadcast(novels.agg(F.count("*").alias("books"))), F.lit(True))
    quota = lambda k: F.greatest(F.lit(1), F.floor(F.lit(TOP_K) / k).cast("int"))
    some = named.withColumn("quota", quota(number)).select("qid", "kind", "novel", "quota")
    ends = X.positional(c, True, TOP_K).withColumn("kind", F.lit("tail")).unionByName(X.positional(c, False, TOP_K).withColumn("kind", F.lit("head")))
    of_named = some.join(ends, ["kind", "novel"])
    of_all = every.withColumn("quota", quota(F.col("books"))).drop("books").join(ends, "kind")
    return of_named.where("rank <= quota").select("qid", "novel", "chunk_id", "rank").unionByName(
        of_all.where("rank <= quota").select("qid", "novel", "chunk_id", "rank")
    )


@query(
    f"""WITH {S.CHUNKS}, {R.ASKED}, bk AS (SELECT qid, h.novel, {S.cosine('vec', 'h.embedding')} AS score FROM q, h WHERE h.level = 'novel' AND {S.usable('vec')} AND {S.usable('h.embedding')} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {S.cosine('vec', 'h.embedding')} DESC, h.novel, summary_id) <= 2),
nb AS (SELECT qid, count(DISTINCT novel) AS n FROM bk GROUP BY qid),
pc AS (SELECT q.qid, h.novel, summary_id AS node, h.start_chunk_id AS s, h.end_chunk_id AS e, {S.cosine('vec', 'h.embedding')} AS score FROM q JOIN (SELECT DISTINCT qid, novel FROM bk) b ON b.qid = q.qid JOIN h ON h.novel = b.novel WHERE h.level = 'chapter' AND {S.usable('h.embedding')}),
pq AS (SELECT pc.*, n FROM pc JOIN nb USING (qid) QUALIFY row_number() OVER (PARTITION BY qid, novel ORDER BY score DESC, node) <= greatest(2, ceil({HIERARCHY_TOP_K} / n))),
pk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) AS r FROM pq QUALIFY r <= greatest({HIERARCHY_TOP_K}, 2 * n)),
pw AS (SELECT qid, novel, r, unnest([s, (s + e) // 2, e])::INT AS chunk_id FROM pk)
SELECT qid, novel, chunk_id, min(r)::INT AS rank FROM pw JOIN c USING (novel, chunk_id) GROUP BY 1, 2, 3"""
)
def hierarchy_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the two nearest books to their nearest chapters, so many of each book as share the places,
    and on to the first, middle and last chunk of each."""
    q = R.with_vector(R.asked(spark, sf_dir))
    h = R.nodes(spark, sf_dir).where(T.usable_vector(F.col("embedding"), EMBEDDING_WIDTH))
    return H.retrieve(q, h, chunks(spark, sf_dir))


_NODES_ASKED = f"{S.NODES}, nq AS (SELECT summary_id AS qid, novel, title, start_chunk_id AS chunk_id FROM h WHERE level = 'chapter' AND title IS NOT NULL)"


def _nodes_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapter = R.nodes(spark, sf_dir).where("level = 'chapter' AND title IS NOT NULL")
    return chapter.select(F.col("summary_id").alias("qid"), "novel", "title", F.col("start_chunk_id").alias("chunk_id"))


@query(f"WITH {S.CHUNKS}, {_NODES_ASKED} SELECT qid, c.novel, c.chunk_id FROM nq JOIN c ON c.novel = nq.novel AND c.chunk_id BETWEEN nq.chunk_id - 2 AND nq.chunk_id + 2")
def read_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.around(_nodes_asked(spark, sf_dir), chunks(spark, sf_dir), 2)


@query(
    f"""WITH {S.CHUNKS}, {_NODES_ASKED}, gc AS (SELECT qid, c.novel, c.chunk_id, row_number() OVER (PARTITION BY qid ORDER BY c.chunk_id) AS r FROM nq JOIN c ON c.novel = nq.novel AND c.chapter_title ILIKE '%' || nq.title || '%')
SELECT qid, novel, chunk_id, max(r) OVER (PARTITION BY qid) <= 8 AS complete FROM gc QUALIFY r <= 8"""
)
def get_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chapter_like(_nodes_asked(spark, sf_dir), chunks(spark, sf_dir))


_CACHE = f"cx AS (SELECT md5(text) AS text_hash, min(context) AS cached FROM novel_chunks WHERE text IS NOT NULL AND NOT {S.is_blank('context')} GROUP BY 1), up AS (SELECT row_id, novel, md5(text) AS text_hash FROM parsed_chunks WHERE NOT {S.is_blank('text')})"


def _uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cache = table(spark, sf_dir, "novel_chunks").where("text IS NOT NULL").select(F.md5("text").alias("text_hash"), "context")
    return X.cached_contexts(table(spark, sf_dir, "parsed_chunks").where(~T.is_blank(F.col("text"))), cache)


@query(f"WITH {_CACHE} SELECT row_id, novel, cached FROM up JOIN cx USING (text_hash)")
def context_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded chunks whose text has a context already."""
    return _uploads(spark, sf_dir)[0].select("row_id", "novel", "cached")


@query(f"WITH {_CACHE} SELECT row_id, novel FROM up WHERE text_hash NOT IN (SELECT text_hash FROM cx)")
def context_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploads(spark, sf_dir)[1].select("row_id", "novel")


@query(f"SELECT id, md5(CASE WHEN {S.is_blank('context')} THEN text ELSE context || chr(10) || text END) AS digest FROM novel_chunks WHERE NOT {S.is_blank('text')}")
def indexed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "novel_chunks").where(~T.is_blank(F.col("text")))
    return rows.select("id", F.md5(L.indexed_text(rows)).alias("digest"))


_REPLIES = f"{S.TURNS}, re AS (SELECT a.session_id, a.turn_index, a.content AS question, b.content AS answer FROM t a JOIN t b ON b.session_id = a.session_id AND b.turn_index = a.turn_index + 1 WHERE lower(trim(a.role)) = 'user' AND a.content IS NOT NULL AND b.content IS NOT NULL)"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = latest_turns(spark, sf_dir).where("content IS NOT NULL")
    said = turns.where("lower(trim(role)) = 'user'").select("session_id", "turn_index", F.col("content").alias("question"))
    after = turns.select("session_id", (F.col("turn_index") - 1).alias("turn_index"), F.col("content").alias("answer"))
    return said.join(after, ["session_id", "turn_index"])


_QUOTES = r"""'^(?:"(.*)"|「(.*)」|“(.*)”|''(.*)'')$'"""


@query(
    f"""WITH {_REPLIES}, li AS (SELECT session_id, turn_index, question, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT *, string_split_regex(answer, '\\r\\n|\\r|\\n') AS ls FROM re)),
lm AS (SELECT * REPLACE (regexp_replace({S.strip("regexp_replace(" + S.strip('line') + ", '^(?:[-*•·]|[0-9]+[.、．)）])\\s*', '')")}, {_QUOTES}, '\\1\\2\\3\\4') AS line) FROM li),
lf AS (SELECT *, translate(line, '{words.IGNORABLE}', '') AS k FROM lm WHERE length(line) BETWEEN 4 AND length(question) * 3 + 50),
lk AS (SELECT session_id, turn_index, line, pos FROM lf WHERE k <> '' AND k <> translate(question, '{words.IGNORABLE}', '') QUALIFY row_number() OVER (PARTITION BY session_id, turn_index, k ORDER BY pos) = 1)
SELECT session_id, turn_index, string_agg(line, chr(10) ORDER BY pos) AS variants FROM (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY session_id, turn_index ORDER BY pos) <= 3) GROUP BY 1, 2"""
)
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other wordings of a question, read from the lines of its reply."""
    found = U.variants(F.col("question"), F.col("answer"))
    return _replies(spark, sf_dir).select("session_id", "turn_index", found.alias("v")).where(F.size("v") > 0).select(
        "session_id", "turn_index", F.array_join("v", "\n").alias("variants")
    )


@query(
    f"""WITH {_REPLIES}, pn AS (SELECT session_id, turn_index, list_filter(list_transform(string_split_regex(answer, '[、,，。；;\\s]+'), lambda x: regexp_replace(x, '^[.！!：:（）()「」《》]+|[.！!：:（）()「」《》]+$', '', 'g')), lambda x: regexp_full_match(x, '[一-龥]{{2,4}}')) AS names FROM re)
SELECT session_id, turn_index, array_to_string(names, ' ') AS names FROM pn WHERE len(names) > 0"""
)
def reply_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of persons listed in replies."""
    names = U.person_names(F.col("answer"))
    return _replies(spark, sf_dir).select("session_id", "turn_index", names.alias("n")).where(F.size("n") > 0).select(
        "session_id", "turn_index", F.array_join("n", " ").alias("names")
    )


_SAID = "[。！？”』」\\n]([\\x{4e00}-\\x{9fff}]{2,3})(?:笑|喝|叹|答|问|说)道"


@query(f"WITH {S.CHUNKS} SELECT novel, name, count(DISTINCT chunk_id // 10) AS batches FROM (SELECT novel, chunk_id, unnest(regexp_extract_all(text, '{_SAID}', 1)) AS name FROM c) GROUP BY 1, 2 HAVING count(DISTINCT chunk_id // 10) >= 2")
def names_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons that more than one batch of ten chunks names."""
    return G.named_in_batches(chunks(spark, sf_dir))


@query(f"WITH {P._CASES} SELECT CASE WHEN starts_with(question, '第') THEN 'numbered' ELSE 'other' END AS category, count(*) AS cases, round(avg(routed::INT), 6) AS accuracy FROM cs JOIN q USING (qid) GROUP BY 1")
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = P._questions_asked(spark, sf_dir).select("qid", "question")
    category = F.when(F.col("question").startswith("第"), "numbered").otherwise("other")
    return E.by_category(P._cases(spark, sf_dir).join(asked, "qid"), category, F.col("routed"))


@query(
    f"""WITH {P._CASES}, lt AS (SELECT qid, c.chunk_id, c.chunk_id BETWEEN q.start_chunk_id AND q.end_chunk_id AS own, row_number() OVER (PARTITION BY qid ORDER BY c.chunk_id) AS r FROM q JOIN c ON c.novel = want AND contains(text, question)),
bl AS (SELECT q.qid, min(r) FILTER (WHERE own AND r <= 20)::INT AS baseline_rank FROM q LEFT JOIN lt ON lt.qid = q.qid GROUP BY q.qid)
SELECT qid, hit_rank::INT AS hit_rank, baseline_rank, CASE WHEN hit_rank IS NOT DISTINCT FROM baseline_rank THEN 'same' WHEN baseline_rank IS NULL THEN 'fixed' WHEN hit_rank IS NULL THEN 'broken' WHEN hit_rank < baseline_rank THEN 'better' ELSE 'worse' END AS change FROM cs JOIN bl USING (qid)"""
)
def case_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the shelf against a search for the title's letters in the own book, case by case."""
    q = P._questions_asked(spark, sf_dir)
    # a chunk without a number comes after all others and is nobody's answer
    own = q.select("qid", F.col("want").alias("novel"), F.col("question").alias("needle"), "start_chunk_id", "end_chunk_id").where("qid IS NOT NULL")
    found = own.join(L.first_containing(chunks(spark, sf_dir), own, 20).drop("r"), ["novel", "needle"])
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id"))).where("r <= 20")
    hits = ranked.where(F.col("chunk_id").between(F.col("start_chunk_id"), F.col("end_chunk_id"))).groupBy("qid").agg(F.min("r").alias("hit_rank"))
    return E.compared(P._cases(spark, sf_dir).where("qid IS NOT NULL"), own.select("qid").distinct().join(hits, "qid", "left"))


@query(f"WITH {P._CASES} SELECT want AS novel, count(DISTINCT chapter_title) AS chapters, count(DISTINCT b.qid) AS cases FROM q JOIN b ON b.qid = q.qid AND b.novel = want JOIN c ON c.novel = b.novel AND c.chunk_id = b.chunk_id GROUP BY 1")
def chapters_per_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chapters of the expected books the hits come from."""
    q = P._questions_asked(spark, sf_dir)
    hits = L.bm25(shelf(spark, sf_dir), q.select("qid", "question"), 20).join(q.select("qid", F.col("want").alias("novel")), ["qid", "novel"])
    return hits.join(chunks(spark, sf_dir).select("novel", "chunk_id", "chapter_title"), ["novel", "chunk_id"]).groupBy("novel").agg(
        F.countDistinct("chapter_title").alias("chapters"), F.countDistinct("qid").alias("cases")
    )


@query(f"WITH {S.TURNS} SELECT session_id, turn_index, role, status FROM t WHERE status IN ('complete', 'error') AND turn_index BETWEEN 1 AND 9 AND content ILIKE '%道%'")
def filtered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = C.matching({"status": ["complete", "error"], "turn_index": (1, 9), "content": "%道%"})
    return latest_turns(spark, sf_dir).where(wanted).select("session_id", "turn_index", "role", "status")


@query(f"WITH {S.CHUNKS} SELECT novel, count(*) AS chunks, max(chunk_id) AS last_chunk FROM c GROUP BY novel")
def published_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shelf published as a snapshot that passes its check, and read back."""
    store = Snapshots(spark, new_path(spark, "shelf-snapshots"))
    rows = chunks(spark, sf_dir).select("novel", "chunk_id", "chapter_title", "text")
    store.publish(rows, check=rows.groupBy("novel", "chunk_id").count().where("count > 1"))
    return store.read_current().groupBy("novel").agg(F.count("*").alias("chunks"), F.max("chunk_id").alias("last_chunk"))


@query()
def rescued_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked candidates; where they tell little, together with what the question's title without
    its number finds."""
    q = R.asked(spark, sf_dir)
    ranked = R.rerank_lexical(spark, sf_dir)
    signals = fusion.confidence(ranked, q, chunks(spark, sf_dir))
    other = q.select("qid", T.strip(F.regexp_replace("question", "^第[^章节卷回]{1,12}[章节卷回]", "")).alias("question")).where("question <> ''")
    found = L.bm25(shelf(spark, sf_dir), other, 20)
    return fusion.rescue(ranked, signals, [found], q, chunks(spark, sf_dir), 10)
