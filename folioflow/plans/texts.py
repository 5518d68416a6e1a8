"""Queries over texts: cleaning, sections, chunks, terms, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.config import EMBEDDING_WIDTH
from folioflow.functions import text as T
from folioflow.functions import words
from folioflow.operators import chunks as C
from folioflow.operators import context as X
from folioflow.operators import lexical as L
from folioflow.operators import understand as U
from folioflow.plans import sql as S
from folioflow.plans.register import query
from folioflow.session import table
from folioflow.sources.shared import is_there, new_path, write


_BUILT: dict[tuple[str, str, str], tuple[str, object]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    """What ``build(path)`` makes, once per application and folder, as long as its files are there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT or not is_there(spark, _BUILT[key][0]):
        path = new_path(spark, name)
        _BUILT[key] = (path, build(path))
    return _BUILT[key][1]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published chunks without vectors and with a number ``doc``, written once and read from then on."""

    def build(path: str) -> DataFrame:
        write(C.published(table(spark, sf_dir, "novel_chunks").drop("embedding")).withColumn("doc", F.monotonically_increasing_id()), path)
        return spark.read.parquet(path)

    return _once(spark, sf_dir, "published", build)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(novel, chunk_id, embedding) of the published chunks that have a usable vector, written once."""

    def build(path: str) -> DataFrame:
        found = C.published(table(spark, sf_dir, "novel_chunks").select("id", "novel", "chunk_id", "chapter_title", "text", "embedding"))
        write(found.where(T.usable_vector(F.col("embedding"), EMBEDDING_WIDTH)).select("novel", "chunk_id", "embedding"), path)
        return spark.read.parquet(path)

    return _once(spark, sf_dir, "vectors", build)


def shelf(spark: SparkSession, sf_dir: str) -> L.Index:
    """The postings of the published chunks, their texts without contexts."""
    published = chunks(spark, sf_dir)

    def build(path: str) -> L.Index:
        made = L.indexed(published.drop("context"))
        spark.range(1).write.parquet(path)  # says that the index is there
        return made

    return _once(spark, sf_dir, "shelf", build)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL")


@query(f"SELECT doc_id, md5({S.clean('text')}) AS cleaned, length({S.clean('text')}) AS n FROM documents WHERE text IS NOT NULL")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = T.clean_text(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(cleaned).alias("cleaned"), F.char_length(cleaned).cast("long").alias("n"))


_PARAS = f"""p0 AS (SELECT doc_id, list_filter(list_transform(string_split_regex({S.clean('text')}, '\\n+'), lambda x: {S.strip('x')}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS paragraph FROM p0),
f AS (SELECT *, length(paragraph) <= 80 AND NOT regexp_matches(paragraph, '{words.SENTENCE_END}') AND regexp_matches(paragraph, '{words.HEADING}') AS is_heading FROM p)"""


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.book_paragraphs(documents(spark, sf_dir), "doc_id", "text")


@query(f"WITH {_PARAS} SELECT doc_id, pos, paragraph FROM p")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).select("doc_id", F.col("pos").cast("long"), "paragraph")


@query(f"WITH {_PARAS} SELECT doc_id, pos, paragraph AS title FROM f WHERE is_heading")
def heading_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).where("is_heading").select("doc_id", F.col("pos").cast("long"), F.col("paragraph").alias("title"))


@query(
    f"""WITH {_PARAS}, s AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section FROM f)
SELECT doc_id, section, first(paragraph ORDER BY pos) FILTER (WHERE is_heading) AS title, count(*) AS paragraphs, sum(length(paragraph))::BIGINT AS chars FROM s GROUP BY doc_id, section"""
)
def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = C.sections(_paragraphs(spark, sf_dir), "doc_id")
    return parts.groupBy("doc_id", "section").agg(
        F.first("title").alias("title"), F.count("*").alias("paragraphs"), F.sum(F.char_length("paragraph")).alias("chars")
    )


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_books(documents(spark, sf_dir), "doc_id", "text")


@query(
    f"""WITH RECURSIVE {_PARAS}, ok AS (SELECT doc_id FROM p GROUP BY doc_id HAVING max(length(paragraph)) <= 500),
s AS (SELECT doc_id, paragraph, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section, pos FROM f WHERE doc_id IN (FROM ok)),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS r FROM s),
x AS (SELECT doc_id, section, r, paragraph AS cur, NULL::VARCHAR AS done FROM z WHERE r = 1
  UNION ALL SELECT z.doc_id, z.section, z.r,
    CASE WHEN length(x.cur) + 2 + length(z.paragraph) <= 500 THEN x.cur || chr(10) || chr(10) || z.paragraph
      WHEN least(length(x.cur), 80) + 2 + length(z.paragraph) <= 500 THEN right(x.cur, 80) || chr(10) || chr(10) || z.paragraph ELSE z.paragraph END,
    CASE WHEN length(x.cur) + 2 + length(z.paragraph) <= 500 THEN NULL ELSE x.cur END
  FROM x JOIN z ON z.doc_id = x.doc_id AND z.section = x.section AND z.r = x.r + 1),
o AS (SELECT doc_id, section, r, done AS text FROM x WHERE done IS NOT NULL UNION ALL
  SELECT doc_id, section, r + 1, cur FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY r DESC) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, r) - 1 AS chunk_id, md5(text) AS digest FROM o"""
)
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents whose paragraphs all fit a chunk."""
    books = documents(spark, sf_dir).withColumn("ps", T.paragraphs(T.clean_text(F.col("text"))))
    fit = books.where(F.forall("ps", lambda p: F.char_length(p) <= 500)).drop("ps")
    return C.chunk_books(fit, "doc_id", "text").select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.md5("text").alias("digest"))


@query(f"WITH {S.CHUNKS}, e AS (SELECT novel, chunk_id, unnest({S.terms('text')}) AS term FROM c) SELECT novel, chunk_id, term, count(*) AS tf FROM e GROUP BY ALL")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = shelf(spark, sf_dir)
    return i.postings.join(i.docs.select("doc", "chunk_id"), "doc").select("novel", "chunk_id", "term", "tf")


@query(f"WITH {S.QUESTIONS} SELECT qid, list_distinct({S.terms('question')}).list_sort() AS terms FROM q")
def tokenize_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = U.questions(table(spark, sf_dir, "chat_turns"))
    return asked.select("qid", F.array_sort(T.query_terms(F.col("question"))).alias("terms"))


@query("SELECT id, sha256(text) AS content_hash FROM novel_chunks WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "novel_chunks").where("text IS NOT NULL").select("id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT novel, sum(n - 1)::BIGINT AS duplicates FROM (SELECT novel, text, count(*) AS n FROM novel_chunks WHERE text IS NOT NULL GROUP BY ALL) GROUP BY novel HAVING sum(n - 1) > 0")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = table(spark, sf_dir, "novel_chunks").where("text IS NOT NULL").groupBy("novel", F.sha2("text", 256)).agg((F.count("*") - 1).alias("extra"))
    return same.groupBy("novel").agg(F.sum("extra").alias("duplicates")).where("duplicates > 0")


@query(
    f"""WITH {S.CHUNKS}, o AS (SELECT novel, chunk_id, text, row_number() OVER (PARTITION BY novel ORDER BY chunk_id) AS p FROM c)
SELECT x.novel, x.chunk_id, md5(string_agg(y.text, chr(10) ORDER BY y.p)) AS digest FROM o x JOIN o y ON x.novel = y.novel AND y.p BETWEEN x.p - 2 AND x.p + 2 GROUP BY ALL"""
)
def chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.neighbour_windows(chunks(spark, sf_dir)).select("novel", "chunk_id", F.md5("window").alias("digest"))


_STATEMENTS = f"""list_filter(list_transform(string_split(regexp_replace(content, '([。！？?!])', '\\1' || chr(1), 'g'), chr(1)), lambda s: {S.strip('s')}), lambda s: s <> '')"""


@query(f"WITH {S.TURNS}, a AS (SELECT session_id, turn_index, {_STATEMENTS} AS ss FROM t WHERE lower(trim(role)) = 'assistant' AND content IS NOT NULL) SELECT session_id, turn_index, unnest(range(len(ss))) AS pos, unnest(ss) AS statement FROM a")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = latest_turns(spark, sf_dir).where("lower(trim(role)) = 'assistant' AND content IS NOT NULL")
    return answers.select("session_id", "turn_index", F.posexplode(T.statements(F.col("content"))).alias("pos", "statement")).withColumn("pos", F.col("pos").cast("long"))


def latest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "chat_turns").where("session_id IS NOT NULL AND turn_index IS NOT NULL")
    w = Window.partitionBy("session_id", "turn_index").orderBy(F.desc_nulls_last("created_at"), F.desc_nulls_last("content"))
    return turns.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


NEEDLE = "钥匙"


@query(f"WITH {S.CHUNKS} SELECT novel, chunk_id, ((length(lower(text)) - length(replace(lower(text), '{NEEDLE}', ''))) // 2)::INT AS match_count FROM c WHERE contains(lower(text), '{NEEDLE}')")
def fulltext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.find_text(chunks(spark, sf_dir), NEEDLE)


@query(
    f"""WITH {S.CHUNKS} SELECT novel, chunk_id, ((length(lower(text)) - length(replace(lower(text), '{NEEDLE}', ''))) // 2)::INT AS match_count, count(*) OVER () AS total
FROM c WHERE contains(lower(text), '{NEEDLE}') ORDER BY novel, chunk_id LIMIT 20 OFFSET 20"""
)
def fulltext_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twenty, with the number of all hits."""
    hits = L.find_text(chunks(spark, sf_dir), NEEDLE)
    page = hits.orderBy("novel", "chunk_id").offset(20).limit(20)
    return page.join(F.broadcast(hits.agg(F.count("*").alias("total"))), F.lit(True))


@query(f"WITH {S.CHUNKS} SELECT novel, max(chunk_id) AS anchor FROM c WHERE {S.any_of('text', words.ENDING_MARKERS[:4])} GROUP BY novel")
def ending_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.endings(chunks(spark, sf_dir))
