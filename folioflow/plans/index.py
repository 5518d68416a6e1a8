"""Queries over the index: catalogue, manifests, quality, graph, sessions' upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import words
from folioflow.operators import graph as G
from folioflow.operators import quality as Q
from folioflow.operators import understand as U
from folioflow.plans import sql as S
from folioflow.plans.register import query
from folioflow.plans.retrieve import nodes
from folioflow.plans.texts import chunks, latest_turns
from folioflow.session import table


@query(f"WITH {S.CHUNKS} SELECT count(DISTINCT novel) AS books, count(*) AS chunks, count(DISTINCT chapter_title) AS titles FROM c")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).agg(
        F.countDistinct("novel").alias("books"), F.count("*").alias("chunks"), F.countDistinct("chapter_title").alias("titles")
    )


@query(f"WITH {S.CHUNKS} SELECT novel, count(*) AS chunks, sum(length(text))::BIGINT AS chars, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM c GROUP BY novel")
def library_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("novel").agg(
        F.count("*").alias("chunks"), F.sum(F.char_length("text")).alias("chars"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk")
    )


@query(f"WITH {S.CHUNKS} SELECT novel, chapter_title, count(*) AS chunks, min(chunk_id) AS first_chunk FROM c GROUP BY novel, chapter_title")
def library_chapters_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("novel", "chapter_title").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_chunk"))


_MANIFEST = "m AS (SELECT * FROM index_manifest QUALIFY row_number() OVER (PARTITION BY novel ORDER BY indexed_at DESC, source_hash DESC) = 1)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.latest(table(spark, sf_dir, "index_manifest"), ["novel"], [F.desc("indexed_at"), F.desc("source_hash")])


@query(f"WITH {_MANIFEST} SELECT novel, source_hash, pipeline_hash, chunk_count FROM m")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("novel", "source_hash", "pipeline_hash", "chunk_count")


_PUBLISHES = """pb AS (SELECT *, row_number() OVER (PARTITION BY novel ORDER BY indexed_at DESC, source_hash DESC) AS k FROM index_manifest)"""


@query(
    f"""WITH {S.CHUNKS}, {_PUBLISHES}, d AS (SELECT novel, source_hash FROM pb WHERE k = 1), m AS (SELECT novel, source_hash, pipeline_hash FROM pb WHERE k = 2),
i AS (SELECT DISTINCT novel FROM c), v AS (SELECT pipeline_hash AS p FROM index_manifest ORDER BY indexed_at DESC, pipeline_hash DESC LIMIT 1), n AS (SELECT novel FROM d UNION SELECT novel FROM m UNION SELECT novel FROM i)
SELECT n.novel, CASE WHEN n.novel NOT IN (SELECT novel FROM d) THEN 'deleted'
  WHEN m.novel IS NULL AND i.novel IS NOT NULL THEN 'modified' WHEN m.novel IS NULL OR i.novel IS NULL THEN 'added'
  WHEN d.source_hash IS DISTINCT FROM m.source_hash OR m.pipeline_hash IS DISTINCT FROM v.p THEN 'modified' ELSE 'unchanged' END AS change
FROM n LEFT JOIN d USING (novel) LEFT JOIN m USING (novel) LEFT JOIN i USING (novel) CROSS JOIN v"""
)
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last publishes change against the ones before: the latest row of a book is taken for
    what the directory holds, the row before it for its manifest, the latest of all for the pipeline."""
    every = table(spark, sf_dir, "index_manifest")
    order = Window.partitionBy("novel").orderBy(F.desc("indexed_at"), F.desc("source_hash"))
    numbered = every.withColumn("k", F.row_number().over(order))
    now = every.agg(F.max(F.struct("indexed_at", "pipeline_hash")).alias("m")).select(F.col("m.pipeline_hash").alias("now"))
    before = numbered.where("k = 2").join(F.broadcast(now), F.lit(True))  # one row
    # a NULL in place of the hash where it is not the current one
    made_now = F.when(F.col("pipeline_hash") == F.col("now"), F.lit("now")).alias("pipeline_hash")
    manifest = before.select("novel", "source_hash", made_now)
    return Q.change_plan(numbered.where("k = 1"), manifest, chunks(spark, sf_dir), "now")


@query(
    f"""WITH {S.CHUNKS}, {S.NODES}, n AS (SELECT novel, max(chunk_id) AS last FROM c GROUP BY novel), k AS (SELECT novel, max(end_chunk_id) AS covered FROM h WHERE level = 'novel' GROUP BY novel)
SELECT novel FROM n LEFT JOIN k USING (novel) WHERE covered IS NULL OR covered <> last"""
)
def hierarchy_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose book node is missing or does not reach their last chunk."""
    have = chunks(spark, sf_dir).groupBy("novel").agg(F.max("chunk_id").alias("last"))
    cover = nodes(spark, sf_dir).where("level = 'novel'").groupBy("novel").agg(F.max("end_chunk_id").alias("covered"))
    return have.join(cover, "novel", "left").where("covered IS NULL OR covered <> last").select("novel")


@query(
    f"""WITH {S.CHUNKS}, s AS (SELECT novel, count(*) AS chunk_count, sum(('0x' || substring(md5(chunk_id || ':' || text), 1, 12))::BIGINT)::VARCHAR AS content_hash FROM c GROUP BY novel) SELECT * FROM s"""
)
def source_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.source_hashes(chunks(spark, sf_dir))


@query(
    f"""WITH u AS (SELECT novel, sum(n - 1)::BIGINT AS duplicates FROM (SELECT novel, text, count(*) AS n FROM novel_chunks WHERE NOT {S.is_blank('text')} GROUP BY ALL) GROUP BY novel),
g AS (SELECT novel, count(*) AS chunks, count(*) FILTER (WHERE {S.is_blank('text')}) AS empty, count(*) FILTER (WHERE length(text) > 500) AS over_limit, count(chapter_title) AS titled,
 coalesce(sum(length(text) - length(replace(text, chr(65533), ''))), 0)::BIGINT AS replacement_chars,
 coalesce(sum(len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))), 0)::BIGINT AS control_chars,
 count(*) FILTER (WHERE embedding IS NULL) AS no_vector, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_width,
 count(*) FILTER (WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) > 0) AS not_finite FROM novel_chunks GROUP BY novel)
SELECT g.*, coalesce(duplicates, 0) AS duplicates, empty + over_limit + no_vector + wrong_width + not_finite = 0 AS passes FROM g LEFT JOIN u USING (novel)"""
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.report(table(spark, sf_dir, "novel_chunks"))


@query(
    """SELECT novel, min(length(text)) AS least, quantile_disc(length(text), 0.5) AS p50, quantile_disc(length(text), 0.95) AS p95, max(length(text)) AS most
FROM novel_chunks WHERE text IS NOT NULL GROUP BY novel"""
)
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "novel_chunks").where("text IS NOT NULL").select("novel", F.char_length("text").cast("long").alias("n"))
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)").cast("long")
    return sized.groupBy("novel").agg(F.min("n").alias("least"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max("n").alias("most"))


@query("SELECT len(embedding) AS width, count(*) AS n, count(*) FILTER (WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) > 0) AS not_finite, count(*) FILTER (WHERE len(list_filter(embedding, lambda e: e <> 0)) = 0) AS zero FROM novel_chunks GROUP BY 1")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        table(spark, sf_dir, "novel_chunks")
        .groupBy(F.when(v.isNotNull(), F.size(v)).cast("long").alias("width"))
        .agg(F.count("*").alias("n"), F.count_if(bad).alias("not_finite"), F.count_if(F.size(F.filter(v, lambda x: x != 0)) == 0).alias("zero"))
    )


_SPEAKER = "[。！？”』」\\n]([\\x{4e00}-\\x{9fff}]{2,3})(?:笑|喝|叹|答|问|说)道"
_KINDS = " UNION ALL ".join(f"SELECT novel, chunk_id, text, '{k}' AS relation FROM c WHERE {S.any_of('text', v)}" for k, v in words.RELATION_TRIGGERS.items())
_PERSONS = f"""{S.CHUNKS}, sn AS (SELECT novel, name, count(*) AS n FROM (SELECT novel, chunk_id, unnest(list_distinct(regexp_extract_all(text, '{_SPEAKER}', 1))) AS name FROM c) GROUP BY 1, 2),
sz AS (SELECT novel, count(*) AS k FROM c GROUP BY 1), sp AS (SELECT novel, name, n FROM sn JOIN sz USING (novel) WHERE n >= greatest(2, k // 50) QUALIFY row_number() OVER (PARTITION BY novel ORDER BY n DESC, name) <= 20)"""
_EDGES = f"""{_PERSONS}, rk0 AS ({_KINDS}), rc AS (SELECT novel, chunk_id, relation, text FROM rk0 QUALIFY count(*) OVER (PARTITION BY novel, relation) >= 2),
sq AS (SELECT rc.novel, chunk_id, relation, name FROM rc JOIN sp ON sp.novel = rc.novel AND contains(text, name)),
ed AS (SELECT a.novel, a.name AS person_a, b.name AS person_b, a.relation, count(*) AS weight FROM sq a JOIN sq b ON a.novel = b.novel AND a.chunk_id = b.chunk_id AND a.relation = b.relation AND a.name < b.name GROUP BY ALL)"""


@query(f"WITH {_PERSONS} SELECT novel, name, n FROM sp")
def main_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.speakers(chunks(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT novel, person_a, person_b, relation, weight FROM ed")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(chunks(spark, sf_dir))


@query(
    f"""WITH {_EDGES}, bo AS (SELECT person_a AS person, relation, person_b AS other, weight FROM ed UNION ALL SELECT person_b, relation, person_a, weight FROM ed),
su AS (SELECT person, relation, other, sum(weight)::BIGINT AS weight FROM bo GROUP BY 1, 2, 3 HAVING sum(weight) >= 2) SELECT *, (row_number() OVER (PARTITION BY person, relation ORDER BY weight DESC, other))::INT AS rank FROM su QUALIFY rank <= 8"""
)
def relation_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.related(G.edges(chunks(spark, sf_dir)))


@query(f"WITH {_EDGES} SELECT novel, person_a AS person FROM ed UNION SELECT novel, person_b FROM ed")
def known_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.known_persons(G.edges(chunks(spark, sf_dir)))


@query(f"WITH {_PERSONS} SELECT novel, chunk_id FROM c WHERE {S.any_of('text', words.PRONOUNS)} AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.novel = c.novel AND contains(c.text, sp.name))")
def context_poor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.context_poor(chunks(spark, sf_dir))


@query(
    f"""WITH {S.TURNS}, l AS (SELECT session_id, turn_index, role, replace(content, chr(10), ' ') AS line FROM t WHERE NOT {S.is_blank('content')} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) <= 8)
SELECT session_id, turn_index, role, CASE WHEN length(line) > 200 THEN substring(line, 1, 200) || '…' ELSE line END AS line FROM l"""
)
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.history(latest_turns(spark, sf_dir))


@query("SELECT session_id, max(turn_index) + 1 AS next_turn FROM chat_turns WHERE session_id IS NOT NULL AND turn_index IS NOT NULL GROUP BY session_id")
def next_turn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "chat_turns").where("session_id IS NOT NULL AND turn_index IS NOT NULL")
    return turns.groupBy("session_id").agg((F.max("turn_index") + 1).alias("next_turn"))


@query(f"WITH {S.TURNS} SELECT session_id, turn_index, role, content, status FROM t")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved turns after every upsert: the last version of each (session_id, turn_index)."""
    return latest_turns(spark, sf_dir).select("session_id", "turn_index", "role", "content", "status")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")
