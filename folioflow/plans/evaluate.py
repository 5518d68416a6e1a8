"""Queries of evaluation: retrieval metrics, citations, judges, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions import words
from folioflow.operators import evaluation as E
from folioflow.operators import lexical as L
from folioflow.plans import sql as S
from folioflow.plans.register import query
from folioflow.plans.retrieve import nodes
from folioflow.plans.texts import chunks, latest_turns, shelf
from folioflow.session import table
from folioflow.streaming.ingest import drain_turns

_ALL_ASKED = f"{S.NODES}, q AS (SELECT summary_id AS qid, title AS question, novel AS want, start_chunk_id, end_chunk_id FROM h WHERE level = 'chapter' AND title IS NOT NULL)"
_CASES = f"""{S.CHUNKS}, {_ALL_ASKED}, {S.bm25('q')},
cs AS (SELECT q.qid, min(rank) FILTER (WHERE b.novel = want AND chunk_id BETWEEN start_chunk_id AND end_chunk_id) AS hit_rank,
  coalesce(bool_or(rank = 1 AND b.novel = want), false) AS routed FROM q LEFT JOIN b ON b.qid = q.qid GROUP BY q.qid)"""


def _questions_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("level = 'chapter' AND title IS NOT NULL").select(
        F.col("summary_id").alias("qid"), F.col("title").alias("question"), F.col("novel").alias("want"), "start_chunk_id", "end_chunk_id"
    )


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, hit_rank, routed): each chapter's title as a question, its own chunks as the answer."""
    q = _questions_asked(spark, sf_dir)
    found = L.bm25(shelf(spark, sf_dir), q.select("qid", "question"), 20)
    hit = (F.col("novel") == F.col("want")) & F.col("chunk_id").between(F.col("start_chunk_id"), F.col("end_chunk_id"))
    return q.join(found, "qid", "left").groupBy("qid").agg(
        F.min(F.when(hit, F.col("rank"))).alias("hit_rank"),
        F.coalesce(F.bool_or((F.col("rank") == 1) & (F.col("novel") == F.col("want"))), F.lit(False)).alias("routed"),
    )


@query(f"WITH {_CASES} SELECT qid, hit_rank::INT AS hit_rank, routed FROM cs")
def hit_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)


_METRICS = f"""WITH {_CASES}, mt AS (SELECT count(*) AS cases, {', '.join(f"round(avg(CASE WHEN hit_rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS recall_{k}" for k in (1, 3, 5, 10, 20))},
 round(avg(coalesce(1.0::DOUBLE / hit_rank, 0)), 3) AS mrr, round(avg(routed::INT), 3) AS routing FROM cs)"""


@query(_METRICS + " SELECT * FROM mt")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.retrieval_metrics(_cases(spark, sf_dir))


BASELINE = {"recall_1": 0.364, "recall_3": 0.455, "recall_5": 0.727, "mrr": 0.478, "routing": 0.909}


@query(_METRICS + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, {b}::DOUBLE AS baseline, {m} >= {b}::DOUBLE - 0.05::DOUBLE AS passes FROM mt" for m, b in BASELINE.items()))
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gate(recall_mrr(spark, sf_dir), BASELINE)


_ANSWERS = f"{S.TURNS}, an AS (SELECT session_id, turn_index, content AS answer, coalesce(json_array_length(try_cast(sources AS JSON)), 0)::INT AS n_sources FROM t WHERE lower(trim(role)) = 'assistant' AND NOT {S.is_blank('content')})"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = latest_turns(spark, sf_dir).where("lower(trim(role)) = 'assistant'").where(~T.is_blank(F.col("content")))
    return turns.select("session_id", "turn_index", F.col("content").alias("answer"), "sources")


@query(
    f"""WITH {_ANSWERS}, ci AS (SELECT *, list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,9}})\\]', 1), lambda n: n::INT)) AS ns FROM an),
vi AS (SELECT *, len(list_filter(ns, lambda n: n >= 1 AND n <= n_sources))::INT AS valid FROM ci)
SELECT session_id, turn_index, n_sources, valid, (len(ns) - valid)::INT AS invalid, CASE WHEN len(ns) = 0 THEN 0.0::DOUBLE ELSE round(valid::DOUBLE / len(ns), 6) END AS valid_ratio FROM vi"""
)
def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.citations(_answers(spark, sf_dir), F.json_array_length("sources")).drop("answer", "sources")


_SPLIT = f"list_filter(list_transform(string_split(regexp_replace(answer, '([。！？?!])', '\\1' || chr(1), 'g'), chr(1)), lambda s: {S.strip('s')}), lambda s: s <> '')"


@query(
    f"""WITH {_ANSWERS}, st AS (SELECT *, {_SPLIT} AS ss FROM an), fc AS (SELECT *, list_filter(ss, lambda s: NOT {S.any_of('s', words.EXEMPT_PHRASES)}) AS fs FROM st),
ct AS (SELECT *, len(list_filter(fs, lambda s: regexp_matches(s, '\\[\\d+\\]'))) AS k FROM fc)
SELECT session_id, turn_index, len(ss)::INT AS statements, len(fs)::INT AS factual, k::INT AS cited, round((len(fs) - k)::DOUBLE / nullif(len(fs), 0), 6) AS uncited_ratio FROM ct"""
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.completeness(_answers(spark, sf_dir)).drop("answer", "sources")


_SUPPORT = f"""{S.TURNS}, an AS (SELECT session_id, turn_index, content AS answer, sources FROM t WHERE lower(trim(role)) = 'assistant' AND NOT {S.is_blank('content')}),
st AS (SELECT session_id, turn_index, unnest(range(len(ss))) AS pos, unnest(ss) AS s, sources FROM (SELECT *, {_SPLIT} AS ss FROM an)),
gr AS (SELECT *, regexp_replace(s, '\\s', '', 'g') AS cl, list_distinct({S.bigrams("regexp_replace(s, '\\s', '', 'g')")}) AS gs, coalesce(sources, '') AS ev FROM st),
sr AS (SELECT *, len(list_filter(gs, lambda g: contains(ev, g))) AS k FROM gr),
pr AS (SELECT session_id, turn_index, pos, CASE WHEN length(cl) < 2 OR ev = '' THEN 'uncertain' WHEN k >= 0.8::DOUBLE * len(gs) THEN 'supported' WHEN k = 0 THEN 'unsupported' ELSE 'uncertain' END AS predicted,
 CASE WHEN regexp_matches(s, '\\[\\d+\\]') THEN 'supported' ELSE 'unsupported' END AS human FROM sr)"""


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's rule label against the sources it was saved with; the writer's own claim,
    a citation or none, stands in for the human label."""
    said = _answers(spark, sf_dir).select("session_id", "turn_index", F.posexplode(T.statements(F.col("answer"))).alias("pos", "s"), "sources")
    label = E.rule_support(F.col("s"), F.coalesce("sources", F.lit("")))
    human = F.when(F.col("s").rlike("\\[\\d+\\]"), "supported").otherwise("unsupported")
    return said.select("session_id", "turn_index", F.col("pos").cast("long").alias("pos"), label.alias("predicted"), human.alias("human"))


@query(f"WITH {_SUPPORT} SELECT session_id, turn_index, pos, predicted FROM pr")
def rule_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _support(spark, sf_dir).drop("human")


@query(f"WITH {_SUPPORT} SELECT predicted, count(*) FILTER (WHERE human = 'supported') AS supported, count(*) FILTER (WHERE human = 'unsupported') AS unsupported FROM pr GROUP BY predicted")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_support(spark, sf_dir), ["supported", "unsupported"])


@query(
    f"WITH {_SUPPORT} "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS label, round(count(*) FILTER (WHERE predicted = '{x}' AND human = '{x}')::DOUBLE / nullif(count(*) FILTER (WHERE predicted = '{x}'), 0), 6) AS precision, round(count(*) FILTER (WHERE predicted = '{x}' AND human = '{x}')::DOUBLE / nullif(count(*) FILTER (WHERE human = '{x}'), 0), 6) AS recall FROM pr"
        for x in ("supported", "unsupported", "uncertain")
    )
)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.precision_recall(_support(spark, sf_dir), ["supported", "unsupported", "uncertain"])


@query(f"WITH {_CASES} SELECT least(coalesce((hit_rank - 1) // 5, 9), 9)::INT AS bin, count(*) AS cases, round(avg(routed::INT), 6) AS routed FROM cs GROUP BY 1")
def confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of questions led to the right book, by how far down the answer is."""
    bins = F.least(F.coalesce(F.floor((F.col("hit_rank") - 1) / 5), F.lit(9)), F.lit(9)).cast("int")
    return _cases(spark, sf_dir).groupBy(bins.alias("bin")).agg(F.count("*").alias("cases"), F.round(F.avg(F.col("routed").cast("double")), 6).alias("routed"))


@query(
    f"""WITH {S.CHUNKS}, {_ALL_ASKED}, {S.bm25('q')}, bx AS (SELECT b.qid, b.rank, length(text) AS n, b.novel = want AND b.chunk_id BETWEEN start_chunk_id AND end_chunk_id AS hit FROM b JOIN q ON q.qid = b.qid JOIN c ON c.novel = b.novel AND c.chunk_id = b.chunk_id)
SELECT k::INT AS top_k, round(avg(hits), 6) AS hit_rate, round(avg(chars), 3) AS prompt_chars, round(avg(signal), 6) AS signal_ratio FROM (SELECT k, qid, max(hit::INT) AS hits, sum(n) AS chars, sum(CASE WHEN hit THEN n ELSE 0 END)::DOUBLE / sum(n) AS signal FROM bx JOIN (SELECT unnest([1, 3, 5, 10, 20]) AS k) ON rank <= k GROUP BY k, qid) GROUP BY k"""
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each size of context costs in characters and how much of it is the answer."""
    q = nodes(spark, sf_dir).where("level = 'chapter' AND title IS NOT NULL").select(
        F.col("summary_id").alias("qid"), F.col("title").alias("question"), F.col("novel").alias("want"), "start_chunk_id", "end_chunk_id"
    )
    c = chunks(spark, sf_dir)
    found = L.bm25(shelf(spark, sf_dir), q.select("qid", "question"), 20).join(c.select("novel", "chunk_id", F.char_length("text").alias("n")), ["novel", "chunk_id"])
    hit = (F.col("novel") == F.col("want")) & F.col("chunk_id").between(F.col("start_chunk_id"), F.col("end_chunk_id"))
    wide = found.join(q, "qid").withColumn("hit", hit).withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in (1, 3, 5, 10, 20)]), lambda k: k >= F.col("rank"))))
    per = wide.groupBy("k", "qid").agg(
        F.max(F.col("hit").cast("int")).alias("hits"), F.sum("n").alias("chars"), (F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("signal")
    )
    return per.groupBy(F.col("k").alias("top_k")).agg(
        F.round(F.avg("hits"), 6).alias("hit_rate"), F.round(F.avg("chars"), 3).alias("prompt_chars"), F.round(F.avg("signal"), 6).alias("signal_ratio")
    )


@query(
    """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    total = events.agg(F.sum("value").alias("total"))
    per = events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"),
        F.round(F.avg("value"), 6).alias("mean"), F.sum("value").alias("s"),
    )
    return per.join(F.broadcast(total), F.lit(True)).withColumn("share", F.round(F.col("s") / F.col("total"), 6)).drop("s", "total")


@query(f"WITH {S.TURNS} SELECT session_id, turn_index, role, status FROM t")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat log as a stream, upserted batch by batch until all of it is read."""
    return drain_turns(spark, f"{sf_dir}/chat_turns.parquet").select("session_id", "turn_index", "role", "status")
