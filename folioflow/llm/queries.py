"""The pN_ queries and, where SQL can state them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import conversations as conv
from folioflow.llm import garbled_text as garbled
from folioflow.llm import mixing, packing, sentences, splitting, tokens
from folioflow.llm import near_duplicates as nd
from folioflow.llm import similar_vectors as sv
from folioflow.llm.storage import written
from folioflow.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_P1_SQL = """
WITH d AS (SELECT id, translate(text, chr(32)||chr(9)||chr(13)||chr(10)||chr(160)||chr(12288), '') AS t FROM novel_chunks),
k AS (SELECT id, t FROM d WHERE length(t) >= 60),
g AS (SELECT DISTINCT id, substring(t, i, 5) AS w FROM (SELECT id, t, unnest(range(1, length(t) - 3)) AS i FROM k)),
n AS (SELECT id, count(*) AS c FROM g GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM g a JOIN g b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2)
"""


@query(
    _P1_SQL
    + "SELECT o.id_a, o.id_b FROM o JOIN n x ON x.id = o.id_a JOIN n y ON y.id = o.id_b WHERE s >= 0.7::DOUBLE * (x.c + y.c - s) - 1e-9::DOUBLE"
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = nd.near_duplicates(table(spark, sf_dir, "novel_chunks"))
    return nd.row_pairs(members, links)


@query()
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = nd.near_duplicates(table(spark, sf_dir, "novel_chunks"))
    return nd.duplicate_groups(members, links)


def _vector_tables(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, DataFrame]]:
    return [
        ("novel_chunks", "id", table(spark, sf_dir, "novel_chunks")),
        ("hierarchy_summaries", "summary_id", table(spark, sf_dir, "hierarchy_summaries")),
    ]


def _p5_sql(name: str, key: str) -> str:
    return f"""SELECT DISTINCT '{name}' AS tbl, least(a, b) AS id_a, greatest(a, b) AS id_b FROM (
  SELECT x.i AS a, y.i AS b, list_cosine_similarity(x.v, y.v) AS c, row_number() OVER (PARTITION BY x.i ORDER BY list_cosine_similarity(x.v, y.v) DESC, y.i) AS r
  FROM v_{name} x JOIN v_{name} y ON x.i <> y.i AND list_cosine_similarity(x.v, y.v) >= 0.92::DOUBLE) WHERE r <= 10"""


def _p5_with(name: str, key: str) -> str:
    return f"""v_{name} AS MATERIALIZED (SELECT {key} AS i, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM {name}
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0)"""


@query(
    "WITH "
    + ", ".join(_p5_with(*x) for x in (("novel_chunks", "id"), ("hierarchy_summaries", "summary_id")))
    + " "
    + " UNION ALL ".join(_p5_sql(*x) for x in (("novel_chunks", "id"), ("hierarchy_summaries", "summary_id")))
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, df in _vector_tables(spark, sf_dir):
        near = sv.neighbours_above(df, key)
        pairs = near.select(
            F.lit(name).alias("tbl"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")
        ).distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out


@query()
def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, df in _vector_tables(spark, sf_dir):
        near = sv.nearest(df, F.col("id") % 50 == 0, key).select(F.lit(name).alias("tbl"), "id", "other", "cosine", "rank")
        out = near if out is None else out.unionByName(near)
    return out


def _texts(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    return [
        ("novel_chunks", table(spark, sf_dir, "novel_chunks"), "id", "text"),
        ("parsed_chunks", table(spark, sf_dir, "parsed_chunks"), "row_id", "text"),
    ]


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    affected, _ = garbled.find_garbled(_texts(spark, sf_dir), restoring=False)
    return affected.select("tbl", "row_id").distinct()


@query()
def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    affected, _ = garbled.find_garbled(_texts(spark, sf_dir))
    return affected.select("tbl", "row_id", "restored", "complete", "how")


@query()
def p2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, votes = garbled.find_garbled(_texts(spark, sf_dir))
    return votes


@query("SELECT id FROM novel_chunks WHERE length(text) > 500")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece_no = 0").select("id")


@query()
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_rows(table(spark, sf_dir, "novel_chunks"), keep=("novel", "chunk_id"))


_P4_SQL = r"""
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index ORDER BY created_at DESC NULLS LAST, status DESC NULLS LAST, content DESC NULLS LAST, role DESC NULLS LAST) AS k
  FROM chat_turns WHERE session_id IS NOT NULL AND turn_index IS NOT NULL) WHERE k = 1),
f AS (SELECT session_id, count(*) AS n, min(turn_index) AS lo, max(turn_index) AS hi,
  count(*) FILTER (WHERE coalesce(lower(trim(role)), '') <> CASE WHEN turn_index % 2 = 0 THEN 'user' ELSE 'assistant' END) AS bad_role,
  count(*) FILTER (WHERE content IS NULL OR regexp_full_match(content, '[\s\x{00A0}\x{3000}\x{200B}\x{FEFF}]*')) AS bad_content,
  count(*) FILTER (WHERE turn_index % 2 = 1 AND coalesce(status, '') <> 'complete') AS bad_status FROM r GROUP BY session_id)
SELECT s.session_id FROM (SELECT DISTINCT session_id FROM chat_turns WHERE session_id IS NOT NULL) s LEFT JOIN f USING (session_id)
WHERE NOT coalesce(lo = 0 AND hi = n - 1 AND n % 2 = 0 AND n >= 2 AND bad_role = 0 AND bad_content = 0 AND bad_status = 0, false)
"""


@query(_P4_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rule asked for does not look at clocks, so they are not estimated here; p4_clocks and
    # p4_conversations have them
    return conv.session_reasons(table(spark, sf_dir, "chat_turns")).where("reason IS NOT NULL").select("session_id")


@query()
def p4_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.conversations(table(spark, sf_dir, "chat_turns"))


@query()
def p4_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.session_facts(table(spark, sf_dir, "chat_turns"))


#: A vocabulary file of a public tokenizer, on every worker.
VOCABULARY = os.environ.get("FOLIOFLOW_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.sized(table(spark, sf_dir, "documents"), VOCABULARY, keep=("source",))


@query()
def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


@query()
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, sf_dir))


@query("SELECT spec, 0::BIGINT AS overfull, 0::BIGINT AS lost, 0::BIGINT AS doubled FROM pack_specs")
def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(_sizes(spark, sf_dir), "p6-audit")
    specs = table(spark, sf_dir, "pack_specs")
    return packing.violations(packing.pack(sizes, specs), sizes, specs)


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@query()
def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


@query()
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


@query("SELECT DISTINCT recipe, lower(trim(source)) AS source, 0::BIGINT AS overused FROM mix_targets WHERE trim(source) <> ''")
def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.violations(p7_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))
