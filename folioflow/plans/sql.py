"""Pieces of the SQL that states the queries' results."""

from folioflow.functions import words

BLANK = r"[\s\x{00a0}\x{3000}]"


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def is_blank(x: str) -> str:
    return f"coalesce(regexp_replace({x}, '{BLANK}+', '', 'g') = '', true)"


def any_of(x: str, items) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in items) + ")"


def bigrams(r: str) -> str:
    return f"list_transform(range(1, length({r})), lambda i: substring({r}, i, 2))"


def terms(x: str) -> str:
    runs = f"flatten(list_transform(regexp_extract_all({x}, '[{words.UNSPACED}]{{2,}}'), lambda r: {bigrams('r')}))"
    return f"list_filter(list_concat(regexp_extract_all({x}, '[{words.SPACED}]{{2,}}'), {runs}), lambda t: t NOT IN ({quoted(words.STOP_WORDS)}))"


def clean(x: str) -> str:
    inner = f"regexp_replace(replace({x}, chr(65279), ''), '\\r\\n?', chr(10), 'g')"
    inner = f"regexp_replace({inner}, '[ \\t\\x{{3000}}]+', ' ', 'g')"
    return strip(f"regexp_replace({inner}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


#: c: published chunks.
CHUNKS = f"""c AS (SELECT id, novel, chunk_id, nullif({strip('chapter_title')}, '') AS chapter_title, text, embedding FROM
  (SELECT * FROM novel_chunks QUALIFY row_number() OVER (PARTITION BY novel, chunk_id ORDER BY id DESC) = 1) WHERE NOT {is_blank('text')})"""

#: q: distinct user questions.
QUESTIONS = f"""q AS (SELECT md5(question) AS qid, question FROM (SELECT DISTINCT {strip('content')} AS question FROM chat_turns
  WHERE lower({strip('role')}) = 'user') WHERE question IS NOT NULL AND question <> '')"""

#: h: latest chapter and book nodes.
NODES = """h AS (SELECT * FROM hierarchy_summaries WHERE level IN ('chapter', 'novel') QUALIFY row_number() OVER (PARTITION BY novel, level, node_id ORDER BY summary_id DESC) = 1)"""

#: t: latest version of every numbered turn.
TURNS = """t AS (SELECT * FROM chat_turns WHERE session_id IS NOT NULL AND turn_index IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id, turn_index ORDER BY created_at DESC NULLS LAST, content DESC NULLS LAST) = 1)"""


def usable(v: str, width: int = 64) -> str:
    return f"(len({v}) = {width} AND len(list_filter({v}, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter({v}, lambda e: e <> 0)) > 0)"


def wide(v: str) -> str:
    return f"list_transform({v}, lambda e: e::DOUBLE)"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({wide(a)}, {wide(b)}), 6)"


def bm25(questions: str, keys: str = "", k: int = 20) -> str:
    """CTEs e, w, s, d and result b(qid, novel, chunk_id, score, rank) over c and ``questions``."""
    on = f", {keys}" if keys else ""
    join = f"USING (term{on})"
    stats = f"JOIN s USING ({keys})" if keys else "CROSS JOIN s"
    group = f"GROUP BY {keys}" if keys else ""
    pick = f"{keys}," if keys else ""
    return f"""e AS (SELECT novel, chunk_id, {terms('text')} AS ts FROM c),
s AS (SELECT {pick} count(*) AS n, avg(len(ts)) AS avgdl FROM e {group}),
w AS (SELECT novel, chunk_id, dl, term, count(*) AS tf FROM (SELECT novel, chunk_id, len(ts) AS dl, unnest(ts) AS term FROM e) GROUP BY ALL),
d AS (SELECT term{on}, count(*) AS df FROM w GROUP BY term{on}),
a AS (SELECT DISTINCT qid{on}, unnest({terms('question')}) AS term FROM {questions}),
b0 AS (SELECT qid, w.novel, w.chunk_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 4) AS score
  FROM a JOIN w {join} JOIN d {join} {stats} GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, novel, chunk_id) AS rank FROM b0 QUALIFY rank <= {k})"""
