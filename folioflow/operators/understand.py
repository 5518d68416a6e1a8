"""Rules over questions, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import HISTORY_CHARS, HISTORY_TURNS
from folioflow.functions import text as T
from folioflow.functions import words


def questions(chat_turns: DataFrame) -> DataFrame:
    """(qid, question): distinct non-blank user messages."""
    q = T.strip(F.col("content"))
    return (
        chat_turns.where(F.lower(T.strip(F.col("role"))) == "user")
        .select(q.alias("question"))
        .where("question IS NOT NULL AND question <> ''")
        .distinct()
        .select(F.md5("question").alias("qid"), "question")
    )


def route(question: Column) -> Column:
    """free or grounded."""
    low = F.lower(question)
    book = (question.contains("《") & question.contains("》")) | T.contains_any(question, words.GROUNDED_SIGNALS)
    return (
        F.when(T.contains_any(question, words.EXPLICIT_FREE), "free")
        .when(book, "grounded")
        .when(low.rlike(words.GREETING) | question.rlike(words.ASSISTANT), "free")
        .when(T.contains_any(low, words.GENERAL_SIGNALS) | question.rlike(words.CREATIVE), "free")
        .otherwise("grounded")
    )


def structural_kind(question: Column) -> Column:
    return F.when(T.contains_any(question, words.TAIL_WORDS), "tail").when(T.contains_any(question, words.HEAD_WORDS), "head")


def is_global(question: Column) -> Column:
    return T.contains_any(question, words.GLOBAL_SIGNALS)


def is_catalogue(question: Column) -> Column:
    shelf = question.contains("书架") & question.rlike("(?:有|包含|多少|几|哪些|全部)")
    return (question.contains("小说") & question.rlike(words.CATALOGUE)) | shelf


def scope(question: Column) -> Column:
    """How much evidence a question needs: catalog, library, exhaustive or open."""
    parts = question.rlike("章节|片段|段落")
    return (
        F.when(question.rlike(words.CATALOGUE) & ~parts, "catalog")
        .when(parts & question.rlike(words.EXHAUSTIVE), "library")
        .when(question.rlike(words.EXHAUSTIVE), "exhaustive")
        .otherwise("open")
    )


def relation_asked(question: Column) -> Column:
    out = None
    for name, needles in words.RELATION_QUESTIONS.items():
        hit = T.contains_any(question, needles)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def needs_rewrite(question: Column, has_history: Column) -> Column:
    return has_history & ((F.char_length(question) <= 8) | T.contains_any(question, words.REFERRING))


def normalised(question: Column) -> Column:
    return F.translate(question, words.IGNORABLE, "")


def named_books(asked: DataFrame, novels: DataFrame) -> DataFrame:
    """(qid, novel): books whose short title stands in 《》 in the question."""
    names = novels.select("novel", F.explode(T.titles(F.col("novel"))).alias("title"))
    said = asked.select("qid", F.explode(T.named_titles(F.col("question"))).alias("title"))
    return said.join(names, "title").select("qid", "novel").distinct()


def _titled(novels: DataFrame) -> DataFrame:
    return novels.select("novel", F.explode(T.titles(F.col("novel"))).alias("title")).where("title <> ''").distinct()


def _grams(text: Column, most: int) -> Column:
    """All distinct runs of 1 to ``most`` characters."""
    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.char_length(text) - n + 1)
        return F.when(F.char_length(text) >= n, F.transform(places, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, most + 1)]))


def mentioned_books(asked: DataFrame, novels: DataFrame) -> DataFrame:
    """(qid, novel): books one of whose titles stands anywhere in the question, with brackets or not.
    Titles and questions meet on the title's first two characters and only then are compared."""
    names = _titled(novels).withColumn("key", F.substring("title", 1, 2))
    said = asked.select("qid", "question", F.explode(_grams(F.col("question"), 2)).alias("key"))
    return said.join(names, "key").where(F.col("question").contains(F.col("title"))).select("qid", "novel").distinct()


def fuzzy_books(asked: DataFrame, novels: DataFrame) -> DataFrame:
    """(qid, novel, typo): books named somewhere in the question, also with a typing error (``typo``).

    A title of under three characters must be there as it is; one of three may have one edit in some
    window of the question, a longer one two. Of ``edits + 1`` parts of such a title one is there
    unchanged, so titles and questions meet on parts, and only then are windows compared.
    """
    title, n = F.col("title"), F.char_length("title")
    edits = F.when(n < 3, 0).when(n == 3, 1).otherwise(2)
    cut = lambda k: F.floor(n * k / (edits + 1)).cast("int")
    # up to three characters of each part are enough to meet
    parts = F.transform(F.sequence(F.lit(0), edits), lambda k: F.substring(title, cut(k) + 1, F.least(F.lit(3), cut(k + 1) - cut(k))))
    names = _titled(novels).withColumn("edits", edits).withColumn("key", F.explode(F.array_distinct(parts)))
    said = asked.select("qid", "question", F.explode(_grams(F.col("question"), 3)).alias("key"))
    met = said.join(names, "key").select("qid", "question", "novel", "title", "edits").distinct()
    q = F.col("question")
    widths = F.sequence(F.greatest(F.lit(3), n - F.col("edits")), n + F.col("edits"))
    places = lambda w: F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(q) - w + 1))
    near = F.exists(
        widths, lambda w: F.exists(places(w), lambda i: F.levenshtein(F.substring(q, i, w), title) <= F.col("edits"))
    )
    exact = q.contains(title)
    found = met.withColumn("exact", exact).where(F.col("exact") | ((n >= 3) & near))
    return found.groupBy("qid", "novel").agg((~F.bool_or("exact")).alias("typo"))


def strip_titles(question: Column, titles: Column) -> Column:
    """The question with every one of ``titles``, in brackets or bare, replaced by a blank."""
    return F.aggregate(titles, question, lambda q, t: F.replace(F.replace(q, F.concat(F.lit("《"), t, F.lit("》")), F.lit(" ")), t, F.lit(" ")))


def resolve_books(requested: DataFrame, novels: DataFrame) -> DataFrame:
    """(qid, novel, how) of ``requested(qid, question)``: the book that is called so exactly, else the
    only one that contains the name or is contained in it without case, else the only one that it names
    with a typing error; ``novel`` is NULL where none is, or several are."""
    low = F.lower("question")
    exact = requested.join(novels.select("novel"), F.col("question") == F.col("novel")).select("qid", "novel", F.lit(1).alias("tier"))
    # either holds the other, so the shorter one's first two characters are in both
    names = novels.select("novel", F.explode(_grams(F.lower("novel"), 2)).alias("key"))
    asked = requested.select("qid", low.alias("low"), F.explode(_grams(low, 2)).alias("key"))
    first = (F.col("key") == F.substring("low", 1, 2)) | (F.col("key") == F.substring(F.lower("novel"), 1, 2))
    holds = asked.join(names, "key").where(first).where(F.col("low").contains(F.lower("novel")) | F.lower("novel").contains(F.col("low")))
    held = holds.select("qid", "novel", F.lit(2).alias("tier")).distinct()
    typo = fuzzy_books(requested, novels).select("qid", "novel", F.lit(3).alias("tier"))
    tiers = exact.unionByName(held).unionByName(typo)
    best = tiers.groupBy("qid", "tier").agg(F.count("*").alias("n"), F.min("novel").alias("novel"))
    top = best.groupBy("qid").agg(F.min(F.struct("tier", "n", "novel")).alias("t"))
    how = F.when(F.col("t.tier") == 1, "exact").when(F.col("t.tier") == 2, "contained").otherwise("typo")
    one = F.col("t.n") == 1
    found = top.select("qid", F.when(one, F.col("t.novel")).alias("novel"), F.when(one, how).otherwise("ambiguous").alias("how"))
    return requested.select("qid").distinct().join(found, "qid", "left").select("qid", "novel", F.coalesce("how", F.lit("unknown")).alias("how"))


def variants(question: Column, answer: Column, most: int = 3) -> Column:
    """Up to ``most`` other wordings of the question, from the lines of a generated answer: without list
    marks and outer quotes, of 4 to ``3 n + 50`` characters, none the same as another or as the
    question once ignorable characters are dropped."""
    lines = F.transform(F.split(answer, "\r\n|\r|\n"), lambda x: T.strip(F.regexp_replace(T.strip(x), words.LIST_MARK, "")))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, words.OUTER_QUOTES, "$1$2$3$4"))
    fit = F.filter(bare, lambda x: (F.char_length(x) >= 4) & (F.char_length(x) <= F.char_length(question) * 3 + 50))

    def add(kept: Column, x: Column) -> Column:
        key = normalised(x)
        known = F.exists(kept, lambda y: normalised(y) == key)
        return F.when((key == "") | (key == normalised(question)) | known, kept).otherwise(F.concat(kept, F.array(x)))

    return F.slice(F.aggregate(fit, F.array().cast("array<string>"), add), 1, most)


def person_names(answer: Column) -> Column:
    """Names of two to four ideographs in a generated list."""
    parts = F.transform(F.split(answer, words.NAME_BREAKS), lambda x: F.regexp_replace(x, words.NAME_EDGES, ""))
    return F.filter(parts, lambda x: x.rlike("^[一-龥]{2,4}$"))


def json_object(answer: Column) -> Column:
    """The JSON object in a generated answer as text, from the first brace to the last, with or without
    a code fence; NULL where it is none."""
    body = F.regexp_replace(answer, "(?m)^\\s*```.*$", "")
    inner = F.regexp_extract(body, "(?s)(\\{.*\\})", 1)
    return F.when(F.try_variant_get(F.try_parse_json(inner), "$", "string").isNotNull(), inner)


def history(turns: DataFrame, most: int = HISTORY_TURNS, chars: int = HISTORY_CHARS) -> DataFrame:
    """(session_id, turn_index, role, line): the last ``most`` turns of each session, one line each."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_index"))
    last = turns.where(~T.is_blank(F.col("content"))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    line = F.replace(F.col("content"), F.lit("\n"), F.lit(" "))
    cut = F.when(F.char_length(line) > chars, F.concat(F.substring(line, 1, chars), F.lit("…"))).otherwise(line)
    return last.select("session_id", "turn_index", "role", cut.alias("line"))
