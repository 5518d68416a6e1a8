"""From cleaned text to sections and bounded, overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import CHUNK_OVERLAP, CHUNK_SIZE
from folioflow.functions import text as T
from folioflow.functions import words


def book_paragraphs(books: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, paragraph, is_heading) of cleaned ``books``."""
    return books.select(key, F.posexplode(T.paragraphs(T.clean_text(F.col(text)))).alias("pos", "paragraph")).withColumn(
        "is_heading", T.is_heading(F.col("paragraph"))
    )


def sections(paragraphs: DataFrame, key: str) -> DataFrame:
    """Adds ``section`` (0 before the first heading) and ``title`` of the heading that opened it."""
    w = Window.partitionBy(key).orderBy("pos")
    out = paragraphs.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    opened = Window.partitionBy(key, "section").orderBy("pos")
    first = F.first(F.when(F.col("is_heading"), F.col("paragraph"))).over(opened)
    return out.withColumn("title", F.when(F.col("section") > 0, first))


def long_pieces(paragraph: Column, size: int = CHUNK_SIZE) -> Column:
    """Pieces of at most ``size``: sentences packed together, a longer sentence cut hard."""
    found = F.regexp_extract_all(paragraph, F.lit(words.SENTENCES), F.lit(0))

    def cut(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.char_length(s) - 1) / size).cast("int")), lambda i: F.substring(s, i * size + 1, F.lit(size))
        )

    def add(acc: Column, s: Column) -> Column:
        done, cur = acc["done"], acc["cur"]
        flushed = F.when(cur == "", done).otherwise(F.concat(done, F.array(cur)))
        too_long = F.char_length(s) > size
        fits = F.char_length(cur) + F.char_length(s) <= size
        return F.struct(
            F.when(too_long, F.concat(flushed, cut(s))).when(fits, done).otherwise(flushed).alias("done"),
            F.when(too_long, F.lit("")).when(fits, F.concat(cur, s)).otherwise(s).alias("cur"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    packed = F.aggregate(found, start, add, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
    return F.when(F.char_length(paragraph) <= size, F.array(paragraph)).otherwise(packed)


def pack_pieces(pieces: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Greedy packing with an empty line between pieces; on overflow the next chunk begins with
    the last ``overlap`` characters if piece and overlap fit."""
    gap = F.lit("\n\n")

    def add(acc: Column, p: Column) -> Column:
        done, cur = acc["done"], acc["cur"]
        empty, fits = cur == "", F.char_length(cur) + 2 + F.char_length(p) <= size
        tail = F.concat(F.right(cur, F.lit(overlap)), gap, p)
        return F.struct(
            F.when(empty | fits, done).otherwise(F.concat(done, F.array(cur))).alias("done"),
            F.when(empty, p).when(fits, F.concat(cur, gap, p)).when(F.char_length(tail) <= size, tail).otherwise(p).alias("cur"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    return F.aggregate(pieces, start, add, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def chunk_books(books: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_id, title, text): chunks of every book, numbered from 0, none across a heading."""
    parts = sections(book_paragraphs(books, key, text), key).withColumn("pieces", long_pieces(F.col("paragraph"), size))
    by_section = parts.groupBy(key, "section").agg(
        F.first("title").alias("title"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "pieces"))), lambda x: x["pieces"])).alias("pieces"),
    )
    chunks = by_section.select(key, "section", "title", F.posexplode(pack_pieces(F.col("pieces"), size, overlap)).alias("_k", "text"))
    order = Window.partitionBy(key).orderBy("section", "_k")
    return chunks.select(key, (F.row_number().over(order) - 1).alias("chunk_id"), "title", "text")


MOST_AGAIN = 1_000_000


def published(novel_chunks: DataFrame, most_again: int = MOST_AGAIN) -> DataFrame:
    """The latest delivery of every (novel, chunk_id), with text, titles stripped.

    Only chunks that were delivered more than once are shuffled, unless these are more than ``most_again``.
    """
    latest = Window.partitionBy("novel", "chunk_id").orderBy(F.desc("id"))
    title = T.strip(F.col("chapter_title"))
    pool = novel_chunks.withColumn("_k", F.xxhash64("novel", "chunk_id"))
    # of chunks whose hashes are equal by chance the window tells which they are
    again = pool.groupBy("_k").agg(F.count("*").alias("n")).where("n > 1").select("_k")
    few = again.count() <= most_again
    more = pool.join(F.broadcast(again), "_k", "left_semi") if few else pool
    last = more.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
    if few:
        last = pool.join(F.broadcast(again), "_k", "left_anti").unionByName(last)
    return (
        last.drop("_k")
        .where(~T.is_blank(F.col("text")))
        .withColumn("chapter_title", F.when(title != "", title))
    )


def neighbour_windows(chunks: DataFrame, n: int = 2) -> DataFrame:
    """(novel, chunk_id, window): texts of the chunks at most ``n`` places away, joined by LF."""
    ranked = Window.partitionBy("novel").orderBy("chunk_id")
    # places are counted without the texts
    base = chunks.select("novel", "chunk_id").withColumn("place", F.row_number().over(ranked))
    near = base.join(chunks.select("novel", "chunk_id", "text"), ["novel", "chunk_id"]).select("novel", F.col("place").alias("other"), F.col("text").alias("t"))
    wide = base.select("novel", "chunk_id", F.explode(F.sequence(F.col("place") - n, F.col("place") + n)).alias("other"))
    return (
        wide.join(near, ["novel", "other"])
        .groupBy("novel", "chunk_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("other", "t"))), lambda x: x["t"]), "\n").alias("window"))
    )


def matching(conditions: dict[str, object]) -> Column:
    """A condition put together at run time: a list is a set to be in, a pair of bounds (either may be
    None) an interval, a text with ``%`` or ``_`` a pattern without case, None a missing value, anything
    else an equal value. No conditions hold for every row."""
    out = F.lit(True)
    for name, wanted in conditions.items():
        c = F.col(name)
        if wanted is None:
            one = c.isNull()
        elif isinstance(wanted, list):
            one = c.isin(wanted)
        elif isinstance(wanted, tuple):
            low, high = wanted
            one = (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
        elif isinstance(wanted, str) and ("%" in wanted or "_" in wanted):
            one = c.ilike(wanted)
        else:
            one = c == wanted
        out = out & one
    return out
