"""Co-occurrence of persons in chunks that speak of a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import RELATION_LEAST, RELATION_TOP
from folioflow.functions import text as T
from folioflow.functions import words

#: Who is said to speak: two or three ideographs before a verb of speech (fixed value).
SPEAKER = "[。！？”』」\n]([\\x{4e00}-\\x{9fff}]{2,3})(?:笑|喝|叹|答|问|说)道"


def speakers(chunks: DataFrame, least_share: int = 50, most: int = 20) -> DataFrame:
    """(novel, name, n): the main persons of each book, named in at least 2 and a fiftieth of its chunks."""
    said = chunks.select("novel", "chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(SPEAKER), F.lit(1)))).alias("name"))
    size = chunks.groupBy("novel").agg(F.count("*").alias("chunks"))
    counted = said.groupBy("novel", "name").agg(F.count("*").alias("n")).join(size, "novel")
    w = Window.partitionBy("novel").orderBy(F.desc("n"), "name")
    kept = counted.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("chunks") / least_share)))
    return kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("novel", "name", "n")


def named_in_batches(chunks: DataFrame, size: int = 10, least: int = 2) -> DataFrame:
    """(novel, name, batches): persons named in at least ``least`` batches of ``size`` chunk numbers."""
    said = chunks.select("novel", F.floor(F.col("chunk_id") / size).alias("batch"), F.explode(F.regexp_extract_all("text", F.lit(SPEAKER), F.lit(1))).alias("name"))
    return said.groupBy("novel", "name").agg(F.countDistinct("batch").alias("batches")).where(F.col("batches") >= least)


def relation_chunks(chunks: DataFrame) -> DataFrame:
    """(novel, chunk_id, relation, text): every chunk with a trigger of the relation; books with
    fewer than two are left out."""
    kinds = F.array(*[F.struct(F.lit(k).alias("relation"), T.contains_any(F.col("text"), v).alias("hit")) for k, v in words.RELATION_TRIGGERS.items()])
    hits = chunks.select("novel", "chunk_id", "text", F.explode(F.filter(kinds, lambda k: k["hit"])).alias("k")).select("novel", "chunk_id", "text", "k.relation")
    several = hits.groupBy("novel", "relation").agg(F.count("*").alias("n")).where("n >= 2")
    return hits.join(several, ["novel", "relation"], "left_semi").select("novel", "chunk_id", "relation", "text")


def edges(chunks: DataFrame) -> DataFrame:
    """(novel, person_a, person_b, relation, weight): persons of a book in one chunk, ends sorted."""
    spoken = relation_chunks(chunks)
    seen = spoken.join(speakers(chunks).select("novel", "name"), "novel").where(F.col("text").contains(F.col("name"))).select("novel", "chunk_id", "relation", "name")
    other = seen.withColumnRenamed("name", "person_b")
    return (
        seen.withColumnRenamed("name", "person_a")
        .join(other, ["novel", "chunk_id", "relation"])
        .where("person_a < person_b")
        .groupBy("novel", "person_a", "person_b", "relation")
        .agg(F.count("*").alias("weight"))
    )


def related(edge: DataFrame, least: int = RELATION_LEAST, most: int = RELATION_TOP) -> DataFrame:
    """(person, relation, other, weight, rank): both directions, summed over books, the strongest."""
    both = edge.select(F.col("person_a").alias("person"), "relation", F.col("person_b").alias("other"), "weight").unionByName(
        edge.select(F.col("person_b").alias("person"), "relation", F.col("person_a").alias("other"), "weight")
    )
    summed = both.groupBy("person", "relation", "other").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= least)
    w = Window.partitionBy("person", "relation").orderBy(F.desc("weight"), "other")
    return summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def known_persons(edge: DataFrame) -> DataFrame:
    return edge.select("novel", F.col("person_a").alias("person")).union(edge.select("novel", "person_b")).distinct()


def context_poor(chunks: DataFrame) -> DataFrame:
    """(novel, chunk_id): chunks with a pronoun and none of the book's main persons."""
    named = chunks.select("novel", "chunk_id", "text").join(speakers(chunks).select("novel", "name"), "novel").where(F.col("text").contains(F.col("name")))
    with_pronoun = chunks.where(T.contains_any(F.col("text"), words.PRONOUNS)).select("novel", "chunk_id")
    return with_pronoun.join(named.select("novel", "chunk_id"), ["novel", "chunk_id"], "left_anti")
