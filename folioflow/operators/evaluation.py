"""Metrics of retrieval, citations, judges and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions import words


def retrieval_metrics(ranks: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """One row from ``ranks(hit_rank, routed)``, where a miss has a NULL hit_rank."""
    hit = F.col("hit_rank")
    recalls = [F.round(F.avg(F.when(hit <= k, 1.0).otherwise(0.0)), 3).alias(f"recall_{k}") for k in at]
    return ranks.agg(
        F.count("*").alias("cases"), *recalls, F.round(F.avg(F.coalesce(1.0 / hit, F.lit(0.0))), 3).alias("mrr"),
        F.round(F.avg(F.col("routed").cast("double")), 3).alias("routing"),
    )


def gate(now: DataFrame, baseline: dict[str, float], slack: float = 0.05) -> DataFrame:
    """(metric, value, baseline, passes): no metric may fall by more than ``slack``."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(b).alias("baseline")) for m, b in baseline.items()])
    return now.select(F.explode(rows).alias("r")).select("r.*").withColumn("passes", F.col("value") >= F.col("baseline") - slack)


def citations(answers: DataFrame, n_sources: Column) -> DataFrame:
    """Adds valid and invalid [n] of ``answers(answer)`` and the share of valid ones, 0 without any."""
    cited = T.citation_numbers(F.col("answer"))
    out = answers.withColumn("n_sources", F.coalesce(n_sources, F.lit(0))).withColumn("numbers", cited)
    valid = F.filter("numbers", lambda n: (n >= 1) & (n <= F.col("n_sources")))
    return out.withColumn("valid", F.size(valid)).withColumn("invalid", F.size("numbers") - F.col("valid")).withColumn(
        "valid_ratio", F.when(F.size("numbers") == 0, F.lit(0.0)).otherwise(F.round(F.col("valid") / F.size("numbers"), 6))
    ).drop("numbers")


def completeness(answers: DataFrame) -> DataFrame:
    """Adds counts of statements and the share of factual ones without citation, NULL without any."""
    exempt = lambda s: T.contains_any(s, words.EXEMPT_PHRASES)
    out = answers.withColumn("_s", T.statements(F.col("answer"))).withColumn("_f", F.filter("_s", lambda s: ~exempt(s)))
    out = out.withColumn("statements", F.size("_s")).withColumn("factual", F.size("_f"))
    cited = F.size(F.filter("_f", lambda s: s.rlike("\\[\\d+\\]")))
    return out.withColumn("cited", cited).withColumn(
        "uncited_ratio", F.round((F.col("factual") - F.col("cited")) / F.nullif(F.col("factual"), F.lit(0)), 6)
    ).drop("_s", "_f")


def rule_support(statement: Column, evidence: Column) -> Column:
    """supported, unsupported or uncertain, from the share of bigrams that the evidence has."""
    clean = F.regexp_replace(statement, "\\s", "")
    grams = F.array_distinct(T.bigrams(clean))
    covered = F.size(F.filter(grams, lambda g: evidence.contains(g)))
    return (
        F.when((F.char_length(clean) < 2) | F.coalesce(evidence == "", F.lit(True)), "uncertain")
        .when(covered >= 0.8 * F.size(grams), "supported")
        .when(covered == 0, "unsupported")
        .otherwise("uncertain")
    )


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """(predicted, one column per human label) from ``pairs(predicted, human)``."""
    return pairs.groupBy("predicted").pivot("human", labels).count().na.fill(0)


def precision_recall(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """(label, precision, recall), NULL where nothing was predicted or is true."""
    rows = []
    p, h = F.col("predicted"), F.col("human")
    for name in labels:
        both, said, true = F.count_if((p == name) & (h == name)), F.count_if(p == name), F.count_if(h == name)
        rows.append(
            pairs.agg(
                F.lit(name).alias("label"),
                F.round(both / F.nullif(said, F.lit(0)), 6).alias("precision"),
                F.round(both / F.nullif(true, F.lit(0)), 6).alias("recall"),
            )
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def by_category(cases: DataFrame, category: Column, right: Column) -> DataFrame:
    """(category, cases, accuracy)."""
    return cases.groupBy(category.alias("category")).agg(F.count("*").alias("cases"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """(qid, hit_rank, baseline_rank, change) of two runs ``(qid, hit_rank)``: fixed, broken, better,
    worse or same; NULL ranks are misses, cases of one run only are added or removed."""
    a = now.select("qid", "hit_rank", F.lit(True).alias("is_now"))
    b = before.select("qid", F.col("hit_rank").alias("baseline_rank"), F.lit(True).alias("was"))
    x, y = F.col("hit_rank"), F.col("baseline_rank")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is_now").isNull(), "removed")
        .when(x.eqNullSafe(y), "same")
        .when(y.isNull(), "fixed")
        .when(x.isNull(), "broken")
        .when(x < y, "better")
        .otherwise("worse")
    )
    return a.join(b, "qid", "full_outer").select("qid", "hit_rank", "baseline_rank", change.alias("change"))
