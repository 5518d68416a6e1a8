"""Problem 7: mixing sources to target weights, by a low-discrepancy schedule.

Each source's documents, shuffled by a hash, are cut into blocks of about equal tokens. A recipe
gets slots 0..n-1; slot k's golden-ratio point, mapped through the cumulative weights, names its
source; the r-th slot of a source takes the r-th block of that source, going round the blocks
again up to ``max_repeats`` times. The scarcest source ends the mixture, so every source that has
documents reaches its share.

Sums and numbers along a source, a recipe or its slots are made over buckets first and then within
each, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.prefix import running
from folioflow.llm.storage import written

GOLDEN, BLOCK_TOKENS, BUCKET_ROWS, SPARE = 0.6180339887498949, 512, 20_000, 16


def source_name(source: F.Column) -> F.Column:
    """Sources without stray case and blanks; NULL and blank ones become NULL."""
    name = F.lower(F.regexp_replace(source, "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$", ""))
    return F.when(name != "", name)


def _offsets(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """``docs(source, doc_id, tokens)`` with ``before``: tokens before each in the source's
    shuffled order."""
    n = docs.groupBy("source").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("buckets"))
    wide = docs.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))).join(n, "source").withColumn("bucket", F.pmod(F.col("h"), F.col("buckets")))
    return running(wide, ["source"], "bucket", ["h", "doc_id"], F.col("tokens"), "before").select("source", "doc_id", "tokens", "before")


def mix(
    sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, bucket_rows: int = BUCKET_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``(mixture, shares)`` for ``sizes(doc_id, source, tokens)`` and
    ``targets(recipe, source, target_weight, max_repeats)``.

    mixture(recipe, slot, source, doc_id, use_no, tokens): the documents in order of ``slot``;
    ``use_no`` counts the uses of a document from 1. shares(recipe, source, target_share,
    actual_share, tokens, documents, most_uses) has every row of ``targets``; ``target_share`` is
    the weight relative to the whole recipe, sources without documents reach 0 and the others
    keep their proportions. Documents with a NULL id, NULL or blank source or no token, and
    targets with a NULL or non-positive weight or cap, take no part; targets named twice add up
    their weights and keep the lower cap. Repeated rows are documents of their own. Empty tables
    give empty results. Blocks have about ``block_tokens`` tokens at any size of the input.
    """
    wanted = (
        targets.select("recipe", source_name(F.col("source")).alias("source"), "target_weight", "max_repeats")
        .where("recipe IS NOT NULL AND source IS NOT NULL AND target_weight > 0 AND max_repeats > 0")
        .groupBy("recipe", "source")
        .agg(F.sum("target_weight").alias("weight"), F.min("max_repeats").cast("long").alias("cap"))
    )
    docs = written(
        sizes.select(source_name(F.col("source")).alias("source"), "doc_id", F.col("tokens").cast("long"))
        .where("source IS NOT NULL AND doc_id IS NOT NULL AND tokens > 0"),
        "p7-sizes",
    )
    docs = docs.join(wanted.select("source").distinct(), "source", "left_semi")
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs"))
    known = written(wanted.join(have, "source"), "p7-known")
    by_recipe = Window.partitionBy("recipe")
    planned = known.withColumn("size", F.min(F.col("have") * F.col("cap") / F.col("weight")).over(by_recipe))
    blocks = written(
        _offsets(docs, bucket_rows)
        .join(have.select("source", F.greatest(F.lit(1.0), F.round(F.col("have") / block_tokens)).alias("n"), "have"), "source")
        # the middle of a document says in which block it is
        .withColumn("block", F.least(F.col("n") - 1, F.floor((F.col("before") + F.col("tokens") / 2) * F.col("n") / F.col("have"))).cast("long"))
        .select("source", "block", "doc_id", "tokens"),
        "p7-blocks",
    )
    filled = blocks.groupBy("source", "block").agg(F.sum("tokens").alias("t")).withColumn("bucket", F.floor(F.col("block") / bucket_rows))
    # blocks that no document fell into are skipped
    filled = running(filled, ["source"], "bucket", ["block"], F.lit(1), "no")
    filled = running(filled, ["source"], "bucket", ["block"], F.col("t"), "before")
    count = filled.groupBy("source").agg(F.count("*").alias("n"))
    numbered = written(filled.join(count, "source").select("source", "block", "no", (F.col("before") + F.col("t") / 2).alias("middle"), "n"), "p7-numbered")
    # how many blocks come nearest to the source's share: whole rounds, then part of one
    need = planned.withColumn("need", F.col("size") * F.col("weight")).withColumn(
        "rounds", F.least(F.col("cap"), F.floor(F.col("need") / F.col("have") + 1e-9))
    )
    part = need.withColumn("rest", F.when(F.col("rounds") < F.col("cap"), F.col("need") - F.col("rounds") * F.col("have")).otherwise(0.0))
    counted = part.join(numbered, "source").groupBy("recipe", "source", "rounds", "n").agg(F.count_if(F.col("middle") <= F.col("rest")).alias("more"))
    plan = counted.withColumn("take", F.col("rounds") * F.col("n") + F.col("more")).where("take > 0")
    order = by_recipe.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("take").over(by_recipe)
    plan = plan.select(
        "recipe", "source", "n", "take",
        # enough points for the rarest source, whose count strays by a few from its share
        (total + F.ceil(SPARE * total / F.min("take").over(by_recipe))).cast("long").alias("slots"),
        ((F.sum("take").over(order) - F.col("take")) / total).alias("low"),
        (F.sum("take").over(order) / total).alias("high"),
    )
    plan = written(plan, "p7-plan")  # a row a target, as targets are a list of weights and not data
    # ranges of slots first, so that the slots of a recipe are made in many tasks
    ranges = plan.select("recipe", "slots").distinct().withColumn("bucket", F.explode(F.expr(f"sequence(0L, (slots - 1) div {bucket_rows})")))
    numbers = ranges.repartition("recipe", "bucket").withColumn(
        "slot", F.explode(F.expr(f"sequence(bucket * {bucket_rows}, least(slots, (bucket + 1) * {bucket_rows}) - 1)"))
    )
    point = F.col("slot") * F.lit(GOLDEN) % 1.0
    slots = numbers.withColumn("u", point).join(F.broadcast(plan.drop("slots")), ["recipe"]).where("u >= low AND u < high")
    ranked = running(slots, ["recipe", "source"], "bucket", ["slot"], F.lit(1), "r")
    ranked = ranked.where(F.col("r") < F.col("take")).select(
        "recipe", "source", "slot", (F.col("r") % F.col("n")).alias("no"), (F.floor(F.col("r") / F.col("n")) + 1).cast("int").alias("use_no")
    )
    mixture = (
        ranked.join(numbered.select("source", "block", "no"), ["source", "no"])
        .join(blocks, ["source", "block"])
        .select("recipe", "slot", "source", "doc_id", "use_no", "tokens")
    )
    mixture = written(mixture, "p7-mixture")
    used = mixture.groupBy("recipe", "source").agg(
        F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("use_no").alias("most_uses")
    )
    shares = (
        wanted.join(used, ["recipe", "source"], "left")
        .na.fill(0, ["tokens", "documents", "most_uses"])
        .select(
            "recipe", "source",
            (F.col("weight") / F.sum("weight").over(by_recipe)).alias("target_share"),
            F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(by_recipe), F.lit(0)), F.lit(0.0)).alias("actual_share"),
            "tokens", "documents", "most_uses",
        )
    )
    return mixture, shares


def violations(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(recipe, source, overused): documents that are used more often than ``max_repeats`` allows, for
    every source that is named in ``targets``; a use is told by its ``use_no``."""
    cap = (
        targets.select("recipe", source_name(F.col("source")).alias("source"), "max_repeats")
        .where("recipe IS NOT NULL AND source IS NOT NULL")
        .groupBy("recipe", "source")
        .agg(F.min("max_repeats").alias("cap"))
    )
    uses = mixture.groupBy("recipe", "source", "doc_id").agg(F.count("*").alias("n"))
    over = uses.join(cap, ["recipe", "source"]).groupBy("recipe", "source").agg(F.count_if(F.col("n") > F.col("cap")).alias("overused"))
    return cap.join(over, ["recipe", "source"], "left").select("recipe", "source", F.coalesce("overused", F.lit(0)).alias("overused"))
