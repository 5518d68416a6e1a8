"""Problem 6: filling containers of fixed capacity, by best-fit decreasing.

Items go to groups of bounded size by a hash; each group is packed best-fit decreasing, where a
segment tree over remaining capacities finds the tightest open container in logarithmic time.
What lies in containers that stay notably open is packed again in fewer groups, ``rounds`` times.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.storage import written

GROUP_ITEMS, FULL_SHARE, ROUNDS, SPEC_BLOCK = 20_000, 0.97, 2, 1_000


class OpenContainers:
    """Open containers by remaining capacity: a segment tree whose leaves are capacities."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        # few nodes of a wide tree are in use
        self.count = [0] * (2 * self.leaves) if self.leaves <= 1 << 20 else defaultdict(int)
        self.at: dict[int, list[int]] = {}

    def add(self, remaining: int, container: int) -> None:
        self.at.setdefault(remaining, []).append(container)
        i = remaining + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(remaining, container) with the least remaining capacity that holds ``size``."""
        i = size + self.leaves
        if not self.count[i]:
            # up to the first subtree on the right that holds anything, then down to its left end
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        remaining = i - self.leaves
        container = self.at[remaining].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return remaining, container


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container of every item (none is larger than ``capacity``), and how many there are."""
    place = np.zeros(len(sizes), np.int64)
    free, made = OpenContainers(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        got = free.take(size)
        if got is None:
            remaining, container = capacity, made
            made += 1
        else:
            remaining, container = got
        place[i] = container
        if remaining > size:
            free.add(remaining - size, container)
    return place, made


def _pack(table: pa.Table, tag: int, full_share: float) -> pa.Table:
    capacity = table.column("capacity")[0].as_py()
    group = table.column("grp")[0].as_py()
    order = np.lexsort([table.column(c).to_numpy() for c in ("item", "part", "doc_id")])
    table = table.take(pa.array(order))
    sizes = table.column("tokens").to_numpy()
    place, made = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(place, weights=sizes, minlength=made)
    return (
        table.select(["spec", "capacity", "item", "doc_id", "part", "token_start", "tokens"])
        .append_column("container", pa.array([f"{tag}-{group}-{p}" for p in place]))
        .append_column("open", pa.array(fill[place] < full_share * capacity))
    )


def _packer(tag: int, full_share: float) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _pack(table, tag, full_share)


_SCHEMA = "spec string, capacity int, item long, doc_id long, part int, token_start long, tokens long, container string, open boolean"


def _per_spec(docs: DataFrame, specs: DataFrame, spec_block: int) -> DataFrame:
    """Every document with every spec: specs of a checked number are broadcast, more of them meet the
    documents in blocks."""
    blocks = -(-specs.count() // spec_block)
    if blocks <= 1:
        return docs.join(F.broadcast(specs), F.lit(True))
    placed = specs.withColumn("_block", F.pmod(F.xxhash64("spec"), F.lit(blocks)))
    return docs.withColumn("_block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).join(placed, "_block").drop("_block")


def pack(
    sizes: DataFrame,
    specs: DataFrame,
    group_items: int = GROUP_ITEMS,
    full_share: float = FULL_SHARE,
    rounds: int = ROUNDS,
    spec_block: int = SPEC_BLOCK,
) -> DataFrame:
    """(spec, container, capacity, doc_id, part, token_start, tokens) for ``sizes(doc_id, tokens)``
    and ``specs(spec, capacity_tokens)``.

    Only a document longer than the capacity is cut, into full containers and a rest; the rest is
    an item like any other. Every item is in exactly one container of each spec. Documents with no
    token and NULL ids or sizes have no row; specs with a NULL name and NULL or non-positive
    capacities are left out, and of a spec that is given twice the least capacity counts; equal sizes
    are taken in order of doc_id; repeated rows are items of their own, in containers of their own
    where they are cut. Empty tables give an empty result. Container names are unique within a spec.
    """
    wanted = (
        specs.select(F.col("spec").cast("string"), F.col("capacity_tokens").cast("int").alias("capacity"))
        .where("spec IS NOT NULL AND capacity > 0")
        .groupBy("spec")
        .agg(F.min("capacity").alias("capacity"))
    )
    docs = sizes.select("doc_id", F.col("tokens").cast("long")).where("doc_id IS NOT NULL AND tokens > 0")
    docs = written(docs.withColumn("item", F.monotonically_increasing_id()), "p6-sizes")  # tells repeated rows apart
    parts = (
        _per_spec(docs, wanted, spec_block)
        .withColumn("part", F.explode(F.expr("sequence(0, cast((tokens - 1) div capacity as int))")))
        .withColumn("token_start", F.col("part").cast("long") * F.col("capacity"))
        .withColumn("tokens", F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("token_start")))
        .select("spec", "capacity", "item", "doc_id", "part", "token_start", "tokens")
    )
    whole = F.col("tokens") == F.col("capacity")
    out = parts.where(whole).select("*", F.format_string("full-%d-%d", "item", "part").alias("container"), F.lit(False).alias("open"))
    todo = parts.where(~whole)
    for tag in range(rounds):
        totals = todo.groupBy("spec").agg(F.ceil(F.count("*") / group_items).cast("int").alias("groups"))  # a row a spec
        grouped = todo.join(totals, "spec").withColumn("grp", F.pmod(F.xxhash64("item", "part", F.lit(tag)), F.col("groups")).cast("int"))
        packed = written(
            grouped.drop("groups").groupBy("spec", "grp").applyInArrow(_packer(tag, full_share), _SCHEMA), "p6-packed"
        )
        last = tag == rounds - 1
        out = out.unionByName(packed if last else packed.where("NOT open"))
        todo = packed.where("open").drop("container", "open")
    return out.select("spec", "container", "capacity", "doc_id", "part", "token_start", "tokens")


def violations(packed: DataFrame, sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, overfull, lost, doubled): containers over their capacity, and documents whose tokens are
    not all there, or more than once, in each of ``specs``."""
    over = packed.groupBy("spec", "container", "capacity").agg(F.sum("tokens").alias("t")).groupBy("spec").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    want = sizes.where("doc_id IS NOT NULL AND tokens > 0").groupBy("doc_id").agg(F.sum("tokens").alias("want"))
    have = packed.groupBy("spec", "doc_id").agg(F.sum("tokens").alias("have"))
    odd = have.join(want, "doc_id", "left").groupBy("spec").agg(
        F.count_if(F.col("have") < F.col("want")).alias("short"), F.count_if(F.col("have") > F.coalesce("want", F.lit(0))).alias("doubled"), F.count("*").alias("seen")
    )
    total = want.agg(F.count("*").alias("documents"))
    return (
        specs.select("spec").join(over, "spec", "left").join(odd, "spec", "left").join(F.broadcast(total), F.lit(True))
        .na.fill(0)
        .select("spec", "overfull", (F.col("short") + F.col("documents") - F.col("seen")).alias("lost"), "doubled")
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """(spec, containers, tokens, least_containers, fill): how full the containers are."""
    return (
        packed.groupBy("spec", "capacity")
        .agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))
        .withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
        .drop("capacity")
    )
