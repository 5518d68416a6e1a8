from __future__ import annotations

import random

import numpy as np
import pytest

from folioflow.llm import mixing, packing, tokens
from folioflow.llm.queries import VOCABULARY


def brute_best_fit(sizes, capacity):
    free, place = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(free) if r >= sizes[i]]
        if fits:
            r, b = min(fits)
        else:
            b = len(free)
            free.append(capacity)
        free[b] -= sizes[i]
        place[i] = b
    return place, len(free)


@pytest.mark.parametrize("capacity", [1, 10, 512, 1000])
def test_best_fit_needs_as_many_containers_as_brute_force(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(400)]
    place, n = packing.best_fit_decreasing(np.array(sizes), capacity)
    fill = np.bincount(place, weights=sizes)
    assert fill.max() <= capacity and n == brute_best_fit(sizes, capacity)[1] == len(fill)


def test_tightest_container_is_taken():
    free = packing.OpenContainers(100)
    for r, c in ((50, 0), (20, 1), (70, 2)):
        free.add(r, c)
    assert free.take(21) == (50, 0) and free.take(20) == (20, 1) and free.take(71) is None and free.take(1) == (70, 2) and free.take(1) is None


def test_pack(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 5, 300, 512, 513, 1024, 5000, rng.randint(1, 600)])) for i in range(600)]
    df = spark.createDataFrame([*sizes, (700, None), (None, 5), (701, -3)], "doc_id long, tokens long")
    specs = spark.createDataFrame([("a", 512), ("b", 2048), ("bad", 0), ("none", None)], "spec string, capacity_tokens int")
    rows = packing.pack(df, specs, group_items=100).collect()
    for spec, cap in (("a", 512), ("b", 2048)):
        own = [r for r in rows if r["spec"] == spec]
        by_doc: dict[int, list] = {}
        fill: dict[str, int] = {}
        for r in own:
            by_doc.setdefault(r["doc_id"], []).append((r["token_start"], r["tokens"]))
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        assert max(fill.values()) <= cap
        for doc, n in sizes:
            parts = sorted(by_doc.get(doc, []))
            assert sum(k for _, k in parts) == n and len(parts) == -(-n // cap)
            assert [a for a, _ in parts] == [i * cap for i in range(len(parts))]
        assert sum(fill.values()) / (cap * len(fill)) > 0.9
    assert {r["spec"] for r in rows} == {"a", "b"}
    assert packing.pack(df.limit(0), specs).count() == 0 and packing.pack(df, specs.limit(0)).count() == 0


def test_repeated_rows_and_many_specs(spark):
    df = spark.createDataFrame([(1, 250), (1, 250), (1, 250), (2, 100), (3, 7)], "doc_id long, tokens long")
    specs = spark.createDataFrame([(f"s{i}", 100 + i) for i in range(7)] + [("s0", 900), (None, 100)], "spec string, capacity_tokens int")
    rows = packing.pack(df, specs, spec_block=3).collect()
    fill: dict[tuple, int] = {}
    for r in rows:
        fill[r["spec"], r["container"]] = fill.get((r["spec"], r["container"]), 0) + r["tokens"]
    assert {s for s, _ in fill} == {f"s{i}" for i in range(7)}
    assert all(n <= 100 + int(s[1:]) for (s, _), n in fill.items())
    assert all(sum(n for (s, _), n in fill.items() if s == f"s{i}") == 857 for i in range(7))
    told = packing.violations(packing.pack(df, specs.where("spec = 's1'")), df, specs.where("spec = 's1'")).collect()
    assert [(r["overfull"], r["lost"], r["doubled"]) for r in told] == [(0, 0, 0)]


def test_wide_capacity():
    sizes = np.array([3_000_000, 2_999_999, 1, 1])
    place, n = packing.best_fit_decreasing(sizes, 3_000_001)
    assert n == 2 and np.bincount(place, weights=sizes).max() == 3_000_001


def test_numbers_over_buckets(spark):
    from pyspark.sql import functions as F

    from folioflow.llm.prefix import running

    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 37).alias("b"), "id")
    got = running(df, ["k"], "b", ["id"], F.col("id"), "before").collect()
    assert len(got) == 500 and all(r["before"] == sum(range(r["k"], r["id"], 2)) for r in got)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (None, "x"), (4, "字" * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.sized(df, VOCABULARY).collect()}
    assert set(got) == {1, 4} and got[1] == tokens.count_tokens(["hello world"], VOCABULARY)[0]


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 10 < 6 else " Mid " if i % 10 < 9 else "SMALL", rng.randint(20, 900)) for i in range(4000)]
    rows += [(9000, None, 50), (9001, " ", 50), (None, "big", 10), (9002, "big", None), (9003, "unused", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame(
        [("r", "big", 5.0, 1), ("r", "mid", 3.0, 2), ("r", "small", 2.0, 4), ("r", "absent", 1.0, 2), ("q", "small", 1.0, 3), ("q", "nil", None, 1), ("q", "zero", 0.0, 1)],
        "recipe string, source string, target_weight double, max_repeats int",
    )
    mixture, shares = mixing.mix(docs, targets, block_tokens=2000, bucket_rows=30)
    got = {(r["recipe"], r["source"]): r for r in shares.collect()}
    assert set(got) == {("r", "big"), ("r", "mid"), ("r", "small"), ("r", "absent"), ("q", "small")}
    assert got["r", "absent"]["actual_share"] == 0
    for source, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(got["r", source]["actual_share"] - want) < 0.01
    uses: dict = {}
    for r in mixture.collect():
        key = (r["recipe"], r["source"], r["doc_id"])
        assert r["use_no"] not in uses.setdefault(key, set())
        uses[key].add(r["use_no"])
    caps = {("r", "big"): 1, ("r", "mid"): 2, ("r", "small"): 4, ("q", "small"): 3}
    assert all(len(u) <= caps[k[0], k[1]] for k, u in uses.items())
    assert {r["overused"] for r in mixing.violations(mixture, targets.where("max_repeats IS NOT NULL")).collect()} == {0}
    # the scarcest source is used up but for a block or two
    small = sum(t for _, s, t in rows if s == "SMALL")
    assert got["q", "small"]["tokens"] > 0.97 * 3 * small
    empty, none = mixing.mix(docs.limit(0), targets)
    assert empty.count() == 0 and {r["actual_share"] for r in none.collect()} == {0.0}
