"""Retrieval on small fixtures, against brute force where the semantics are sequential."""

from __future__ import annotations

import math
import time
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.operators import chunks as C
from folioflow.operators import context as X
from folioflow.operators import dense as D
from folioflow.operators import fusion
from folioflow.operators import graph as G
from folioflow.operators import hierarchy as H
from folioflow.operators import lexical as L
from folioflow.operators import understand as U
from folioflow.sources.shared import written
from folioflow.sources.snapshots import Snapshots
from folioflow.sources.text_files import books, decode


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [("A", i, f"第{1 + i // 3}章", f"韩立在山谷修炼第{i}日，南宫来访") for i in range(10)] + [("B", i, None, f"灯火{i}照山谷") for i in range(5)]
    return spark.createDataFrame(rows, "novel string, chunk_id int, chapter_title string, text string").cache()


@pytest.mark.parametrize("most_asked", [0, 1000])
def test_bm25_against_brute_force(spark, shelf, most_asked):
    asked = spark.createDataFrame([("q1", "山谷灯火"), ("q2", "不存在词"), ("q3", "")], "qid string, question string")
    got = {(r["qid"], r["novel"], r["chunk_id"]): r["score"] for r in L.bm25(shelf, asked, 20, most_asked=most_asked).collect()}
    docs = {(r["novel"], r["chunk_id"]): r["ts"] for r in shelf.select("novel", "chunk_id", L.T.terms(F.col("text")).alias("ts")).collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for key, ts in docs.items():
        score = 0.0
        for t in ("山谷", "谷灯", "灯火"):
            df = sum(t in x for x in docs.values())
            tf = ts.count(t)
            if tf:
                score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        if score:
            want["q1", *key] = round(score, 4)
    assert got == want


def test_best_of_a_place_are_those_of_all_its_sums():
    """Only a question's best leave where the postings are, ties of them too, and none is passed over."""
    rng = np.random.default_rng(5)
    rows = {(t, d): round(float(rng.choice([0.5, 0.5, 1.0]) * (9 - t % 8)), 3) for t in range(40) for d in rng.choice(3_000, 20 + 60 * t, replace=False).tolist()}
    order = rng.permutation(len(rows))
    t, d, w = (np.array(c)[order] for c in (*zip(*rows, strict=True), list(rows.values())))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 5_000]) for x in (t, d, w)], names=["t", "doc", "w"]) for lo in range(0, len(t), 5_000)]
    asked = [sorted(rng.choice(44, rng.integers(1, 7), replace=False).tolist()) for _ in range(300)]  # 40 to 43 are nowhere
    starts = np.cumsum([0, *map(len, asked)])
    halves = [SimpleNamespace(value=(np.arange(lo, hi), starts[lo : hi + 1] - starts[lo], np.concatenate(asked[lo:hi]))) for lo, hi in ((0, 120), (120, 300))]
    got = {i: {} for i in range(300)}
    for b in L._best(iter(batches), halves, 20):
        for r in b.to_pylist():
            got[r["q"]][r["doc"]] = r["score"]
    for i, ts in enumerate(asked):
        sums = np.zeros(3_000)
        for x in ts:
            for doc in range(3_000):
                sums[doc] += rows.get((x, doc), 0.0)
        least = np.sort(sums)[-20]
        want = {int(doc): sums[doc] for doc in np.flatnonzero((sums > 0) & (sums >= least - 1e-6))}
        assert set(got[i]) == set(want) and all(abs(got[i][doc] - want[doc]) < 1e-6 for doc in want)


def test_what_leaves_a_place_does_not_grow_with_its_chunks(spark):
    """Many questions over many chunks that match: a few rows for each question are ranked, not one a chunk."""
    chunks = spark.range(3_000).select(F.lit("A").alias("novel"), F.col("id").cast("int").alias("chunk_id"), F.concat(F.when(F.col("id") % 3 == 0, "山谷灯火").otherwise("渡口"), F.repeat(F.lit("石阶"), (F.col("id") % 97 + 1).cast("int"))).alias("text"))
    asked = spark.range(200).select("id", F.col("id").cast("string").alias("qid"), F.concat(F.lit("山谷，灯火 w"), "id").alias("question")).drop("id")
    found = L.bm25(chunks, asked, 3)
    assert {r["rank"]: r["n"] for r in found.groupBy("rank").agg(F.count("*").alias("n")).collect()} == {1: 200, 2: 200, 3: 200}
    assert {r["chunk_id"] for r in found.collect()} == {0, 291, 582}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # sums are made where the postings are


def test_rrf_keeps_first_seen_on_ties(spark):
    a = spark.createDataFrame([(1, "A", 1, 1), (1, "A", 2, 2)], "qid int, novel string, chunk_id int, rank int")
    b = spark.createDataFrame([(1, "A", 2, 1), (1, "A", 3, 2)], "qid int, novel string, chunk_id int, rank int")
    got = [r["chunk_id"] for r in fusion.rrf(fusion.channels([("dense", a), ("keyword", b)]), 10).orderBy("rank").collect()]
    assert got == [2, 1, 3]


def test_neighbours(spark, shelf):
    hits = spark.createDataFrame([(1, "A", 6, 1)], "qid int, novel string, chunk_id int, rank int")
    assert sorted(r["chunk_id"] for r in X.neighbours(hits, shelf).collect()) == [5, 6, 7]


def test_chapter_growth_within_budget():
    own = pd.DataFrame({"qid": 1, "novel": "A", "chunk_id": range(10), "group_rank": 1, "tokens": 10, "hit": [i == 5 for i in range(10)]})
    out = X.grow(own, 35)
    assert out["chunk_id"].tolist() == [4, 5, 6] and out["tokens"].sum() == 30 and out["truncated"].all()
    single = pd.DataFrame({"qid": [1], "novel": ["A"], "chunk_id": [0], "group_rank": [1], "tokens": [50], "hit": [True]})
    out = X.grow(single, 5)
    assert out["tokens"].tolist() == [50] and out["truncated"].all()


def test_chapter_budget_of_many_questions_makes_no_frames(spark, shelf, capsys):
    """Each question's chapters are grown as ``grow`` does it, without a pandas frame for every question."""
    hits = spark.createDataFrame([(q, "A", (q * k) % 10, k) for q in range(1, 40) for k in (1, 3)], "qid long, novel string, chunk_id int, rank int")
    hits = hits.dropDuplicates(["qid", "chunk_id"])
    got = X.chapter_budget(hits, shelf, 45)
    got.explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroupsInArrow" in plan and "Pandas" not in plan
    tokens = {(r["novel"], r["chunk_id"]): (r["chapter_title"], len(r["text"])) for r in shelf.collect()}
    want = []
    for q in range(1, 40):
        asked = [(r["rank"], r["chunk_id"]) for r in hits.where(F.col("qid") == q).collect()] if q < 6 else []
        titles = {}
        for rank, c in sorted(asked):
            titles.setdefault(tokens["A", c][0], rank)
        members = [(q, "A", c, titles[t], n, c in {x for _, x in asked}) for (book, c), (t, n) in sorted(tokens.items()) if book == "A" and t in titles]
        if members:
            frame = pd.DataFrame(members, columns=["qid", "novel", "chunk_id", "group_rank", "tokens", "hit"])
            want += X.grow(frame, 45).itertuples(index=False, name=None)
    assert sorted(tuple(r) for r in got.where("qid < 6").collect()) == sorted(want)


def test_chapter_groups(spark, shelf):
    hits = spark.createDataFrame([(1, "A", 4, 1), (1, "B", 2, 2)], "qid long, novel string, chunk_id int, rank int")
    got = sorted((r["novel"], r["chunk_id"]) for r in X.chapters_of(hits, shelf).collect())
    assert got == [("A", 3), ("A", 4), ("A", 5), ("B", 2)]


def test_hierarchy_runs_and_ends(spark, shelf):
    got = sorted((r["novel"], r["start_chunk_id"], r["end_chunk_id"]) for r in H.chapter_nodes(shelf).collect())
    assert got == [("A", 0, 2), ("A", 3, 5), ("A", 6, 8), ("A", 9, 9), ("B", 0, 4)]
    untitled = H.chapter_runs(shelf.where("novel = 'B'"), window=2).groupBy("run").agg(F.max("chunk_id").alias("e"), F.min("chunk_id").alias("s"))
    assert sorted((r["s"], r["e"]) for r in untitled.collect()) == [(0, 1), (2, 3), (4, 4)]


def test_summary_has_both_ends(spark):
    df = spark.createDataFrame([([f"文{i}" for i in range(20)],)], "t array<string>")
    made = df.select(H.summary(F.lit("题"), F.col("t"), 200).alias("s")).first()["s"]
    assert "文0" in made and "文19" in made and len(made) <= 200
    assert spark.createDataFrame([([" "],)], "t array<string>").select(H.summary(F.lit("题"), F.col("t")).alias("s")).first()["s"] == "题"


def test_dense_blocks_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    e, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    chunks = spark.createDataFrame([("A", i, [float(x) for x in v]) for i, v in enumerate(e)], "novel string, chunk_id int, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid long, vec array<float>")
    got = {(r["qid"], r["rank"]): r["chunk_id"] for r in D.exact(asked, chunks, 5, block=50).collect()}
    sim = q @ e.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(e, axis=1)[None]
    for i in range(7):
        assert [got[i, r + 1] for r in range(5)] == np.argsort(-sim[i])[:5].tolist()


def test_edges(spark):
    text = "师父来了。\n韩立笑道：走。\n南宫问道：哪里？"
    chunks = spark.createDataFrame([("A", i, text) for i in range(3)], "novel string, chunk_id int, text string")
    row = G.edges(chunks).collect()
    assert [(r["person_a"], r["person_b"], r["relation"], r["weight"]) for r in row] == [("南宫", "韩立", "师徒", 3)]


def test_edges_count_every_chunk_of_a_book(spark):
    text = "师父来了。\n韩立笑道：走。\n南宫问道：哪里？"
    chunks = spark.createDataFrame([("A", i, text) for i in range(200)] + [("B", 0, text)], "novel string, chunk_id int, text string")
    assert [(r["novel"], r["weight"]) for r in G.edges(chunks).collect()] == [("A", 200)]


def test_fuzzy_title(spark):
    novels = spark.createDataFrame([("《诡秘之主》作者：某",), ("《赤渊》",)], "novel string")
    asked = spark.createDataFrame([("q", "《闺秘之王》讲什么"), ("r", "《赤源》讲什么")], "qid string, question string")
    assert [(r["qid"], r["typo"]) for r in U.fuzzy_books(asked, novels).collect()] == [("q", True)]


def test_published_takes_the_last_delivery(spark):
    df = spark.createDataFrame([(1, "A", 0, " t ", "旧"), (2, "A", 0, "　", "新"), (3, "A", 1, None, " ")], "id long, novel string, chunk_id int, chapter_title string, text string")
    rows = C.published(df).collect()
    assert [(r["id"], r["text"], r["chapter_title"]) for r in rows] == [(2, "新", None)]


def test_snapshots_move_only_after_the_check(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        store.read_current()
    store.publish(spark.range(3).toDF("x"))
    with pytest.raises(ValueError):
        store.publish(spark.range(5).toDF("x"), check=spark.range(1))
    assert store.read_current().count() == 3
    store.publish(spark.range(5).toDF("x"))
    assert store.read_current().count() == 5


def test_text_files(spark, tmp_path):
    (tmp_path / "甲.txt").write_bytes("第一章\n你好".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes(b"hello")
    (tmp_path / "c.md").write_bytes(b"no")
    got = {r["novel"]: (r["text"], r["encoding"]) for r in books(spark, str(tmp_path)).collect()}
    assert got == {"甲": ("第一章\n你好", "gb18030"), "b": ("hello", "utf-8")}
    assert decode(b"ab\xff") == ("ab", "utf-8", True, 1)


def test_what_a_written_table_shuffled_does_not_stay_beside_it(spark):
    """What the exchanges of a plan leave on disk goes once its table is there, not at the next collection of garbage."""
    places = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())

    def shuffled() -> set[str]:
        return {p.name for d in places for p in Path(d.getPath()).rglob("shuffle_*")}

    before, kept = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = written(spark.range(10_000).withColumn("k", F.col("id") % 100).groupBy("k").agg(F.sum("id").alias("n")), "sums")
    for _ in range(50):  # it goes in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert got.agg(F.sum("n")).first()[0] == sum(range(10_000)) and got.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept


def test_postings_are_scored_where_they_lie(spark):
    """What is asked for of a table of files is not moved, and moved or not gives the same rows; the least chunks of a tie stay."""
    chunks = spark.range(0, 800, 1, 8).select(F.when(F.col("id") % 2 == 0, "B").otherwise("A").alias("novel"), F.col("id").cast("int").alias("chunk_id"), F.concat(F.when(F.col("id") % 3 == 0, "山谷灯火").otherwise("渡口"), F.repeat(F.lit("石阶"), (F.col("id") % 5).cast("int"))).alias("text"))
    asked = spark.createDataFrame([("a", "山谷"), ("b", "山谷！"), ("c", "渡口石阶"), ("d", "无")], "qid string, question string")
    found, moved = L.bm25(chunks, asked, 7), L.bm25(chunks, asked, 7, most_asked=0)
    assert "RepartitionByExpression" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in moved._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(tuple, found.select("qid", "rank", "novel", "chunk_id", "score").collect()))
    assert rows == sorted(map(tuple, moved.select("qid", "rank", "novel", "chunk_id", "score").collect()))
    assert [r[2:4] for r in rows if r[0] == "a"] == [r[2:4] for r in rows if r[0] == "b"] == [("A", 15 + 30 * i) for i in range(7)]


@pytest.mark.parametrize("size", [1, 3, 4, 100])
def test_parts_end_where_a_chunk_ends(size):
    doc = [5, 5, 5, 2, 2, 9, 9, 9, 9, 9, 9, 9, 1, 4, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(doc[lo : lo + 4], pa.int64())], names=["doc"]) for lo in range(0, len(doc), 4)] + [pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["doc"])]
    parts = [[d for b in part for d in b.column("doc").to_pylist()] for part in L._parts(iter(batches), size)]
    assert [d for p in parts for d in p] == doc
    assert all(not set(a) & set(b) for i, a in enumerate(parts) for b in parts[:i]) and (len(parts) > 1) == (size < 100)


def test_published_moves_only_what_came_again(spark):
    rows = [(1, "a", 0, "x", "旧"), (2, "a", 0, "y", "新"), (3, "a", 1, None, "独"), (4, None, 1, "x", "无"), (5, None, 1, "x", "后"), (6, "a", 2, "x", " "), (7, "a", 3, "x", "先"), (8, "a", 3, "x", None)]
    df = spark.createDataFrame(rows, "id long, novel string, chunk_id int, chapter_title string, text string")
    got = [sorted(r["id"] for r in C.published(df, most_again=n).collect()) for n in (0, 1_000)]
    assert got == [[2, 3, 5], [2, 3, 5]]
    assert "Union" in C.published(df)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("most_asked", "taken"), [(L.MOST_ASKED, L.TAKEN), (50, 40)])
def test_first_containing_against_brute_force(spark, monkeypatch, most_asked, taken):
    rng = np.random.default_rng(5)
    word = lambda most: "".join(rng.choice(list("ab第章𠀀"), rng.integers(0, most)))
    texts = [(["B", "C", None, "D"][rng.integers(4)], int(i) if i % 40 else None, word(60)) for i in rng.permutation(400)]
    needles = {("BCX"[rng.integers(3)], word(12)) for _ in range(99)} | {(b or "X", t[i % 9 : i % 9 + i // 4]) for i, (b, _, t) in enumerate(texts[:120])} | {("B", ""), ("B", texts[0][2]), ("C", texts[1][2] + "a"), ("C", "ab" * 20), ("B", None), (None, "a")}
    chunks = spark.createDataFrame(texts, "novel string, chunk_id int, text string").coalesce(2).select("chunk_id", "text", "novel")
    asked = spark.createDataFrame([*needles, *needles], "novel string, needle string")
    monkeypatch.setattr(L, "TAKEN", taken)
    got = sorted(map(tuple, L.first_containing(chunks, asked, 3, most_asked).select("novel", "needle", "r", "chunk_id").collect()))
    want = []
    for b, x in needles:
        if b is not None and x is not None:
            want += [(b, x, r, c) for r, c in enumerate(sorted(c for n, c, t in texts if n == b and c is not None and x in t)[:3], 1)]
    assert got == sorted(want) and len({x for _, x, *_ in want}) > 50
    # in one place with little room to compare in
    held = L._needles(asked.dropna().distinct().withColumn("n", F.monotonically_increasing_id()))
    batch = chunks.where("novel IS NOT NULL AND chunk_id IS NOT NULL").select("novel", F.col("chunk_id").cast("long"), "text").toArrow().combine_chunks().to_batches()
    found = pa.Table.from_batches(list(L._first_containing(iter(batch), [SimpleNamespace(value=held)], 3)))
    assert found.num_rows == len(want)
