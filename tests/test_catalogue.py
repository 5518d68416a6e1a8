"""Titles, change plans, snapshots, rescue and reading on, against literal cases and brute force."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.operators import chunks as C
from folioflow.operators import context as X
from folioflow.operators import dense as D
from folioflow.operators import evaluation as E
from folioflow.operators import fusion
from folioflow.operators import hierarchy as H
from folioflow.operators import lexical as L
from folioflow.operators import quality as Q
from folioflow.operators import understand as U
from folioflow.plans import registry
from folioflow.sources import shared
from folioflow.sources.snapshots import Books, Snapshots


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def named_fuzzily(question, title):
    n = len(title)
    if title in question:
        return True
    if n < 3:
        return False
    most = 1 if n == 3 else 2
    return any(edits(question[i : i + w], title) <= most for w in range(max(3, n - most), n + most + 1) for i in range(max(1, len(question) - w + 1)))


def test_mistyped_titles_against_brute_force(spark):
    rng = random.Random(3)
    signs = "诡秘之主凡人修仙传剑来雪中悍刀行"
    titles = ["".join(rng.choices(signs, k=rng.randint(1, 8))) for _ in range(40)]
    questions = []
    for _ in range(60):
        t = list(rng.choice(titles))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = rng.choice([[], [rng.choice("天地人")]])
        questions.append("请问" + "".join(t) + rng.choice(["里谁是主角", "", "的结局"]))
    q = spark.createDataFrame([(str(i), x) for i, x in enumerate(questions)], "qid string, question string")
    novels = spark.createDataFrame([(t,) for t in set(titles)], "novel string")
    got = {(int(r["qid"]), r["novel"]): r["typo"] for r in U.fuzzy_books(q, novels).collect()}
    want = {(i, t): t not in x for i, x in enumerate(questions) for t in set(titles) if named_fuzzily(x, t)}
    assert got == want and any(want.values())
    bare = {(int(r["qid"]), r["novel"]) for r in U.mentioned_books(q, novels).collect()}
    assert bare == {(i, t) for i, x in enumerate(questions) for t in set(titles) if t in x}


def test_resolving_a_book(spark):
    novels = spark.createDataFrame([("《诡秘之主》作者：甲",), ("《剑来》",), ("Dune",), ("Dune Messiah",)], "novel string")
    asked = ["《剑来》", "诡秘之主", "dune messiah and more", "Dune", "du", "闺蜜之主", "没有的书", "MESSIAH"]
    q = spark.createDataFrame([(str(i), x) for i, x in enumerate(asked)], "qid string, question string")
    got = [(r["novel"], r["how"]) for r in U.resolve_books(q, novels).orderBy(F.col("qid").cast("int")).collect()]
    assert got == [
        ("《剑来》", "exact"), ("《诡秘之主》作者：甲", "contained"), (None, "ambiguous"), ("Dune", "exact"),
        (None, "ambiguous"), ("《诡秘之主》作者：甲", "typo"), (None, "unknown"), ("Dune Messiah", "contained"),
    ]


def test_generated_lists(spark):
    rows = [("韩立的师父是谁？", "1. 谁是韩立的师父\n- “韩立拜谁为师？”\n\n好的\n韩立的师父是谁\n* 韩立师承何人\n谁教了韩立功法", "甲乙、丙丁戊。己（庚辛）!Bob;王", '```json\n{"a": [1, 2]}\n```')]
    rows.append(("问", None, "", "no {json"))
    df = spark.createDataFrame(rows, "q string, a string, n string, j string")
    first, second = df.select(U.variants(F.col("q"), F.col("a")).alias("v"), U.person_names(F.col("n")).alias("n"), U.json_object(F.col("j")).alias("j")).collect()
    assert first["v"] == ["谁是韩立的师父", "韩立拜谁为师？", "韩立师承何人"]
    assert first["n"] == ["甲乙", "丙丁戊"] and first["j"] == '{"a": [1, 2]}'
    assert second["v"] is None and second["n"] == [] and second["j"] is None


def test_change_plan_by_contract(spark):
    directory = [("new", "h"), ("taken over", "h"), ("same", "h"), ("changed", "h2"), ("other pipeline", "h"), ("lost rows", "h"), ("no hash", None)]
    manifest = [("same", "h", "p"), ("changed", "h", "p"), ("other pipeline", "h", "old"), ("lost rows", "h", "p"), ("gone", "h", "p"), ("no hash", None, "p")]
    indexed = ["taken over", "same", "changed", "other pipeline", "gone from disk", "no hash"]
    d = spark.createDataFrame(directory, "novel string, source_hash string")
    m = spark.createDataFrame(manifest, "novel string, source_hash string, pipeline_hash string")
    i = spark.createDataFrame([(x,) for x in indexed * 2], "novel string")
    plan = lambda **kw: {r["novel"]: r["change"] for r in Q.change_plan(d, m, i, "p", **kw).collect()}
    assert plan() == {
        "new": "added", "taken over": "modified", "same": "unchanged", "changed": "modified", "other pipeline": "modified",
        "lost rows": "added", "gone": "deleted", "gone from disk": "deleted", "no hash": "modified",
    }
    assert plan(force=True)["same"] == "modified"
    assert Q.pipeline_hash(a=1, b=2) == Q.pipeline_hash(b=2, a=1) != Q.pipeline_hash(a=1, b=3)
    books = spark.createDataFrame([("a", 10), ("b", 900)], "novel string, chunks int")
    told = lambda **kw: [r["skipped_because"] for r in Q.contextual_decision(books, 500, **kw).orderBy("novel").collect()]
    assert told() == [None, "too many chunks"] and told(mode="off") == ["off", "off"]
    assert told(backend=False) == ["no backend", "too many chunks"] and told(mode="on", backend=False) == [None, "too many chunks"]


def test_a_failed_snapshot_changes_nothing(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.current() is None
    with pytest.raises(FileNotFoundError):
        store.read_current()
    store.publish(spark.range(3))
    with pytest.raises(ValueError):
        store.publish(spark.range(9), check=spark.range(1))
    assert store.read_current().count() == 3
    store.publish(spark.range(5))
    assert store.read_current().count() == 5
    store.withdraw()
    assert store.current() is None


def test_books_are_replaced_one_by_one(spark, tmp_path):
    books = Books(spark, str(tmp_path / "b"))
    rows = spark.createDataFrame([("x", 0, "甲"), ("x", 1, "乙"), ("y", 0, "丙")], "novel string, chunk_id int, text string")
    books.replace("x", rows, {"source_hash": "1"})
    books.replace("y", rows, {"source_hash": "2"})
    assert sorted((r["novel"], r["text"]) for r in books.chunks(["x", "y", "z"]).collect()) == sorted([("x", "甲"), ("x", "乙"), ("y", "丙")])
    with pytest.raises(ValueError):
        books.replace("x", rows.where("novel = 'none'"), {"source_hash": "3"})
    with pytest.raises(Exception, match="boom|UserDefined|RAISE|error"):
        books.replace("x", rows.withColumn("text", F.when(F.col("chunk_id") >= 0, F.raise_error(F.lit("boom")))), {"source_hash": "4"})
    told = {r["novel"]: (r["manifest"]["source_hash"], r["chunk_count"]) for r in books.manifest(["x", "y"]).collect()}
    assert told == {"x": ("1", 2), "y": ("2", 1)}
    books.delete("x")
    assert {r["novel"] for r in books.chunks(["x", "y"]).collect()} == {"y"} and books.chunks(["x"]) is None


def test_written_tables_can_be_discarded(spark):
    before = shared.written(spark.range(4), "t")
    path = shared.new_path(spark, "other")
    spark.range(1).write.parquet(path)
    assert before.count() == 4 and shared.is_there(spark, path)


def test_rescue_merges_pools(spark):
    chunks = spark.createDataFrame([("n", i, t) for i, t in enumerate(["宝剑", "长刀", "宝剑长刀", "无"])], "novel string, chunk_id int, text string")
    q = spark.createDataFrame([(1, "宝剑长刀"), (2, "宝剑")], "qid long, question string")
    cand = spark.createDataFrame([(1, "n", 0, 0.5, 1), (1, "n", 1, 0.4, 2), (2, "n", 0, 1.0, 1)], "qid long, novel string, chunk_id int, score double, rank int")
    signals = spark.createDataFrame([(1, True), (2, False)], "qid long, is_low boolean")
    found = spark.createDataFrame([(1, "n", 2, 1), (1, "n", 0, 2)], "qid long, novel string, chunk_id int, rank int")
    pool = {(r["qid"], r["chunk_id"]): r["place"] for r in fusion.merged_pool([cand, found]).collect()}
    assert pool == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (2, 0): 0}
    got = sorted((r["qid"], r["rank"], r["chunk_id"], r["rescued"]) for r in fusion.rescue(cand, signals, [found], q, chunks, 2).collect())
    assert got[0] == (1, 1, 2, True) and got[-1] == (2, 1, 0, False) and len(got) == 3


def test_reading_on(spark):
    chunks = spark.createDataFrame([("n", i, f"第{i // 4}章 Gate") for i in range(12)], "novel string, chunk_id int, chapter_title string")
    asked = spark.createDataFrame([(1, "n", "gate", 0), (2, "n", "第1章", 11), (3, "n", "第_章", 5), (4, "m", "gate", 0)], "qid long, novel string, title string, chunk_id int")
    got = {}
    for r in X.chapter_like(asked, chunks, 5).collect():
        got.setdefault(r["qid"], []).append((r["chunk_id"], r["complete"]))
    assert sorted(got[1]) == [(i, False) for i in range(5)] and sorted(got[2]) == [(i, True) for i in range(4, 8)] and len(got[3]) == 5 and 4 not in got
    near = {(r["qid"], r["chunk_id"]) for r in X.around(asked, chunks, 9).collect()}
    assert {c for q, c in near if q == 2} == {8, 9, 10, 11} and {c for q, c in near if q == 3} == {2, 3, 4, 5, 6, 7, 8}


def test_conditions_at_run_time(spark):
    df = spark.createDataFrame([(1, "Gate", None), (2, "gate_x", "s"), (3, None, "t")], "a int, b string, c string")
    ids = lambda **kw: {r["a"] for r in df.where(C.matching(kw)).collect()}
    assert ids() == {1, 2, 3} and ids(b="GATE%") == {1, 2} and ids(c=None) == {1} and ids(a=(2, None)) == {2, 3} and ids(a=[1, 9], b="Gate") == {1}


def test_dense_search_near_and_in_blocks(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    rows = [(f"n{i % 7}", i, vec()) for i in range(300)] + [("n0", 900 + i, [1.0] * 8) for i in range(30)]
    chunks = spark.createDataFrame(rows, "novel string, chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(i, vec()) for i in range(5)] + [(9, [1.0] * 8)], "qid long, vec array<float>")
    for search in (D.exact, D.per_book):
        near, far = ({(r["qid"], r["novel"], r["chunk_id"], r["score"]) for r in search(q, chunks, 4, near_queries=n).collect()} for n in (100, 0))
        assert near == far and len(near) == (24 if search is D.exact else 6 * 7 * 4)
    assert D.exact(q.limit(0), chunks, 3).count() == 0


def test_comparing_runs(spark):
    now = spark.createDataFrame([(1, 1), (2, None), (3, 4), (4, 2), (5, None), (7, 1)], "qid long, hit_rank int")
    before = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 5), (5, None), (6, 2)], "qid long, hit_rank int")
    got = {r["qid"]: r["change"] for r in E.compared(now, before).collect()}
    assert got == {1: "same", 2: "broken", 3: "fixed", 4: "better", 5: "same", 6: "removed", 7: "added"}


def test_summaries_by_contract(spark):
    rows = [("b", i, "一章" if i < 7 else None, f"文{i} " * 300 if i != 3 else " ") for i in range(9)] + [("空", 0, "题", "　")]
    chunks = spark.createDataFrame(rows, "novel string, chunk_id int, chapter_title string, text string")
    made = {(r["novel"], r["node_order"]): r for r in H.chapter_nodes(chunks).collect()}
    summary = made["b", 0]["summary"]
    per = (800 - len("一章：") - 8) // 5
    want = "一章：" + " … ".join((f"文{i} " * 300).strip()[:per] for i in (0, 1, 2, 5, 6))
    assert summary == want[:800] and made["空", 0]["summary"] == "题"
    assert made["b", 1]["title"] == "未命名章节（片段 7–8）"
    book = {r["novel"]: r["summary"] for r in H.book_nodes(H.chapter_nodes(chunks)).collect()}
    assert book["b"].startswith("《b》全书概览：一章 一章：文0")


def test_indexed_text_takes_the_context(spark):
    rows = [("n", 0, "剑客", "上文 宝刀"), ("n", 1, "剑客剑客", None), ("n", 2, "别的文字", " ")]
    df = spark.createDataFrame(rows, "novel string, chunk_id int, text string, context string")
    q = spark.createDataFrame([(1, "宝刀")], "qid long, question string")
    assert [r["chunk_id"] for r in L.bm25(L.indexed(df), q, 5).collect()] == [0]
    assert L.bm25(L.indexed(df.drop("context")), q, 5).count() == 0
    reused, pending = X.cached_contexts(df, spark.createDataFrame([("x", "y")], "text_hash string, context string").union(df.select(F.md5("text"), "context")))
    assert [r["chunk_id"] for r in reused.collect()] == [0] and sorted(r["chunk_id"] for r in pending.collect()) == [1, 2]


def test_cases_are_compared_in_one_pass_over_the_texts(spark, tmp_path):
    """No title is held against every text of its book, and odd rows are as in SQL: chunks without a number, titles that are
    empty, NULL or in more than twenty chunks, questions without a number or with that of another book's."""
    chunk = [(i, "甲", i, f"石阶{i}号" + "山谷灯火" * (i % 2) + "渡" * (i % 7)) for i in range(60)]
    chunk += [(100, "甲", None, "山谷灯火" + "无人知晓的去处" * 9), (101, "乙", 3, "渡口长亭"), (102, "乙", 4, "山谷灯火三更"), (103, None, 5, "山谷灯火")]
    spark.createDataFrame([(*c[:3], None, c[3], None, None, None) for c in chunk], "id long, novel string, chunk_id int, chapter_title string, text string, embedding array<float>, token_count int, context string").write.parquet(f"{tmp_path}/novel_chunks.parquet")
    node = [(1, "甲", "山谷灯火", 5, 9), (2, "甲", "山谷灯火", 50, 59), (3, "甲", "", 3, 4), (4, "甲", None, 0, 9), (5, "甲", "石阶7", 7, 7), (6, "甲", "没有", 0, 9), (7, "乙", "渡口", 3, 3), (7, "甲", "石阶59号", 59, 59), (None, "乙", "渡口", 3, 4), (8, None, "渡口", 3, 4), (9, "乙", "灯火三", None, 4), (10, "丙", "灯火", 0, 9)]
    spark.createDataFrame([(n[0], n[1], "chapter", str(i), n[2], i, n[3], n[4], None, None) for i, n in enumerate(node)], "summary_id long, novel string, level string, node_id string, title string, node_order int, start_chunk_id int, end_chunk_id int, summary string, embedding array<float>").write.parquet(f"{tmp_path}/hierarchy_summaries.parquet")
    got = registry.QUERIES["case_comparison"](spark, str(tmp_path))
    assert "Contains(" not in got._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    for name in ("novel_chunks", "hierarchy_summaries"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLES["case_comparison"]).fetchall())
    assert sorted(map(tuple, got.select("qid", "hit_rank", "baseline_rank", "change").collect())) == want
    assert {r[0]: r[2] for r in want} == {1: 3, 2: None, 3: 4, 5: 1, 6: None, 7: 1, 8: None, 9: None, 10: None}
