"""Pure cases of the text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import chunks as C
from folioflow.operators import evaluation as E
from folioflow.operators import understand as U


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("第一章 山边小村", True),
        ("第102章：新的旅程", True),
        ("楔子", True),
        ("番外篇 南宫婉", True),
        ("第一章讲的是他离开家乡的故事。", False),
        ("我在第一章里提到过他", False),
    ],
)
def test_heading(spark, line, expected):
    assert one(spark, line, T.is_heading) is expected


def test_clean_text(spark):
    assert one(spark, "﻿a\r\nb \t　c\n\n\n\nd  ", T.clean_text) == "a\nb c\n\nd"
    assert one(spark, None, T.clean_text) is None


def test_terms_keep_repeats_and_drop_stop_words(spark):
    assert one(spark, "韩立韩立 rag 我 什么", T.terms) == ["rag", "韩立", "立韩", "韩立"]
    assert one(spark, "", T.terms) == []
    assert one(spark, "Élan naïve Привет мир कहानी", T.terms) == ["Élan", "naïve", "Привет", "мир", "कहानी"]
    assert one(spark, "灯りを消せ。한국말", T.terms) == ["灯り", "りを", "を消", "消せ", "한국", "국말"]


def test_chunks_do_not_cross_headings(spark):
    book = "前言文字\n第一章 甲\n" + "甲" * 30 + "\n第二章 乙\n" + "乙" * 30
    rows = C.chunk_books(spark.createDataFrame([("b", book)], "k string, text string"), "k", "text").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == [0, 1, 2]
    assert [r["title"] for r in rows] == [None, "第一章 甲", "第二章 乙"]
    assert all(not ("甲甲" in r["text"] and "乙乙" in r["text"]) for r in rows)


def brute_chunks(pieces, size, overlap):
    done, cur = [], ""
    for p in pieces:
        if not cur:
            cur = p
        elif len(cur) + 2 + len(p) <= size:
            cur += "\n\n" + p
        else:
            done.append(cur)
            tail = cur[-overlap:] + "\n\n" + p
            cur = tail if len(tail) <= size else p
    return done + ([cur] if cur else [])


def test_packing_against_brute_force(spark):
    pieces = ["字" * n for n in (10, 480, 5, 100, 300, 499, 1, 1, 250, 260)]
    got = one(spark, pieces, lambda c: C.pack_pieces(c), "array<string>")
    assert got == brute_chunks(pieces, 500, 80)


def test_long_paragraph_is_cut_hard_only_where_a_sentence_is_too_long(spark):
    text = "甲" * 300 + "。" + "乙" * 300 + "。" + "丙" * 1100 + "。" + "丁" * 3
    got = one(spark, text, lambda c: C.long_pieces(c))
    assert [len(x) for x in got] == [301, 301, 500, 500, 101, 3]
    assert "".join(got) == text


@pytest.mark.parametrize(
    ("question", "route"),
    [
        ("你好", "free"),
        ("不要搜索，直接说说", "free"),
        ("《诡秘之主》讲了什么", "grounded"),
        ("什么是RAG", "free"),
        ("帮我写一首诗", "free"),
        ("主角是谁", "grounded"),
        ("韩立后来去了哪里", "grounded"),
    ],
)
def test_route(spark, question, route):
    assert one(spark, question, U.route) == route


def test_rewrite_gate(spark):
    df = spark.createDataFrame([("他后来怎么样了呢到底", True), ("还有吗", True), ("韩立最初在哪个村子长大的呀", True), ("还有吗", False)], "q string, h boolean")
    got = [r["y"] for r in df.select(U.needs_rewrite(F.col("q"), F.col("h")).alias("y")).collect()]
    assert got == [True, True, False, False]


def test_statements_keep_their_marks(spark):
    assert one(spark, "甲走了。乙来了！丙？", T.statements) == ["甲走了。", "乙来了！", "丙？"]
    assert one(spark, "  ", T.statements) == []


def test_citations(spark):
    df = spark.createDataFrame([("先看[2]，再看[1]和[9]，又看[2]。",)], "answer string")
    r = E.citations(df, F.lit(2)).first()
    assert (r["valid"], r["invalid"], r["valid_ratio"]) == (2, 1, 0.666667)


def test_completeness_without_facts_is_null(spark):
    df = spark.createDataFrame([("无法确定。",), ("根据原文。甲是乙。希望对你有帮助！",)], "answer string")
    a, b = E.completeness(df).collect()
    assert a["uncited_ratio"] is None
    assert (b["statements"], b["factual"], b["uncited_ratio"]) == (3, 1, 1.0)


def test_rule_support(spark):
    df = spark.createDataFrame([("韩立进山", "韩立进山采药"), ("天地玄黄", "韩立进山采药"), ("韩立回家", "韩立进山采药"), ("韩", "韩立"), ("韩立", "")], "s string, e string")
    got = [r["y"] for r in df.select(E.rule_support(F.col("s"), F.col("e")).alias("y")).collect()]
    assert got == ["supported", "unsupported", "uncertain", "uncertain", "uncertain"]


def test_sigmoid(spark):
    got = [r["y"] for r in spark.createDataFrame([(0.0,), (20.0,), (-20.0,)], "x double").select(T.sigmoid(F.col("x")).alias("y")).collect()]
    assert got[0] == 0.5 and got[1] > 0.999999 and got[2] < 0.000001


def test_confusion_and_precision(spark):
    pairs = [("supported", "supported"), ("supported", "supported"), ("supported", "partial"), ("unsupported", "unsupported"), ("uncertain", "supported"), ("uncertain", "partial")]
    df = spark.createDataFrame(pairs, "predicted string, human string")
    table = {r["predicted"]: r.asDict() for r in E.confusion(df, ["supported", "partial", "unsupported"]).collect()}
    assert table["supported"] == {"predicted": "supported", "supported": 2, "partial": 1, "unsupported": 0}
    got = {r["label"]: (r["precision"], r["recall"]) for r in E.precision_recall(df, ["supported", "unsupported", "none"]).collect()}
    assert got == {"supported": (0.666667, 0.666667), "unsupported": (1.0, 1.0), "none": (None, None)}


def test_evaluation_set_keeps_labelled_cases(spark, tmp_path):
    from folioflow.sources.text_files import evaluation_set

    path = tmp_path / "cases.json"
    path.write_text('[{"id": 1, "retrieval": {"keywords": ["a"]}}, {"id": 2}]')
    assert [r["id"] for r in evaluation_set(spark, str(path)).collect()] == [1]
