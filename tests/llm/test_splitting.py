from __future__ import annotations

import random

import pytest

from folioflow.llm import splitting as s

SCHEMA = "id long, text string, chapter_title string, item int, length string, range_no int"


def check_pieces(text, pieces, limit, overlap):
    assert pieces[0]["start"] == 0 and pieces[-1]["end"] == len(text)
    for k, p in enumerate(pieces):
        assert p["piece_no"] == k and p["n_pieces"] == len(pieces)
        assert p["text"] == text[p["start"] : p["end"]] and 0 < len(p["text"]) <= limit
        if k:
            assert pieces[k - 1]["end"] - overlap <= p["start"] <= pieces[k - 1]["end"] < p["end"]


def story(rng, n):
    parts = []
    while sum(map(len, parts)) < n:
        parts.append("".join(rng.choice("天地玄黄宇宙洪荒日月") for _ in range(rng.randint(3, 40))) + rng.choice(["，", "。", "！\n\n", "；", "……", "。\r\n", " "]))
        if rng.random() < 0.02:
            parts.append(f"\n第{rng.randint(1, 99)}章 山门\n")
    return "".join(parts)


@pytest.mark.parametrize("size", [16_384, 2_500])
def test_pieces_cover_every_text(spark, size):
    rng = random.Random(4)
    texts = {i: story(rng, n) for i, n in enumerate([501, 900, 5_000, 30_000])} | {10: "无" * 1_700, 11: "字" * 500, 12: None, 13: "", 14: "a" * 100_000, 15: "\n" * 1_000, 16: "🙂" * 700}
    rows = [(i, t, " 题 " if i != 1 else None, 1, "x", 2) for i, t in texts.items()] + [(None, "字" * 800, None, 1, "x", 2)]
    out: dict[int, list] = {}
    for r in s.split_rows(spark.createDataFrame(rows, SCHEMA), size=size).collect():
        out.setdefault(r["id"], []).append(r)
    assert set(out) == {i for i, t in texts.items() if t and len(t) > 500}
    for i, pieces in out.items():
        check_pieces(texts[i], sorted(pieces, key=lambda r: r["piece_no"]), s.LIMIT, s.OVERLAP)


def test_cuts_are_natural(spark):
    text = ("甲" * 120 + "，" + "乙" * 120 + "。") * 6
    rows = s.split_rows(spark.createDataFrame([(1, text, None, 1, "", 0)], SCHEMA)).orderBy("piece_no").collect()
    assert all(r["text"][-1] == "。" for r in rows)


def test_headings_open_pieces_and_give_titles(spark):
    text = "前" * 300 + "。\n第五章 渡口\n" + "后" * 400 + "。"
    rows = s.split_rows(spark.createDataFrame([(1, text, "　第四章 ", 1, "", 0)], SCHEMA)).orderBy("piece_no").collect()
    assert [r["chapter_title"] for r in rows] == ["第四章", "第五章 渡口"]
    assert rows[1]["text"].startswith("第五章") and rows[1]["start"] == rows[0]["end"]


def test_empty_and_bad_parameters(spark):
    assert s.split_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        s.split_rows(spark.createDataFrame([], SCHEMA), limit=100, overlap=80)


def test_file_ranges_find_what_one_pass_finds(spark, tmp_path):
    text = story(random.Random(9), 60_000)
    path = tmp_path / "book.txt"
    path.write_bytes(text.encode())
    files = spark.createDataFrame([(1, f"file:{path}", path.stat().st_size)], "item long, path string, length long")
    tables = s.file_boundaries(spark, files, size=20_000).orderBy("range_no").collect()
    got = [(p, k) for r in tables for p, k in zip(r["places"], r["strengths"], strict=True)]
    want = [(len(text[:p].encode()), k) for p, k in s.pauses(text)]
    assert got == want


@pytest.mark.parametrize("size", [4_000, 20_000, 4_194_304])
def test_files_are_cut_like_texts(spark, tmp_path, size):
    rng = random.Random(11)
    texts = [story(rng, 60_000), "字" * 500, "无" * 9_000, "🙂a" * 5_000, "第一章 山\n" + story(rng, 30_000).replace("\n第", "\n"), ""]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    files = spark.createDataFrame([(i, str(tmp_path / f"{i}.txt"), len(t.encode())) for i, t in enumerate(texts)], "item long, path string, length long")
    out: dict[int, list] = {}
    for r in s.split_files(spark, files, size=size).collect():
        out.setdefault(r["id"], []).append(r)
    assert set(out) == {0, 2, 3, 4}
    for i, pieces in out.items():
        pieces.sort(key=lambda r: r["piece_no"])
        check_pieces(texts[i], pieces, s.LIMIT, s.OVERLAP)
        own = s.headings(texts[i])
        for p, before in zip(pieces, [0, *[p["end"] for p in pieces]]):
            told = [h for at, h in own if at <= before]
            assert p["chapter_title"] == (told[-1] if told else None)
    if size > 10**6:  # one range: the very pieces of the same text as a row
        rows = s.split_rows(spark.createDataFrame([(0, texts[0], None, 1, "", 0)], SCHEMA), size=10**6).orderBy("piece_no").collect()
        assert [(r["start"], r["end"], r["text"]) for r in rows] == [(r["start"], r["end"], r["text"]) for r in out[0]]


def test_a_file_that_is_not_utf8_is_an_error(spark, tmp_path):
    path = tmp_path / "other.txt"
    path.write_bytes(("字。" * 2_000).encode("gb18030"))
    files = spark.createDataFrame([(1, str(path), path.stat().st_size)], "item long, path string, length long")
    with pytest.raises(Exception, match="UnicodeDecodeError"):
        s.split_files(spark, files).collect()
