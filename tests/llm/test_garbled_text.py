from __future__ import annotations

import random

import pyarrow as pa

from folioflow.llm import garbled_text as g


def clean_rows(n=400, seed=1):
    rng = random.Random(seed)
    subjects = "少年 掌柜 女医 镖师 巡夜人 守门弟子 账房先生 卖炭翁".split()
    verbs = "收好了 递过了 藏起了 打量了 摔碎了 借走了 点燃了".split()
    things = "钥匙 令牌 古琴 药囊 地图 罗盘 竹筒 琴谱 斗篷".split()
    tails = "没有人敢先开口。 雾气漫过石阶。 旧伤隐隐作痛！ 守夜人换了第二班。".split()
    return ["".join(f"{rng.choice(subjects)}{rng.choice(verbs)}{rng.choice(things)}，{rng.choice(tails)}" for _ in range(12)) + f"\n\nNo. {i} of {rng.randrange(10**6)}" for i in range(n)]


def test_garbled_rows_are_found_and_restored(spark):
    rows = clean_rows()
    bad = {}
    for i, how in enumerate([("utf-8", "gbk"), ("utf-8", "western"), ("gb18030", "latin-1"), ("utf-8", "big5"), ("gb18030", "utf-8"), ("gb18030", "cp1251")]):
        for k in range(4):
            n = i * 10 + k
            a, b = (0, len(rows[n]) - 30) if k % 2 else (40, 160)
            bad[n] = (rows[n], how)
            rows[n] = rows[n][:a] + g.garble(rows[n][a:b], how) + rows[n][b:]
    rows[200] = rows[200] + "屏幕上只剩“锟斤拷”三个字。"
    rows[201] = rows[201] + "怪符是 Ã 与 Þ，😀 &amp; \\u4f60。"
    df = spark.createDataFrame([*enumerate(rows), (900, None), (901, ""), (902, "  "), (None, rows[0])], "id long, text string")
    affected, _ = g.find_garbled([("t", df, "id", "text")])
    got = {r["row_id"]: r for r in affected.collect()}
    assert set(got) == set(bad)
    lossless = [n for n, (_, how) in bad.items() if how in (("utf-8", "western"), ("gb18030", "latin-1"), ("gb18030", "cp1251"))]
    restored = [n for n in lossless if got[n]["restored"] == bad[n][0]]
    assert len(restored) >= 0.8 * len(lossless)
    ids = g.find_garbled([("t", df, "id", "text")], restoring=False)[0]
    assert {r["row_id"] for r in ids.collect()} == set(bad)


def test_twins_vote_and_restore(spark):
    rows = clean_rows(300, seed=2)
    twins = {5: ("utf-8", "big5"), 6: ("gb18030", "utf-8")}
    data = list(enumerate(rows))
    for n, how in twins.items():
        head, tail = rows[n].split("\n\n")
        data.append((1000 + n, g.garble(head, how) + "\n\n" + tail))
    affected, votes = g.find_garbled([("t", spark.createDataFrame(data, "id long, text string"), "id", "text")])
    got = {r["row_id"]: r for r in affected.collect()}
    assert set(got) == {1005, 1006}
    assert all(got[1000 + n]["restored"] == rows[n] and "twin" in got[1000 + n]["how"] for n in twins)
    assert {r["hypothesis"] for r in votes.collect()} == {"utf-8/big5", "gb18030/utf-8"}


def test_near_twins_with_edits_vote(spark):
    rows = [r + f" ref-{i:03d}-{i * 7919 % 1000:03d} a=5, b={i}; see page {i * 31 % 97}" for i, r in enumerate(clean_rows(300, seed=4))]
    data = list(enumerate(rows))
    for n, how in {5: ("utf-8", "big5"), 9: ("utf-8", "western"), 14: ("gb18030", "cp1251")}.items():
        head, tail = rows[n].split("\n\n")
        edited = head[:40] + "又" + head[41:]  # an edit in the text, another in the anchors
        data.append((1000 + n, g.garble(edited, how) + "\n\n" + tail.replace("a=5", "a=6!")))
    affected, votes = g.find_garbled([("t", spark.createDataFrame(data, "id long, text string"), "id", "text")])
    assert {r["row_id"] for r in affected.collect()} == {1005, 1009, 1014}
    assert {r["hypothesis"] for r in votes.collect()} >= {"utf-8/big5", "utf-8/western", "gb18030/cp1251"}


def test_twins_share_windows_that_many_texts_have(spark):
    """Windows of a boilerplate that hundreds of clean texts have are shared windows too, also where what is
    left differs by an edit; every pair that shares enough is met."""
    rows = [r.split("\n\n")[0] + f"\n\nfree e-books at www.example-shelf.net, part {i}" for i, r in enumerate(clean_rows(200, seed=6))]
    head = rows[7].split("\n\n")[0]
    data = [*enumerate(rows), (1007, g.garble(head, ("utf-8", "big5")) + "\n\nfree e-books at www.example-shelf.net, part 9999")]
    affected, votes = g.find_garbled([("t", spark.createDataFrame(data, "id long, text string"), "id", "text")])
    assert {r["row_id"]: "twin" in (r["how"] or "") for r in affected.collect()} == {1007: True}
    assert {r["hypothesis"] for r in votes.collect()} == {"utf-8/big5"}


def test_all_pairs_that_share_keys(spark):
    rng = random.Random(3)
    draw = lambda n: sorted({int(rng.paretovariate(0.6)) for _ in range(n)})
    asks = [(draw(8), rng.choice([1, 2, 3])) for _ in range(150)]
    asks, sets = [(k, n) for k, n in asks if n <= len(k)], [draw(8) for _ in range(200)]
    got = g.shared_keys(spark.createDataFrame(asks, "keys array<long>, least int"), spark.createDataFrame([(x,) for x in sets], "twin_keys array<long>"))
    want = {(tuple(k), n, tuple(x)) for k, n in asks for x in sets if len({*k} & {*x}) >= n}
    found = [(tuple(r["keys"]), r["least"], tuple(r["twin_keys"])) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_alignment_passes_over_edits_of_anchors():
    assert g.align("Ã©A1Ã¨B2Ã»", "éA1èB2û") == [("Ã©", "é"), ("Ã¨", "è"), ("Ã»", "û")]
    assert g.align("Ã©A1Ã¨C3Ã»D4ß", "éA1èB2ûD4ß") == [("Ã©", "é")]
    assert g.align("Ã©", "é") == [("Ã©", "é")] and g.align("Ã©A", "éB") == []


def test_what_is_left_around_lost_bytes(spark):
    rows = clean_rows()
    bad = {}
    for n, (how, lose) in enumerate([(("utf-8", "western"), 3), (("utf-8", "cp932"), 2), (("utf-8", "gbk"), 2), (("gb18030", "latin-1"), 1)] * 3):
        head = rows[n].split("\n\n")[0]
        made = list(g.garble(head, how))
        for k in range(40, len(made), 60):
            made[k : k + lose] = [g.LOST]
        bad[n] = head
        rows[n] = "".join(made)
    affected, _ = g.find_garbled([("t", spark.createDataFrame(list(enumerate(rows)), "id long, text string"), "id", "text")])
    got = {r["row_id"]: r for r in affected.collect()}
    assert set(bad) <= set(got)
    for n, text in bad.items():
        r = got[n]
        assert not r["complete"] and "in part" in r["how"]
        kept = sum(len(p) for p in r["restored"].split(g.LOST) if len(p) > 1 and p in text)
        assert kept >= 0.6 * len(text), (n, r["how"])


def test_every_stretch_is_tried_with_every_hypothesis(spark):
    rows = clean_rows()
    usual, other = ("utf-8", "western"), ("gb18030", "cp1251")
    parts = [r.split("\n\n")[0] for r in rows[:9]]
    made = [g.garble(p[:12], usual) + " -- " + p for p in parts[:8]] + [parts[8] + g.garble("钥匙在罗盘", other) + "。"]
    data = [*enumerate(rows), (900, " ".join(made))]
    affected, _ = g.find_garbled([("t", spark.createDataFrame(data, "id long, text string"), "id", "text")])
    got = {r["row_id"]: r for r in affected.collect()}
    assert set(got) == {900} and {"/".join(usual), "/".join(other)} <= set(got[900]["how"].split(","))
    assert "钥匙在罗盘" in got[900]["restored"][-8:]


def test_round_trips():
    for how in g.HYPOTHESES:
        made = g.garble("plain ascii, kept", how)
        assert made == "plain ascii, kept" or how[0] not in ("utf-8",)
    text = "钥匙在第三块砖下面。"
    for how in (("utf-8", "western"), ("utf-8", "latin-1"), ("gb18030", "latin-1"), ("utf-8", "western", "utf-8", "western")):
        assert g.restore(g.garble(text, how), how) == text
    assert g.restore("好�好", ("utf-8", "latin-1")) is None


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, text string")
    affected, votes = g.find_garbled([("t", df, "id", "text")])
    assert affected.count() == 0 and votes.count() == 0


def test_only_texts_with_explained_runs_are_aligned(monkeypatch):
    aligned = []
    monkeypatch.setattr(g, "align", lambda *pair, align=g.align: aligned.append(pair) or align(*pair))
    rng = random.Random(3)
    rows = clean_rows(40, seed=4)
    pairs = [(f"{x[:50]}; {x[50:]}", f"{y[:50]}; {y[50:]}") for x, y in zip(rows, reversed(rows), strict=True)]
    for x in rows[:20]:
        how = rng.choice(g.HYPOTHESES)
        pairs.append((f"a{g.garble('é', how)}b, {g.garble(x[:60], how)}; {x[60:]}", f"aéb, {x[:60]}; {x[60:]}"))
    table = [{"tbl": "t", "row_id": i, "text": t, "twin": twin} for i, (t, twin) in enumerate(pairs)]
    got = [r for b in g._explain(iter([pa.RecordBatch.from_pylist(table)])) for r in b.to_pylist()]
    seen = [*aligned]
    told = {i for i, (t, twin) in enumerate(pairs) if any(g.explained(*x) is not None for x in g.align(t, twin))}
    assert {r["row_id"] for r in got} == told
    assert told and not {*seen} & {*pairs[:40]}
