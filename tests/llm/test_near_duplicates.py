from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import near_duplicates as nd

SCHEMA = "id long, text string, key string, norm int, part string"


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往", k=rng.randint(2, 4))) for _ in range(60)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            base = list(rng.choice(out))
            for _ in range(rng.randint(0, 6)):
                i = rng.randrange(len(base))
                base[i : i + rng.choice([0, 1])] = rng.choice("甲乙丙丁")
            out.append("".join(base))
        else:
            out.append("".join(rng.choices(words, k=rng.randint(15, 60))))
    return out


def brute(rows, t=nd.THRESHOLD):
    norm = [(i, x.translate(str.maketrans("", "", nd.IGNORED))) for i, x in rows if i is not None and x is not None]
    norm = [(i, x) for i, x in norm if len(x) >= nd.LEAST]
    return sorted(
        tuple(sorted((a, b)))
        for k, (a, x) in enumerate(norm)
        for b, y in norm[k + 1 :]
        if a != b and nd.resemblance(x, y) >= t
    )


ODD = [(1002, None), (1003, ""), (1004, "短"), (1005, "很" * 100), (1006, "很" * 90)]


@pytest.mark.parametrize(("slack", "list_rows", "hot"), [(6, 1000, 10), (0, 100_000, 1_000_000), (2, 300, 3)])
def test_pairs_against_brute_force(spark, slack, list_rows, hot):
    rows = list(enumerate(texts()))
    rows += [(1000, rows[0][1]), (1001, rows[0][1] + "\u3000\n"), (None, rows[0][1]), *ODD]
    df = spark.createDataFrame([(i, x, "k", 1, "p") for i, x in rows], SCHEMA)
    members, links = nd.near_duplicates(df, slack=slack, block=500, list_rows=list_rows, hot=hot)
    got = sorted((r["id_a"], r["id_b"]) for r in nd.row_pairs(members, links).collect())
    assert got == brute(rows) and len(got) > 20


@pytest.mark.parametrize("slack", [0, 3])
@pytest.mark.parametrize("parts", [1, 3])
def test_merging_finds_all_pairs_of_given_lists(slack, parts):
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(80):
        s = set(rng.integers(0, 400, 30).tolist())
        sets += [s, set(list(s)[2:]) | {int(rng.integers(400, 500))}]
    rows = []
    for d, s in enumerate(sets):
        short = int(nd.short_prefix(np.array([len(s)]), 0.7, slack)[0])
        for place, run in enumerate(sorted(s)[:short]):
            left = len(s) - place
            if parts == 1:
                rows.append((run, 0, d, len(s), left))
            else:  # a split list
                rows.append((run, 2 + 2 * (d % parts), d, len(s), left))
                rows += [(run, 3 + 2 * p, d, len(s), left) for p in range(parts)]
    columns = [np.array(c, np.int32) for c in zip(*rows, strict=True)]
    count: dict[int, int] = {}
    for pair, met in nd.merged(*columns, 0.7, slack, 50):
        for p, m in zip(pair.tolist(), met.tolist(), strict=True):
            count[p] = count.get(p, 0) + m
    got = {(p >> 32, p & 0xFFFFFFFF) for p, m in count.items() if m > slack}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    assert want and want <= got and (not slack or len(got) < 0.2 * len(sets) ** 2 / 2)


def test_lists_hold_a_text_as_often_at_every_size():
    """What is shuffled per text depends on its runs only, not on the number of texts or buckets."""
    import pyarrow as pa

    own = texts(60)
    sizes = []
    for buckets, copies in ((16, 1), (16, 2), (1000, 1)):
        batch = pa.RecordBatch.from_pydict({"d": pa.array(range(len(own) * copies), pa.int32()), "norm": own * copies})
        rows = list(nd._postings(iter([batch]), 5, 0.7, 6, buckets, nd.HOT, np.zeros(1 << 20, np.uint8)))
        sizes.append(sum(len(r) for b in rows for r in b.column("d").to_pylist()) / copies)
    assert sizes[0] == sizes[1] == sizes[2]


def test_empty_table(spark):
    members, links = nd.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert nd.row_pairs(members, links).count() == 0 and members.count() == 0


def test_groups_follow_chains(spark):
    base = "".join(f"第{i}句话写在这里" for i in range(60))
    step = [base, base[30:] + "甲" * 30, base[60:] + "甲" * 30 + "乙" * 30]
    rows = [(i, x) for i, x in enumerate(step)] + [(9, step[0]), (20, "别的文字" + "".join(chr(0x5000 + 7 * i) for i in range(100)))]
    members, links = nd.near_duplicates(spark.createDataFrame(rows, "id long, text string"))
    got = {r["id"]: (r["class_id"], r["group_id"]) for r in nd.duplicate_groups(members, links).collect()}
    assert got[9] == (0, 0) and got[2][1] == 0 and got[20] == (20, 20)


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in nd.components(edges).collect()} == {0}
