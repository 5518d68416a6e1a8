"""Problem 1: near-duplicate records, by T-occurrence search with DivideSkip.

Two texts resemble each other by Jaccard >= ``threshold`` on their sets of runs of ``width``
code points. Every run has an inverted list of the texts that hold it. As in DivideSkip, the
lists of a text are divided into *short* ones (its rarest ``n - T + 1 + slack`` runs, where
``T = ceil(threshold * n)`` runs must be shared) and *long* ones (its ``T - 1 - slack`` most
frequent): a pair must meet at least ``slack + 1`` times in short lists, so only these are merged,
and the long ones are probed for the pairs that are left.

1. How frequent runs are is counted over all texts, in ``2^bits`` hashed counters. Any order of
   the runs that is the same for all texts gives the same links; the counts make lists short.
2. Each text goes to the lists of its short runs only, as (run, text, size, runs left from here).
   A list is in one bucket, buckets grow in number with the texts. A list of over ``hot`` texts is
   split: each part has some of the larger texts of a pair, and all smaller ones.
3. Lists are merged in order of size, the array form of the heap. A pair that meets with too few
   runs left on either side to reach the overlap is skipped; the others are counted per bucket,
   then over all buckets, and stay if they met ``slack + 1`` times.
4. For these the long lists are probed by binary search: all runs of the one text in the sorted runs
   of the other, from the texts themselves.

Texts go by 32 bits of a hash up to step 3, where a collision only adds a pair to probe; a class of
equal texts is named by 128 bits. Copies in one task are one text; all of them are one in a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.storage import written

#: Characters that don't count (fixed values): space, tab, CR, LF, U+00A0, U+3000.
IGNORED = " \t\r\n 　"
THRESHOLD, WIDTH, LEAST = 0.70, 5, 60
SLACK, BLOCK, LIST_ROWS, HOT = 6, 1_000_000, 2_000_000, 1_000_000
FEWEST, SEEN = 16, 1_000_000  # buckets at least; texts of a task remembered as copies

_DOCS, _HASH = 2_048, 45  # texts in one array; bits of a run's hash
_PIECE = 1 << 16


def normalised(text: F.Column) -> F.Column:
    return F.translate(text, IGNORED, "")


def _normal(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm")).where(
        F.col("id").isNotNull() & (F.char_length("norm") >= least)
    )


def _short_name(norm: str = "norm") -> F.Column:
    return F.shiftright(F.xxhash64(norm), 32).cast("int").alias("d")


def _hashed(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash of ``_HASH`` bits) of every run of every text, in order."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(cp) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = np.zeros(len(cp) - width + 1, np.uint64)
    for k in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += cp[k : k + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    doc = np.repeat(np.arange(len(texts)), lens)[: len(h)]
    inside = np.arange(len(h)) - (np.cumsum(lens) - lens)[doc] <= lens[doc] - width
    return doc[inside].astype(np.uint64), h[inside] >> np.uint64(64 - _HASH)


def _chunks(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``_DOCS`` texts and, but for a longer text alone, ``most`` code points."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and (i - lo == _DOCS or size + len(text) > most):
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


# --- how frequent runs are -------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << bits, np.int32)
    for batch in batches:
        texts = batch.column("norm").to_pylist()
        for lo, hi in _chunks(texts):
            _, h = _hashed(texts[lo:hi], width)
            at, n = np.unique(h & np.uint64((1 << bits) - 1), return_counts=True)
            total[at.astype(np.int64)] += n.astype(np.int32)
    for piece in range(0, 1 << bits, _PIECE):
        own = total[piece : piece + _PIECE]
        if own.any():  # byte by byte, as the higher bytes are mostly zero
            data = own.view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([piece // _PIECE], pa.int32()), pa.array([data], pa.binary())], names=["piece", "counts"])


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel().astype(np.int64) for c in table.column("counts").to_pylist())
    level = np.minimum(255, np.floor(8 * np.log2(total + 1))).astype(np.uint8)
    return pa.table({"piece": table.column("piece").slice(0, 1), "level": pa.array([level.tobytes()], pa.binary()), "runs": pa.array([int(total.sum())], pa.int64())})


def frequencies(norms: DataFrame, width: int, bits: int) -> tuple[np.ndarray, int]:
    """Eight times the logarithm of how often runs occur, by the low ``bits`` of their hash, one byte
    each, and how many runs there are; from all rows of ``norms(norm)``."""
    tasks = 4 * norms.sparkSession.sparkContext.defaultParallelism
    counted = norms.coalesce(tasks).mapInArrow(lambda it: _count(it, width, bits), "piece int, counts binary")
    summed = counted.groupBy("piece").applyInArrow(_sum_counts, "piece int, level binary, runs long")
    levels, runs = np.zeros(1 << bits, np.uint8), 0
    for r in summed.collect():  # 2^bits bytes
        own = np.frombuffer(r["level"], np.uint8)
        levels[r["piece"] * _PIECE :][: len(own)] = own
        runs += r["runs"]
    return levels, runs


# --- lists -----------------------------------------------------------------------------------


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row a bucket with the arrays of its rows."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[first, len(bucket)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first].astype(np.int32)), *[pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns.values()]],
        names=["bucket", *columns],
    )


def _unpacked(batches: list[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    table = pa.Table.from_batches(batches)
    return [np.concatenate([c.flatten().to_numpy() for c in table.column(name).chunks]) for name in names]


def short_prefix(n: np.ndarray, t: float, slack: int) -> np.ndarray:
    """How many of ``n`` runs have short lists: all but the ``T - 1 - slack`` most frequent."""
    return np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + 1 + slack)


_LISTS = ["run", "part", "d", "n", "left"]


def _postings(
    batches: Iterator[pa.RecordBatch], width: int, t: float, slack: int, buckets: int, hot: int, levels: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """(d, norm) -> one row a bucket: run, part of its list (0: the list is whole; 2s: the larger texts
    of part s; 2s + 1: smaller ones for part s), text, its number of runs, and those left from here on."""
    seen: set[int] = set()
    low = np.uint64(len(levels) - 1)
    for batch in batches:
        texts, ids = batch.column("norm").to_pylist(), batch.column("d").to_numpy()
        fresh = []
        for i, key in enumerate(zip(ids.tolist(), map(len, texts), map(hash, texts), strict=True)):
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                fresh.append(i)
        texts, ids = [texts[i] for i in fresh], ids[fresh]
        for lo, hi in _chunks(texts):
            doc, h = _hashed(texts[lo:hi], width)
            x = doc << np.uint64(8 + _HASH) | levels[(h & low).astype(np.int64)].astype(np.uint64) << np.uint64(_HASH) | h
            x.sort()
            x = x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
            doc = (x >> np.uint64(8 + _HASH)).astype(np.int64)
            n = np.bincount(doc, minlength=hi - lo)
            place = np.arange(len(x)) - (np.cumsum(n) - n)[doc]
            short = place < short_prefix(n, t, slack)[doc]
            x, doc, place = x[short], doc[short], place[short]
            run = ((x & np.uint64((1 << _HASH) - 1)) >> np.uint64(_HASH - 32)).astype(np.uint32).view(np.int32)
            level = ((x >> np.uint64(_HASH)) & np.uint64(255)).astype(np.float64)
            parts = np.maximum(1, np.ceil(2.0 ** (level / 8) / hot)).astype(np.int64)
            own = ids[lo:hi][doc]
            part = np.where(parts > 1, 2 + 2 * (own.astype(np.int64) % parts), 0)
            # the smaller text of a pair must be in every part
            many = np.flatnonzero(parts > 1)
            again = np.repeat(many, parts[many])
            number = np.arange(len(again)) - np.repeat(np.cumsum(parts[many]) - parts[many], parts[many])
            at = np.r_[np.arange(len(x)), again]
            part = np.r_[part, 3 + 2 * number].astype(np.int32)
            bucket = (run[at].astype(np.int64) * 0x9E3779B1 + (part // 2).astype(np.int64) * 0x85EBCA6B >> 7) % buckets
            yield _packed(bucket, dict(zip(_LISTS, (run[at], part, own[at], n[doc][at].astype(np.int32), (n[doc] - place)[at].astype(np.int32)), strict=True)))


def merged(
    run: np.ndarray, part: np.ndarray, d: np.ndarray, n: np.ndarray, left: np.ndarray, t: float, slack: int, block: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, count): the pairs that meet in the given lists, as two ids of 32 bits in one number, and
    how often they do. Pairs whose overlap can't reach ``t`` are left out; see the module text."""
    list_no = run.astype(np.int64) << 32 | part.astype(np.int64) // 2
    order = np.lexsort((d, n, list_no))
    list_no, part, d, n, left = list_no[order], part[order] % 2 + 2 * (part[order] == 0), d[order].view(np.uint32).astype(np.uint64), n[order].astype(np.int64), left[order].astype(np.int64)
    if not len(d):
        return
    # copies of a text from several tasks
    new = np.r_[True, (list_no[1:] != list_no[:-1]) | (d[1:] != d[:-1]) | (n[1:] != n[:-1]) | (part[1:] != part[:-1])]
    list_no, part, d, n, left = list_no[new], part[new], d[new], n[new], left[new]
    number = np.cumsum(np.r_[0, (list_no[1:] != list_no[:-1]).astype(np.int64)])
    span = n.max() + 2
    small = np.flatnonzero(part > 0)  # as the smaller text; whole lists are both
    place = (number * span + n)[small]
    large = np.flatnonzero(part != 1)
    # overlap <= slack + left, and it must be t / (1 + t) of both sizes
    most = np.floor((slack + left[large]) * (1 + t) / t - n[large] + 1e-6).astype(np.int64)
    lo = np.searchsorted(place, number[large] * span + np.ceil(t * n[large] - 1e-9).astype(np.int64), "left")
    hi = np.searchsorted(place, number[large] * span + np.clip(most, -1, n[large]), "right")
    reach = np.maximum(hi - lo, 0)
    some = reach > 0
    large, lo, reach = large[some], lo[some], reach[some]
    work = np.cumsum(reach)
    at = 0
    while at < len(large):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + block, "right")))
        own = reach[at:to]
        a = np.repeat(large[at:to], own)
        b = small[np.repeat(lo[at:to], own) + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)]
        at = to
        need = np.ceil(t / (1 + t) * (n[a] + n[b]) - 1e-9).astype(np.int64)
        fit = (slack + left[b] >= need) & ((n[b] < n[a]) | (d[b] < d[a])) & (d[a] != d[b])
        a, b, need = a[fit], b[fit], need[fit]
        pair = np.minimum(d[a], d[b]) << np.uint64(32) | np.maximum(d[a], d[b])
        order = np.argsort(pair)
        pair, few = pair[order], (need <= slack)[order]  # such a pair needn't meet slack + 1 times
        if len(pair):
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            yield pair[first].view(np.int64), np.add.reduceat(np.where(few, slack + 1, 1), first)


def _merge(batches: Iterator[pa.RecordBatch], t: float, slack: int, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if got:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for found in merged(*_unpacked(got, _LISTS), t, slack, block):
            kept.append(found)
            if sum(len(p) for p, _ in kept) > 4 * block:
                yield _pairs_of(kept, slack, buckets)
                kept = []
        if kept:
            yield _pairs_of(kept, slack, buckets)


def _added(kept: list[tuple[np.ndarray, np.ndarray]], slack: int) -> tuple[np.ndarray, np.ndarray]:
    pair, count = (np.concatenate(c) for c in zip(*kept, strict=True))
    order = np.argsort(pair, kind="stable")
    pair, count = pair[order], count[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    return pair[first], np.minimum(np.add.reduceat(count, first), slack + 1)


def _pairs_of(kept: list[tuple[np.ndarray, np.ndarray]], slack: int, buckets: int) -> pa.RecordBatch:
    pair, count = _added(kept, slack)
    return _packed((pair * 0x9E3779B1 >> 9) % buckets, {"pair": pair, "met": count.astype(np.int32)})


def _enough(batches: Iterator[pa.RecordBatch], slack: int) -> Iterator[pa.RecordBatch]:
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            kept.append(tuple(_unpacked([batch], ["pair", "met"])))
            if sum(len(p) for p, _ in kept[1:]) > BLOCK:
                kept = [_added(kept, slack)]
    if kept:
        pair, count = _added(kept, slack)
        pair = pair[count > slack].view(np.uint64)
        low = (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array((pair >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(low)], names=["a", "b"])


# --- probing ---------------------------------------------------------------------------------


def resemblance(a: str, b: str, width: int = WIDTH) -> float:
    """Jaccard of the sets of runs of two normalised texts."""
    x, y = ({s[i : i + width] for i in range(len(s) - width + 1)} for s in (a, b))
    return len(x & y) / len(x | y) if x or y else 0.0


def _distinct(texts: list[str], width: int) -> np.ndarray:
    doc, h = _hashed(texts, width)
    x = doc << np.uint64(8 + _HASH) | h
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _probe(batches: Iterator[pa.RecordBatch], t: float, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts_a, texts_b = batch.column("norm_a").to_pylist(), batch.column("norm_b").to_pylist()
        share = np.zeros(len(texts_a))
        for lo, hi in _chunks([a if len(a) > len(b) else b for a, b in zip(texts_a, texts_b, strict=True)], 1_000_000):
            a, b = _distinct(texts_a[lo:hi], width), _distinct(texts_b[lo:hi], width)
            found = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
            shift = np.uint64(8 + _HASH)
            both = np.bincount((a[found] >> shift).astype(np.int64), minlength=hi - lo)
            size = [np.bincount((x >> shift).astype(np.int64), minlength=hi - lo) for x in (a, b)]
            share[lo:hi] = both / np.maximum(size[0] + size[1] - both, 1)
        out = batch.select(["key_a", "key_b"]).append_column("resemblance", pa.array(share))
        yield out.filter(pa.array(share >= t - 1e-12))


def near_duplicates(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    least: int = LEAST,
    slack: int = SLACK,
    block: int = BLOCK,
    list_rows: int = LIST_ROWS,
    hot: int = HOT,
) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: members(id, key) has every row that takes part, ``key`` naming its
    class of equal normalised texts; links(key_a, key_b, resemblance) has every pair of classes
    that reaches ``threshold``, with ``key_a < key_b``.

    Null ids, null, empty and short texts take no part; equal texts share a key and are never
    compared; rows repeated under one id appear as often as they occur; an empty table gives two
    empty results. Extra columns of any name are ignored. ``threshold`` must be in (0.5, 1].
    Texts of any length are taken whole; ``least`` must be at least ``width``. ``block`` pairs are
    merged at once, a bucket has about ``list_rows`` entries; neither they nor ``slack`` nor
    ``hot`` change the result.
    """
    if not (0.5 < threshold <= 1 and least >= width):
        raise ValueError("threshold must be in (0.5, 1] and least at least width")
    base = _normal(df, id_col, text_col, least)
    keys = written(base.select("id", F.unhex(F.md5("norm")).alias("key"), _short_name()), "p1-keys")
    # about as many counters as there are runs, within bounds of memory (16 MB to 64 MB a task)
    bits = int(np.clip(np.ceil(np.log2(max(keys.count(), 1) * 32)), 20, 26))
    levels, runs = frequencies(base.select("norm"), width, bits)
    buckets = max(FEWEST, -(-int(runs * (1 - threshold) * 1.1) // list_rows))
    shared = df.sparkSession.sparkContext.broadcast(levels)  # 2^bits bytes
    lists = base.select(_short_name(), "norm").mapInArrow(
        lambda it: _postings(it, width, threshold, slack, buckets, hot, shared.value),
        "bucket int, run array<int>, part array<int>, d array<int>, n array<int>, left array<int>",
    )
    met = lists.repartitionById(buckets, F.col("bucket")).mapInArrow(
        lambda it: _merge(it, threshold, slack, block, buckets), "bucket int, pair array<long>, met array<int>"
    )
    pairs = met.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda it: _enough(it, slack), "a int, b int")
    # different texts whose 32 bits are the same were one in the lists
    same = keys.groupBy("d").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select(F.col("d").alias("a"), F.col("d").alias("b"))
    pairs = written(pairs.union(same), "p1-pairs")
    # the text of one row of each class that is in a pair
    wanted = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct()
    reps = written(
        keys.join(wanted, "d", "left_semi").groupBy("key").agg(F.min("id").alias("id"), F.first("d").alias("d")), "p1-reps"
    )
    # an id may come again with another text, which then is not of the class
    own = base.join(reps, "id").where(F.unhex(F.md5("norm")) == F.col("key"))
    texts = own.dropDuplicates(["key"]).select("key", "d", "norm")
    links = (
        pairs.join(texts.select(F.col("d").alias("a"), F.col("key").alias("x"), F.col("norm").alias("norm_x")), "a")
        .join(texts.select(F.col("d").alias("b"), F.col("key").alias("y"), F.col("norm").alias("norm_y")), "b")
        .where("a <> b OR x < y")
        .select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), F.col("norm_x").alias("norm_a"), F.col("norm_y").alias("norm_b"))
        .mapInArrow(lambda it: _probe(it, threshold, width), "key_a binary, key_b binary, resemblance double")
    )
    return keys.select("id", "key"), links


def row_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of rows (id_a < id_b): rows of linked classes, and rows of one class. A class of m
    equal texts gives all its m * (m - 1) / 2 pairs, since that is what is asked for."""
    a = members.select(F.col("id").alias("x"), F.col("key").alias("key_a"))
    b = members.select(F.col("id").alias("y"), F.col("key").alias("key_b"))
    between = links.join(a, "key_a").join(b, "key_b").select("x", "y")
    several = members.groupBy("key").count().where("count > 1").select("key")
    dup = members.join(several, "key", "left_semi")
    within = (
        dup.select("key", F.col("id").alias("x")).join(dup.select("key", F.col("id").alias("y")), "key").where("x < y")
    ).select("x", "y")
    return (
        between.unionByName(within)
        .where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the least node that can be reached.

    Each round every node takes the least label among its neighbours and then its label's label,
    so the rounds grow with the logarithm of the longest chain; each round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "cc")
    for _ in range(most):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = written(
            step.join(hop, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("next"), "root"), "cc"
        )
        moved = after.where("next <> root").limit(1).count()
        labels = after.select("node", F.col("next").alias("root"))
        if not moved:
            return labels
    raise RuntimeError(f"labels still moved after {most} rounds")


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_links, group_id): one row per member. ``class_id`` is the least id with an
    equal text, ``n_links`` the number of other classes it resembles, ``group_id`` the least id
    that links lead to."""
    links = written(links.select("key_a", "key_b"), "p1-links")
    reps = members.groupBy("key").agg(F.min("id").alias("class_id"))
    named = (
        links.join(reps.select(F.col("key").alias("key_a"), F.col("class_id").alias("a")), "key_a")
        .join(reps.select(F.col("key").alias("key_b"), F.col("class_id").alias("b")), "key_b")
        .select("a", "b")
    )
    named = written(named, "p1-named")
    degree = named.select(F.col("a").alias("class_id")).union(named.select("b")).groupBy("class_id").agg(
        F.count("*").alias("n_links")
    )
    roots = components(named).select(F.col("node").alias("class_id"), F.col("root").alias("group_id"))
    return (
        members.join(reps, "key")
        .join(degree, "class_id", "left")
        .join(roots, "class_id", "left")
        .select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
    )
