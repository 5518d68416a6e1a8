"""Problem 5: most similar vectors, by additive quantisation.

``fit`` learns ``levels`` full-dimensional codebooks on residuals of a bounded sample.
``encode`` finds each vector's codes by beam search and stores the norm of what is left over,
so that a vector ``x``, its reconstruction ``r`` and a query ``q`` obey
``|q - r| - |x - r| <= |q - x|``. Queries are scored against codes by lookup tables (inner
products of the query with all codewords), and what the tables let through is ranked again by
the exact cosine in the same task.

Two searches use this:

* ``neighbours_above``: all rows against all rows, down to a least cosine. A vector is stored in
  the ``base_cells`` cells its beam likes best (a cell is a code of the first two codebooks, at every
  size) and asked for in ``query_cells``. Within a cell the bound above drops only what can't reach
  the least cosine. Cells over ``cell_rows`` are split into blocks on either side.
* ``nearest``: a stated query set against every row, in blocks, with ``depth`` rows of every
  block ranked again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.storage import written

WIDTH, K = 64, 10
LEVELS, WORDS, BEAM, SAMPLE = 8, 256, 4, 16_384
QUERY_CELLS, BASE_CELLS, CELL_DEPTH, CELL_ROWS = 5, 2, 2, 8_192
PACK, QUERY_BLOCK, DEPTH, NEAR_ROWS = 8_192, 1_024, 96, 200_000
TASK_ROWS, BUFFER, PAIRS, MATRIX = 25_000, 20_000, 400_000, 16_384  # rows of a task and held, pairs at once and that make a cell a matrix


@dataclass(frozen=True)
class Codebooks:
    """(levels, words, width) codewords."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, beam, levels), best first, and the residuals of the best (n, width)."""
        levels, k, width = self.words.shape
        n = len(x)
        residual, codes, cost = x[:, None, :], np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1), np.float32)
        for c in self.words:
            # |r - c|^2 for every residual in the beam and every codeword
            d = (residual**2).sum(2, keepdims=True) + (c**2).sum(1) - 2 * (residual @ c.T)
            d = d.reshape(n, -1)
            b = min(beam, d.shape[1])
            top = np.argpartition(d, b - 1, axis=1)[:, :b] if b < d.shape[1] else np.tile(np.arange(b), (n, 1))
            cost = np.take_along_axis(d, top, 1)
            order = np.argsort(cost, axis=1, kind="stable")
            top, cost = np.take_along_axis(top, order, 1), np.take_along_axis(cost, order, 1)
            parent, word = np.divmod(top, k)
            residual = np.take_along_axis(residual, parent[:, :, None], 1) - c[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        return codes, residual[:, 0]

    def cells(self, x: np.ndarray, depth: int, most: int) -> np.ndarray:
        """The ``most`` best cells of each vector (n, most): prefixes of ``depth`` codes."""
        codes, _ = Codebooks(self.words[:depth]).encode(x, most)
        cell = np.zeros(codes.shape[:2], np.int64)
        for level in range(depth):
            cell = cell * 256 + codes[:, :, level]
        return cell

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(c[codes[:, m]] for m, c in enumerate(self.words))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Lookup tables (levels, words, n) of inner products."""
        return np.einsum("mkd,nd->mkn", self.words, q, optimize=True)

    @staticmethod
    def look_up(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products (codes, queries) of the coded vectors with the queries."""
        out = tables[0][codes[:, 0]].copy()
        for m in range(1, len(tables)):
            out += tables[m][codes[:, m]]
        return out


def fit(sample: np.ndarray, levels: int = LEVELS, words: int = WORDS, rounds: int = 8, seed: int = 7) -> Codebooks:
    rng = np.random.default_rng(seed)
    k = int(max(1, min(words, len(sample) // 4)))
    left, books = sample.astype(np.float32), []
    for _ in range(levels):
        c = left[rng.choice(len(left), k, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin((c**2).sum(1) - 2 * (left @ c.T), axis=1)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, near, left)
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        near = np.argmin((c**2).sum(1) - 2 * (left @ c.T), axis=1)
        left = left - c[near]
        books.append(c)
    return Codebooks(np.stack(books).astype(np.float32))


def usable(df: DataFrame, id_col: str, vec_col: str, width: int = WIDTH) -> DataFrame:
    """(id, vec): without NULL, of the width, finite and not zero."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
        .where(F.col("id").isNotNull() & (F.size("vec") == width))
        .where(finite & F.exists("vec", lambda v: v != 0))
    )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def _unit(x: np.ndarray, kind: type = np.float32) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(kind)


def sampled(vectors: DataFrame, of: int, size: int = SAMPLE) -> np.ndarray:
    """At most ``size`` unit vectors of a table of ``of`` rows, chosen by a hash of the id; a share about
    twice as large is taken where the rows are, before they are put in order."""
    share = F.pmod(F.xxhash64("id", F.lit("share")), F.lit(1_000_000)) < int(min(1.0, 2 * size / max(of, 1)) * 1_000_000)
    rows = vectors.where(share).orderBy(F.xxhash64("id"), "id").limit(size).select("vec").toArrow()
    return _unit(_matrix(rows.column("vec"), len(rows.column("vec")[0]))) if rows.num_rows else np.zeros((0, WIDTH), np.float32)


def _placed(batches: Iterator[pa.RecordBatch], books: Codebooks, depth: int, base_cells: int, query_cells: int, width: int):
    for batch in batches:
        ids_all, x_all = batch.column("id").to_numpy(), _matrix(batch.column("vec"), width)
        for lo in range(0, len(ids_all), 2048):
            ids, raw = ids_all[lo : lo + 2048], x_all[lo : lo + 2048]
            x = _unit(raw)
            codes, rest = books.encode(x)
            cell = books.cells(x, depth, max(base_cells, query_cells))
            coded, norm = codes[:, 0], np.linalg.norm(rest, axis=1)
            for kind, most in ((0, base_cells), (1, query_cells)):
                m = min(most, cell.shape[1])
                who = np.repeat(np.arange(len(ids)), m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell[:, :m].ravel()),
                        pa.array(np.full(len(who), kind, np.int32)),
                        pa.array(ids[who]),
                        pa.array([v.tobytes() for v in raw[who]], pa.binary()),
                        pa.array([c.tobytes() for c in coded[who]] if kind == 0 else [None] * len(who), pa.binary()),
                        pa.array(norm[who].astype(np.float32)),
                    ],
                    names=["cell", "kind", "id", "vec", "codes", "rest"],
                )


def _bytes(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _scored_cells(rows: pa.Table, books: Codebooks, least: float, k: int, width: int) -> pa.RecordBatch:
    """The ``k`` best of each cell's rows for each of its queries, from whole cells in order of
    (cell, block, part, kind)."""
    at = [rows.column(c).to_numpy() for c in ("cell", "block", "part")]
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in at], axis=0)]
    group = np.cumsum(new) - 1
    kind, ids = rows.column("kind").to_numpy(), rows.column("id").to_numpy()
    raw = _bytes(rows.column("vec"), np.float32, width)
    base, ask = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    count = np.bincount(group[base], minlength=group[-1] + 1)
    first = np.cumsum(count) - count  # of each group's stored rows
    ask = ask[count[group[ask]] > 0]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(base) and len(ask):
        bx, qx = _unit(raw[base], np.float64), _unit(raw[ask], np.float64)
        codes = _bytes(rows.column("codes").filter(pa.array(kind == 0)), np.uint8, len(books.words)).astype(np.int64)
        norm = (books.decode(codes) ** 2).sum(1)
        # |q - r| <= |q - x| + |x - r|, so products below this can't reach the least cosine
        bound = (1 + norm - (np.sqrt(2 - 2 * least) + rows.column("rest").to_numpy()[base] + 1e-4) ** 2) / 2
        reach = count[group[ask]]
        asked = np.bincount(group[ask], minlength=len(count))
        begin = 0
        while begin < len(ask):
            g = group[ask[begin]]
            if asked[g] * count[g] >= MATRIX:  # one cell, all its rows against some of its queries
                end = min(begin + 512, int(np.searchsorted(group[ask], g, "right")))
                own = slice(first[g], first[g] + count[g])
                est = books.look_up(books.tables(qx[begin:end].astype(np.float32)), codes[own])
                b, a = np.nonzero(est >= bound[own][:, None])
                a, b = a + begin, b + first[g]
            else:  # many small cells
                small = asked[group[ask[begin : begin + 512]]] * reach[begin : begin + 512] < MATRIX
                work = np.cumsum(reach[begin : begin + 512])
                end = begin + max(1, min(int(np.searchsorted(work, PAIRS, "right")), int(np.argmin(small)) if not small.all() else len(small)))
                own = reach[begin:end]
                a = np.repeat(np.arange(begin, end), own)
                b = np.repeat(first[group[ask[begin:end]]] - np.cumsum(own) + own, own) + np.arange(len(a))
                tables = books.tables(qx[begin:end].astype(np.float32))
                est = sum(tables[m][codes[b, m], a - begin] for m in range(len(tables)))
                near = est >= bound[b]
                a, b = a[near], b[near]
            cos = np.einsum("ij,ij->i", bx[b], qx[a])
            keep = (cos >= least) & (ids[base[b]] != ids[ask[a]])
            a, b, cos = a[keep], ids[base[b[keep]]], cos[keep]
            order = np.lexsort((b, -cos, a))
            a, b, cos = a[order], b[order], cos[order]
            top = np.arange(len(a)) - np.searchsorted(a, a) < k
            found.append((ids[ask[a[top]]], b[top], cos[top]))
            begin = end
    cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], names=["id", "other", "cosine"]
    )


def _search_cells(batches: Iterator[pa.RecordBatch], books: Codebooks, least: float, k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of cells, cut where a cell ends; no more is held than ``BUFFER`` rows and one cell."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < BUFFER:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        at = [rows.column(c).to_numpy() for c in ("cell", "block", "part")]
        last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in at], axis=0))
        if not len(last):
            continue
        whole = int(last[-1]) + 1
        yield _scored_cells(rows.slice(0, whole), books, least, k, width)
        held = rows.slice(whole).to_batches()
        n = rows.num_rows - whole
    if n:
        yield _scored_cells(pa.Table.from_batches(held).combine_chunks(), books, least, k, width)


def neighbours_above(
    df: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    least: float = 0.92,
    k: int = K,
    width: int = WIDTH,
    query_cells: int = QUERY_CELLS,
    base_cells: int = BASE_CELLS,
    cell_depth: int = CELL_DEPTH,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(id, other, cosine, rank): of the ``k`` most similar other rows of each row those with a
    cosine of at least ``least``; ties go to the lesser id.

    NULL ids and vectors that are NULL, of another width, zero or not finite take no part. Rows
    with equal vectors are one while searching and each other's neighbours after. An empty table
    gives an empty result; extra columns are ignored; ids are taken to be unique. The index is
    fitted on at most ``SAMPLE`` vectors and holds every row; measured recall is in the README.
    """
    # two hashes, 96 bits, stand for a vector
    vectors = usable(df, id_col, vec_col, width).withColumn("class", F.struct(F.xxhash64("vec").alias("x"), F.hash("vec").alias("y")))
    members = vectors.select("id", "class")
    reps = members.groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    sample = sampled(vectors, df.count())
    empty = df.sparkSession.createDataFrame([], "id long, other long, cosine double, rank int")
    if not len(sample):
        return empty
    books = fit(sample)
    # all rows of a class but the one that stands for it
    other = members.join(reps.where("n > 1").select("class", F.col("id").alias("rep")), "class").where("id <> rep").select("id")
    distinct = vectors.join(other, "id", "left_anti")
    placed = written(
        distinct.select("id", "vec").mapInArrow(
            lambda it: _placed(it, books, cell_depth, base_cells, query_cells, width),
            "cell long, kind int, id long, vec binary, codes binary, rest float",
        ),
        "p5-cells",
    )
    # at most 256^depth rows, so of bounded size
    blocks = placed.groupBy("cell").agg(
        F.ceil(F.count_if(F.col("kind") == 0) / cell_rows).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("kind") == 1) / cell_rows).cast("int").alias("parts")
    )
    spot = F.pmod(F.xxhash64("id"), F.when(F.col("kind") == 0, F.col("blocks")).otherwise(F.col("parts"))).cast("int")
    every = F.sequence(F.lit(0), F.when(F.col("kind") == 0, F.col("parts")).otherwise(F.col("blocks")) - 1)
    stored = F.col("kind") == 0
    spread = (
        placed.join(F.broadcast(blocks.where("blocks > 0 AND parts > 0")), "cell")
        .withColumn("spot", spot)
        .withColumn("copy", F.explode(every))
        .withColumn("block", F.when(stored, F.col("spot")).otherwise(F.col("copy")))
        .withColumn("part", F.when(stored, F.col("copy")).otherwise(F.col("spot")))
        .select("cell", "block", "part", "kind", "id", "vec", "codes", "rest")
    )
    tasks = max(1, -(-placed.count() // TASK_ROWS))
    found = (
        spread.repartition(tasks, "cell", "block", "part")
        .sortWithinPartitions("cell", "block", "part", "kind")
        .mapInArrow(lambda it: _search_cells(it, books, least, k, width), "id long, other long, cosine double")
    )
    best = found.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    return _spread_copies(best, members, reps, k, least)


def _spread_copies(best: DataFrame, members: DataFrame, reps: DataFrame, k: int, least: float) -> DataFrame:
    """From neighbours of classes to neighbours of rows: ``k + 1`` least ids of a class suffice."""
    by_class = Window.partitionBy("class").orderBy("id")
    several = members.join(reps.where("n > 1").select("class", F.col("id").alias("rep")), "class")
    first = several.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    targets = first.select(F.col("rep").alias("other"), F.col("id").alias("target"))
    wide = (
        best.join(targets, "other", "left")
        .select("id", F.coalesce("target", "other").alias("other"), "cosine")
    )
    askers = several.select(F.col("rep").alias("id"), F.col("id").alias("asker"))
    outer = wide.join(askers, "id", "left").select(F.coalesce("asker", "id").alias("id"), "other", "cosine")
    inner = (
        several.select("class", "id")
        .join(first.select("class", F.col("id").alias("other")), "class")
        .where("id <> other")
        .select("id", "other", F.lit(1.0).alias("cosine"))
    )
    ranked = outer.unionByName(inner).withColumn(
        "rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    )
    return ranked.where((F.col("rank") <= k) & (F.col("cosine") >= least))


def _packs(batches: Iterator[pa.RecordBatch], books: Codebooks | None, size: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows packed into blocks: ids, raw vectors, and codes if there are ``books``."""
    held: list[pa.RecordBatch] = []

    def packed(rows: pa.Table) -> pa.RecordBatch:
        ids, x = rows.column("id").to_numpy(), _matrix(rows.column("vec"), width)
        arrays = [ids, x]
        if books is not None:
            arrays.append(np.concatenate([books.encode(_unit(x[s : s + 2048]))[0][:, 0] for s in range(0, len(x), 2048)]))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in arrays], names=["ids", "vecs", "codes"][: len(arrays)])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            rows = pa.Table.from_batches(held).combine_chunks()
            whole = rows.num_rows // size * size
            for lo in range(0, whole, size):
                yield packed(rows.slice(lo, size).combine_chunks())
            held = rows.slice(whole).to_batches()
    if sum(b.num_rows for b in held):
        yield packed(pa.Table.from_batches(held).combine_chunks())


def _score(batches: Iterator[pa.RecordBatch], books: Codebooks, k: int, depth: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bid, bx = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"], np.float32).reshape(-1, width)
            codes = np.frombuffer(row["codes"], np.uint8).reshape(len(bid), -1)
            qid, qx = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vecs"], np.float32).reshape(-1, width)
            bx, qx = _unit(bx, np.float64), _unit(qx, np.float64)
            norm = (books.decode(codes) ** 2).sum(1)  # stored norms turn products into distances
            top = min(depth, len(bid))
            for lo in range(0, len(qid), 128):
                q = qx[lo : lo + 128]
                far = norm[:, None] - 2 * books.look_up(books.tables(q.astype(np.float32)), codes)
                pick = np.argpartition(far, top - 1, axis=0)[:top] if top < len(bid) else np.tile(np.arange(top)[:, None], (1, len(q)))
                cos = np.einsum("tnd,nd->tn", bx[pick], q)
                cos[bid[pick] == qid[lo : lo + 128]] = -np.inf
                n = np.tile(np.arange(len(q)), (top, 1)).ravel()
                b, cos = pick.ravel(), cos.ravel()
                order = np.lexsort((bid[b], -cos, n))
                n, b, cos = n[order], b[order], cos[order]
                keep = (np.arange(len(n)) - np.searchsorted(n, n) < k) & np.isfinite(cos)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[lo + n[keep]]), pa.array(bid[b[keep]]), pa.array(cos[keep])], names=["id", "other", "cosine"]
                )


def nearest(
    df: DataFrame,
    queries: F.Column,
    id_col: str = "id",
    vec_col: str = "embedding",
    k: int = K,
    width: int = WIDTH,
    depth: int = DEPTH,
    near_rows: int = NEAR_ROWS,
) -> DataFrame:
    """(id, other, cosine, rank): the ``k`` most similar other rows of each row for which
    ``queries`` (a condition on ``id``) holds, against every row, ties to the lesser id.

    The same rows take part as in ``neighbours_above``; fewer than ``k`` others give fewer rows.
    At most ``near_rows`` queries are broadcast (50 MB at 64 floats). The work is the number of rows
    times that of queries.
    """
    vectors = usable(df, id_col, vec_col, width)
    sample = sampled(vectors, df.count())
    if not len(sample):
        return df.sparkSession.createDataFrame([], "id long, other long, cosine double, rank int")
    books = fit(sample)
    packs = written(vectors.mapInArrow(lambda it: _packs(it, books, PACK, width), "ids binary, vecs binary, codes binary"), "p5-packs")
    wanted = vectors.where(queries)
    number = wanted.count()
    # as many queries to a partition as to a block
    asked = written(
        wanted.repartition(max(1, number // QUERY_BLOCK)).mapInArrow(lambda it: _packs(it, None, QUERY_BLOCK, width), "ids binary, vecs binary").select(
            F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")
        ),
        "p5-asked",
    )
    # every block of rows meets every block of the stated queries; few blocks go where the rows are
    found = (
        packs.repartition(df.sparkSession.sparkContext.defaultParallelism * 2)
        .join(F.broadcast(asked) if number <= near_rows else asked, F.lit(True))
        .mapInArrow(lambda it: _score(it, books, k, depth, width), "id long, other long, cosine double")
    )
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
