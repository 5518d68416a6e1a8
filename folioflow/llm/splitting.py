"""Problem 3: splitting oversized items at natural boundaries, by ranges with halos.

An item (a row's text, or a file) is cut into ranges of fixed length. Workers find the
boundaries of their own range, reading a halo on both sides so that none is missed at an edge.
The boundary tables of neighbouring ranges are stitched, each range's chain of cuts is derived
from them alone, piece counts are summed up to here to number the pieces, and pieces are emitted
by offset from the range they start in. No step holds a whole file (``split_files``). A row's text
is one value, cut into its ranges in one pass; the later steps see ranges only.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.storage import written

LIMIT, OVERLAP, RANGE, FILE_RANGE = 500, 80, 16_384, 4_194_304
HALO = 1_200  # more than a piece, its overlap and a heading line

#: How strong a pause is (fixed values).
HARD, CLAUSE, SENTENCE, PARAGRAPH, CHAPTER = 0, 1, 2, 3, 4
_HEADING = (
    r"(?:正文[ 　]*)?第[0-9０-９零〇一二两三四五六七八九十百千万]{1,12}[章节節卷回部篇集話话][^\n。！？；]{0,48}"
    r"|(?:楔子|序章|序言|引子|尾声|后记|番外[^\n。！？；]{0,40})|(?:Chapter|CHAPTER)\s+\d+[^\n]{0,60}"
)
_PAUSE = re.compile(
    rf"(?P<chapter>(?:(?<=\n)|\A)[ \t　]*(?:{_HEADING})[ \t　]*(?=\r?\n|\Z))"
    r"|(?P<paragraph>[ \t　]*(?:\r\n|\n|\r)\s*)"
    r"|(?P<sentence>(?:[。！？；!?;…‥।؟۔]+|\.(?=\s))[”’」』）】》)\]\"']*[ \t　]*)"
    r"|(?P<clause>[，、：,:—–]+[”’」』]*[ \t　]*)"
    r"|(?P<space>[ \t　]+)"
)


def pauses(text: str) -> list[tuple[int, int]]:
    """(place, strength) of every place in ``text`` where a piece may end or begin."""
    found: dict[int, int] = {}
    for m in _PAUSE.finditer(text):
        kind = m.lastgroup
        if kind == "chapter":
            place, strength = m.start(), CHAPTER
        else:
            place, strength = m.end(), {"paragraph": PARAGRAPH, "sentence": SENTENCE}.get(kind, CLAUSE)
        if 0 < place < len(text):
            found[place] = max(strength, found.get(place, 0))
    return sorted(found.items())


def headings(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0].strip()) for m in _PAUSE.finditer(text) if m.lastgroup == "chapter"]


def block_start(places: np.ndarray, strength: np.ndarray, start: int, window: int) -> int:
    """Where a range's chain begins: the strongest, then first pause in its first ``window``."""
    if start == 0:
        return 0
    near = (places >= start) & (places < start + window)
    if not near.any():
        return start
    return int(places[near][np.argmax(strength[near])])


def chain(places: np.ndarray, strength: np.ndarray, start: int, end: int, limit: int, overlap: int, first: bool) -> list[tuple[int, int]]:
    """Pieces [a, b) that cover [start, end), each at most ``limit`` long and repeating at most
    ``overlap`` of the one before; unless ``first`` the chain goes on from an earlier one."""
    out: list[tuple[int, int]] = []
    cursor = start

    def begin(at: int) -> int:
        near = places[(places >= at - overlap) & (places < at)]
        if strength.size and at in places and strength[np.searchsorted(places, at)] == CHAPTER:
            return at  # nothing is repeated across a heading
        return int(near[0]) if len(near) else max(0, at - overlap)

    while cursor < end:
        a = cursor if first and cursor == start else begin(cursor)
        if end - a <= limit:
            lo = np.searchsorted(places, cursor, "right")
            hi = np.searchsorted(places, end)
            strong = lo + np.flatnonzero(strength[lo:hi] == CHAPTER)
            if not len(strong):
                out.append((a, end))
                break
        low, high = cursor, min(a + limit, end)
        lo, hi = np.searchsorted(places, low, "right"), np.searchsorted(places, high, "right")
        place, power = places[lo:hi], strength[lo:hi]
        chapter = place[power == CHAPTER]
        far = place >= low + (high - low) // 2  # a weak pause shouldn't make a short piece
        if len(chapter):
            b = int(chapter[0])
        elif far.any():
            best = power[far].max()
            b = int(place[far][power[far] == best][-1])
        elif len(place):
            b = int(place[power == power.max()][-1])
        else:
            b = high
        out.append((a, b))
        cursor = b
    return out


def _detect(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Boundary tables: places of the own range, in the item's offsets."""
    for batch in batches:
        places, strengths = [], []
        for no, base, text in zip(*(batch.column(c).to_pylist() for c in ("range_no", "base", "slice")), strict=True):
            own = [(base + p, s) for p, s in pauses(text) if no * size <= base + p < (no + 1) * size]
            places.append([p for p, _ in own])
            strengths.append([s for _, s in own])
        yield batch.select(["item", "range_no", "length"]).append_column("places", pa.array(places, pa.list_(pa.int64()))).append_column(
            "strengths", pa.array(strengths, pa.list_(pa.int32()))
        )


def _own_ends(found: DataFrame, size: int) -> DataFrame:
    """Adds the ends [low, high) of every range of ``size``."""
    low = F.col("range_no") * size
    return found.withColumn("low", low).withColumn("high", F.least(low + size, "length"))


def _cut(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends = [], []
        for r in batch.to_pylist():
            places = np.array((r["before"] or []) + r["places"] + (r["after"] or []), np.int64)
            strength = np.array((r["before_s"] or []) + r["strengths"] + (r["after_s"] or []), np.int64)
            start = block_start(places, strength, r["low"], limit)
            end = r["length"] if r["high"] >= r["length"] else min(block_start(places, strength, r["high"], limit), r["length"])
            cut = chain(places, strength, start, end, limit, overlap, r["low"] == 0) if start < end else []
            starts.append([a for a, _ in cut])
            ends.append([b for _, b in cut])
        yield batch.select(["item", "range_no", "length"]).append_column("starts", pa.array(starts, pa.list_(pa.int64()))).append_column(
            "ends", pa.array(ends, pa.list_(pa.int64()))
        )


def cut_boundaries(found: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(item, length, range_no, base_no, starts, ends): the pieces that begin in each range, the first
    of them numbered ``base_no``, from ``found(item, range_no, length, low, high, places, strengths)``."""
    several = found.where("low > 0 OR high < length")
    near = F.size(F.filter("places", lambda p: p < F.col("low") + limit))
    head = several.select(
        "item", (F.col("range_no") - 1).alias("range_no"),
        F.slice("places", F.lit(1), near).alias("after"), F.slice("strengths", F.lit(1), near).alias("after_s"),
    )
    late = F.size(F.filter("places", lambda p: p >= F.col("high") - limit))
    tail = several.select(
        "item", (F.col("range_no") + 1).alias("range_no"),
        F.slice("places", F.size("places") - late + 1, late).alias("before"),
        F.slice("strengths", F.size("strengths") - late + 1, late).alias("before_s"),
    )
    stitched = found.join(head, ["item", "range_no"], "left").join(tail, ["item", "range_no"], "left")
    cut = stitched.mapInArrow(
        lambda it: _cut(it, limit, overlap), "item long, range_no long, length long, starts array<long>, ends array<long>"
    )
    to_here = Window.partitionBy("item").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("base_no", F.coalesce(F.sum(F.size("starts")).over(to_here), F.lit(0)))


def cut_ranges(ranges: DataFrame, limit: int, overlap: int, size: int) -> DataFrame:
    """(item, length, range_no, piece_no, start, end) from ``ranges(item, range_no, length, base, slice)``."""
    found = written(
        ranges.mapInArrow(lambda it: _detect(it, size), "item long, range_no long, length long, places array<long>, strengths array<int>"),
        "p3-boundaries",
    )
    return cut_boundaries(_own_ends(found, size), limit, overlap).select(
        "item", "length", "range_no", "base_no", F.posexplode(F.arrays_zip("starts", "ends")).alias("k", "p")
    ).select(
        "item", "length", "range_no", (F.col("base_no") + F.col("k")).cast("int").alias("piece_no"),
        F.col("p.starts").alias("start"), F.col("p.ends").alias("end"),
    )


def _ranges_of(batches: Iterator[pa.RecordBatch], size: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of every text in one pass over it, at most about ``most`` code points at once."""
    names = ["item", "range_no", "length", "base", "slice"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    rows: list[tuple] = []
    held = 0

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            for no in range(-(-len(text) // size)):
                base = max(0, no * size - HALO)
                rows.append((item, no, len(text), base, text[base : base + size + 2 * HALO]))
                held += len(rows[-1][4])
                if held >= most:
                    yield batch_of()
                    rows, held = [], 0
    if rows:
        yield batch_of()


def _row_ranges(rows: DataFrame, size: int) -> DataFrame:
    """(item, range_no, length, base, slice): ranges with halos of ``rows(item, text)``."""
    return rows.mapInArrow(lambda it: _ranges_of(it, size), "item long, range_no long, length long, base long, slice string")


def split_rows(
    df: DataFrame, id_col: str = "id", text_col: str = "text", title_col: str = "chapter_title", keep: tuple[str, ...] = (),
    limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE,
) -> DataFrame:
    """(id, *keep, piece_no, n_pieces, start, end, chapter_title, text): the pieces of every row
    whose text has more than ``limit`` code points.

    Pieces cover the text without a gap, in order of ``piece_no``, each at most ``limit`` long;
    from the second on they repeat up to ``overlap`` code points of the one before, none across a
    chapter heading. ``chapter_title`` is the last heading line at or before the piece's own part,
    else the row's title without outer blanks (NULL if blank). Rows with a NULL id or text and
    shorter texts have no pieces; the id must be unique; other columns are ignored; an empty table
    gives an empty result. ``limit`` must exceed twice the overlap.
    """
    if not limit > 2 * overlap >= 0:
        raise ValueError("limit must exceed twice the overlap")
    rows = df.select(
        F.col(id_col).cast("long").alias("item"), *[F.col(c) for c in keep], F.col(title_col).cast("string").alias("title"), F.col(text_col).alias("text")
    ).where(F.col("item").isNotNull() & (F.char_length("text") > limit))
    ranges = _row_ranges(rows.select("item", "text"), size)
    cut = cut_ranges(ranges.select("item", "range_no", "length", "base", "slice"), limit, overlap, size)
    n = Window.partitionBy("item")
    cut = cut.withColumn("n_pieces", F.count("*").over(n).cast("int"))
    placed = cut.join(ranges.select("item", "range_no", "base", "slice"), ["item", "range_no"])
    piece = F.substring("slice", (F.col("start") - F.col("base") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    schema = "item long, piece_no int, n_pieces int, start int, end int, text string, heading string"
    made = placed.select(
        "item", "piece_no", "n_pieces", F.col("start").cast("int"), F.col("end").cast("int"), piece.alias("text")
    ).mapInArrow(_first_heading, schema)
    # the last heading that began at or before this piece, also in earlier pieces
    before = Window.partitionBy("item").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.regexp_replace("title", "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$", "")
    titles = rows.select("item", *keep, F.when(title != "", title).alias("title"))
    return (
        made.withColumn("heading", F.last("heading", True).over(before))
        .join(titles, "item")
        .select(F.col("item").alias("id"), *keep, "piece_no", "n_pieces", "start", "end", F.coalesce("heading", "title").alias("chapter_title"), "text")
    )


def _first_heading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece is cut before a heading, so a heading of its own is its first line."""
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            own = headings(text[:200])
            found.append(own[0][1] if own and not text[: own[0][0]].strip() else None)
        yield batch.append_column("heading", pa.array(found, pa.string()))


def _read(path: str, start: int, end: int) -> tuple[int, bytes]:
    """The bytes [start, end) of a file without the rest of a character before them, and their start."""
    start = max(0, start)
    scheme, colon, rest = path.partition(":")
    uri = f"file:///{rest.lstrip('/')}" if scheme == "file" else path
    system, place = FileSystem.from_uri(uri) if colon else (LocalFileSystem(), path)
    with system.open_input_file(place) as f:
        f.seek(start)
        data = f.read(end - start)
    skip = next((i for i, b in enumerate(data[:4]) if b & 0xC0 != 0x80), 0) if start else 0
    return start + skip, data[skip:]


def _characters(data: bytes) -> int:
    """Characters that begin in ``data``: all but UTF-8's continuation bytes."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def _file_ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Reads only the bytes of each range and its halo; lengths and offsets here are bytes, except
    ``chars``, the characters that begin in the range, and ``char_places``, counted from its first."""
    for batch in batches:
        for r in batch.to_pylist():
            low, high = r["range_no"] * size, (r["range_no"] + 1) * size
            base, data = _read(r["path"], low - HALO * 4, high + HALO * 4)
            text = data.decode("utf-8", "ignore")
            before = _characters(data[: max(0, low - base)])
            places, at, offset = [], 0, base
            for p, s in pauses(text):
                offset += len(text[at:p].encode("utf-8"))
                at = p
                if low <= offset < high:
                    places.append((offset, s, p - before))
            yield pa.RecordBatch.from_pylist(
                [{
                    "item": r["item"], "range_no": r["range_no"], "length": r["length"], "places": [p for p, _, _ in places],
                    "strengths": [s for _, s, _ in places], "chars": _characters(data[max(0, low - base) : high - base]), "char_places": [c for _, _, c in places],
                }],
                schema=pa.schema([
                    ("item", pa.int64()), ("range_no", pa.int64()), ("length", pa.int64()), ("places", pa.list_(pa.int64())),
                    ("strengths", pa.list_(pa.int32())), ("chars", pa.int64()), ("char_places", pa.list_(pa.int64())),
                ]),
            )


def file_boundaries(spark: SparkSession, files: DataFrame, size: int = FILE_RANGE) -> DataFrame:
    """Boundary tables (item, range_no, length, places, strengths, chars, char_places) of UTF-8
    ``files(item, path, length)`` on storage that all workers can open; offsets are bytes, but for
    the last column, which counts characters from the range's first. Only ranges are read."""
    ranges = files.where("length > 0").withColumn("range_no", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")))
    return ranges.repartition(spark.sparkContext.defaultParallelism * 4, "item", "range_no").mapInArrow(
        lambda it: _file_ranges(it, size),
        "item long, range_no long, length long, places array<long>, strengths array<int>, chars long, char_places array<long>",
    )


def _file_pieces(batches: Iterator[pa.RecordBatch], size: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The texts of the pieces that begin in each range, read from there."""
    for batch in batches:
        for r in batch.to_pylist():
            if not r["starts"]:
                continue
            low, high = r["range_no"] * size, (r["range_no"] + 1) * size
            base, data = _read(r["path"], low - 8 * limit, high + 8 * limit)
            first = r["low"] - _characters(data[: max(0, low - base)])
            # strict: what is no UTF-8 must not shift or lose characters
            text = codecs.getincrementaldecoder("utf-8")("strict").decode(data, base + len(data) >= r["bytes"])
            cut = [text[a - first : b - first] for a, b in zip(r["starts"], r["ends"], strict=True)]
            for lo in range(0, len(cut), 1_000):
                own = cut[lo : lo + 1_000]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["item"]] * n, pa.int64()), pa.array([r["range_no"]] * n, pa.int64()),
                        pa.array(range(r["base_no"] + lo, r["base_no"] + lo + n), pa.int64()), pa.array(r["starts"][lo : lo + n], pa.int64()),
                        pa.array(r["ends"][lo : lo + n], pa.int64()), pa.array(own, pa.string()),
                    ],
                    names=["item", "range_no", "piece_no", "start", "end", "text"],
                )


def split_files(
    spark: SparkSession, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE
) -> DataFrame:
    """(id, piece_no, n_pieces, start, end, chapter_title, text): the pieces of the UTF-8
    ``files(item, path, length)``, lengths in bytes, on storage that all workers can open.

    As for rows: files of more than ``limit`` code points are cut; ``start``, ``end`` and ``limit``
    count code points; ``chapter_title`` is NULL before the first heading. Ranges are of ``size``
    bytes; a file that is not UTF-8 is an error. The item must be unique.
    """
    if not limit > 2 * overlap >= 0:
        raise ValueError("limit must exceed twice the overlap")
    if size < 8 * limit:
        raise ValueError("a range must hold at least two pieces")
    files = files.select(F.col("item").cast("long").alias("item"), "path", F.col("length").cast("long").alias("length"))
    found = written(file_boundaries(spark, files, size), "p3-file-boundaries")
    to_here = Window.partitionBy("item").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("chars").over(to_here), F.lit(0)).cast("long")
    sizes = found.groupBy("item").agg(F.sum("chars").alias("length"))
    placed = found.select("item", "range_no", "strengths", "chars", "char_places", low.alias("low")).join(sizes.where(F.col("length") > limit), "item")
    placed = placed.select(
        "item", "range_no", "length", "low", (F.col("low") + F.col("chars")).alias("high"),
        F.transform("char_places", lambda p: p + F.col("low")).alias("places"), "strengths",
    )
    cut = written(cut_boundaries(placed, limit, overlap), "p3-file-cuts")
    work = (
        cut.join(placed.select("item", "range_no", "low"), ["item", "range_no"])
        .join(files.select("item", "path", F.col("length").alias("bytes")), "item")
        .repartition(spark.sparkContext.defaultParallelism * 4, "item", "range_no")
    )
    made = written(
        work.mapInArrow(lambda it: _file_pieces(it, size, limit), "item long, range_no long, piece_no long, start long, end long, text string").mapInArrow(
            _first_heading, "item long, range_no long, piece_no long, start long, end long, text string, heading string"
        ),
        "p3-file-pieces",
    )
    # the last heading that began before a range, from one row a range
    last = made.groupBy("item", "range_no").agg(F.max_by("heading", F.when(F.col("heading").isNotNull(), F.col("piece_no"))).alias("last"))
    carried = last.select("item", "range_no", F.last("last", True).over(to_here).alias("carried"))
    inside = Window.partitionBy("item", "range_no").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, 0)
    counted = cut.groupBy("item").agg(F.sum(F.size("starts")).alias("n_pieces"))
    return (
        made.withColumn("own", F.last("heading", True).over(inside))
        .join(carried, ["item", "range_no"])
        .join(counted, "item")
        .select(F.col("item").alias("id"), "piece_no", "n_pieces", "start", "end", F.coalesce("own", "carried").alias("chapter_title"), "text")
    )
