"""Problem 2: text that was decoded with the wrong character encoding.

1. *What garbling looks like.* Every hypothesis of ``HYPOTHESES`` (written in one encoding, read
   in another) is applied to a bounded sample of rows; the pairs of neighbouring characters it
   makes and the sample itself does not have are its marks. Counts of all pairs over **all** rows
   tell how rare a mark is in the corpus; the log ratio of both is the mark's weight.
2. *Suspects.* A row's score is the largest sum of weights over one stretch of it (marks count
   up, ordinary pairs down).
3. *Twins.* Suspects are joined with clean rows that nearly agree once non-ASCII characters are
   stripped: texts that share ``SHARED`` of the ``KEYS`` least hashed windows of what is left, however
   many texts have these windows (texts of the same windows are compared once, and a text goes to
   its rarest windows only, of which twins share one). The stretches between the ASCII anchors that both have are aligned; where a hypothesis turns the clean stretch
   into the garbled one it gets a vote, and the pair of stretches is learned as a mapping. A twin
   that explains a weak suspect confirms it.
4. *The rest.* Stretches without a twin are restored by the learned mappings, else by undoing
   the hypotheses, those with votes first, where the result reads better under the corpus' own
   pair counts; what has lost bytes is restored around them, the lost places marked by U+FFFD.

A row is affected if its score is at least ``SURE``, or at least ``WEAK`` and confirmed by a twin
or by a hypothesis that undoes its stretches without loss into plainly likelier text.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.storage import written

#: Encodings that text is written in, and those that it is wrongly read in.
WRITTEN = ("utf-8", "gb18030", "big5", "cp932", "euc_jp", "euc_kr", "cp1252")
READ = (
    *("western", "latin-1", "cp1251", "cp1250", "koi8_r", "mac_roman", "cp437", "cp850"),
    *("utf-8", "gbk", "big5", "cp932", "euc_jp", "euc_kr"),
)
_SAME = {("gb18030", "gbk"), ("cp1252", "western"), ("cp1252", "latin-1")}
#: (written in, read in); each further pair is applied to the result.
HYPOTHESES: tuple[tuple[str, ...], ...] = (
    *((w, r) for w in WRITTEN for r in READ if w != r and (w, r) not in _SAME),
    ("utf-8", "western", "utf-8", "western"),
    ("utf-8", "latin-1", "utf-8", "latin-1"),
    ("utf-8", "gbk", "utf-8", "gbk"),
    ("gb18030", "utf-8", "utf-8", "gbk"),
    ("big5", "utf-8", "utf-8", "gbk"),
)
SAMPLE, BITS, SURE, WEAK, GAIN = 2_000, 21, 26.0, 7.0, 10.0
UP, DOWN, UNKNOWN, PLAIN = 6.0, -4.0, -1.0, -0.05
# Printable ASCII characters of a window of a skeleton, windows of a text, of these shared by twins;
# characters aligned at once.
ANCHORS, KEYS, SHARED, WINDOW = 8, 8, 3, 8
SINGLE = 3  # fewer characters that turn into as many prove nothing
NEAR, LOSS = 12, 5.0  # characters between stretches of one loss; what a lost place costs
KEPT, SHORT = 16_384, 512  # stretches whose undoing a task remembers, of at most so many characters


@lru_cache(maxsize=1)
def _western() -> tuple[dict[int, int], dict[int, str]]:
    """cp1252 with its five undefined bytes read as control characters."""
    there = {}
    for b in range(256):
        try:
            there[b] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            there[b] = chr(b)
    return {ord(c): b for b, c in there.items()}, there


def _encode(text: str, name: str, errors: str) -> bytes:
    if name != "western":
        return text.encode(name, errors)
    back, _ = _western()
    out = bytearray()
    for c in text:
        b = back.get(ord(c))
        if b is not None:
            out.append(b)
        elif errors == "strict":
            raise UnicodeEncodeError("western", c, 0, 1, "not in the code page")
        else:
            out += b"?"
    return bytes(out)


def _decode(data: bytes, name: str, errors: str) -> str:
    if name != "western":
        return data.decode(name, errors)
    return data.decode("latin-1").translate(_western()[1])


def garble(text: str, how: tuple[str, ...]) -> str:
    for w, r in zip(how[::2], how[1::2], strict=True):
        text = _decode(_encode(text, w, "replace"), r, "replace")
    return text


def restore(text: str, how: tuple[str, ...]) -> str | None:
    """The text before ``how``, or None where a character can't come from it."""
    try:
        for w, r in reversed(list(zip(how[::2], how[1::2], strict=True))):
            text = _decode(_encode(text, r, "strict"), w, "strict")
    except UnicodeError:
        return None
    return text


LOST, GAP = "\ufffd", b"\xff"  # a lost place in a text, and in bytes, where no encoding of ``WRITTEN`` has it
_LOST, _KANA = re.compile(LOST + "+"), re.compile("[\u3040-\u30ff\u3001\u3002\u300c\u300d]")
_PAIRED = ("gb18030", "big5", "euc_kr")
_SINGLE = frozenset(r for r in READ if r not in ("utf-8", "gbk", "big5", "cp932", "euc_jp", "euc_kr"))

codecs.register_error("folioflow-lost", lambda e: (GAP * (e.end - e.start), e.end))


def _gapped(text: str, name: str) -> bytes:
    """The bytes of ``text``, with a gap for every character that ``name`` lacks."""
    if name != "western":
        return text.encode(name, "folioflow-lost")
    back, _ = _western()
    return bytes(back.get(ord(c), GAP[0]) for c in text)


def _around(data: bytes, name: str) -> str:
    """``data`` decoded as far as it goes, each run of lost places as one mark."""
    if name == "utf-8":  # tells by itself where characters begin
        return _LOST.sub(LOST, data.decode("utf-8", "replace"))
    out, i = [], 0
    if name == "euc_jp":  # after a loss a character may begin at once or a byte later; kana tell which
        for part in data.split(GAP):
            made = (part.decode(name, "replace"), LOST + part[1:].decode(name, "replace"))
            out.append(max(made, key=lambda t: len(_KANA.findall(t)) - t.count(LOST)))
        return _LOST.sub(LOST, LOST.join(out))
    while i < len(data):
        step = 1 if data[i] < 0x80 else 2
        try:
            out.append(data[i : i + step].decode(name))
        except UnicodeDecodeError:
            out.append(LOST)
        i += step
    return _LOST.sub(LOST, "".join(out))


def restore_around(text: str, how: tuple[str, ...]) -> str | None:
    """What is left of the text before ``how``, with a mark for each run of lost characters; None for
    encodings in which nothing can be told after a loss."""
    for w, r in reversed(list(zip(how[::2], how[1::2], strict=True))):
        if not (w == "utf-8" or (w in _PAIRED and r in _SINGLE) or (w, r) == ("euc_jp", "cp932")) or r == "utf-8":
            return None
        text = _around(_gapped(text, r), w)
    return text


def _pairs(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by U+0000, and the hash of every neighbouring pair."""
    cp = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    h = (cp[:-1] * np.uint32(0x9E3779B1)) ^ (cp[1:] * np.uint32(0x85EBCA6B))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return cp, h >> np.uint32(32 - bits)


def _count(texts: list[str], bits: int, lost: bool = False) -> np.ndarray:
    """How often each pair occurs; with ``lost`` pairs with a question mark, as put for what an
    encoding lacks, are left out."""
    if not texts:
        return np.zeros(1 << bits, np.int64)
    cp, h = _pairs(texts, bits)
    if lost:
        h = h[(cp[:-1] != 63) & (cp[1:] != 63)]
    return np.bincount(h, minlength=1 << bits)


def _partial_counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << bits, np.int64)
    for batch in batches:
        total += _count([t for t in batch.column("text").to_pylist() if t], bits)
    at = np.flatnonzero(total)
    for lo in range(0, len(at), 100_000):
        own = at[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["pair", "n"])


class Weights:
    """Weight of every pair as a mark of garbling, and its log rate in the corpus."""

    def __init__(self, counts: np.ndarray, rows: int, sample: list[str], bits: int):
        self.bits = bits
        source = _count(sample, bits)
        marks = np.zeros(1 << bits, np.int64)
        for how in HYPOTHESES:
            made = _count([garble(t, how) for t in sample], bits, lost=True)
            np.maximum(marks, np.where(made > 3 * source, made, 0), out=marks)
        with np.errstate(divide="ignore"):
            rate = np.log((counts + 0.5) / max(rows, 1))
            ratio = np.log(marks / max(len(sample), 1)) - rate
        self.weight = np.where(
            marks > 0, np.clip(ratio, DOWN, UP), np.where(counts <= 2, UNKNOWN, DOWN)
        ).astype(np.float32)
        self.rate, self.rarest = rate.astype(np.float32), float(rate.min())
        self.mean = float((counts * rate).sum() / max(counts.sum(), 1))

    def _weights(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, h = _pairs(texts, self.bits)
        w = self.weight[h].astype(np.float64)
        w[(cp[:-1] < 128) & (cp[1:] < 128)] = PLAIN
        w[(cp[:-1] == 0) | (cp[1:] == 0)] = 0.0
        return cp, w

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        cp, w = self._weights(texts)
        w[cp[1:] == 0] = -1e4  # no stretch crosses rows
        total = np.cumsum(w)
        over = total - np.minimum.accumulate(np.r_[0.0, total[:-1]])
        ends = np.flatnonzero(cp[1:] == 0)
        starts = np.r_[0, ends[:-1] + 1]
        best = np.maximum.reduceat(over, starts)
        return np.maximum(best, 0.0)

    def stretches(self, text: str, least: float) -> list[tuple[int, int]]:
        """Disjoint stretches [start, end) whose weights sum to ``least`` or more."""
        if len(text) < 2:
            return []
        _, w = self._weights([text])
        w = w[: len(text) - 1]
        out: list[tuple[int, int]] = []
        todo = [(0, len(w))]
        while todo:
            lo, hi = todo.pop()
            if lo >= hi:
                continue
            total = np.cumsum(w[lo:hi])
            low = np.minimum.accumulate(np.r_[0.0, total[:-1]])
            end = int(np.argmax(total - low))
            if total[end] - low[end] < least:
                continue
            before = np.r_[0.0, total[:end]]
            start = int(len(before) - 1 - np.argmin(before[::-1]))
            out.append((lo + start, lo + end + 2))
            todo += [(lo, lo + start), (lo + end + 1, hi)]
        return sorted(out)

    def likely(self, texts: list[str]) -> np.ndarray:
        """Log rate in the corpus of the pairs of each text."""
        cp, h = _pairs(texts, self.bits)
        rate = self.rate[h].astype(np.float64)
        rate[(cp[:-1] == 0) | (cp[1:] == 0)] = 0.0
        starts = np.r_[0, np.flatnonzero(cp == 0)[:-1] + 1]
        return np.add.reduceat(rate, starts)


def _widen(text: str, start: int, end: int) -> tuple[int, int]:
    """A stretch shows up in pairs; its outer characters may be clean neighbours."""
    while start < end and ord(text[start]) < 128:
        start += 1
    while end > start and ord(text[end - 1]) < 128:
        end -= 1
    return start, end


class Undoer:
    """Finds the likeliest lossless undoing of stretches of one text; ``known`` keeps what was found
    for the same stretch between the same neighbours, also in other texts."""

    def __init__(self, text: str, model: Weights, order: list[int], known: dict[tuple, tuple | None] | None = None):
        self.text, self.model, self.order = text, model, list(order)
        self.known = {} if known is None else known
        self.bytes: dict[tuple[str, int, int], bytes | None] = {}
        self.worked: list[int] = []

    def _encoded(self, name: str, a: int, b: int) -> bytes | None:
        key = (name, a, b)
        if key not in self.bytes:
            try:
                self.bytes[key] = _encode(self.text[a:b], name, "strict")
            except UnicodeError:
                self.bytes[key] = None
        return self.bytes[key]

    def _before(self, how: tuple[str, ...], a: int, b: int) -> str | None:
        data = self._encoded(how[-1], a, b)
        if data is None:
            return None
        try:
            made = _decode(data, how[-2], "strict")
            return restore(made, how[:-2]) if len(how) > 2 else made
        except UnicodeError:
            return None

    def undo(self, start: int, end: int) -> tuple[int, int, str, int] | None:
        """(start, end, restored, hypothesis), or None. Hypotheses that worked on the text before
        come first and are enough if they work again; else all others are tried."""
        start, end = _widen(self.text, start, end)
        low = max(0, start - 2)
        # all that is read of the text, and what decides which hypotheses come first
        key = (self.text[low : end + 2], start - low, end - start, tuple(self.worked))
        if key in self.known:
            got = self.known[key]
        else:
            got = self._undo(start, end)
            got = None if got is None else (got[0] - start, got[1] - start, got[2], got[3])
            if end - start <= SHORT:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[key] = got
        if got is None:
            return None
        if got[3] not in self.worked:
            self.worked.append(got[3])
        return got[0] + start, got[1] + start, got[2], got[3]

    def _undo(self, start: int, end: int) -> tuple[int, int, str, int] | None:
        text, model = self.text, self.model
        edges = [(a, b) for a in (start, start + 1, start - 1) for b in (end, end - 1, end + 1) if 0 <= a < b <= len(text)]
        best, rest = None, [i for i in self.order if i not in self.worked]
        for tier in (self.worked, rest):
            tried: list[tuple[int, int, str, int]] = []
            for i in tier:
                how = HYPOTHESES[i]
                if end - start > 4 and self._encoded(how[-1], start + 1, end - 1) is None:
                    continue
                for a, b in edges:
                    made = self._before(how, a, b)
                    if not made or made == text[a:b] or _CONTROL.search(made):
                        continue
                    if b - a < SINGLE and len(made) == b - a:
                        continue  # any character turns into some other one
                    tried.append((a, b, made, i))
            if not tried:
                continue
            around = [(text[max(0, a - 1) : a], text[b : b + 1]) for a, b, _, _ in tried]
            now = model.likely([x + made + y for (_, _, made, _), (x, y) in zip(tried, around, strict=True)])
            was = model.likely([x + text[a:b] + y for (a, b, _, _), (x, y) in zip(tried, around, strict=True)])
            # as many pairs on either side: what a side lacks is put at the corpus' mean
            longer = np.array([len(made) - (b - a) for a, b, made, _ in tried])
            gain = now - was - model.mean * longer
            top = int(np.argmax(gain))
            if gain[top] > GAIN:
                best = tried[top]
                break
        return best


def undo_around(text: str, start: int, end: int, model: Weights, order: list[int]) -> tuple[int, int, str, int] | None:
    """(start, end, restored, hypothesis) of a stretch from which bytes are lost: what is left of it, the
    lost places marked; None where less than half of it comes back or it reads no better."""
    start, end = _widen(text, start, end)

    def tried(a: int, b: int, hypotheses: list[int]) -> list[tuple[float, int, int, str, int]]:
        found = []
        for i in hypotheses:
            made = restore_around(text[a:b], HYPOTHESES[i])
            if not made or _CONTROL.search(made):
                continue
            lost = made.count(LOST)
            back = sum(ord(c) > 127 for c in made) - lost
            if back > max(lost, 1):
                found.append((a, b, made, i, lost))
        if not found:
            return []
        now = model.likely([_LOST.sub("", made) for _, _, made, _, _ in found])
        kept = _LOST.sub("", text[a:b])
        was = model.likely([kept])[0]
        return [
            (gain - was - model.mean * (len(made) - lost - len(kept)) - LOSS * lost, a, b, made, i)
            for gain, (a, b, made, i, lost) in zip(now, found, strict=True)
        ]

    best = max(tried(start, end, order), default=None)
    if best is None or best[0] <= GAIN:
        return None
    # it must read like the corpus, not only better than what is there
    plain = _LOST.sub("", best[3])
    if model.likely([plain])[0] / len(plain) < (model.mean + model.rarest) / 2:
        return None
    # characters at the edges may be clean neighbours
    edges = [(a, b) for a in (start, start + 1, start + 2) for b in (end, end - 1, end - 2) if a < b and (a, b) != (start, end)]
    best = max([best, *(x for a, b in edges for x in tried(a, b, [best[4]]))])
    return best[1], best[2], best[3], best[4]


def _suspects(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t if t else " " for t in batch.column("text").to_pylist()]
        score = shared.value.scores([t.replace("\0", " ") for t in texts])
        keep = score >= WEAK
        if keep.any():
            out = batch.append_column("score", pa.array(score))
            yield out.filter(pa.array(keep))


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_UNPRINTED = re.compile(b"[^!-~]+")
_ANCHOR = re.compile("[0-9A-Za-z]+|[\x00-\x7f]")


@lru_cache(maxsize=1_024)
def _anchors(text: str) -> tuple[list[re.Match], list[str], Counter]:
    found = list(_ANCHOR.finditer(text))
    names = [m[0] for m in found]
    return found, names, Counter(names)


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Stretches (garbled, clean) between ASCII anchors that both texts have in the same order, without
    what the stretches share at the ends. Anchors that one text lacks are passed over with their
    stretches; texts that share less than half of their anchors have none."""
    (ours, our_names, our_counts), (theirs, their_names, their_counts) = _anchors(garbled), _anchors(clean)
    if our_names == their_names:
        both = [(g, c, k > 0) for k, (g, c) in enumerate(zip(ours, theirs, strict=True))]
    else:
        if 2 * (our_counts & their_counts).total() < max(len(ours), len(theirs)):  # no twins
            return []
        blocks = SequenceMatcher(None, our_names, their_names, autojunk=False).get_matching_blocks()
        both = [(ours[b.a + k], theirs[b.b + k], k > 0) for b in blocks for k in range(b.size)]
    pairs, last = [], None
    for g, c, goes_on in both:
        begins = last is None and g is ours[0] and c is theirs[0]
        if goes_on or begins:
            pairs.append((garbled[last[0].end() if last else 0 : g.start()], clean[last[1].end() if last else 0 : c.start()]))
        last = (g, c)
    if last is None:
        if ours or theirs:
            return []
        pairs.append((garbled, clean))
    elif last[0] is ours[-1] and last[1] is theirs[-1]:
        pairs.append((garbled[last[0].end() :], clean[last[1].end() :]))
    return [(g, c) for g, c in (_apart(*pair) for pair in pairs) if g and c]


def _apart(g: str, c: str) -> tuple[str, str]:
    """Two stretches without what they share at the ends."""
    n = min(len(g), len(c))
    head = next((i for i in range(n) if g[i] != c[i]), n)
    tail = next((i for i in range(n - head) if g[-1 - i] != c[-1 - i]), n - head)
    return g[head : len(g) - tail], c[head : len(c) - tail]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tbl, row_id, key, least, twin) of texts with other than ASCII characters: the least hashes of their
    skeletons' windows, a row each, how many keys a twin must share, and the hash of the text."""
    for batch in batches:
        at, keys, least, twin = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            skeleton = _UNPRINTED.sub(b"", text.encode("ascii", "ignore"))
            if len(skeleton) < ANCHORS or text.isascii():
                continue
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(skeleton, np.uint8), ANCHORS)
            h = np.ascontiguousarray(windows).view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15)
            h = np.unique((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))[:KEYS]
            at += [i] * len(h)
            keys.append(h.view(np.int64))
            least += [min(SHARED, len(h))] * len(h)
            twin += [_hash(text.encode("utf-8", "surrogatepass"))] * len(h)
        if at:
            own = batch.select(["tbl", "row_id"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(np.concatenate(keys)), pa.array(least, pa.int32()), pa.array(twin, pa.int64())],
                names=["tbl", "row_id", "key", "least", "twin"],
            )


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _changed(garbled: str, clean: str) -> bool:
    """Whether most characters differ; related encodings share whole rows of characters."""
    same = sum(x == y for x, y in zip(garbled, clean, strict=False))
    return 2 * same < max(len(garbled), len(clean))


def _garbled(text: str) -> list[str]:
    """What every hypothesis makes of a text, which is written only once in each encoding."""
    data = {w: _encode(text, w, "replace") for w in WRITTEN}
    once = ((_decode(data[how[0]], how[1], "replace"), how[2:]) for how in HYPOTHESES)
    return [garble(made, rest) if rest else made for made, rest in once]


@lru_cache(maxsize=4_096)
def _probed(probe: str) -> tuple[str, ...]:
    """What every hypothesis makes of a few characters, without what the neighbours decide."""
    return tuple(inner[2:-2] or inner for inner in _garbled(probe))


def explained(garbled: str, clean: str) -> tuple[int, bool] | None:
    """(hypothesis, whether it makes all of ``garbled``) of a stretch and its clean twin.

    Where the twin has small edits, runs of ``WINDOW`` characters of it that turn up garbled in
    the right order are enough.
    """
    if len(garbled) == len(clean) < SINGLE:
        return None
    parts = [clean[i : i + WINDOW] for i in range(0, max(1, len(clean) - WINDOW + 1), WINDOW)]
    best, most = None, 0.5
    for i, (how, inner) in enumerate(zip(HYPOTHESES, _probed(clean[len(clean) // 2 :][:WINDOW]), strict=True)):
        if inner not in garbled:
            continue
        if garble(clean, how) == garbled and _changed(garbled, clean):
            return i, True
        at, hits, missed = 0, 0, 1
        for p in parts:
            inner = garble(p, how)[1:-1] if len(clean) > WINDOW else garble(p, how)
            # not far from the run before, as texts repeat themselves
            reach = at + missed * (2 * len(inner) + WINDOW)
            found = garbled.find(inner, at, reach) if len(inner) >= 2 and _changed(inner, p[1:-1]) else -1
            if found >= 0:
                hits, at, missed = hits + 1, found + len(inner), 1
            else:
                missed += 1
        if hits / len(parts) > most:
            best, most = i, hits / len(parts)
    return None if best is None else (best, False)


_RUN, _WORD = re.compile("([^\x00-\x7f]+)"), string.ascii_letters + string.digits


@lru_cache(maxsize=4_096)
def _runs(text: str) -> dict[tuple[str, str], set[str]]:
    """The runs of other than ASCII characters of a text, by the anchors before and after them."""
    parts = _RUN.split(text)
    out: dict[tuple[str, str], set[str]] = {}
    for i in range(1, len(parts), 2):
        before, after = parts[i - 1], parts[i + 1]
        around = (before[len(before.rstrip(_WORD)) :] or before[-1:], after[: len(after) - len(after.lstrip(_WORD))] or after[:1])
        out.setdefault(around, set()).add(parts[i])
    return out


@lru_cache(maxsize=4_096)
def _within(probe: str) -> tuple[str, ...]:
    """What ``_probed`` makes of ``probe`` where all of it is other than ASCII."""
    return tuple({inner for inner in _probed(probe) if _RUN.fullmatch(inner)})


@lru_cache(maxsize=65_536)
def _told(garbled: str, clean: str) -> bool:
    """Whether a hypothesis explains a run by another one, in any alignment that puts them together."""
    g, c = _apart(garbled, clean)
    return bool(g and c) and any(map(g.__contains__, _within(c[len(c) // 2 :][:WINDOW]))) and explained(g, c) is not None


def may_explain(garbled: str, clean: str) -> bool:
    """False only where no stretch of ``align`` is explained. Aligned stretches are whole runs of other than
    ASCII characters between the same anchors, so these are looked at before anything is aligned."""
    ours, theirs = _runs(garbled), _runs(clean)
    return any(_told(g, c) for around in ours.keys() & theirs.keys() for g in ours[around] for c in theirs[around])


def _explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Twins to (row, share of differing stretches made exactly, hypothesis, garbled, clean, twin's text)."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if not may_explain(r["text"], r["twin"]):
                continue
            pairs = align(r["text"], r["twin"])
            told = [explained(g, c) for g, c in pairs]
            share = sum(t is not None and t[1] for t in told) / max(1, len(told))
            for (g, c), t in zip(pairs, told, strict=True):
                if t is not None:
                    rows.append((r["tbl"], r["row_id"], share, t[0], g if t[1] else None, c if t[1] else None, r["twin"]))
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["tbl", "row_id", "share", "hypothesis", "garbled", "clean", "twin"],
            )


def _joined(spans: list[tuple[int, int]], done: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """Stretches that are at most ``NEAR`` apart as one, unless something restored lies between."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start - out[-1][1] <= NEAR and not any(out[-1][1] <= a < start for a, _, _, _ in done):
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _decide(batches: Iterator[pa.RecordBatch], shared, order: list[int], restoring: bool) -> Iterator[pa.RecordBatch]:
    """Affected rows; with ``restoring`` also the restored text, NULL where nothing could be restored."""
    model: Weights = shared.value
    known: dict[tuple, tuple | None] = {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            how: list[str] = []
            made, whole = r["text"], True
            for m in sorted(r["mappings"] or [], key=lambda m: -len(m["garbled"])):
                if m["garbled"] in made:
                    made = made.replace(m["garbled"], m["clean"])
                    how.append("mapping")
            sure = r["score"] >= SURE or r["twin"] is not None or bool(how)
            if restoring or not sure:
                spans = model.stretches(made, 4.0)
                work = Undoer(made, model, order, known)
                found = {}
                # the longest stretches tell which hypotheses to try first
                for start, end in sorted(spans, key=lambda x: x[0] - x[1]):
                    found[start, end] = work.undo(start, end)
                pieces = [x for x in found.values() if x is not None]
                how += ["/".join(HYPOTHESES[i]) for _, _, _, i in sorted(pieces, reverse=True)]
                left = [x for x in spans if found[x] is None]
                whole = not left
                if restoring and (sure or how):
                    # what no hypothesis undoes as a whole may have lost bytes here and there
                    for start, end in _joined(left, pieces):
                        got = undo_around(made, start, end, model, order)
                        if got is not None and all(got[1] <= a or b <= got[0] for a, b, _, _ in pieces):
                            pieces.append(got)
                            how.append("/".join(HYPOTHESES[got[3]]) + " in part")
                for a, b, new, _ in sorted(pieces, reverse=True):
                    made = made[:a] + new + made[b:]
            if not (sure or how):
                continue
            if r["twin"] is not None and (r["share"] or 0) >= 1.0:
                made, whole, how = r["twin"], True, ["twin", *how]
            rows.append((r["tbl"], r["row_id"], r["score"], made if how else None, bool(how) and whole, ",".join(dict.fromkeys(how)) or None))
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["tbl", "row_id", "score", "restored", "complete", "how"],
            )


def learn(rows: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> Weights:
    """Pair counts of all rows, and the hypotheses' marks on at most ``sample`` rows of them."""
    spark = rows.sparkSession
    some = [
        r["text"]
        for r in rows.where(F.trim("text") != "").orderBy(F.xxhash64("tbl", "row_id"), "row_id").limit(sample).select("text").collect()
    ]
    tasks = 4 * spark.sparkContext.defaultParallelism
    partial = rows.select("text").coalesce(tasks).mapInArrow(lambda it: _partial_counts(it, bits), "pair long, n long")
    got = partial.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most 2^bits rows
    counts = np.zeros(1 << bits, np.int64)
    counts[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return Weights(counts, rows.count(), [t.replace("\0", " ") for t in some], bits)


def shared_keys(asks: DataFrame, sets: DataFrame) -> DataFrame:
    """(keys, least, twin_keys): all pairs of ``asks(keys, least)`` and ``sets(twin_keys)`` that share
    ``least`` keys.

    Sets of keys that occur often meet once. Of n keys of which ``least`` must be shared one is among the
    n - ``least`` + 1 rarest, so the others, which many sets have, make no pairs of their own.
    """
    asks, sets = asks.distinct(), sets.distinct()
    there = sets.select("twin_keys", F.explode("twin_keys").alias("key"))
    rare = there.groupBy("key").agg(F.count("*").alias("n"))
    asked = asks.select("keys", "least", F.explode("keys").alias("key")).join(rare, "key", "left").na.fill(0, ["n"])
    few = asked.groupBy("keys", "least").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("by"))
    few = few.select("keys", "least", F.explode(F.slice("by", F.lit(1), F.size("by") - F.col("least") + 1)).alias("x"))
    pairs = few.select("keys", "least", F.col("x.key").alias("key")).join(there, "key").select("keys", "least", "twin_keys").distinct()
    return pairs.where(F.size(F.array_intersect("keys", "twin_keys")) >= F.col("least"))


def find_garbled(
    tables: list[tuple[str, DataFrame, str, str]], bits: int = BITS, restoring: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(affected, votes)`` over ``tables`` of (name, frame, id column, text column).

    affected(tbl, row_id, score, restored, complete, how): one row per affected row; ``restored``
    is NULL where no part could be restored, ``complete`` tells whether all of it was. Without
    ``restoring`` texts are restored only where that decides whether a row is affected.
    votes(hypothesis, votes): what aligned twins say.

    Rows with NULL id or text take no part; blank texts are never affected; rows repeated under
    one id are reported as often as they occur; empty tables give empty results; other columns
    are ignored. Whole texts are read, of any length.
    """
    rows = None
    for name, df, id_col, text_col in tables:
        part = df.select(
            F.lit(name).alias("tbl"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text")
        ).where(F.col("row_id").isNotNull() & F.col("text").isNotNull())
        rows = part if rows is None else rows.unionByName(part)
    spark = rows.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.broadcast(learn(rows, bits))  # 2^bits entries, whatever the input
    suspects = written(rows.mapInArrow(lambda it: _suspects(it, shared), "tbl string, row_id long, text string, score double"), "p2-suspects")

    # near-twins share some of the least hashes of the windows of what is printable ASCII in them
    def keyed(df: DataFrame) -> DataFrame:
        return df.select("tbl", "row_id", "text").mapInArrow(_windows, "tbl string, row_id long, key long, least int, twin long")

    asks = written(keyed(suspects).drop("twin"), "p2-asks")
    clean = written(
        keyed(rows)
        .join(asks.select("key").distinct(), "key", "left_semi")
        .join(suspects.select("tbl", "row_id"), ["tbl", "row_id"], "left_anti")
        .groupBy("twin")  # equal texts are one twin
        .agg(F.min(F.struct("tbl", "row_id")).alias("t"), F.array_sort(F.collect_set("key")).alias("twin_keys"))
        .select(F.col("t.tbl").alias("twin_tbl"), F.col("t.row_id").alias("twin_id"), "twin_keys"),
        "p2-clean",
    )
    asks = asks.groupBy("tbl", "row_id", "least").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    met = asks.join(shared_keys(asks.select("keys", "least"), clean.select("twin_keys")), ["keys", "least"]).join(clean, "twin_keys")
    met = met.select("tbl", "row_id", "twin_tbl", "twin_id").distinct()
    twins = rows.select(F.col("tbl").alias("twin_tbl"), F.col("row_id").alias("twin_id"), F.col("text").alias("twin"))
    twins = twins.join(met.select("twin_tbl", "twin_id").distinct(), ["twin_tbl", "twin_id"], "left_semi").distinct()
    told = written(
        met.join(suspects.select("tbl", "row_id", "text").distinct(), ["tbl", "row_id"])
        .join(twins, ["twin_tbl", "twin_id"])  # a twin's rows come one after the other
        .select("tbl", "row_id", "text", "twin")
        .mapInArrow(_explain, "tbl string, row_id long, share double, hypothesis int, garbled string, clean string, twin string"),
        "p2-twins",
    )
    votes = told.groupBy("hypothesis").agg(F.count("*").alias("votes"))
    ranked = {r["hypothesis"]: r["votes"] for r in votes.collect()}  # at most one row a hypothesis
    order = sorted(range(len(HYPOTHESES)), key=lambda i: (-ranked.get(i, 0), i))
    best = told.withColumn(
        "r", F.row_number().over(Window.partitionBy("tbl", "row_id").orderBy(F.desc("share"), "twin"))
    ).where("r = 1")
    # a learned mapping helps the suspects that hold the same garbled stretch
    learned = told.where(F.length("garbled") >= 2).groupBy("garbled").agg(F.mode("clean", True).alias("clean"))
    stretch = suspects.select("tbl", "row_id", F.explode(F.array_distinct(F.split("text", "[\\x00-\\x7f]+"))).alias("garbled"))
    mappings = (
        stretch.join(learned, "garbled").groupBy("tbl", "row_id").agg(F.collect_list(F.struct("garbled", "clean")).alias("mappings"))
    )
    affected = (
        suspects.join(best.select("tbl", "row_id", "share", "twin"), ["tbl", "row_id"], "left")
        .join(mappings, ["tbl", "row_id"], "left")
        .repartition(tasks, "tbl", "row_id")  # few rows, much work on each
        .mapInArrow(
            lambda it: _decide(it, shared, order, restoring),
            "tbl string, row_id long, score double, restored string, complete boolean, how string",
        )
    )
    names = F.create_map(*[x for i, h in enumerate(HYPOTHESES) for x in (F.lit(i), F.lit("/".join(h)))])
    return affected, votes.select(names[F.col("hypothesis")].alias("hypothesis"), "votes")
