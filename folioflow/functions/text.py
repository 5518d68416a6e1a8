"""Expressions over texts: cleaning, paragraphs, headings, terms, statements, titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import words

#: Whitespace of any script that counts as outer blank (fixed value).
BLANKS = "[\\s\\u00a0\\u3000]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, f"{BLANKS}+", "") == "", F.lit(True))


def clean_text(raw: Column) -> Column:
    """No byte order marks, LF only, single blanks inside lines, at most one empty line, stripped."""
    text = F.replace(raw, F.lit("﻿"), F.lit(""))
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t\\u3000]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def paragraphs(cleaned: Column) -> Column:
    return F.filter(F.transform(F.split(cleaned, "\n+"), strip), lambda p: p != "")


def is_heading(paragraph: Column) -> Column:
    p = strip(paragraph)
    return (F.char_length(p) <= 80) & ~p.rlike(words.SENTENCE_END) & p.rlike(words.HEADING)


def compact(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{BLANKS}+", " "))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in needles:
        out = out | text.contains(w)
    return out


def bigrams(run: Column) -> Column:
    """All runs of two neighbouring characters."""
    return F.when(
        F.char_length(run) >= 2, F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    ).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Terms in order, repeats kept: words of scripts that have spaces between them, bigrams of those
    that have none (ideographs, kana, Hangul, Thai), without stop words. Questions and chunks share
    this one segmentation."""
    spaced = F.regexp_extract_all(text, F.lit(f"[{words.SPACED}]{{2,}}"), F.lit(0))
    runs = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"[{words.UNSPACED}]{{2,}}"), F.lit(0)), bigrams))
    return F.filter(F.concat(spaced, runs), lambda t: ~t.isin(words.STOP_WORDS))


def query_terms(text: Column) -> Column:
    return F.array_distinct(terms(text))


def statements(answer: Column) -> Column:
    """Sentences with their end marks."""
    marked = F.regexp_replace(answer, "([。！？?!])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def citation_numbers(answer: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("\\[(\\d{1,9})\\]"), F.lit(1)), lambda n: n.cast("int")))


def titles(novel: Column) -> Column:
    """Names a book goes by: all in 《》, else what stands before （ and 作者."""
    inner = F.regexp_extract_all(novel, F.lit("《([^》]+)》"), F.lit(1))
    plain = strip(F.regexp_replace(novel, "（.*$|作者.*$", ""))
    return F.when(F.size(inner) > 0, inner).otherwise(F.array(plain))


def named_titles(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question, F.lit("《([^》]+)》"), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def usable_vector(v: Column, width: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == width) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
