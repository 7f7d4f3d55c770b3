"""Sentences: a conservative splitter that works on prose with abbreviations, numbers and addresses.

The splitter finds candidate marks with one regular expression and decides each by what
stands around it, so a text is read once. It runs in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrow import arrow_function
from quillspark.functions.vocabulary import ABBREVIATIONS

_MARKS = re.compile(r"[.!?…。！？]+")
_CLOSERS = re.compile("[\"'’”»)\\]}）］｝]*")
_TOKEN_BACK = re.compile(r"[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*")
_ADDRESS = re.compile(r"(?:https?://|www\.|@)\S*$", re.I)
_DOTTED = re.compile(r"[A-Za-z](?:\.[A-Za-z])+")
_BREAK = re.compile(r"\n{2,}")
_GAP = re.compile(r"\s*")


def _starts_sentence(c: str) -> bool:
    """Nothing, an upper-case letter, a digit or an ideograph."""
    return not c or (c.isalpha() and c == c.upper() and c != c.lower()) or c.isnumeric() or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _is_end(text: str, start: int, stop: int) -> bool:
    """Whether the run of marks ``text[start:stop]`` ends a sentence."""
    mark, after = text[stop - 1], text[stop : stop + 1]
    if mark in "!?。！？":
        return True
    beyond = _GAP.match(text, stop).end()  # an offset: copying the rest of a text at every mark would be quadratic
    following = text[beyond : beyond + 1]
    if mark == "…" or stop - start >= 2:
        return _starts_sentence(following)
    if text[stop - 2 : stop - 1].isdigit() and after.isdigit():
        return False
    joined = bool(after) and (after.isalpha() or after.isnumeric())
    if joined and _ADDRESS.search(text[max(0, start - 200) : start]):
        return False
    found = _TOKEN_BACK.match(text[max(0, start - 200) : start][::-1])  # read backwards: a search would try every place before it
    token = found[0][::-1] if found else ""
    if token.lower() in ABBREVIATIONS or _DOTTED.fullmatch(token):
        return False
    if len(token) == 1 and token.isalpha() and following and following.isalpha() and _starts_sentence(following):
        return False
    return not (joined and len(token) <= 3)


def split_paragraph(text: str) -> list[str]:
    """Sentences of one paragraph; single line ends are spaces."""
    text = " ".join(x for x in (line.strip() for line in text.split("\n")) if x)
    out, begin = [], 0
    for found in _MARKS.finditer(text):
        if found.start() < begin or not _is_end(text, *found.span()):
            continue
        end = _CLOSERS.match(text, found.end()).end()
        out.append(text[begin:end].strip())
        begin = end
    out.append(text[begin:].strip())
    return [x for x in out if x]


def paragraphs_of(text: str | None) -> list[list[str]]:
    clean = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    return [split_paragraph(p) for p in _BREAK.split(clean)] if clean else []


def split_sentences(text: str | None) -> list[str]:
    return [s for p in paragraphs_of(text) for s in p]


def sentence_paragraphs(text: str | None) -> str:
    """Sentences joined by a space, paragraphs by a blank line."""
    return "\n\n".join(x for x in (" ".join(p) for p in paragraphs_of(text)) if x)


@arrow_function("array<string>")
def sentences(text: pd.Series) -> pd.Series:
    return text.map(split_sentences, na_action=None)


@arrow_function("string")
def format_sentences(text: pd.Series) -> pd.Series:
    return text.map(sentence_paragraphs, na_action=None)


def timed_sentences(segments: DataFrame) -> DataFrame:
    """``session, ordinal, piece, text, start, end``: a segment's time shared out by characters."""
    split = segments.where(F.col("text").isNotNull()).withColumn("text", F.trim("text")).withColumn("pieces", sentences(F.col("text")))
    each = split.select("session", "ordinal", F.length("text").alias("n"), "start", "end", F.posexplode("pieces").alias("piece", "sentence"), "pieces")
    before = F.aggregate(F.slice("pieces", 1, F.col("piece")), F.lit(0), lambda s, x: s + F.length(x) + 1)

    def at(characters: Column) -> Column:
        return F.when(F.col("end") > F.col("start"), F.col("start") + (F.col("end") - F.col("start")) * F.least(F.lit(1.0), characters / F.col("n"))).otherwise(F.col("start"))

    return each.select("session", "ordinal", "piece", F.col("sentence").alias("text"), at(before).alias("start"), at(before + F.length("sentence")).alias("end"))
