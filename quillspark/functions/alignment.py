"""Recogniser segments aligned with a canonical text: sentences with ids, times and where they come from."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrow import arrow_function
from quillspark.functions.sentences import split_sentences

ALIGNED_DDL = "array<struct<id:string,text:string,start:double,end:double,source_id:string,source_index:int>>"


class Cursor:
    """Finds pieces of a text one after another, first as they are and then whatever their case."""

    def __init__(self, content: str) -> None:
        self.content, self.folded, self.at = content, content.lower(), 0

    def take(self, piece: str) -> str | None:
        """The text's own wording of the piece from the cursor on, and moves behind it; None if it isn't there."""
        if not piece or not self.content:
            return None
        place = self.content.find(piece, self.at)
        if place < 0:
            place = self.folded.find(piece.lower(), self.at)
        if place < 0:
            return None
        self.at = place + len(piece)
        return self.content[place : self.at]


def timed_pieces(text: str, start: float, end: float) -> list[tuple[str, float, float]]:
    """The sentences of a text with its time shared out by characters."""
    clean, out, used = text.strip(), [], 0
    for sentence in split_sentences(clean):
        span = (used, used + len(sentence))
        used = span[1] + 1
        a, b = ((start + (end - start) * min(1.0, x / len(clean))) if end > start else start for x in span)
        out.append((sentence, a, b))
    return out


def align(segments: Iterable[dict[str, Any]] | None, content: str | None, prefix: str = "seg") -> list[dict[str, Any]]:
    """Sentences of ``id, text, start, end`` segments in the canonical wording.

    Each segment is looked for from where the one before it ended. If what comes out
    isn't the canonical text, its own sentences are taken instead, without times. Without
    segments the text is one.
    """
    raw = (content or "").strip()
    flat = " ".join(raw.split())
    cursor, out = Cursor(flat), []
    for number, segment in enumerate(list(segments or []) or [{"text": raw}]):
        own = (segment.get("text") or "").strip()
        text = cursor.take(" ".join(own.split())) or own
        pieces = timed_pieces(text, segment.get("start") or 0.0, segment.get("end") or 0.0) if text else []
        for place, (sentence, start, end) in enumerate(pieces):
            name = str(segment["id"]) if len(pieces) == 1 and segment.get("id") else f"{prefix}_{len(out)}"
            out.append({"id": name, "text": sentence, "start": start, "end": end, "source_id": segment.get("id"), "source_index": place})
    if flat and out and " ".join(" ".join(x["text"] for x in out).split()) != flat:
        return [{"id": f"{prefix}_{k}", "text": s, "start": 0.0, "end": 0.0, "source_id": None, "source_index": k} for k, s in enumerate(split_sentences(raw))]
    return out


@arrow_function(ALIGNED_DDL)
def _aligned(segments: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([align(None if s is None else list(s), c) for s, c in zip(segments, content, strict=True)])


def aligned_segments(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """``session, place, id, text, start, end, source_id, source_index`` of ``session, content`` and ``session, ordinal, id, text, start, end``.

    A session's segments meet in one row, as its canonical text does.
    """
    listed = segments.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text", "start", "end"))).alias("segments"))
    joined = sessions.join(listed, "session", "left")
    return joined.select("session", F.posexplode(_aligned(F.col("segments"), F.col("content"))).alias("place", "a")).select("session", "place", "a.*")
