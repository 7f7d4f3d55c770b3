"""Paragraphs of a segmented transcript: adjacent pairs, boundary scores, manual locks.

A session's segments meet each other only through windows over one session, so the unit
that has to fit a task is a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T

LONG_RUN, LONG_SEGMENT, STABLE_TAIL = 120, 180, 3


def boundary_candidates(segments: DataFrame) -> DataFrame:
    """A row for each pair of neighbours of ``session, ordinal, text, start, end`` segments.

    Gives ``session, after, next, pause, sentence, transition, topic_shift, long, score,
    enabled, from_end``. The word count runs on from the first segment and is never reset.
    """
    order = Window.partitionBy("session").orderBy("ordinal")
    rows = segments.where(F.col("text").isNotNull() & (F.trim("text") != "")).withColumn("text", F.trim("text"))
    n_words = F.size(T.words(F.col("text")))
    paired = rows.select(
        "session", F.col("ordinal").alias("after"), F.lead("ordinal").over(order).alias("next"), "text", F.lead("text").over(order).alias("right"), "end",
        F.lead("start").over(order).alias("right_start"), n_words.alias("n_words"), F.sum(n_words).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"),
        (F.count("*").over(Window.partitionBy("session")) - F.row_number().over(order)).alias("from_end"),
    ).where(F.col("next").isNotNull())
    signals = paired.select(
        "session", "after", "next", "from_end", F.greatest(F.lit(0.0), F.col("right_start") - F.col("end")).alias("pause"), T.ends_sentence(F.col("text")).alias("sentence"),
        T.opens_topic(F.col("right")).alias("transition"), ((F.col("so_far") >= LONG_RUN) | (F.col("n_words") >= LONG_SEGMENT)).alias("long"),
        (T.ends_sentence(F.col("text")) & (F.col("n_words") >= 5) & (T.overlap(F.col("text"), F.col("right")) < 0.12)).alias("topic_shift"),
    )
    score = F.when(F.col("pause") >= 2.0, 0.28).when(F.col("pause") >= 1.1, 0.14).otherwise(0.0)
    for signal, weight in (("sentence", 0.24), ("transition", 0.25), ("topic_shift", 0.30), ("long", 0.22)):
        score = score + F.when(F.col(signal), F.lit(weight)).otherwise(0.0)
    scored = signals.withColumn("raw", score)
    enabled = F.when(F.col("long"), F.col("raw") >= 0.22).otherwise(F.col("sentence") & (F.col("raw") >= 0.48))
    return scored.withColumn("enabled", enabled).withColumn("score", F.least(F.lit(0.99), F.col("raw"))).drop("raw")


def resolve_boundaries(candidates: DataFrame, previous: DataFrame, final: bool = False) -> DataFrame:
    """Candidates with earlier decisions by edge: locked ones stay, stable ones stay while live.

    ``previous`` has ``session, after, next, enabled, score, source, locked, stable``.
    Locked merges stay as rows though their edge is no candidate any more.
    """
    old = previous.select("session", "after", "next", *[F.col(c).alias(f"was_{c}") for c in ("enabled", "score", "source", "locked", "stable")])
    joined = candidates.join(old, ["session", "after", "next"], "left")
    unsettled = F.col("from_end") < STABLE_TAIL
    keeps = F.coalesce(F.col("was_locked"), F.lit(False)) | (F.lit(not final) & ~unsettled & F.coalesce(F.col("was_stable"), F.lit(False)))
    source = F.lit("semantic-refinement" if final else "heuristic-live")
    locked = F.coalesce(F.col("was_locked"), F.lit(False))
    now = joined.select(
        "session", "after", "next", F.when(keeps, F.col("was_enabled")).otherwise(F.col("enabled")).alias("enabled"),
        F.when(keeps, F.col("was_score")).otherwise(F.col("score")).alias("score"), F.when(keeps, F.col("was_source")).otherwise(source).alias("source"),
        locked.alias("locked"), (locked | F.lit(final) | ~unsettled).alias("stable"),
    )
    tombs = previous.where(F.col("locked") & ~F.col("enabled")).join(candidates.select("session", "after", "next"), ["session", "after", "next"], "left_anti")
    return now.unionByName(tombs.select(*now.columns))


def paragraph_numbers(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``session, ordinal, text, paragraph``: from 1, one more after each enabled boundary."""
    cuts = boundaries.where("enabled").select("session", F.col("after").alias("ordinal"), F.lit(1).alias("cut")).dropDuplicates(["session", "ordinal"])
    before = Window.partitionBy("session").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    joined = segments.join(cuts, ["session", "ordinal"], "left")
    return joined.select("session", "ordinal", "text", (F.coalesce(F.sum(F.coalesce("cut", F.lit(0))).over(before), F.lit(0)) + 1).alias("paragraph"))


def paragraphs(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """A row for each paragraph: text, segments, the least confidence of its edges and whether one is locked."""
    numbered = paragraph_numbers(segments, boundaries)
    edges = boundaries.where("enabled").select("session", F.col("after").alias("ordinal"), "score", "locked")
    joined = numbered.join(edges, ["session", "ordinal"], "left")
    return joined.groupBy("session", "paragraph").agg(
        ordered_text(F.col("ordinal"), F.col("text")).alias("text"), F.count("*").alias("n_segments"), F.coalesce(F.min("score"), F.lit(1.0)).alias("confidence"),
        F.coalesce(F.bool_or("locked"), F.lit(False)).alias("locked"),
    )


def ordered_text(order: Column, text: Column, separator: str = " ") -> Column:
    """Trimmed non-empty texts of a group in order, joined."""
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.trim(F.coalesce(text, F.lit(""))).alias("t"))))
    return F.array_join(F.filter(F.transform(entries, lambda e: e["t"]), lambda t: t != ""), separator)


def render(numbered: DataFrame) -> DataFrame:
    """``session, text``: paragraphs joined by blank lines."""
    each = numbered.groupBy("session", "paragraph").agg(ordered_text(F.col("ordinal"), F.col("text")).alias("text"))
    return each.groupBy("session").agg(ordered_text(F.col("paragraph"), F.col("text"), "\n\n").alias("text"))


def split_override(numbered: DataFrame, requests: DataFrame) -> DataFrame:
    """Locked boundaries for ``session, paragraph, after`` requests; a null ``after`` means the middle.

    Requests that do not fall inside a paragraph are left out.
    """
    inside = Window.partitionBy("session", "paragraph").orderBy("ordinal")
    places = numbered.select(
        "session", "paragraph", "ordinal", F.row_number().over(inside).alias("place"), F.count("*").over(Window.partitionBy("session", "paragraph")).alias("size"),
        F.lead("ordinal").over(inside).alias("next"),
    )
    joined = places.join(requests.select("session", "paragraph", F.col("after").alias("asked")), ["session", "paragraph"])
    hit = joined.where(F.when(F.col("asked").isNull(), F.col("place") == F.ceil(F.col("size") / 2)).otherwise(F.col("ordinal") == F.col("asked")) & F.col("next").isNotNull())
    return _locked(hit.select("session", F.col("ordinal").alias("after"), "next"), True, "manual-split")


def merge_override(numbered: DataFrame, requests: DataFrame) -> DataFrame:
    """Locked boundaries that join ``session, paragraph`` to the paragraph before it."""
    edges = numbered.groupBy("session", "paragraph").agg(F.min("ordinal").alias("next"), F.max("ordinal").alias("last"))
    above = edges.select("session", (F.col("paragraph") + 1).alias("paragraph"), F.col("last").alias("after"))
    hit = edges.join(requests.select("session", "paragraph"), ["session", "paragraph"]).join(above, ["session", "paragraph"])
    return _locked(hit.select("session", "after", "next"), False, "manual-merge")


def _locked(edges: DataFrame, enabled: bool, source: str) -> DataFrame:
    return edges.select("session", "after", "next", F.lit(enabled).alias("enabled"), F.lit(1.0).alias("score"), F.lit(source).alias("source"), F.lit(True).alias("locked"), F.lit(True).alias("stable"))
