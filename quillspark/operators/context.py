"""Evidence from elsewhere in a session: contextual similarity and a bounded reference of other paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import guard
from quillspark.functions import text as T
from quillspark.functions.vocabulary import SUPPORT_STOPWORDS

#: Characters of a reference.
REFERENCE_CHARACTERS = 2400


def features(text: Column) -> Column:
    """``tokens, numbers, has_formula`` of a text: what similarities compare, taken once for each text."""
    tokens = F.array_distinct(F.filter(T.meaningful_tokens(text), lambda t: ~t.isin(*SUPPORT_STOPWORDS)))
    return F.struct(tokens.alias("tokens"), guard.number_mentions(text).alias("numbers"), (F.size(T.formulas(text)) > 0).alias("has_formula"))


def similarity(source: Column, candidate: Column) -> Column:
    """Points for what a candidate shares with a source, both as ``features``; 0 where either has no tokens.

    A source token counts 4 if it stands in the candidate and is long, 2 if it is short, 1 if
    a token within two edits does; a shared number adds 4, formulas on both sides 3.
    """

    def points(token: Column) -> Column:
        near = F.exists(
            candidate["tokens"],
            lambda other: (F.length(other) >= 5) & (F.abs(F.length(other) - F.length(token)) <= 2) & (F.levenshtein(token, other, 2) >= 0),
        )
        exact = F.when(F.length(token) >= 7, 4).otherwise(2)
        return F.when(F.array_contains(candidate["tokens"], token), exact).when((F.length(token) >= 5) & near, 1).otherwise(0)

    total = F.aggregate(F.transform(source["tokens"], points), F.lit(0), lambda s, x: s + x)
    total += F.when(F.arrays_overlap(source["numbers"], candidate["numbers"]), 4).otherwise(0)
    total += F.when(source["has_formula"] & candidate["has_formula"], 3).otherwise(0)
    return F.when((F.size(source["tokens"]) == 0) | (F.size(candidate["tokens"]) == 0), 0).otherwise(total)


def scored_paragraphs(windows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``session, window, ordinal, score, text``: other paragraphs of a window's session that share something with it.

    ``windows`` has ``session, window, first, last, text, adjacent``, ``paragraphs`` has
    ``session, ordinal, text``. Paragraphs of the window and those that its adjacent
    context holds already are left out.
    """
    asked = windows.select("session", "window", "first", "last", T.normalise_space(F.col("adjacent")).alias("adjacent"), features(F.col("text")).alias("source"))
    given = paragraphs.select("session", "ordinal", "text", T.normalise_space(F.col("text")).alias("flat"), features(F.col("text")).alias("candidate"))
    pairs = asked.join(given, "session").where(~F.col("ordinal").between(F.col("first"), F.col("last")) & ~F.col("adjacent").contains(F.col("flat")))
    scored = pairs.select("session", "window", "ordinal", similarity(F.col("source"), F.col("candidate")).alias("score"), "text")
    return scored.where("score > 0")


def lecture_reference(windows: DataFrame, paragraphs: DataFrame, limit: int = REFERENCE_CHARACTERS) -> DataFrame:
    """``session, window, n_paragraphs, reference``: the most similar paragraphs, as many as fill a budget of characters.

    The last one is cut. A running length tells which can still fit, so that only those
    few meet in a row.
    """
    order = Window.partitionBy("session", "window").orderBy(F.desc("score"), "ordinal")
    before = F.coalesce(F.sum(F.length(F.trim("text")) + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scored = scored_paragraphs(windows, paragraphs).where(F.trim("text") != "")
    near = scored.withColumn("place", F.row_number().over(order)).withColumn("allowed", F.lit(limit) - before).where("allowed > 0")
    kept = near.withColumn("text", F.trim(F.substring(F.col("text"), F.lit(1), F.col("allowed").cast("int")))).where("text <> ''")
    listed = kept.groupBy("session", "window").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("taken"))
    return listed.select("session", "window", F.size("taken").alias("n_paragraphs"), F.array_join(F.transform("taken", lambda x: x["text"]), "\n\n").alias("reference"))
