"""Translation units of a growing text: assembly, stable identities and timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T


def assemble(texts: DataFrame, finalize: bool = False) -> DataFrame:
    """``session, ordinal, text, key, pending`` from ``session, text``: finished sentences and what is still open.

    A unit's key is its text's fingerprint and how many equal ones came before it, so it
    stays the same while text is appended. With ``finalize`` the open end is a unit too.
    """
    parts = texts.select("session", T.stable_sentences(F.col("text")).alias("done"), T.unfinished_tail(F.col("text")).alias("tail"))
    tail = F.when(F.col("tail") != "", F.array(F.struct(F.col("tail").alias("text"), F.lit(not finalize).alias("pending"))))
    units = F.concat(F.transform("done", lambda s: F.struct(s.alias("text"), F.lit(False).alias("pending"))), F.coalesce(tail, F.array().cast("array<struct<text:string,pending:boolean>>")))
    rows = parts.select("session", F.posexplode(units).alias("ordinal", "u")).select("session", "ordinal", "u.text", "u.pending")
    number = F.row_number().over(Window.partitionBy("session", "text").orderBy("ordinal")) - 1
    return rows.withColumn("key", F.concat_ws(":", T.fingerprint(F.col("text")), number.cast("string")))


def append_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """``session, grows, suffix``: whether the new text only continues the old one, and with what."""
    joined = before.select("session", T.normalise_space(F.col("text")).alias("old")).join(after.select("session", T.normalise_space(F.col("text")).alias("new")), "session")
    grows = F.col("new").startswith(F.col("old"))
    return joined.select("session", grows.alias("grows"), F.when(grows, F.ltrim(F.substring(F.col("new"), F.length("old") + 1, F.length("new")))).alias("suffix"))


def reuse_identities(units: DataFrame, previous: DataFrame) -> DataFrame:
    """``session, ordinal, id, reused``: the earlier unit that each unit goes on from.

    First by equal text in order of occurrence, then by the same place if that unit is
    still free; the rest are new and get their key as id.
    """
    by_text = previous.select("session", "key", F.col("id").alias("text_id"))
    exact = units.join(by_text, ["session", "key"], "left")
    taken = exact.where("text_id IS NOT NULL").select("session", F.col("text_id").alias("id"))
    free = previous.join(taken, ["session", "id"], "left_anti").select("session", "ordinal", F.col("id").alias("place_id"))
    joined = exact.join(free, ["session", "ordinal"], "left")
    found = F.coalesce("text_id", "place_id")
    return joined.select("session", "ordinal", F.coalesce(found, "key").alias("id"), found.isNotNull().alias("reused"))


def timing(units: DataFrame, segments: DataFrame) -> DataFrame:
    """``session, ordinal, start, end`` of units from the segments that hold them or that they hold."""
    parts = segments.select("session", T.normalise_space(F.col("text")).alias("piece"), F.col("start").alias("s"), F.col("end").alias("e")).where("piece <> ''")
    joined = units.select("session", "ordinal", "text").join(parts, "session", "left")
    hit = F.col("text").contains(F.col("piece")) | F.col("piece").contains(F.col("text"))
    return joined.groupBy("session", "ordinal").agg(F.min(F.when(hit, F.col("s"))).alias("start"), F.max(F.when(hit, F.col("e"))).alias("end"))


def rolling_context(rows: DataFrame, key: str, order: str, text_col: str, back: int = 2, limit: int = 1800) -> DataFrame:
    """Each row with the end of what came in the ``back`` rows before it."""
    before = F.array_join(F.collect_list(text_col).over(Window.partitionBy(key).orderBy(order).rowsBetween(-back, -1)), "\n")
    return rows.select(key, order, F.right(before, F.lit(limit)).alias("context"))


def selection(response: Column, most: int = 8) -> Column:
    """``ids, problem`` of a selector's JSON answer: at most eight ids like C3."""
    parsed = F.from_json(response, "candidateIds array<string>")["candidateIds"]
    valid = F.forall(parsed, lambda x: x.rlike("^C[0-9]+$"))
    problem = F.when(parsed.isNull(), "invalid-json").when((F.size(parsed) > most) | ~valid, "invalid-candidate-list")
    return F.struct(F.when(problem.isNull(), parsed).otherwise(F.array().cast("array<string>")).alias("ids"), problem.alias("problem"))


def change_marker(*columns: Column) -> Column:
    """One string that changes with any of the columns."""
    return F.to_json(F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(f"f{k}") for k, c in enumerate(columns)]))


def poll_delay(failures: Column, base_ms: int = 1000, cap_ms: int = 30_000, most: int = 5) -> Column:
    """Twice the delay after each failure, up to a cap."""
    return F.least(F.lit(cap_ms), F.lit(base_ms) * F.pow(F.lit(2), F.least(F.lit(most), failures))).cast("long")


def unit_status(rows: DataFrame, *keys: str) -> DataFrame:
    """The status of groups of units: failed if one is, done if all are, else open."""
    return rows.groupBy(*keys).agg(
        F.when(F.bool_or(F.col("status") == "error"), "error").when(F.bool_and(F.col("status") == "translated"), "translated").otherwise("pending").alias("status"), F.count("*").alias("n_units")
    )
