"""Transcript segments: versions, order, projections, backlogs and set operations on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import normalise_space
from quillspark.functions.vocabulary import STAGE_PREFERENCES, STAGES
from quillspark.operators.paragraphs import ordered_text


def usable_version(versions: Column, stage: str | None = None) -> Column:
    """The revised version of a ``versions`` map, else the provisional one; or a named stage."""
    return versions[stage] if stage else F.coalesce(versions["revised"], versions["provisional"])


def project_transcript(segments: DataFrame, stage: str | None = None, integrated: bool = False) -> DataFrame:
    """``session, text, n_segments`` from segments with a ``versions`` map, in order of ordinal, start and id."""
    rows = segments if integrated else segments.where(~F.coalesce(F.col("integrated"), F.lit(False)))
    text = rows.withColumn("text", usable_version(F.col("versions"), stage)).where("text IS NOT NULL")
    return text.groupBy("session").agg(ordered_text(F.struct("ordinal", "start", "id"), F.col("text")).alias("text"), F.count("*").alias("n_segments"))


def summarise_sessions(segments: DataFrame, preview: int = 140) -> DataFrame:
    """A light row for each session: counts, a preview and whether there is a transcript."""
    each = segments.groupBy("session").agg(F.count("*").alias("n_segments"), ordered_text(F.col("ordinal"), F.col("text")).alias("text"))
    return each.select("session", "n_segments", F.substring("text", 1, preview).alias("preview"), (F.length("text") > 0).alias("has_transcript"))


def needs_translation(unit: Column) -> Column:
    """Whether a unit's translation is missing, in another language, of another revision, or else not marked done.

    ``unit`` has the fields translated, target, translated_target, translated_revision,
    source_revision and status.
    """
    blank = F.trim(F.coalesce(unit["translated"], F.lit(""))) == ""
    other = (F.coalesce(unit["target"], F.lit("")) != "") & ~unit["translated_target"].eqNullSafe(unit["target"])
    revised = F.coalesce(unit["translated_revision"], F.lit("")) != ""
    return F.when(blank | other, True).when(revised, unit["translated_revision"] != unit["source_revision"]).otherwise(~unit["status"].eqNullSafe(F.lit("translated")))


def live_eligible(units: DataFrame, first_live: Column) -> DataFrame:
    """Units for live work: they need it, belong to the recording, were never tried and did not fail."""
    return units.where(F.col("needs") & (F.col("ordinal") >= first_live) & (F.coalesce(F.col("attempts"), F.lit(0)) == 0) & (F.coalesce(F.col("status"), F.lit("")) != "error"))


def related_source(a: Column, b: Column) -> Column:
    """Whether either text begins with the other, both being something but for space."""
    x, y = normalise_space(a), normalise_space(b)
    return (x != "") & (y != "") & (x.startswith(y) | y.startswith(x))


def model_plan(installed: DataFrame, stage: str, explicit: str | None = None, legacy: str | None = None) -> DataFrame:
    """``stage, model, fallbacks``: installed ones of a stage's candidates, best first."""
    wanted = list(STAGE_PREFERENCES[stage])
    if explicit:
        wanted.insert(0, explicit)
    elif legacy:
        wanted.insert(STAGES.index(stage) + 1, legacy)
    ranks = installed.sparkSession.createDataFrame([(m, k) for k, m in enumerate(dict.fromkeys(wanted))], "model string, rank int")
    kept = ranks.join(installed.select("model").distinct(), "model", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "model"))), lambda x: x["model"])
    return kept.agg(ordered.alias("fallbacks")).select(F.lit(stage).alias("stage"), F.try_element_at("fallbacks", F.lit(1)).alias("model"), "fallbacks")


def fallback_model(requested: Column, installed: Column, default: str) -> Column:
    """The requested model if installed, else its latest tag, the default, or the first installed."""
    latest = F.concat(requested, F.lit(":latest"))
    return F.coalesce(
        F.when(F.array_contains(installed, requested), requested), F.when(F.array_contains(installed, latest), latest),
        F.when(F.array_contains(installed, F.lit(default)), F.lit(default)), F.try_element_at(installed, F.lit(1)),
    )


def stage_backlog(states: DataFrame) -> DataFrame:
    """``stage, queued, active, total`` of ``stage, status, has_version, eligible`` rows.

    Segments that have the stage's version are done whatever their status says.
    """
    open_ = ~F.col("has_version") & F.col("eligible")
    queued, active = F.count_if(open_ & (F.col("status") == "pending")), F.count_if(open_ & (F.col("status") == "running"))
    return states.groupBy("stage").agg(queued.alias("queued"), active.alias("active"), (queued + active).alias("total"))


def stage_rollup(states: DataFrame, *keys: str) -> DataFrame:
    """Unfinished, failed and completed of each group of ``status, has_version`` rows."""
    return states.groupBy(*keys).agg(
        F.count_if(F.col("status").isin("pending", "running")).alias("pending"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if("has_version").alias("completed"),
        F.count("*").alias("total"),
    )


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """``left`` with the first of the matching right rows by ``order``, or nulls; firsts are found map-side."""
    return left.join(_first_rows(right, on, order), on, "left")


def _first_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least ``order`` of each group of keys, null keys included."""
    others = [c for c in rows.columns if c not in keys and c != order]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(order, *others), F.struct(F.col(order).isNotNull(), order)).alias("__first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in rows.columns])


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, those of ``changes`` winning."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that are not in ``old`` or differ in any column: what has to be written."""
    before = old.select(F.col(key).alias("__k"), F.struct(*[c for c in new.columns if c != key]).alias("__old"))
    joined = new.join(before, new[key] == before["__k"], "left")
    return joined.where(~F.struct(*[c for c in new.columns if c != key]).eqNullSafe(F.col("__old"))).select(*new.columns)


def idempotent_output(existing: DataFrame, produced: DataFrame, key: str, replaceable: DataFrame) -> DataFrame:
    """``key, action``: write what is new, keep equal bytes, replace known degraded ones, refuse the rest."""
    rows = produced.select(key, F.sha2("content", 256).alias("new")).join(existing.select(key, F.sha2("content", 256).alias("old")), key, "left")
    known = replaceable.select(F.col("hash").alias("old"), F.lit(True).alias("degraded")).distinct()
    joined = rows.join(known, "old", "left")
    action = F.when(F.col("old").isNull(), "write").when(F.col("old") == F.col("new"), "keep").when(F.col("degraded"), "replace").otherwise("refuse")
    return joined.select(key, action.alias("action"))


def keep_last(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def daily_sequence(rows: DataFrame, date_col: str, order: list[str], counters: DataFrame | None = None) -> DataFrame:
    """Numbers within a date that go on from the highest one ever given out there."""
    number = F.row_number().over(Window.partitionBy(date_col).orderBy(*order))
    if counters is None:
        return rows.withColumn("sequence", number)
    high = counters.select(F.col(date_col).alias("__d"), F.col("high"))
    return rows.join(high, rows[date_col] == F.col("__d"), "left").withColumn("sequence", number + F.coalesce("high", F.lit(0))).drop("__d", "high")


def idempotent_ingest(chunks: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The first arrival of each chunk; later ones with its key are the same chunk."""
    return _first_rows(chunks, keys, arrival)


def neighbour_after_delete(rows: DataFrame, key: str, order: str) -> DataFrame:
    """For each row the one to select when it is deleted: the next, else the previous."""
    w = Window.partitionBy("session").orderBy(order)
    return rows.select("session", key, F.coalesce(F.lead(key).over(w), F.lag(key).over(w)).alias("neighbour"))


def public_session(sessions: DataFrame, private: tuple[str, ...] = ("stored_path", "extracted_text")) -> DataFrame:
    """Sessions without their private columns, with whether they have a transcript."""
    kept = sessions.drop(*private)
    return kept.withColumn("has_transcript", F.length(F.trim(F.coalesce("transcript", F.lit("")))) > 0)


def segment_texts(groups: DataFrame, segments: DataFrame) -> DataFrame:
    """``session, paragraph, text`` of ``session, paragraph, ordinals``: each segment's text in order, missing ones empty."""
    each = groups.select("session", "paragraph", F.posexplode("ordinals").alias("place", "ordinal"))
    joined = each.join(segments.select("session", "ordinal", "text"), ["session", "ordinal"], "left")
    return joined.groupBy("session", "paragraph").agg(ordered_text(F.col("place"), F.col("text")).alias("text"))


def repair_totals(attempts: DataFrame) -> DataFrame:
    """Accepted and rejected edits of each session over its windows' attempts, and whether any was kept."""
    each = attempts.select("session", F.explode_outer("attempts").alias("a"))
    totals = each.groupBy("session").agg(F.coalesce(F.sum("a.accepted"), F.lit(0)).alias("accepted"), F.coalesce(F.sum("a.rejected"), F.lit(0)).alias("rejected"))
    return totals.withColumn("retained", F.col("accepted") > 0)


def resume_plan(cases: DataFrame, done: DataFrame) -> DataFrame:
    """``case, action`` for a rerun: what is complete under equal run and case fingerprints is kept."""
    before = done.select("case", F.col("run_fp").alias("__run"), F.col("case_fp").alias("__case"), F.col("status").alias("__status"))
    joined = cases.join(before, "case", "left")
    same = F.col("run_fp").eqNullSafe(F.col("__run")) & F.col("case_fp").eqNullSafe(F.col("__case"))
    action = F.when(F.col("__run").isNull(), "start").when(~F.col("run_fp").eqNullSafe(F.col("__run")), "refuse").when(same & (F.col("__status") == "complete"), "keep").otherwise("rerun")
    return joined.select("case", action.alias("action"))
