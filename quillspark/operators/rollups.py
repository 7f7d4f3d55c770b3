"""Roll-ups of runs: completion, queues, usage, attempts, numbered titles and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T


def completion(segments: DataFrame) -> DataFrame:
    """``session, state, completed, failed, expected, models`` of ``session, ordinal, has_version, status, model`` rows.

    All versions there: complete; else error if a segment failed, else running. Models are
    those of the versions, each at its first segment's place.
    """
    first = segments.where(F.col("has_version") & (F.col("model") != "")).groupBy("session", "model").agg(F.min("ordinal").alias("at"))
    models = first.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("models"))
    totals = segments.groupBy("session").agg(F.count_if("has_version").alias("completed"), F.count_if(F.col("status") == "error").alias("failed"), F.count("*").alias("expected"))
    state = F.when(F.col("completed") == F.col("expected"), "complete").when(F.col("failed") > 0, "error").otherwise("running")
    return totals.join(models, "session", "left").select("session", state.alias("state"), "completed", "failed", "expected", F.coalesce("models", F.array().cast("array<string>")).alias("models"))


def queue_snapshot(jobs: DataFrame, now: Column) -> DataFrame:
    """``lane, active, queued, oldest_active, oldest_queued`` of ``lane, enqueued, started, ended`` jobs at a time; ages in the unit of the times."""
    active = F.col("started").isNotNull() & (F.col("started") <= now) & (F.col("ended").isNull() | (F.col("ended") > now))
    queued = (F.col("enqueued") <= now) & (F.col("started").isNull() | (F.col("started") > now))
    return jobs.groupBy("lane").agg(
        F.count_if(active).alias("active"), F.count_if(queued).alias("queued"),
        F.coalesce(F.max(F.when(active, now - F.col("started"))), F.lit(0.0)).alias("oldest_active"), F.coalesce(F.max(F.when(queued, now - F.col("enqueued"))), F.lit(0.0)).alias("oldest_queued"),
    )


def token_usage(chunks: DataFrame, *keys: str) -> DataFrame:
    """Input and output tokens over the chunks of each group; a missing count is none."""
    return chunks.groupBy(*keys).agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))


def timeline_offset(segments: DataFrame) -> DataFrame:
    """Where a continued recording begins: the latest end of a session's segments, at least 0."""
    return segments.groupBy("session").agg(F.greatest(F.lit(0.0), F.max(F.coalesce("timeline_end", "end", F.lit(0.0)))).alias("offset"))


def run_status(cases: DataFrame, *keys: str) -> DataFrame:
    """Degraded cases and inference errors of each run; a run with a degraded case is degraded."""
    totals = cases.groupBy(*keys).agg(F.count_if(F.col("status") == "degraded").alias("degraded_cases"), F.sum(F.coalesce("inference_errors", F.lit(0))).alias("inference_errors"))
    return totals.withColumn("status", F.when(F.col("degraded_cases") > 0, "degraded").otherwise("complete"))


def distinct_sets(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, members``: the different values of each group in the order of their first rows, without blanks."""
    first = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key, value).agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("members"))


def settled_attempts(attempts: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """The attempt that a bounded retry ends with, of ``keys, attempt, accepted, rejected, error`` rows (attempts from 1).

    The first that accepted something, rejected nothing or failed outright; else the last allowed one.
    """
    allowed = attempts.where(F.col("attempt") <= most)
    ends = F.col("error") | (F.col("accepted") > 0) | (F.col("rejected") == 0)
    chosen = F.coalesce(F.min(F.when(ends, F.col("attempt"))), F.max("attempt"))
    last = allowed.groupBy(*keys).agg(chosen.alias("attempt"))
    return allowed.join(last, [*keys, "attempt"], "left_semi")


def ensured(artifacts: DataFrame, results: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """``keys, outcome, attempt`` of asking for artifacts: reused if valid, else the first of ``most`` results that isn't stale.

    ``artifacts`` has ``keys, valid``; ``results`` has ``keys, attempt, stale`` (attempts from 1).
    """
    first = results.where(F.col("attempt") <= most).groupBy(*keys).agg(F.min(F.when(~F.col("stale"), F.col("attempt"))).alias("first"), F.count("*").alias("tried"))
    joined = artifacts.join(first, keys, "left")
    outcome = F.when(F.col("valid"), "reused").when(F.col("first").isNotNull(), "generated").when(F.coalesce(F.col("tried"), F.lit(0)) >= most, "stale").otherwise("pending")
    return joined.select(*keys, outcome.alias("outcome"), F.when(~F.col("valid"), F.col("first")).alias("attempt"))


def newest_first(sessions: DataFrame, time: str, key: str) -> DataFrame:
    """Sessions by time, the newest first; ties by key. Times are ISO strings, so their order is that of text."""
    return sessions.orderBy(F.desc(time), key)


def first_live_ordinal(prefix: Column) -> Column:
    """How many units a recording's earlier text holds: the ordinal of its first live one."""
    return F.size(T.stable_sentences(prefix))


def title_high_water(sessions: DataFrame, counters: DataFrame, requests: DataFrame, prefix: str = "Lecture") -> DataFrame:
    """``date, label, high``: the highest number ever given out for each requested date and label.

    ``sessions`` has ``title, created, title_date, title_index``, ``counters`` has ``date,
    high`` and outlives deleted sessions. A title without a number counts as the first of
    its own date; a number in a title counts wherever it stands.
    """
    asked = requests.select("date", "label").distinct().withColumn("base", F.concat(F.lit(f"{prefix} — "), F.col("label")))
    numbered = F.regexp_extract(F.col("title"), r"^(.*) — (\d{1,15})\z", 1)
    index = F.regexp_extract(F.col("title"), r"^(.*) — (\d{1,15})\z", 2).try_cast("long")
    by_title = sessions.select(numbered.alias("base"), index.alias("n")).where("n IS NOT NULL").groupBy("base").agg(F.max("n").alias("by_title"))
    plain = sessions.groupBy(F.col("title").alias("base"), F.col("created").alias("date")).agg(F.lit(1).cast("long").alias("plain"))
    stored = sessions.where("title_index IS NOT NULL").groupBy(F.col("title_date").alias("date")).agg(F.max("title_index").alias("stored"))
    joined = asked.join(by_title, "base", "left").join(plain, ["base", "date"], "left").join(stored, "date", "left").join(counters.select("date", "high"), "date", "left")
    none = F.lit(0).cast("long")
    return joined.select("date", "label", F.greatest(none, F.coalesce("high", none), F.coalesce("stored", none), F.coalesce("by_title", none), F.coalesce("plain", none)).alias("high"))


def numbered_titles(requests: DataFrame, sessions: DataFrame, counters: DataFrame, order: str, prefix: str = "Lecture") -> DataFrame:
    """``requests`` (``date, label`` and an order) with ``index, title``: numbers go on from the highest and are never used again."""
    high = title_high_water(sessions, counters, requests, prefix)
    joined = requests.join(high, ["date", "label"])
    index = F.col("high") + F.row_number().over(Window.partitionBy("date", "label").orderBy(order))
    return joined.withColumn("index", index.cast("long")).drop("high").withColumn("title", F.concat(F.lit(f"{prefix} — "), F.col("label"), F.lit(" — "), F.col("index").cast("string")))


def copy_plan(source: DataFrame, target: DataFrame, key: str = "path") -> DataFrame:
    """``path, action``: what copying a workspace does with each entry; nothing is overwritten."""
    there = target.select(key).distinct().withColumn("__there", F.lit(True))
    return source.select(key).distinct().join(there, key, "left").select(key, F.when(F.col("__there"), "keep").otherwise("copy").alias("action"))


def late_results(results: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Results with ``verdict``: those of an older token or revision come too late, whenever they arrive."""
    now = state.select(*keys, F.col("token").alias("__token"), F.col("revision").alias("__revision"))
    joined = results.join(now, keys, "left")
    verdict = (
        F.when(F.col("__token").isNull(), "unknown").when(~F.col("token").eqNullSafe(F.col("__token")), "other-job")
        .when(F.col("revision") < F.col("__revision"), "stale").otherwise("applied")
    )
    return joined.withColumn("verdict", verdict).drop("__token", "__revision")


def claimed_units(claims: DataFrame, units: DataFrame) -> DataFrame:
    """``session, unit, claim, granted``: a unit goes to its first claim that fits it, once.

    ``claims`` has ``session, unit, claim, at, revision, language``; ``units`` has ``session,
    unit, revision, language, needs, attempted, status``.
    """
    now = units.select("session", "unit", F.col("revision").alias("__r"), F.col("language").alias("__l"), (F.col("needs") & ~F.col("attempted") & (F.coalesce("status", F.lit("")) != "error")).alias("__open"))
    joined = claims.join(now, ["session", "unit"], "left")
    fits = F.coalesce(F.col("__open") & (F.col("revision") == F.col("__r")) & (F.col("language") == F.col("__l")), F.lit(False))
    first = joined.where(fits).groupBy("session", "unit").agg(F.min(F.struct("at", "claim")).alias("first")).select("session", "unit", F.col("first.claim").alias("__won"))
    return claims.join(first, ["session", "unit"], "left").select("session", "unit", "claim", F.coalesce(F.col("claim") == F.col("__won"), F.lit(False)).alias("granted"))


def drained_at(snapshots: DataFrame, lane: str, at: str) -> DataFrame:
    """When each lane was idle for good: the second of two empty snapshots in a row, null if there was none."""
    empty = (F.col("queued") == 0) & (F.col("active") == 0)
    before = F.lag(empty).over(Window.partitionBy(lane).orderBy(at))
    rows = snapshots.withColumn("__done", empty & F.coalesce(before, F.lit(False)))
    return rows.groupBy(lane).agg(F.min(F.when(F.col("__done"), F.col(at))).alias("drained_at"))


def frame_batches(frames: DataFrame, size: int = 2048) -> DataFrame:
    """``key, batch, samples`` of ``key, at, samples, flush`` frames: arrays of ``size`` samples, the rest at the flush.

    What comes after a key's first flush is not recorded. Places follow from running
    lengths, so only samples are grouped, by batch.
    """
    order = Window.partitionBy("key").orderBy("at")
    flushed = F.max(F.col("flush").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.sum(F.size("samples")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = frames.withColumn("__after", F.coalesce(flushed, F.lit(0))).where("__after = 0").withColumn("__start", start)
    ends = kept.groupBy("key").agg(F.max("flush").alias("__flush"))
    each = kept.select("key", "__start", F.posexplode("samples").alias("i", "x")).withColumn("n", F.col("__start") + F.col("i"))
    batches = each.groupBy("key", F.floor(F.col("n") / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("samples"))
    return batches.join(ends, "key").where((F.size("samples") == size) | F.col("__flush")).drop("__flush")
