"""What depends on what, and what a change makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import fingerprint
from quillspark.functions.vocabulary import DEPENDENCIES, MATERIAL_ROOTS

LANGUAGE_BOUND = ("translation", "cleanedTranslation", "rawTranslation", "notesTranslation", "outlineTranslation")
#: The longest chain of dependencies.
DEPTH = 3


def dependency_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEPENDENCIES), "key string, parent string")


def closure(spark: SparkSession) -> DataFrame:
    """``ancestor, key``: every artifact below every other; a table of a few dozen rows."""
    parents = dict(DEPENDENCIES)
    rows = []
    for key in parents:
        above: str | None = key
        while above in parents:
            above = parents[above]
            rows.append((above, key))
    return spark.createDataFrame(rows, "ancestor string, key string")


def resolve_dependency(artifacts: DataFrame) -> DataFrame:
    """``session, key, parent, parent_fp`` for each artifact: what it is made from and that text's fingerprint.

    Analysis artifacts fall back to the raw transcript where there is no cleaned one.
    """
    spark = artifacts.sparkSession
    texts = artifacts.select("session", F.col("key").alias("parent"), fingerprint(F.col("content")).alias("parent_fp"), (F.length("content") > 0).alias("filled"))
    cleaned = texts.where((F.col("parent") == "cleanedTranscript") & F.col("filled")).select("session", F.lit(True).alias("has_cleaned"))
    joined = artifacts.select("session", "key").join(dependency_table(spark), "key").join(cleaned, "session", "left")
    falls = F.col("key").isin("keyPoints", "qa", "structuredAnalysis", "notes", "outline") & F.col("has_cleaned").isNull()
    parent = joined.select("session", "key", F.when(falls, "rawTranscript").otherwise(F.col("parent")).alias("parent"))
    return parent.join(texts.drop("filled"), ["session", "parent"], "left").select("session", "key", "parent", F.coalesce("parent_fp", fingerprint(F.lit(""))).alias("parent_fp"))


def raw_change(artifacts: DataFrame) -> DataFrame:
    """Artifacts after a change of the raw transcript: all that come from it are stale."""
    below = closure(artifacts.sparkSession).where("ancestor = 'rawTranscript'").select("key", F.lit(True).alias("hit"))
    return artifacts.join(below, "key", "left").withColumn("stale", F.col("stale") | F.coalesce("hit", F.lit(False))).drop("hit")


def material_change(artifacts: DataFrame) -> DataFrame:
    """``session, key`` of artifacts that a change of materials makes stale.

    Staleness spreads from the roots along dependents and stops at a manual edit; the
    chain is short, so it is unrolled into joins.
    """
    spark = artifacts.sparkSession
    live = artifacts.where(F.coalesce(F.col("source"), F.lit("")) != "manual-edit").select("session", "key")
    edges = dependency_table(spark).where(F.col("parent").isin("cleanedTranscript", "notes", "outline"))
    reached = live.where(F.col("key").isin(*MATERIAL_ROOTS))
    front = reached
    for _ in range(DEPTH - 1):
        front = front.withColumnRenamed("key", "parent").join(edges, "parent").select("session", "key").join(live, ["session", "key"], "left_semi")
        reached = reached.union(front)
    return reached.distinct()


def direct_dependents(artifacts: DataFrame, changed: str) -> DataFrame:
    """``session, key`` of what is made from ``changed`` itself."""
    edges = dependency_table(artifacts.sparkSession).where(F.col("parent") == changed)
    return artifacts.join(edges, "key", "left_semi").select("session", "key")


def language_change(key: Column) -> Column:
    """Whether a change of the target language makes an artifact stale."""
    return key.isin(*LANGUAGE_BOUND)


def valid(artifacts: DataFrame) -> DataFrame:
    """``session, key, valid``: manual edits of documents are; others need content, freshness and the fingerprint of what they are made from."""
    now = resolve_dependency(artifacts).select("session", "key", F.col("parent").alias("now_parent"), F.col("parent_fp").alias("now_fp"))
    joined = artifacts.join(now, ["session", "key"], "left")
    manual = (F.coalesce(F.col("source"), F.lit("")) == "manual-edit") & F.col("key").isin("cleanedTranscript", "notes", "outline")
    same = F.col("now_parent").isNull() | (F.col("depends_on").eqNullSafe(F.col("now_parent")) & F.col("depends_fp").eqNullSafe(F.col("now_fp")))
    return joined.select("session", "key", (manual | ((F.length(F.coalesce("content", F.lit(""))) > 0) & ~F.col("stale") & same)).alias("valid"))


def optimistic_write(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """``session, key, accepted, reason``: a write is refused if what it was made from has changed meanwhile."""
    now = resolve_dependency(current).select("session", "key", F.col("parent").alias("p"), F.col("parent_fp").alias("fp"))
    state = current.select("session", "key", F.col("source").alias("cur_source"))
    joined = incoming.join(now, ["session", "key"], "left").join(state, ["session", "key"], "left")
    manual = (F.coalesce(F.col("cur_source"), F.lit("")) == "manual-edit") & ~F.coalesce(F.col("overwrite"), F.lit(False))
    reason = F.when(F.col("p").isNotNull() & ~F.col("depends_on").eqNullSafe(F.col("p")), "dependency-key").when(
        F.col("p").isNotNull() & ~F.col("depends_fp").eqNullSafe(F.col("fp")), "dependency-changed").when(manual, "manual-edit")
    return joined.select("session", "key", reason.isNull().alias("accepted"), reason.alias("reason"))


def latest_attempts(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose token and source revision are still the current ones."""
    return results.where((F.col("token") == F.col("current_token")) & (F.col("source_revision") == F.col("current_revision"))).select(*keys)


def recover(status: Column) -> Column:
    """What becomes of a state after a crash: running work failed, queued work waits."""
    return F.when(status == "running", "error").when(status == "pending", "deferred").otherwise(status)


def merge_edit(base: Column, edited: Column, current: Column) -> Column:
    """An edit of a growing text: what was appended meanwhile goes after it; any other change gives way to it."""
    b, e, c = (F.coalesce(x, F.lit("")) for x in (base, edited, current))
    appended = F.substring(c, F.length(b) + 1, F.length(c))
    grows = (c != e) & c.startswith(b) & (appended != "") & ~e.endswith(appended)
    return F.when(grows, F.concat(e, appended)).otherwise(e)


def reuse_regions(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` with ``cleaned``: the cached text where its fingerprint and text are the same, else null."""
    known = cache.where(F.col("cleaned").isNotNull()).select("fp", "text", "cleaned").dropDuplicates(["fp", "text"])
    return wanted.join(known, ["fp", "text"], "left")
