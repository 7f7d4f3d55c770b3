"""Queries over keyed state: a stream that is run to its end, folds in order of time, and committed versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.unit_queries import d_units
from quillspark.session import checkpoint_dir, load, share_code
from quillspark.sources.commits import CommittedTable
from quillspark.streaming import stateful

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that checks it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(f"""SELECT CAST(session AS VARCHAR) AS session, CAST(ordinal AS BIGINT) AS ordinal, text, key FROM ({d_units("(SELECT conv_id AS session, string_agg(coalesce(text, '') || ' ', '' ORDER BY turn) AS text FROM conversations GROUP BY 1)", "text")}) WHERE NOT pending""")
def streamed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished sentences of conversations whose turns come as a stream, from its files to its end."""
    share_code(spark)
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("long").alias("seq"), F.concat(F.coalesce("text", F.lit("")), F.lit(" ")).alias("text"), F.lit(False).alias("last"))
    # A stream reads folders of files that don't change, so the turns are written as such once, dealt anyhow.
    turns.repartition(4, "seq").write.parquet(f"{folder}/in")
    pieces = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    run = stateful.assembled(pieces).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stateful.UNITS).parquet(f"{folder}/out").select("session", "ordinal", "text", "key")


_D_EVENTS = "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, event_id % 3 AS revision, CASE WHEN event_type = 'view' THEN 'fr' ELSE 'en' END AS language, 't' || (event_id // 50 % 2) AS token, event_id % 5 = 0 AS opens FROM events"
_D_BEFORE = "OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _events(spark: SparkSession, sf_dir: str, opening: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 5 == 0, opening).otherwise("other")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 3).alias("revision"),
        F.when(F.col("event_type") == "view", "fr").otherwise("en").alias("language"), F.concat(F.lit("t"), (F.floor(F.col("event_id") / 50) % 2).cast("string")).alias("token"),
    )


@query(f"""WITH e AS ({_D_EVENTS}), s AS (SELECT *, last_value(CASE WHEN opens THEN token END IGNORE NULLS) {_D_BEFORE} AS now_token, last_value(CASE WHEN opens THEN revision END IGNORE NULLS) {_D_BEFORE} AS now_revision FROM e)
  SELECT key, id, CASE WHEN now_token IS NULL THEN 'unknown' WHEN token <> now_token THEN 'other-job' WHEN revision < now_revision THEN 'stale' ELSE 'applied' END AS verdict FROM s WHERE NOT opens""")
def ordered_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results judged by the job and revision that their key had when they came."""
    share_code(spark)
    return stateful.in_order_batch(_events(spark, sf_dir, "state"), ["key"], stateful.verdict_step, stateful.VERDICTS)


@query(f"""WITH e AS ({_D_EVENTS}), s AS (SELECT *, last_value(CASE WHEN opens THEN revision END IGNORE NULLS) {_D_BEFORE} AS r, last_value(CASE WHEN opens THEN language END IGNORE NULLS) {_D_BEFORE} AS l FROM e),
  f AS (SELECT *, coalesce(revision = r AND language = l, false) AS fits FROM s WHERE NOT opens) SELECT key, id, fits AND id = min(CASE WHEN fits THEN id END) OVER (PARTITION BY key) AS granted FROM f""")
def ordered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim that fits what its key is open for."""
    share_code(spark)
    return stateful.in_order_batch(_events(spark, sf_dir, "unit"), ["key"], stateful.claim_step, stateful.GRANTS)


@query("""SELECT key, id, lag(id, 50) OVER w AS evicted_id, row_number() OVER w AS n_seen, least(50, row_number() OVER w) AS n_held FROM (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id FROM events) WINDOW w AS (PARTITION BY key ORDER BY id)""")
def telemetry_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event each event drives out of its key's log of fifty."""
    share_code(spark)
    rows = _events(spark, sf_dir, "start").withColumn("item", F.col("id") % 7)
    return stateful.in_order_batch(rows, ["key"], stateful.telemetry_step(), stateful.TELEMETRY).select("key", "id", "evicted_id", "n_seen", "n_held")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'edited' ELSE role END AS role, length(text) AS n_chars FROM conversations""")
def committed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns after two commits: all of them, then an edit of every second one as it was read."""
    table = CommittedTable(spark, f"{checkpoint_dir(spark)}/committed-{uuid.uuid4().hex}", ["conv_id", "turn"])
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    table.commit(turns.withColumn("expected_fp", F.lit(None).cast("string")))
    edited = table.read().where(F.col("turn") % 2 == 0).select("conv_id", "turn", F.lit("edited").alias("role"), "n_chars", F.col("row_fp").alias("expected_fp"))
    table.commit(edited)
    return table.read().drop("row_fp")
