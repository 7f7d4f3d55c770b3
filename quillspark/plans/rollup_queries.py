"""Queries over runs, queues, titles, values and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import rollups
from quillspark.plans.text_queries import D_PAIRS, d_distance, d_space
from quillspark.session import load
from quillspark.streaming import segmentation

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that checks it, if any."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), "role", "text")


# A turn stands for a segment: which model made it, and whether it is there, follow from its numbers.
_D_STATES = """SELECT conv_id AS session, turn AS ordinal, (conv_id % 3 = 0) OR (turn % 3 <> 2) AS has_version, CASE WHEN conv_id % 5 = 1 AND turn % 3 = 2 THEN 'error' ELSE 'pending' END AS status,
  CASE WHEN conv_id % 4 = 3 THEN '' WHEN turn % 2 = 0 THEN 'large' ELSE 'turbo' END AS model FROM conversations"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = F.col("session"), F.col("ordinal")
    return _turns(spark, sf_dir).select(
        s, o, ((s % 3 == 0) | (o % 3 != 2)).alias("has_version"), F.when((s % 5 == 1) & (o % 3 == 2), "error").otherwise("pending").alias("status"),
        F.when(s % 4 == 3, "").when(o % 2 == 0, "large").otherwise("turbo").alias("model"),
    )


@query(f"""SELECT t.session, CASE WHEN completed = expected THEN 'complete' WHEN failed > 0 THEN 'error' ELSE 'running' END AS state, completed, failed, expected, coalesce(models, '') AS models FROM (
  SELECT session, count(*) FILTER (has_version) AS completed, count(*) FILTER (status = 'error') AS failed, count(*) AS expected FROM ({_D_STATES}) GROUP BY session) t
  LEFT JOIN (SELECT session, string_agg(model, ',' ORDER BY seen) AS models FROM (SELECT session, model, min(ordinal) AS seen FROM ({_D_STATES}) WHERE has_version AND model <> '' GROUP BY 1, 2) GROUP BY 1) m ON m.session = t.session""")
def completion_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollups.completion(_states(spark, sf_dir))
    return found.withColumn("models", F.array_join("models", ","))


_D_JOBS = "SELECT CAST(user_id AS VARCHAR) AS lane, CAST(event_id AS DOUBLE) AS enqueued, CASE WHEN event_type <> 'error' THEN event_id + value END AS started, CASE WHEN event_id % 3 > 0 THEN event_id + 4 * value END AS ended FROM events"


@query(f"""SELECT lane, count(*) FILTER (a) AS active, count(*) FILTER (q) AS queued, coalesce(max(CASE WHEN a THEN 500.0 - started END), 0) AS oldest_active, coalesce(max(CASE WHEN q THEN 500.0 - enqueued END), 0) AS oldest_queued FROM (
  SELECT *, coalesce(started <= 500 AND (ended IS NULL OR ended > 500), false) AS a, enqueued <= 500 AND (started IS NULL OR started > 500) AS q FROM ({_D_JOBS})) GROUP BY lane""")
def queue_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each lane's queue holds at the time 500."""
    e, at = load(spark, sf_dir, "events"), F.col("event_id").cast("double")
    jobs = e.select(
        F.col("user_id").cast("string").alias("lane"), at.alias("enqueued"), F.when(F.col("event_type") != "error", at + F.col("value")).alias("started"),
        F.when(F.col("event_id") % 3 > 0, at + 4 * F.col("value")).alias("ended"),
    )
    return rollups.queue_snapshot(jobs, F.lit(500.0))


@query("""SELECT conv_id AS session, CAST(sum(CASE WHEN turn % 4 = 3 THEN 0 ELSE coalesce(length(text), 0) END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END) AS BIGINT) AS output_tokens
  FROM conversations GROUP BY 1""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    chunks = _turns(spark, sf_dir).select("session", F.when(F.col("ordinal") % 4 != 3, n).alias("input_tokens"), F.when(F.col("role") == "assistant", n).alias("output_tokens"))
    return rollups.token_usage(chunks, "session")


@query('SELECT conv_id AS session, greatest(0.0, max(CASE WHEN turn % 3 = 0 THEN 2.5 * turn + 1 ELSE coalesce(CASE WHEN turn % 3 = 1 THEN 2.0 * turn + 1 END, 0) END)) AS "offset" FROM conversations GROUP BY 1')
def timeline_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("ordinal")
    rows = _turns(spark, sf_dir).select("session", F.when(o % 3 == 0, 2.5 * o + 1).alias("timeline_end"), F.when(o % 3 == 1, 2.0 * o + 1).alias("end"))
    return rollups.timeline_offset(rows)


@query("""SELECT source AS run, count(*) FILTER (doc_id % 7 = 0 AND lang = 'en') AS degraded_cases, CAST(sum(CASE WHEN doc_id % 7 = 0 THEN doc_id % 5 ELSE 0 END) AS BIGINT) AS inference_errors,
  CASE WHEN count(*) FILTER (doc_id % 7 = 0 AND lang = 'en') > 0 THEN 'degraded' ELSE 'complete' END AS status FROM documents GROUP BY 1""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    odd = F.col("doc_id") % 7 == 0
    cases = d.select(F.col("source").alias("run"), F.when(odd & (F.col("lang") == "en"), "degraded").otherwise("complete").alias("status"), F.when(odd, F.col("doc_id") % 5).alias("inference_errors"))
    return rollups.run_status(cases, "run")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS members FROM (SELECT user_id, event_type, min(event_id) AS seen FROM events WHERE event_type <> '' GROUP BY 1, 2) GROUP BY 1""")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different event types of each user in the order of their first events."""
    found = rollups.distinct_sets(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return found.withColumn("members", F.array_join("members", ","))


_D_ATTEMPTS = "SELECT user_id AS session, event_id // 4 AS win, event_id % 4 + 1 AS attempt, CAST(floor(value) AS INT) % 2 AS accepted, CAST(floor(value) AS INT) % 3 AS rejected, event_type = 'error' AS error FROM events"


@query(f"""SELECT session, win, attempt, accepted, rejected, error FROM (SELECT *, coalesce(min(CASE WHEN error OR accepted > 0 OR rejected = 0 THEN attempt END) OVER w, max(attempt) OVER w) AS chosen FROM ({_D_ATTEMPTS}) WHERE attempt <= 2
  WINDOW w AS (PARTITION BY session, win)) WHERE attempt = chosen""")
def settled_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retry of two attempts ends with in each window."""
    e = load(spark, sf_dir, "events")
    points = F.floor("value").cast("int")
    attempts = e.select(
        F.col("user_id").alias("session"), F.floor(F.col("event_id") / 4).alias("win"), (F.col("event_id") % 4 + 1).alias("attempt"), (points % 2).alias("accepted"), (points % 3).alias("rejected"),
        (F.col("event_type") == "error").alias("error"),
    )
    return rollups.settled_attempts(attempts, ["session", "win"])


@query("""WITH a AS (SELECT DISTINCT user_id AS session, event_id // 50 AS key, (event_id // 50) % 3 = 0 AS valid FROM events),
  r AS (SELECT user_id AS session, event_id // 50 AS key, row_number() OVER (PARTITION BY user_id, event_id // 50 ORDER BY event_id) AS attempt, event_type <> 'click' AS stale FROM events),
  f AS (SELECT session, key, min(CASE WHEN NOT stale THEN attempt END) AS first, count(*) AS tried FROM r WHERE attempt <= 4 GROUP BY 1, 2)
  SELECT session, key, CASE WHEN valid THEN 'reused' WHEN first IS NOT NULL THEN 'generated' WHEN coalesce(tried, 0) >= 4 THEN 'stale' ELSE 'pending' END AS outcome, CAST(CASE WHEN NOT valid THEN first END AS INT) AS attempt
  FROM a LEFT JOIN f USING (session, key)""")
def ensured_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that are asked for: reused, made at the first result that isn't stale, or not to be had."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 50).alias("key"), "event_id", "event_type")
    artifacts = e.select("session", "key", (F.col("key") % 3 == 0).alias("valid")).distinct()
    number = F.row_number().over(Window.partitionBy("session", "key").orderBy("event_id"))
    results = e.select("session", "key", number.alias("attempt"), (F.col("event_type") != "click").alias("stale"))
    return rollups.ensured(artifacts, results, ["session", "key"])


@query("SELECT o_orderkey AS session, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created FROM orders")
def newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions, the newest first."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created"))
    return rollups.newest_first(rows, "created", "session")


@query(f"""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all({d_space("text")}, '{T.STABLE_SENTENCE.replace("'", "''")}'), lambda x: trim(x)), lambda x: x <> '')) AS INT) AS first_live FROM documents""")
def first_live_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first live unit's ordinal of a recording that goes on after each text."""
    return load(spark, sf_dir, "documents").select("doc_id", rollups.first_live_ordinal(F.col("text")).alias("first_live"))


# Orders stand for sessions and for requests of a numbered title: every fifth asks, others have titles of all sorts.
_D_TITLED = """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created, strftime(o_orderdate, '%d %b') AS label,
  CASE o_orderkey % 5 WHEN 1 THEN 'Lecture — ' || strftime(o_orderdate, '%d %b') WHEN 2 THEN 'Lecture — ' || strftime(o_orderdate, '%d %b') || ' — ' || CAST(o_custkey % 9 + 1 AS VARCHAR) WHEN 3 THEN 'My — 7' ELSE 'Notes' END AS title,
  CASE WHEN o_orderkey % 5 = 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS title_date, CASE WHEN o_orderkey % 5 = 4 THEN o_custkey % 6 END AS title_index, o_orderkey % 5 = 0 AS asks FROM orders"""


@query(f"""WITH t AS ({_D_TITLED}), c AS (SELECT created AS date, 3 AS high FROM t WHERE id % 11 = 0 GROUP BY 1), r AS (SELECT id, created AS date, label FROM t WHERE asks), s AS (SELECT * FROM t WHERE NOT asks),
  h AS (SELECT date, label, greatest(0, coalesce((SELECT max(high) FROM c WHERE c.date = q.date), 0), coalesce((SELECT max(title_index) FROM s WHERE s.title_date = q.date), 0),
    coalesce((SELECT max(CAST(regexp_extract(title, ' — (\\d+)$', 1) AS BIGINT)) FROM s WHERE regexp_extract(title, '^(.*) — (\\d+)$', 1) = 'Lecture — ' || q.label), 0),
    coalesce((SELECT 1 FROM s WHERE s.title = 'Lecture — ' || q.label AND s.created = q.date LIMIT 1), 0)) AS high FROM (SELECT DISTINCT date, label FROM r) q)
  SELECT id, date, label, CAST(high + row_number() OVER (PARTITION BY date, label ORDER BY id) AS BIGINT) AS index, 'Lecture — ' || label || ' — ' || CAST(high + row_number() OVER (PARTITION BY date, label ORDER BY id) AS VARCHAR) AS title
  FROM r JOIN h USING (date, label)""")
def numbered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for automatic titles by date, after stored numbers, titles' suffixes and counters."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    label, date = F.date_format("o_orderdate", "dd MMM"), F.date_format("o_orderdate", "yyyy-MM-dd")
    base = F.concat(F.lit("Lecture — "), label)
    title = F.when(k % 5 == 1, base).when(k % 5 == 2, F.concat(base, F.lit(" — "), (F.col("o_custkey") % 9 + 1).cast("string"))).when(k % 5 == 3, "My — 7").otherwise("Notes")
    rows = o.select(k.alias("id"), date.alias("created"), label.alias("label"), title.alias("title"), F.when(k % 5 == 4, date).alias("title_date"), F.when(k % 5 == 4, F.col("o_custkey") % 6).alias("title_index"))
    requests = rows.where(F.col("id") % 5 == 0).select("id", F.col("created").alias("date"), "label")
    counters = rows.where(F.col("id") % 11 == 0).select(F.col("created").alias("date"), F.lit(3).cast("long").alias("high")).distinct()
    return rollups.numbered_titles(requests, rows.where(F.col("id") % 5 != 0), counters, "id")


@query("""SELECT conv_id AS session, turn AS ordinal, regexp_matches(trim(text), '(?i)^(?:thanks|thank you)\\s+for\\s+watching[.!?…]*$') AS caption FROM (
  SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' Thanks for  watching! ' WHEN 1 THEN 'thank you for watching…' WHEN 2 THEN 'Thanks for watching the lecture.' ELSE coalesce(text, '') END AS text FROM conversations)""")
def stock_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which segments are closing captions made out of silence."""
    k = F.col("ordinal") % 4
    text = F.when(k == 0, " Thanks for  watching! ").when(k == 1, "thank you for watching…").when(k == 2, "Thanks for watching the lecture.").otherwise(F.col("text"))
    return _turns(spark, sf_dir).select("session", "ordinal", V.is_stock_caption(text).alias("caption"))


@query("""SELECT event_id, greatest(80.0, coalesce(nullif(try_cast(x AS DOUBLE), 0), 2200.0)) AS option, CAST(CASE WHEN try_cast(x AS DOUBLE) IS NULL THEN 3 ELSE greatest(0, floor(try_cast(x AS DOUBLE))) END AS BIGINT) AS size_limit,
  least(256.0, greatest(32.0, coalesce(nullif(try_cast(x AS DOUBLE), 0), 128.0))) AS bounded FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'many' WHEN 2 THEN '0' WHEN 3 THEN '-5.5' ELSE CAST(100 * value AS VARCHAR) END AS x FROM events)""")
def numeric_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options given as text, with defaults and bounds."""
    k = F.col("event_id") % 6
    x = F.when(k == 0, None).when(k == 1, "many").when(k == 2, "0").when(k == 3, "-5.5").otherwise((100 * F.col("value")).cast("string"))
    given = load(spark, sf_dir, "events").select("event_id", x.alias("x"))
    return given.select("event_id", V.numeric_option(F.col("x"), 2200, 80).alias("option"), V.size_limit(F.col("x"), 3).alias("size_limit"), V.numeric_option(F.col("x"), 128, 32, 256).alias("bounded"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_date, try_strptime(d, '%Y-%m-%d') IS NOT NULL AND regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') AND strftime(try_strptime(d, '%Y-%m-%d'), '%Y-%m-%d') = d AS valid
  FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS o_orderdate, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-02-30') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d')
  WHEN 3 THEN strftime(o_orderdate, '%Y-%m') || '-1' ELSE '' END AS d FROM orders)""")
def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local dates nine hours east, and which texts are dates."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    d = F.when(k % 5 == 0, F.date_format(at, "yyyy-MM-dd")).when(k % 5 == 1, F.concat(F.date_format(at, "yyyy"), F.lit("-02-30"))).when(k % 5 == 2, F.date_format(at, "yyyy/MM/dd")).when(k % 5 == 3, F.concat(F.date_format(at, "yyyy-MM"), F.lit("-1"))).otherwise("")
    moved = F.timestamp_seconds(F.unix_seconds(at.cast("timestamp")) + (k % 24) * 3600)
    return load(spark, sf_dir, "orders").select(k.alias("id"), V.local_date(moved, "Asia/Tokyo").alias("local_date"), V.is_calendar_date(d).alias("valid"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '2024-02-30' ELSE '2024-02-29' END AS date, left(trim(label), 80) AS label, page_id % 3 <> 2 AND trim(label) <> '' AS valid,
  trim(label) <> '' AS present FROM (SELECT page_id, CASE WHEN page_id % 4 = 1 THEN '  ' ELSE ' ' || repeat(coalesce(url, ''), 3) || ' ' END AS label FROM pages)""")
def title_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for numbered titles: which are valid."""
    k = F.col("page_id")
    label = F.when(k % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), F.repeat(F.coalesce("url", F.lit("")), 3), F.lit(" ")))
    date = F.when(k % 3 == 2, "2024-02-30").otherwise("2024-02-29")
    return load(spark, sf_dir, "pages").select("page_id", V.title_request(date, label).alias("r"), V.required_text(label)["problem"].isNull().alias("present")).select("page_id", "r.*", "present")


@query("""SELECT event_id, path, regexp_matches(resolved, '^/work/space(/|$)') AS inside, NOT (regexp_matches(resolved, '^/work/space/') OR starts_with('/work/space/', rtrim(resolved, '/') || '/')) OR resolved = '/work/space' AS may_copy FROM (
  SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'a/b' WHEN 1 THEN '../x' WHEN 2 THEN 'a/../../space/c' WHEN 3 THEN '/work/space2' WHEN 4 THEN '/work' WHEN 5 THEN '.' ELSE '/other/./q/..' END AS path,
  CASE event_id % 7 WHEN 0 THEN '/work/space/a/b' WHEN 1 THEN '/work/x' WHEN 2 THEN '/work/space/c' WHEN 3 THEN '/work/space2' WHEN 4 THEN '/work' WHEN 5 THEN '/work/space' ELSE '/other' END AS resolved FROM events)""")
def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths stay inside a workspace, and to which it may be copied."""
    k, root = F.col("event_id") % 7, F.lit("/work/space")
    path = F.when(k == 0, "a/b").when(k == 1, "../x").when(k == 2, "a/../../space/c").when(k == 3, "/work/space2").when(k == 4, "/work").when(k == 5, ".").otherwise("/other/./q/..")
    return load(spark, sf_dir, "events").select("event_id", path.alias("path")).select("event_id", "path", V.is_contained(root, F.col("path")).alias("inside"), V.may_copy(root, V.resolved_path(root, F.col("path"))).alias("may_copy"))


@query("SELECT DISTINCT url AS path, CASE WHEN url IN (SELECT url FROM pages WHERE page_id % 3 = 0) THEN 'keep' ELSE 'copy' END AS action FROM pages WHERE url IS NOT NULL")
def workspace_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What copying a workspace does with each entry where every third one is there already."""
    pages = load(spark, sf_dir, "pages").where(F.col("url").isNotNull()).select("page_id", F.col("url").alias("path"))
    return rollups.copy_plan(pages, pages.where(F.col("page_id") % 3 == 0))


@query("""SELECT event_id, user_id, CASE WHEN user_id % 6 = 5 THEN 'unknown' WHEN user_id % 4 = 3 THEN 'other-job' WHEN event_id % 5 < 2 THEN 'stale' ELSE 'applied' END AS verdict FROM events""")
def late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that come too late for their job or revision."""
    e = load(spark, sf_dir, "events")
    results = e.select("event_id", "user_id", F.lit("t1").alias("token"), (F.col("event_id") % 5).alias("revision"))
    state = e.where(F.col("user_id") % 6 != 5).select("user_id", F.when(F.col("user_id") % 4 == 3, "t2").otherwise("t1").alias("token"), F.lit(2).cast("long").alias("revision")).distinct()
    return rollups.late_results(results, state, ["user_id"]).select("event_id", "user_id", "verdict")


@query("""WITH u AS (SELECT DISTINCT user_id AS session, event_id // 20 AS unit FROM events), c AS (SELECT user_id AS session, event_id // 20 AS unit, event_id AS claim, event_id % 3 AS revision, CASE WHEN event_type = 'view' THEN 'fr' ELSE 'en' END AS language FROM events),
  f AS (SELECT session, unit, min(claim) AS won FROM c WHERE revision = 1 AND language = 'en' AND unit % 4 <> 0 AND session % 5 <> 0 AND unit % 7 <> 3 GROUP BY 1, 2)
  SELECT session, unit, claim, coalesce(claim = won, false) AS granted FROM c LEFT JOIN f USING (session, unit)""")
def claimed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claim gets a unit."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 20).alias("unit"), "event_id", "event_type")
    claims = e.select("session", "unit", F.col("event_id").alias("claim"), F.col("event_id").alias("at"), (F.col("event_id") % 3).alias("revision"), F.when(F.col("event_type") == "view", "fr").otherwise("en").alias("language"))
    units = e.select("session", "unit").distinct().select(
        "session", "unit", F.lit(1).cast("long").alias("revision"), F.lit("en").alias("language"), (F.col("unit") % 4 != 0).alias("needs"), (F.col("session") % 5 == 0).alias("attempted"),
        F.when(F.col("unit") % 7 == 3, "error").alias("status"),
    )
    return rollups.claimed_units(claims, units)


@query("""SELECT user_id, min(CASE WHEN empty AND before THEN event_id END) AS drained_at FROM (SELECT user_id, event_id, value < 8 AND event_type <> 'error' AS empty,
  coalesce(lag(value < 8 AND event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id), false) AS before FROM events) GROUP BY 1""")
def drain_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each lane had two empty snapshots in a row."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") < 8, 0).otherwise(2).alias("queued"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("active"))
    return rollups.drained_at(e, "user_id", "event_id")


@query("""WITH f AS (SELECT user_id AS key, event_id AS moment, value, event_type = 'error' AND event_id % 5 = 0 AS flush FROM events), k AS (SELECT *, coalesce(max(CAST(flush AS INT)) OVER (PARTITION BY key ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM f),
  s AS (SELECT key, moment, unnest([value, value + 1, value + 2]) AS x, unnest([0, 1, 2]) AS i FROM k WHERE after = 0), n AS (SELECT key, x, row_number() OVER (PARTITION BY key ORDER BY moment, i) - 1 AS n FROM s)
  SELECT key, batch, round(total, 4) AS total, size FROM (SELECT key, n // 16 AS batch, sum(x) AS total, CAST(count(*) AS INT) AS size FROM n GROUP BY 1, 2) WHERE size = 16 OR key IN (SELECT key FROM k WHERE after = 0 AND flush)""")
def frame_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of three samples as batches of sixteen: how many samples, and their sum."""
    v = F.col("value")
    frames = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.array(v, v + 1, v + 2).alias("samples"), ((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("flush")
    )
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    return rollups.frame_batches(frames, 16).select("key", "batch", F.round(total, 4).alias("total"), F.size("samples").alias("size"))


@query("""WITH m AS (SELECT event_id, [(value + (value + 2)) / 2, (value + 1 + value) / 2, (value + 2 + value - 1) / 2, (value + 3 + value * 2) / 2, (value + 4 + 1) / 2] AS s FROM events)
  SELECT event_id, round(s[1], 6) AS a, round(s[1 + 2], 6) AS b, round(s[2] * 0.5 + s[3] * 0.5, 6) AS c, CAST(3 AS INT) AS n FROM m""")
def resampled_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels mixed to one, and that at 3 fifths of its rate: the first sample, its third at half rate, and one between."""
    v = F.col("value")
    channels = F.array(F.array(v, v + 1, v + 2, v + 3, v + 4), F.array(v + 2, v, v - 1, v * 2, F.lit(1.0)))
    mono = load(spark, sf_dir, "events").select("event_id", V.mono_mix(channels).alias("m"))
    half, slower = V.resample(F.col("m"), 32_000, 16_000), V.resample(F.col("m"), 24_000, 16_000)
    return mono.select("event_id", F.round(half[0], 6).alias("a"), F.round(half[1], 6).alias("b"), F.round(slower[1], 6).alias("c"), F.size(slower).alias("n"))


@query(f"""SELECT session, ordinal, CAST({d_distance("a", "b")} AS INT) AS distance, CAST(CASE WHEN {d_distance("a", "b")} <= 3 THEN {d_distance("a", "b")} END AS INT) AS near FROM (
  SELECT session, ordinal, lower(regexp_extract(text, '[\\p{{L}}]+')) AS a, lower(regexp_extract(right_text, '[\\p{{L}}]+')) AS b FROM ({D_PAIRS}) WHERE next IS NOT NULL AND text IS NOT NULL AND right_text IS NOT NULL)""")
def word_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit distance of the first words of neighbouring turns."""
    following = F.lead("text").over(Window.partitionBy("session").orderBy("ordinal"))
    pairs = _turns(spark, sf_dir).select("session", "ordinal", "text", following.alias("right")).where("text IS NOT NULL AND right IS NOT NULL")
    a, b = (F.lower(F.regexp_extract(x, r"\p{L}+", 0)) for x in ("text", "right"))
    return pairs.select("session", "ordinal", V.edit_distance(a, b).alias("distance"), V.edit_distance(a, b, 3).alias("near"))


@query("""SELECT event_id, floor((value - 10) * 10 + 0.5) / 10 AS rounded, list_extract(l, -1) AS last, l[2:3] AS middle, CAST(coalesce(list_position(l, 'b'), 0) - 1 AS BIGINT) AS place, list_contains(l, event_type) AS has
  FROM (SELECT event_id, value, event_type, ['a', 'b', event_type, 'c'] AS l FROM events)""")
def array_and_number_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding with halves upwards, and the array helpers: last, slice, place and membership."""
    e = load(spark, sf_dir, "events").withColumn("l", F.array(F.lit("a"), F.lit("b"), F.col("event_type"), F.lit("c")))
    return e.select(
        "event_id", V.round_half_up(F.col("value") - 10, 1).alias("rounded"), F.element_at("l", -1).alias("last"), F.slice("l", 2, 2).alias("middle"), (F.array_position("l", "b") - 1).alias("place"),
        F.array_contains("l", F.col("event_type")).alias("has"),
    )


@query(f"""SELECT session, ordinal, text, pending FROM (SELECT session, CAST(generate_subscripts(u, 1) - 1 AS INT) AS ordinal, unnest(u) AS text, false AS pending FROM (SELECT doc_id AS session, string_split({d_space("text")}, ' ') AS u FROM documents WHERE {d_space("text")} <> '')
  UNION ALL SELECT doc_id AS session, -1 AS ordinal, source AS text, true AS pending FROM documents)""")
def stable_and_pending_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and open units as one table."""
    d = load(spark, sf_dir, "documents")
    stable = d.where(T.normalise_space(F.col("text")) != "").select(F.col("doc_id").alias("session"), F.posexplode(F.split(T.normalise_space(F.col("text")), " ")).alias("ordinal", "text"), F.lit(False).alias("pending"))
    return stable.unionByName(d.select(F.col("doc_id").alias("session"), F.lit(-1).alias("ordinal"), F.col("source").alias("text"), F.lit(True).alias("pending")))


@query("""WITH RECURSIVE r AS (SELECT user_id AS lane, CAST(event_id AS DOUBLE) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  w AS (SELECT lane, 0::BIGINT AS k, -1.0::DOUBLE AS until, false AS pending, 0 AS runs FROM (SELECT DISTINCT lane FROM r)
  UNION ALL SELECT lane, k, CASE WHEN moment >= u THEN moment + 90 ELSE u END AS until, moment < u AS pending, n + CAST(moment >= u AS INT) AS runs FROM (
    SELECT w.lane, r.k, r.moment, CASE WHEN w.pending AND r.moment >= w.until THEN w.until + 90 ELSE w.until END AS u, w.runs + CAST(w.pending AND r.moment >= w.until AS INT) AS n, w.pending AND r.moment < w.until AS p FROM w JOIN r ON r.lane = w.lane AND r.k = w.k + 1))
  SELECT CAST(lane AS VARCHAR) AS lane, CAST(runs + CAST(pending AS INT) AS INT) AS runs, until + CASE WHEN pending THEN 90 ELSE 0 END AS until FROM w QUALIFY row_number() OVER (PARTITION BY lane ORDER BY k DESC) = 1""")
def coalesced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs of 90 each lane's requests come to, and when the last one ends."""
    requests = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("lane"), F.col("event_id").cast("double").alias("at"))
    return segmentation.coalesced_runs(requests, 90.0).groupBy("lane").agg(F.count("*").cast("int").alias("runs"), F.max("until").alias("until"))
