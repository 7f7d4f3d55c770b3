"""Queries over segments, events and dated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.functions.vocabulary import DEPENDENCIES, STAGE_PREFERENCES
from quillspark.operators import lineage, profiler, segments
from quillspark.session import load

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


# Turns stand for segments; a label of the document with the conversation's number decides
# whether there is a revised version, and the role whether a turn was integrated.
D_SEGMENTS = """SELECT c.conv_id AS session, c.turn AS ordinal, 2.0 * c.turn AS start, CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR) AS id, c.text AS provisional,
  CASE WHEN l.quality = 1 AND c.turn % 2 = 0 THEN c.text || ' (revised)' END AS revised, c.turn % 5 = 4 AS integrated FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, labels = load(spark, sf_dir, "conversations"), load(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = turns.join(labels, turns["conv_id"] == labels["doc_id"], "left")
    revised = F.when((F.col("quality") == 1) & (F.col("turn") % 2 == 0), F.concat(F.col("text"), F.lit(" (revised)")))
    return joined.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), (2.0 * F.col("turn")).alias("start"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text",
        F.create_map(F.lit("provisional"), F.col("text"), F.lit("revised"), revised).alias("versions"), (F.col("turn") % 5 == 4).alias("integrated"),
    )


@query(f"""SELECT session, string_agg(trim(v), ' ' ORDER BY ordinal, start, id) FILTER (trim(v) <> '') AS text, count(*) AS n_segments
  FROM (SELECT *, coalesce(revised, provisional) AS v FROM ({D_SEGMENTS}) WHERE NOT integrated) WHERE v IS NOT NULL GROUP BY session""")
def usable_version_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.project_transcript(_segments(spark, sf_dir))


@query(f"SELECT session, string_agg(trim(revised), ' ' ORDER BY ordinal, start, id) AS text, count(*) AS n_segments FROM ({D_SEGMENTS}) WHERE revised IS NOT NULL GROUP BY session")
def named_stage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.project_transcript(_segments(spark, sf_dir), stage="revised", integrated=True)


@query("""SELECT conv_id AS session, count(*) AS n_segments, left(string_agg(trim(text), ' ' ORDER BY turn) FILTER (trim(coalesce(text, '')) <> ''), 140) AS preview,
  length(string_agg(trim(text), ' ' ORDER BY turn)) > 0 AS has_transcript FROM conversations GROUP BY 1""")
def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.summarise_sessions(_segments(spark, sf_dir))


@query("""SELECT session, ordinal, CASE WHEN trim(coalesce(translated, '')) = '' OR translated_target <> 'en' THEN true WHEN translated_revision <> '' THEN translated_revision <> 'r1' ELSE status IS DISTINCT FROM 'translated' END AS needs
  FROM (SELECT conv_id AS session, turn AS ordinal, CASE WHEN turn % 4 <> 1 THEN text END AS translated, CASE WHEN turn % 3 = 0 THEN 'fr' ELSE 'en' END AS translated_target,
  CASE turn % 5 WHEN 0 THEN 'r1' WHEN 1 THEN 'r0' ELSE '' END AS translated_revision, CASE WHEN conv_id % 2 = 0 THEN 'translated' ELSE 'error' END AS status FROM conversations)""")
def needs_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, turn = load(spark, sf_dir, "conversations"), F.col("turn")
    unit = F.struct(
        F.when(turn % 4 != 1, F.col("text")).alias("translated"), F.lit("en").alias("target"), F.when(turn % 3 == 0, "fr").otherwise("en").alias("translated_target"),
        F.when(turn % 5 == 0, "r1").when(turn % 5 == 1, "r0").otherwise("").alias("translated_revision"), F.lit("r1").alias("source_revision"),
        F.when(F.col("conv_id") % 2 == 0, "translated").otherwise("error").alias("status"),
    )
    return t.select(F.col("conv_id").alias("session"), turn.alias("ordinal"), segments.needs_translation(unit).alias("needs"))


@query("""SELECT conv_id AS session, turn AS ordinal FROM conversations WHERE text IS NOT NULL AND turn >= 2 AND turn % 3 <> 0 AND conv_id % 2 = 0""")
def live_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "conversations")
    units = t.select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), F.col("text").isNotNull().alias("needs"), (F.col("turn") % 3 == 0).cast("int").alias("attempts"), F.when(F.col("conv_id") % 2 == 1, "error").alias("status"))
    return segments.live_eligible(units, F.lit(2)).select("session", "ordinal")


@query(f"""SELECT a.doc_id, a.idx, a.text = b.text OR starts_with(a.text, b.text) OR starts_with(b.text, a.text) AS related FROM
  (SELECT conv_id AS doc_id, turn AS idx, {"trim(regexp_replace(coalesce(text, ''), '" + T.SPACE + "+', ' ', 'g'))"} AS text FROM conversations) a
  JOIN (SELECT conv_id AS doc_id, turn AS idx, {"trim(regexp_replace(coalesce(left(text, 20), ''), '" + T.SPACE + "+', ' ', 'g'))"} AS text FROM conversations) b ON a.doc_id = b.doc_id AND (a.idx = b.idx OR a.idx = b.idx + 1)
  WHERE a.text <> '' AND b.text <> ''""")
def related_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")
    b = t.select("doc_id", F.explode(F.array(F.col("idx"), F.col("idx") + 1)).alias("idx"), F.substring("text", 1, 20).alias("other"))
    both = t.join(b, ["doc_id", "idx"]).where((T.normalise_space(F.col("text")) != "") & (T.normalise_space(F.col("other")) != ""))
    return both.select("doc_id", "idx", segments.related_source(F.col("text"), F.col("other")).alias("related"))


_PREF = " UNION ALL ".join(f"SELECT '{s}' AS stage, '{m}' AS model, {k} AS rank" for s, ms in STAGE_PREFERENCES.items() for k, m in enumerate(ms))


@query(f"""SELECT stage, min_by(model, rank) AS model, list(model ORDER BY rank) AS fallbacks FROM ({_PREF})
  WHERE model IN (SELECT CASE event_type WHEN 'click' THEN 'small' WHEN 'view' THEN 'base' WHEN 'purchase' THEN 'large' ELSE 'none' END FROM events) GROUP BY stage""")
def model_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    installed = load(spark, sf_dir, "events").select(F.when(kind == "click", "small").when(kind == "view", "base").when(kind == "purchase", "large").otherwise("none").alias("model")).distinct()
    plans = [segments.model_plan(installed, s) for s in STAGE_PREFERENCES]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


D_STATES = """SELECT CASE user_id % 3 WHEN 0 THEN 'provisional' WHEN 1 THEN 'revised' ELSE 'highQuality' END AS stage, user_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'error' ELSE 'completed' END AS status,
  value > 50 AS has_version, user_id % 3 <> 1 OR event_id % 2 = 0 AS eligible FROM events"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = load(spark, sf_dir, "events"), F.col("event_type")
    return e.select(
        F.when(F.col("user_id") % 3 == 0, "provisional").when(F.col("user_id") % 3 == 1, "revised").otherwise("highQuality").alias("stage"), "user_id",
        F.when(kind == "click", "pending").when(kind == "view", "running").when(kind == "error", "error").otherwise("completed").alias("status"),
        (F.col("value") > 50).alias("has_version"), ((F.col("user_id") % 3 != 1) | (F.col("event_id") % 2 == 0)).alias("eligible"),
    )


@query(f"""SELECT stage, count(*) FILTER (o AND status = 'pending') AS queued, count(*) FILTER (o AND status = 'running') AS active, count(*) FILTER (o AND status IN ('pending', 'running')) AS total
  FROM (SELECT *, NOT has_version AND eligible AS o FROM ({D_STATES})) GROUP BY stage""")
def stage_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.stage_backlog(_states(spark, sf_dir))


@query(f"""SELECT user_id, stage, count(*) FILTER (status IN ('pending', 'running')) AS pending, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (has_version) AS completed, count(*) AS total FROM ({D_STATES}) GROUP BY 1, 2""")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.stage_rollup(_states(spark, sf_dir), "user_id", "stage")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 50""")
def last_n_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = segments.keep_last(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 50)
    return kept.select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) + 10 AS INT) AS sequence FROM orders""")
def daily_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a day that go on after a stored high-water mark of ten."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    counters = orders.select("day").distinct().withColumn("high", F.lit(10))
    return segments.daily_sequence(orders, "day", ["o_orderkey"], counters).select("o_orderkey", F.col("sequence").cast("int").alias("sequence"))


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS ordinal FROM orders""")
def dense_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).cast("int").alias("ordinal"))


@query("""SELECT e.event_id, max(s.ts) AS matched FROM (SELECT * FROM events WHERE event_type = 'purchase') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') s
  ON s.user_id = e.user_id AND s.ts <= e.ts GROUP BY 1""")
def asof_finalized_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the latest view of its user that is not later."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = profiler.as_of(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").select("user_id", "ts"), "user_id", "ts", "ts", 20)
    return found.select("event_id", "matched")


D_EVENT_PAIRS = """SELECT a.k, a.started, b.ended FROM (SELECT user_id AS k, min(ts) AS started FROM events WHERE event_type = 'view' GROUP BY 1) a
  JOIN (SELECT user_id AS k, max(ts) AS ended FROM events WHERE event_type = 'purchase' GROUP BY 1) b USING (k)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", "event_type")
    starts = e.where("event_type = 'view'").groupBy("k").agg(F.min("ts").alias("ts"))
    ends = e.where("event_type = 'purchase'").groupBy("k").agg(F.max("ts").alias("ts"))
    return profiler.pair_events(starts, ends, "k")


@query(D_EVENT_PAIRS)
def event_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"""SELECT k % 4 AS grp, count(*) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.95), 6) AS p95, max(s) AS largest FROM (SELECT k, CAST(epoch(ended) - epoch(started) AS DOUBLE) AS s FROM ({D_EVENT_PAIRS})) GROUP BY 1""")
def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ended").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started").cast("timestamp")) / 1e6
    return profiler.latency_summary(_pairs(spark, sf_dir).select((F.col("k") % 4).alias("grp"), seconds.alias("s")), "grp", F.col("s"))


@query("""SELECT count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT session) AS sessions FROM (SELECT l_suppkey AS session, l_orderkey AS recording, l_linenumber AS sequence, max(CAST(l_quantity AS BIGINT)) AS bytes FROM lineitem GROUP BY ALL)""")
def runtime_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return profiler.runtime_totals(lines.select(F.col("l_suppkey").alias("session"), F.col("l_orderkey").alias("recording"), F.col("l_linenumber").alias("sequence"), F.col("l_quantity").cast("long").alias("bytes")))


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def bounded_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = profiler.bounded_events(load(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20)
    return kept.select("user_id", "event_id")


@query("""SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1""")
def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("samples"))
    return frames.select("user_id", F.round(profiler.frame_energy(F.col("samples")), 6).alias("rms"))


@query("""SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type""")
def idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first arrival of each (user, type) chunk."""
    return segments.idempotent_ingest(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("""SELECT l.doc_id, CAST(coalesce(n.quality, l.quality) AS INT) AS quality, l.toxic FROM labels l LEFT JOIN (SELECT doc_id, 1 - quality AS quality FROM labels WHERE toxic = 1) n USING (doc_id)""")
def upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    return segments.upsert(labels, labels.where("toxic = 1").withColumn("quality", 1 - F.col("quality")), "doc_id")


@query("""SELECT doc_id, toxic FROM labels WHERE quality = 0""")
def write_elision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to write where quality 0 rows got another toxic flag."""
    labels = load(spark, sf_dir, "labels")
    new = labels.withColumn("toxic", F.when(F.col("quality") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return segments.changed_rows(labels, new, "doc_id").select("doc_id", (1 - F.col("toxic")).alias("toxic"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'write' WHEN text = (CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END) THEN 'keep' WHEN doc_id % 2 = 0 THEN 'replace' ELSE 'refuse' END AS action FROM documents
  WHERE text NOT IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def idempotent_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    docs = docs.join(docs.groupBy("content").count().where("count > 1"), "content", "left_anti").select("doc_id", "content")
    new = docs.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.upper("content")).otherwise(F.col("content")))
    known = docs.where("doc_id % 2 = 0").select(F.sha2("content", 256).alias("hash"))
    return segments.idempotent_output(docs.where("doc_id % 4 <> 0"), new, "doc_id", known)


@query("""SELECT session, ordinal, coalesce(lead(ordinal) OVER w, lag(ordinal) OVER w) AS neighbour FROM (SELECT conv_id AS session, turn AS ordinal FROM conversations) WINDOW w AS (PARTITION BY session ORDER BY ordinal)""")
def neighbour_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.neighbour_after_delete(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal")), "ordinal", "ordinal")


@query("""SELECT session, ordinal, edge_text FROM (SELECT c.conv_id AS session, c.turn AS ordinal, (SELECT min(e.event_id) FROM events e WHERE e.user_id = c.conv_id) AS edge_text FROM conversations c)""")
def first_chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the first event of its key, or null."""
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"))
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("edge_text"))
    return segments.first_match(turns, events, ["session"], "edge_text")


_EDGES = ", ".join(f"('{k}', '{p}')" for k, p in DEPENDENCIES)
# Every conversation has every artifact; some documents were edited by hand.
D_ARTIFACTS = f"""SELECT c.session, k.key, 'v' || CAST(c.session AS VARCHAR) || k.key AS content, CASE WHEN k.key = 'cleanedTranscript' AND c.session % 3 = 0 OR k.key = 'notes' AND c.session % 2 = 0 THEN 'manual-edit' ELSE 'model' END AS source
  FROM (SELECT DISTINCT conv_id AS session FROM conversations) c CROSS JOIN (SELECT 'rawTranscript' AS key UNION ALL SELECT k FROM (VALUES {_EDGES}) t(k, p)) k"""


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session")).distinct()
    keys = F.array(*[F.lit(k) for k in ("rawTranscript", *[k for k, _ in DEPENDENCIES])])
    rows = sessions.select("session", F.explode(keys).alias("key"))
    manual = ((F.col("key") == "cleanedTranscript") & (F.col("session") % 3 == 0)) | ((F.col("key") == "notes") & (F.col("session") % 2 == 0))
    return rows.select("session", "key", F.concat(F.lit("v"), F.col("session").cast("string"), F.col("key")).alias("content"), F.when(manual, "manual-edit").otherwise("model").alias("source"), F.lit(False).alias("stale"))


@query(f"""WITH RECURSIVE a AS ({D_ARTIFACTS}), e(k, p) AS (VALUES {_EDGES}), r AS (SELECT session, key FROM a WHERE key IN ('cleanedTranscript', 'notes', 'outline') AND source <> 'manual-edit'
  UNION SELECT a.session, a.key FROM r JOIN e ON e.p = r.key JOIN a ON a.session = r.session AND a.key = e.k WHERE a.source <> 'manual-edit') SELECT session, key FROM r""")
def staleness_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.material_change(_artifacts(spark, sf_dir))


@query(f"SELECT session, key, key <> 'rawTranscript' AS stale FROM ({D_ARTIFACTS})")
def raw_change_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.raw_change(_artifacts(spark, sf_dir)).select("session", "key", "stale")


@query(f"WITH e(k, p) AS (VALUES {_EDGES}) SELECT session, key FROM ({D_ARTIFACTS}) a JOIN e ON e.k = a.key WHERE e.p = 'cleanedTranscript'")
def direct_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.direct_dependents(_artifacts(spark, sf_dir), "cleanedTranscript")


@query(f"SELECT session, key, key IN ({', '.join(repr(k) for k in lineage.LANGUAGE_BOUND)}) AS stale FROM ({D_ARTIFACTS})")
def language_change_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark, sf_dir).select("session", "key", lineage.language_change(F.col("key")).alias("stale"))


D_DEPS = f"""WITH a AS ({D_ARTIFACTS}), e(k, p) AS (VALUES {_EDGES}), d AS (SELECT a.session, a.key, e.p AS parent, substr(sha256(b.content), 1, 16) AS parent_fp FROM a JOIN e ON e.k = a.key JOIN a b ON b.session = a.session AND b.key = e.p)"""


@query(f"{D_DEPS} SELECT * FROM d")
def dependency_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.resolve_dependency(_artifacts(spark, sf_dir))


def _made(artifacts: DataFrame) -> DataFrame:
    """Artifacts that recorded what they were made from; every fifth session's record is out of date."""
    now = lineage.resolve_dependency(artifacts)
    fp = F.when(F.col("session") % 5 == 0, F.lit("0")).otherwise(F.col("parent_fp"))
    return artifacts.join(now.select("session", "key", F.col("parent").alias("depends_on"), fp.alias("depends_fp")), ["session", "key"], "left")


@query(f"""{D_DEPS} SELECT a.session, a.key, (a.source = 'manual-edit') OR d.key IS NULL OR a.session % 5 <> 0 AS valid FROM a LEFT JOIN d USING (session, key)""")
def artifact_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.valid(_made(_artifacts(spark, sf_dir)))


@query(f"""{D_DEPS} SELECT session, key, reason IS NULL AS accepted, reason FROM (SELECT a.session, a.key, CASE WHEN a.session % 5 = 0 THEN 'dependency-changed' WHEN a.source = 'manual-edit' THEN 'manual-edit' END AS reason FROM a JOIN d USING (session, key))""")
def optimistic_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = _artifacts(spark, sf_dir)
    incoming = _made(artifacts).where("depends_on IS NOT NULL").select("session", "key", "depends_on", "depends_fp", F.lit(False).alias("overwrite"))
    return lineage.optimistic_write(incoming, artifacts)


@query("""SELECT session, ordinal, CASE WHEN current_text <> edited AND starts_with(current_text, base) AND length(current_text) > length(base) AND NOT ends_with(edited, substr(current_text, length(base) + 1))
  THEN edited || substr(current_text, length(base) + 1) ELSE edited END AS merged FROM (SELECT conv_id AS session, turn AS ordinal, left(text, 30) AS base, 'edited ' || left(text, 30) AS edited, CASE WHEN turn % 2 = 0 THEN text ELSE lower(role) END AS current_text FROM conversations)""")
def concurrent_edit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "conversations")
    base = F.substring("text", 1, 30)
    current = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lower("role"))
    return t.select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), lineage.merge_edit(base, F.concat(F.lit("edited "), base), current).alias("merged"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'error' WHEN 'click' THEN 'deferred' ELSE event_type END AS status FROM events""")
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").select("event_id", lineage.recover(F.when(kind == "view", "running").when(kind == "click", "pending").otherwise(kind)).alias("status"))


@query("""SELECT w.doc_id, c.cleaned FROM documents w LEFT JOIN (SELECT text, any_value('clean ' || text) AS cleaned FROM documents WHERE doc_id % 2 = 0 GROUP BY text) c ON c.text = w.text""")
def cached_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", T.fingerprint(F.col("text")).alias("fp"))
    cache = docs.where("doc_id % 2 = 0").select("fp", "text", F.concat(F.lit("clean "), F.col("text")).alias("cleaned"))
    return lineage.reuse_regions(docs, cache).select("doc_id", "cleaned")


@query("""SELECT session, ordinal FROM (SELECT conv_id AS session, turn AS ordinal FROM conversations) WHERE (session, ordinal) NOT IN (SELECT conv_id, turn FROM conversations WHERE role = 'user')""")
def unseen_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), "role")
    return turns.join(turns.where("role = 'user'").select("session", "ordinal"), ["session", "ordinal"], "left_anti").drop("role")
