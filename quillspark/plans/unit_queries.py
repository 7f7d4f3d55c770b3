"""Queries over translation units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import units
from quillspark.plans.text_queries import D_TAIL, d_space
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


def d_units(source: str, text: str) -> str:
    """SQL of the units of a ``session, text`` source."""
    mark = T.STABLE_SENTENCE.replace("'", "''")
    tail = D_TAIL.replace(d_space("text"), d_space(text))
    tail = f"""CASE WHEN regexp_matches({d_space(text)}, '[^.!?。！？…][.!?。！？…]') THEN {d_space(f"regexp_replace({tail}, '^[\"''”’»)]*', '')")} ELSE {d_space(text)} END"""
    done = f"list_filter(list_transform(regexp_extract_all({d_space(text)}, '{mark}'), lambda x: trim(x)), lambda x: x <> '')"
    return f"""SELECT session, ordinal, text, pending, substr(sha256(text), 1, 16) || ':' || CAST(row_number() OVER (PARTITION BY session, text ORDER BY ordinal) - 1 AS VARCHAR) AS key FROM (
      SELECT session, CAST(generate_subscripts(u, 1) - 1 AS INT) AS ordinal, unnest(u) AS text, generate_subscripts(u, 1) > n AS pending FROM (
      SELECT session, len({done}) AS n, list_concat({done}, CASE WHEN {tail} <> '' THEN [{tail}] ELSE [] END) AS u FROM {source}))"""


D_OLD, D_NEW = d_units("(SELECT doc_id AS session, left(text, 400) AS text FROM documents)", "text"), d_units("(SELECT doc_id AS session, text FROM documents)", "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("session"), "text")


@query(D_NEW)
def assembled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.assemble(_docs(spark, sf_dir))


@query(f"""SELECT doc_id AS session, starts_with(n, o) AS grows, CASE WHEN starts_with(n, o) THEN ltrim(substr(n, length(o) + 1)) END AS suffix FROM (SELECT doc_id, {d_space("left(text, 400)")} AS o, {d_space("text")} AS n FROM documents)""")
def append_only_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return units.append_only(docs.withColumn("text", F.substring("text", 1, 400)), docs)


@query(f"""WITH o AS ({D_OLD}), n AS ({D_NEW}), e AS (SELECT n.*, o.ordinal AS old FROM n LEFT JOIN o ON o.session = n.session AND o.key = n.key),
  f AS (SELECT o.session, o.ordinal FROM o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session = o.session AND e.old = o.ordinal))
  SELECT e.session, e.ordinal, coalesce('u' || CAST(e.old AS VARCHAR), 'u' || CAST(f.ordinal AS VARCHAR), e.key) AS id, e.old IS NOT NULL OR f.ordinal IS NOT NULL AS reused
  FROM e LEFT JOIN f ON f.session = e.session AND f.ordinal = e.ordinal""")
def reused_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of documents and of their first 400 characters as the earlier version."""
    docs = _docs(spark, sf_dir)
    before = units.assemble(docs.withColumn("text", F.substring("text", 1, 400))).withColumn("id", F.concat(F.lit("u"), F.col("ordinal").cast("string")))
    return units.reuse_identities(units.assemble(docs), before)


@query(f"""WITH c AS (SELECT conv_id AS session, turn, {d_space("text")} AS t FROM conversations), u AS (SELECT session, turn AS ordinal, t AS text FROM c WHERE turn % 2 = 0)
  SELECT u.session, u.ordinal, min(CASE WHEN contains(u.text, c.t) OR contains(c.t, u.text) THEN 2.0 * c.turn END)::DOUBLE AS start, max(CASE WHEN contains(u.text, c.t) OR contains(c.t, u.text) THEN 2.0 * c.turn + 1 END)::DOUBLE AS "end"
  FROM u LEFT JOIN (SELECT * FROM c WHERE t <> '') c ON c.session = u.session GROUP BY 1, 2""")
def unit_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "text")
    parts = turns.select("session", "text", (2.0 * F.col("turn")).alias("start"), (2.0 * F.col("turn") + 1).alias("end"))
    asked = turns.where("turn % 2 = 0").select("session", F.col("turn").alias("ordinal"), T.normalise_space(F.col("text")).alias("text"))
    return units.timing(asked, parts)


@query("""SELECT session, turn, right(coalesce(list_aggregate(list(text) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 'string_agg', chr(10)), ''), 1800) AS context
  FROM (SELECT conv_id AS session, turn, text FROM conversations)""")
def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.rolling_context(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "text"), "session", "turn", "text")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['C1', 'C2'] ELSE [] END AS ids, CASE event_id % 4 WHEN 1 THEN 'invalid-json' WHEN 2 THEN 'invalid-candidate-list' WHEN 3 THEN 'invalid-candidate-list' END AS problem FROM events""")
def selector_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    nine = F.lit('{"candidateIds":["C1","C2","C3","C4","C5","C6","C7","C8","C9"]}')
    text = F.when(k == 0, '{"candidateIds":["C1","C2"]}').when(k == 1, "not json").when(k == 2, '{"candidateIds":["X1"]}').otherwise(nine)
    return load(spark, sf_dir, "events").select("event_id", units.selection(text).alias("s")).select("event_id", "s.*")


@query("SELECT event_id, CAST(least(30000, 1000 * (1 << CAST(least(5, event_id % 8) AS INT))) AS BIGINT) AS delay FROM events")
def poll_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", units.poll_delay(F.col("event_id") % 8).alias("delay"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_and(event_type = 'view') THEN 'translated' ELSE 'pending' END AS status, count(*) AS n_units FROM events GROUP BY 1""")
def aligned_unit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = load(spark, sf_dir, "events").select("user_id", F.when(kind == "error", "error").when(kind == "view", "translated").otherwise("pending").alias("status"))
    return units.unit_status(rows, "user_id")


@query("""SELECT count(DISTINCT (o_custkey, o_orderstatus, o_totalprice)) AS markers FROM orders""")
def change_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.select(F.count_distinct(units.change_marker(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_totalprice"))).alias("markers"))
