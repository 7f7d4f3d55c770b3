"""Queries whose operators scan texts or fold events in Arrow batches; tests check them in place of SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import chunks, guard, repair, sentences
from quillspark.functions import text as T
from quillspark.functions.arrow import arrow_function
from quillspark.functions.vocabulary import ABBREVIATIONS
from quillspark.plans.text_queries import D_ANCHORS, listed
from quillspark.session import load
from quillspark.sources import files
from quillspark.streaming import folds, segmentation

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
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), "text", (2.0 * F.col("turn")).alias("start"), (2.0 * F.col("turn") + 1).alias("end"))


_MARK = "[.!?…。！？]+"
_TRIMMED = "'^\\s+|\\s+$', '', 'g'"


def d_sentences(source: str, key: str) -> str:
    """SQL ``key, paragraph, place, sentence`` of a source's texts: each mark is judged by what stands around it."""
    clean = f"regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), {_TRIMMED})"
    starts = "following = '' OR regexp_matches(following, '^[\\p{Lu}\\p{N}㐀-䶿一-鿿豈-﫿]')"
    return f"""WITH p0 AS (SELECT {key} AS key, string_split_regex({clean}, '\\n{{2,}}') AS ps FROM {source}),
    p AS (SELECT key, paragraph, array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda x: regexp_replace(x, {_TRIMMED})), lambda x: x <> ''), ' ') AS t
      FROM (SELECT key, generate_subscripts(ps, 1) AS paragraph, unnest(ps) AS raw FROM p0)),
    m AS (SELECT key, paragraph, t, k, run, list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(runs[1:k - 1], lambda x: length(x))), 0) AS start FROM (
      SELECT key, paragraph, t, pieces, runs, generate_subscripts(runs, 1) AS k, unnest(runs) AS run FROM (SELECT *, regexp_extract_all(t, '{_MARK}') AS runs, string_split_regex(t, '{_MARK}') AS pieces FROM p))),
    c AS (SELECT *, start + length(run) AS stop, right(run, 1) AS mark, substr(t, CAST(start + length(run) + 1 AS BIGINT), 1) AS after, regexp_extract(substr(t, CAST(start + length(run) + 1 AS BIGINT), 300), '^\\s*(\\S?)', 1) AS following,
      substr(t, CAST(greatest(1, start - 199) AS BIGINT), CAST(least(start, 200) AS BIGINT)) AS near, substr(t, CAST(start + length(run) - 1 AS BIGINT), 1) AS before FROM m),
    d AS (SELECT *, regexp_extract(near, '[A-Za-z0-9]+(?:\\.[A-Za-z0-9]+)*$') AS token, regexp_matches(after, '^[\\p{{L}}\\p{{N}}]') AS joined FROM c),
    e AS (SELECT key, paragraph, t, CAST(stop + length(regexp_extract(substr(t, CAST(stop + 1 AS BIGINT), 300), '^["''”’»)\\]}}）］｝]*')) AS BIGINT) AS cut FROM d WHERE CASE WHEN mark IN ('!', '?', '。', '！', '？') THEN true
      WHEN mark = '…' OR length(run) >= 2 THEN {starts} WHEN regexp_matches(before, '^\\p{{Nd}}$') AND regexp_matches(after, '^\\p{{Nd}}$') THEN false
      WHEN joined AND regexp_matches(near, '(?i)(?:https?://|www\\.|@)\\S*$') THEN false WHEN lower(token) IN ({listed(ABBREVIATIONS)}) OR regexp_full_match(token, '[A-Za-z](?:\\.[A-Za-z])+') THEN false
      WHEN regexp_full_match(token, '[A-Za-z]') AND regexp_matches(following, '^\\p{{L}}') AND ({starts}) THEN false ELSE NOT (joined AND length(token) <= 3) END),
    s AS (SELECT key, paragraph, cut, regexp_replace(substr(t, coalesce(lag(cut) OVER w, 0) + 1, cut - coalesce(lag(cut) OVER w, 0)), {_TRIMMED}) AS sentence FROM e WINDOW w AS (PARTITION BY key, paragraph ORDER BY cut)
      UNION ALL SELECT p.key, p.paragraph, 1000000000, regexp_replace(substr(any_value(p.t), coalesce(max(cut), 0) + 1), {_TRIMMED}) FROM p LEFT JOIN e ON e.key = p.key AND e.paragraph = p.paragraph GROUP BY p.key, p.paragraph)
    SELECT key, paragraph, cut AS place, sentence FROM s WHERE sentence <> ''"""


@query(f"SELECT key AS doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY paragraph, place) - 1 AS INT) AS idx, sentence FROM ({d_sentences('documents', 'doc_id')})")
def conservative_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences.sentences(F.col("text"))).alias("idx", "sentence"))


@query(f"""SELECT doc_id, coalesce(f.text, '') AS text FROM documents LEFT JOIN (SELECT key, string_agg(t, chr(10) || chr(10) ORDER BY paragraph) AS text FROM (
  SELECT key, paragraph, string_agg(sentence, ' ' ORDER BY place) AS t FROM ({d_sentences('documents', 'doc_id')}) GROUP BY 1, 2) GROUP BY key) f ON f.key = doc_id""")
def sentence_paragraph_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", sentences.format_sentences(F.col("text")).alias("text"))


@query(f"""SELECT session, ordinal, CAST(n - 1 AS INT) AS piece, sentence AS text, 2.0 * ordinal + least(1.0, before / size) AS start, 2.0 * ordinal + least(1.0, (before + length(sentence)) / size) AS "end" FROM (
  SELECT conv_id AS session, turn AS ordinal, row_number() OVER w AS n, sentence, coalesce(sum(length(sentence) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, length(trim(text)) AS size
  FROM ({d_sentences("(SELECT conv_id * 100000 + turn AS id, trim(text) AS text FROM conversations WHERE text IS NOT NULL)", "id")}) JOIN conversations ON key = conv_id * 100000 + turn WINDOW w AS (PARTITION BY conv_id, turn ORDER BY paragraph, place))""")
def timed_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.timed_sentences(_turns(spark, sf_dir))


@arrow_function("array<string>")
def _snippets(text: pd.Series) -> pd.Series:
    return text.map(chunks.snippets, na_action=None)


_D_BLOCKS = f"""SELECT doc_id, bn, regexp_replace(regexp_replace(raw, '[\\t ]+', ' ', 'g'), {_TRIMMED}) AS block FROM (SELECT doc_id, generate_subscripts(b, 1) AS bn, unnest(b) AS raw FROM (
  SELECT doc_id, string_split_regex(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^(#{{1,6}}\\s)', chr(12) || '\\1', 'g'), '\\f|\\n\\s*\\n') AS b FROM documents))"""
_D_LONG = f"(SELECT doc_id * 100000 + bn AS id, block AS text FROM ({_D_BLOCKS}) WHERE length(block) > 1800)"
#: Sentences of long blocks, packed one by one; one that is too long is left out and ends a run.
_D_SNIPPETS = f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY bn, g) - 1 AS INT) AS idx, snippet FROM (
  SELECT doc_id, bn, 0 AS g, block AS snippet FROM ({_D_BLOCKS}) WHERE block <> '' AND length(block) <= 1800
  UNION ALL SELECT key // 100000 AS doc_id, key % 100000 AS bn, g, snippet FROM (WITH RECURSIVE q AS (SELECT key, sentence, length(sentence) AS n, row_number() OVER (PARTITION BY key ORDER BY paragraph, place) AS k FROM ({d_sentences(_D_LONG, "id")})),
    w AS (SELECT DISTINCT key, 0::BIGINT AS k, 0 AS g, 0::BIGINT AS used, '' AS sentence, false AS kept FROM q
      UNION ALL SELECT w.key, q.k, CASE WHEN q.n <= 1800 AND w.used > 0 AND w.used + 1 + q.n <= 1800 THEN w.g ELSE w.g + 1 END, CASE WHEN q.n > 1800 THEN 0 WHEN w.used > 0 AND w.used + 1 + q.n <= 1800 THEN w.used + 1 + q.n ELSE q.n END, q.sentence, q.n <= 1800
      FROM w JOIN q ON q.key = w.key AND q.k = w.k + 1)
    SELECT key, g, string_agg(sentence, ' ' ORDER BY k) AS snippet FROM w WHERE kept GROUP BY key, g))"""


@query(_D_SNIPPETS)
def material_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(_snippets(F.col("text"))).alias("idx", "snippet"))


@query(f"""WITH s AS ({_D_SNIPPETS}), a AS (SELECT id, count(DISTINCT term) AS n_anchors FROM (WITH src AS (SELECT doc_id AS id, snippet AS text FROM s) {D_ANCHORS}) GROUP BY id)
  SELECT doc_id, CAST(length(text) AS INT) AS characters, CAST(coalesce(n, 0) AS INT) AS n_chunks, CAST(coalesce(longest, 0) AS INT) AS longest, CAST(coalesce(n_anchors, 0) AS INT) AS n_anchors
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, max(length(snippet)) AS longest FROM s GROUP BY 1) c USING (doc_id) LEFT JOIN a ON a.id = d.doc_id""")
def material_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, chunks, the longest chunk and different anchors of each document."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("characters"), _snippets(F.col("text")).alias("chunks"))
    anchors = F.array_distinct(F.flatten(F.transform("chunks", lambda c: T.anchor_terms(c))))
    longest = F.coalesce(F.array_max(F.transform("chunks", F.length)), F.lit(0))
    return rows.select("doc_id", "characters", F.size("chunks").alias("n_chunks"), longest.alias("longest"), F.size(anchors).alias("n_anchors"))


@arrow_function("array<string>")
def _lossless(text: pd.Series) -> pd.Series:
    return text.map(lambda t: chunks.lossless_windows(t, 2000), na_action=None)


@query("SELECT doc_id, coalesce(text, '') AS text, true AS bounded FROM documents")
def lossless_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most 2,000 characters, put together again."""
    rows = load(spark, sf_dir, "documents").select("doc_id", _lossless(F.col("text")).alias("w"))
    return rows.select("doc_id", F.array_join("w", "").alias("text"), F.forall("w", lambda x: F.length(x) <= 2000).alias("bounded"))


def d_split(source: str, limit: int) -> str:
    """SQL ``key, part, piece`` of a source's ``key, text``: cut after the last sentence mark or at the last space that comes late enough, else at the limit."""
    head = f"left(rest, {limit + 1})"
    mark = f"CASE WHEN regexp_matches({head}, '\\. |。|！|？') THEN length(regexp_extract({head}, '(?s)^(.*)(?:\\. |。|！|？)', 1)) ELSE -1 END"
    space = f"CASE WHEN contains({head}, ' ') THEN length(regexp_extract({head}, '(?s)^(.*) ', 1)) ELSE -1 END"
    cut = f"CASE WHEN {mark} >= {int(limit * 0.55)} THEN {mark} + 1 WHEN {space} >= {int(limit * 0.55)} THEN {space} ELSE {limit} END"
    return f"""WITH RECURSIVE cuts AS (SELECT key, 0 AS part, text AS rest, NULL::VARCHAR AS piece FROM {source}
    UNION ALL SELECT key, part + 1, CASE WHEN at_end THEN '' ELSE regexp_replace(substr(rest, cut + 1), '^\\s+', '') END, CASE WHEN at_end THEN rest ELSE regexp_replace(left(rest, cut), {_TRIMMED}) END
      FROM (SELECT *, length(rest) <= {limit} AS at_end, CAST({cut} AS BIGINT) AS cut FROM cuts WHERE rest <> ''))
    SELECT key, part, piece FROM cuts WHERE part > 0"""


#: Sentences packed to paragraphs of 1,200 characters, these cut to parts of 3,000 and packed to windows.
_D_SOURCE = f"""WITH RECURSIVE q AS (SELECT key, sentence, length(sentence) AS n, row_number() OVER (PARTITION BY key ORDER BY paragraph, place) AS k FROM ({d_sentences('documents', 'doc_id')})),
  w AS (SELECT DISTINCT key, 0::BIGINT AS k, -1 AS g, 0::BIGINT AS used, '' AS sentence FROM q
  UNION ALL SELECT w.key, q.k, CASE WHEN w.g >= 0 AND w.used + 1 + q.n <= 1200 THEN w.g ELSE w.g + 1 END, CASE WHEN w.g >= 0 AND w.used + 1 + q.n <= 1200 THEN w.used + 1 + q.n ELSE q.n END, q.sentence FROM w JOIN q ON q.key = w.key AND q.k = w.k + 1)
  SELECT key, g, string_agg(sentence, ' ' ORDER BY k) AS text FROM w WHERE k > 0 GROUP BY key, g"""
_D_PIECES = f"""SELECT key // 1000000 AS doc_id, key % 1000000 AS par, part, count(*) OVER (PARTITION BY key) AS parts, piece FROM ({d_split(f"(SELECT key * 1000000 + g AS key, text FROM ({_D_SOURCE}))", 3000)})"""
_D_WINDOWED = f"""WITH RECURSIVE q AS (SELECT *, length(piece) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY par, part) AS k FROM ({_D_PIECES})),
  w AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, -1 AS g, 0::BIGINT AS used FROM q
  UNION ALL SELECT w.doc_id, q.k, CASE WHEN w.g >= 0 AND w.used + 2 + q.n <= 3000 THEN w.g ELSE w.g + 1 END, CASE WHEN w.g >= 0 AND w.used + 2 + q.n <= 3000 THEN w.used + 2 + q.n ELSE q.n END FROM w JOIN q ON q.doc_id = w.doc_id AND q.k = w.k + 1),
  j AS (SELECT w.doc_id, w.g, w.k, q.par, q.part, q.parts, CASE WHEN lag(q.par) OVER v IS NULL THEN '' WHEN lag(q.par) OVER v = q.par THEN ' ' ELSE chr(10) || chr(10) END || q.piece AS t FROM w JOIN q ON q.doc_id = w.doc_id AND q.k = w.k WINDOW v AS (PARTITION BY w.doc_id, w.g ORDER BY w.k))
  SELECT doc_id, CAST(g AS INT) AS idx, string_agg(t, '' ORDER BY k) AS text, CAST(min(par) AS INT) AS first, CAST(max(par) AS INT) AS last, arg_min(part, k) > 1 AS continues_previous, arg_max(part, k) < arg_max(parts, k) AS continues_next FROM j GROUP BY doc_id, g"""

_WINDOW = "array<struct<text:string,first:int,last:int,continues_previous:boolean,continues_next:boolean>>"


@arrow_function(_WINDOW)
def _windows(text: pd.Series) -> pd.Series:
    return text.map(lambda t: chunks.windows(chunks.source_paragraphs(t), 3000), na_action=None)


@query(_D_WINDOWED)
def cleanup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(_windows(F.col("text"))).alias("idx", "w"))
    return rows.select("doc_id", "idx", "w.*")


@arrow_function("string")
def _reassembled(text: pd.Series) -> pd.Series:
    return text.map(lambda t: chunks.reassemble([w | {"cleaned": w["text"]} for w in chunks.windows(chunks.source_paragraphs(t), 3000)], guard.remove_repeats), na_action=None)


@query()
def region_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", _reassembled(F.col("text")).alias("text"))


@arrow_function("array<string>")
def _semantic(text: pd.Series) -> pd.Series:
    return text.map(lambda t: chunks.semantic_chunks(t, 1500), na_action=None)


_D_UNITS = f"""WITH b AS (SELECT doc_id, generate_subscripts(b, 1) AS bn, unnest(b) AS block FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), {_TRIMMED}), '\\n{{2,}}') AS b FROM documents)),
  l AS (SELECT doc_id, bn, row_number() OVER (PARTITION BY doc_id, bn ORDER BY i) AS ln, regexp_replace(x, {_TRIMMED}) AS line FROM (SELECT doc_id, bn, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM (SELECT doc_id, bn, string_split(block, chr(10)) AS ls FROM b WHERE length(block) > 1500)) WHERE regexp_replace(x, {_TRIMMED}) <> '')
  SELECT doc_id, bn, 0 AS ln, 0 AS part, block AS unit, chr(10) || chr(10) AS joint FROM b WHERE length(block) <= 1500
  UNION ALL SELECT key // 1000000000 AS doc_id, (key // 10000) % 100000 AS bn, key % 10000 AS ln, part, piece, CASE WHEN part > 1 THEN ' ' WHEN key % 10000 = 1 THEN chr(10) || chr(10) ELSE chr(10) END FROM ({d_split("(SELECT doc_id * 1000000000 + bn * 10000 + ln AS key, line AS text FROM l)", 1500)})"""


@query(f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bn, ln, part) AS k FROM ({_D_UNITS})),
  w AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, -1 AS g, 0::BIGINT AS used, '' AS t FROM q
  UNION ALL SELECT doc_id, k, CASE WHEN fits OR blank THEN g ELSE g + 1 END, CASE WHEN fits THEN used + length(joint || unit) WHEN blank THEN used ELSE length(unit) END, CASE WHEN fits THEN joint || unit WHEN blank THEN '' ELSE unit END FROM (
    SELECT q.doc_id, q.k, w.g, w.used, q.unit, q.joint, w.g >= 0 AND w.used + length(q.joint || q.unit) <= 1500 AS fits, regexp_replace(q.unit, {_TRIMMED}) = '' AS blank FROM w JOIN q ON q.doc_id = w.doc_id AND q.k = w.k + 1))
  SELECT doc_id, CAST(g AS INT) AS idx, string_agg(t, '' ORDER BY k) AS chunk FROM w WHERE k > 0 AND g >= 0 GROUP BY doc_id, g""")
def translation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(_semantic(F.col("text"))).alias("idx", "chunk"))


@arrow_function("array<array<string>>")
def _groups(units: pd.Series) -> pd.Series:
    return units.map(lambda us: chunks.display_groups([(str(u["ordinal"]), u["text"]) for u in us]))


@query("""WITH RECURSIVE u AS (SELECT conv_id AS session, CAST(turn AS VARCHAR) AS id, len(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL),
  w AS (SELECT DISTINCT session, 0::BIGINT AS k, 0 AS grp, 0 AS members, 0::BIGINT AS n, '' AS id FROM u
  UNION ALL SELECT session, k, CASE WHEN cut THEN grp + 1 ELSE grp END, CASE WHEN cut THEN 1 ELSE members + 1 END, CASE WHEN cut THEN size ELSE n + size END, id FROM (
    SELECT w.session, u.k, w.grp, w.members, w.n, u.id, u.size, w.members > 0 AND (w.members = 3 OR w.n >= 40 OR (w.n >= 15 AND w.n + u.size > 40)) AS cut FROM w JOIN u ON u.session = w.session AND u.k = w.k + 1))
  SELECT session, CAST(grp AS INT) AS idx, list(id ORDER BY k) AS members FROM w WHERE k > 0 GROUP BY session, grp""")
def display_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).where("text IS NOT NULL")
    units = turns.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("units"))
    return units.select("session", F.posexplode(_groups(F.col("units"))).alias("idx", "members"))


@query()
def artifact_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", guard.clean_artifacts(F.col("text")).alias("text"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("text").over(Window.partitionBy("session").orderBy("ordinal"))
    return _turns(spark, sf_dir).select("session", "ordinal", "text", following.alias("candidate")).where("candidate IS NOT NULL")


@query()
def cleanup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over each turn and the next one in the role of its rewriting."""
    return _pairs(spark, sf_dir).select("session", "ordinal", guard.guard(F.col("text"), F.col("candidate")).alias("g")).select("session", "ordinal", "g.*")


@query()
def accepted_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draft that is taken for each turn: the next turn, or itself with a doubled first word."""
    first = F.split("text", " ")[0]
    drafts = F.array("candidate", F.concat_ws(" ", first, "text"))
    return _pairs(spark, sf_dir).select("session", "ordinal", guard.accepted_draft(F.col("text"), drafts).alias("d")).select("session", "ordinal", "d.*")


@query()
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean character and word error rates of next turns against turns, by parity of the session."""
    rates = _pairs(spark, sf_dir).select((F.col("session") % 2).alias("grp"), guard.error_rates(F.col("text"), F.col("candidate")).alias("r"))
    return rates.groupBy("grp").agg(F.round(F.avg("r.cer"), 6).alias("cer"), F.round(F.avg("r.wer"), 6).alias("wer"), F.count("*").alias("n"))


_CANDIDATE = "array<struct<id:string,start:int,stop:int,original:string,replacement:string,score:double>>"


@arrow_function(_CANDIDATE)
def _candidates(source: pd.Series, evidence: pd.Series) -> pd.Series:
    def one(text: str, snippet: str) -> list[dict]:
        return [
            {"id": p["id"], "start": p["start"], "stop": p["stop"], "original": p["edit"].original, "replacement": p["edit"].replacement, "score": p["score"]}
            for p in repair.candidates(text or "", {"M1:S1": snippet or ""})
        ]

    return pd.Series([one(a, b) for a, b in zip(source, evidence, strict=True)])


@query()
def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn's wording would become with the next turn as evidence."""
    pairs = _pairs(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session", "ordinal")
    rows = pairs.select("session", "ordinal", F.explode(_candidates(F.col("text"), F.col("candidate"))).alias("c"))
    return rows.select("session", "ordinal", "c.*")


_D_FRAMES = "SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS DOUBLE) AS moment, value / 4000 AS energy, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value / 4000) AS k FROM events"


@query(f"""WITH RECURSIVE f AS ({_D_FRAMES}), w AS (SELECT DISTINCT key, 0::BIGINT AS k, 0.0::DOUBLE AS start, 0.0::DOUBLE AS length, 0.0::DOUBLE AS quiet, false AS speech, NULL::DOUBLE AS from_ms, NULL::DOUBLE AS to_ms, NULL::BOOLEAN AS had, NULL::VARCHAR AS why FROM f
  UNION ALL SELECT key, k, CASE WHEN cut IS NULL THEN start ELSE start + l END, CASE WHEN cut IS NULL THEN l ELSE 0 END, CASE WHEN cut IS NULL THEN q ELSE 0 END, CASE WHEN cut IS NULL THEN s ELSE false END,
    CASE WHEN cut IS NOT NULL THEN start END, CASE WHEN cut IS NOT NULL THEN start + l END, CASE WHEN cut IS NOT NULL THEN s END, cut FROM (
    SELECT *, CASE WHEN l >= {folds.MAX_MS} THEN 'max-duration' WHEN s AND l >= {folds.MIN_MS} AND q >= {folds.SILENCE_MS} THEN 'speech-boundary' END AS cut FROM (
      SELECT w.key, f.k, w.start, w.length + 500 AS l, CASE WHEN f.energy >= {folds.SPEECH} THEN 0 WHEN w.speech THEN w.quiet + 500 ELSE w.quiet END AS q, w.speech OR f.energy >= {folds.SPEECH} AS s FROM w JOIN f ON f.key = w.key AND f.k = w.k + 1)))
  SELECT key, from_ms AS start_ms, to_ms AS stop_ms, had AS has_speech, why AS reason FROM w WHERE why IS NOT NULL
  UNION ALL SELECT key, start, start + length, speech, 'stop' FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k DESC) AS r FROM w) WHERE r = 1 AND length > 0""")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.segment_batch(segmentation.event_frames(load(spark, sf_dir, "events")))


@query(f"""WITH RECURSIVE f AS (SELECT * REPLACE (100 * moment AS moment) FROM ({_D_FRAMES})), w AS (SELECT DISTINCT key, 0::BIGINT AS k, 0.0::DOUBLE AS heard, false AS armed, NULL::DOUBLE AS deadline, false AS done FROM f
  UNION ALL SELECT key, k, CASE WHEN over THEN heard WHEN loud THEN heard + 500 WHEN NOT armed THEN 0 ELSE heard END, armed OR (NOT over AND loud AND heard + 500 >= {folds.MEANINGFUL_MS}),
    CASE WHEN over THEN deadline WHEN loud AND (armed OR heard + 500 >= {folds.MEANINGFUL_MS}) THEN NULL WHEN NOT loud AND armed AND deadline IS NULL THEN moment + {folds.AUTO_STOP_MS} ELSE deadline END, over FROM (
    SELECT w.key, f.k, f.moment, w.heard, w.armed, w.deadline, coalesce(f.moment >= w.deadline, false) AS over, f.energy >= {folds.SPEECH} AS loud FROM w JOIN f ON f.key = w.key AND f.k = w.k + 1 WHERE NOT w.done))
  SELECT key, deadline AS stop_ms FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1""")
def inactivity_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.stops(segmentation.event_frames(load(spark, sf_dir, "events")).withColumn("at", F.col("at") * 100))


@query()
def schedule_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded queue's history for the submissions of each user."""
    e = load(spark, sf_dir, "events")
    priority = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1).otherwise(3)
    jobs = e.select(
        F.col("user_id").cast("string").alias("lane"), F.col("event_id").cast("double").alias("at"), F.concat_ws(":", "event_type", F.col("event_id") % 7).alias("job"), priority.alias("priority"),
        (10 * F.col("value")).alias("cost"), (priority == 3).alias("preemptible"),
    )
    return segmentation.replay_schedule(jobs)


@query("""WITH RECURSIVE f AS (SELECT CAST(user_id AS VARCHAR) AS lane, event_id * 1000.0::DOUBLE AS moment, event_id * 1000.0::DOUBLE + 20 * value AS until, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value) AS k FROM events),
  w AS (SELECT DISTINCT lane, 0::BIGINT AS k, NULL::DOUBLE AS moment, 0 AS epoch, 0 AS n, NULL::DOUBLE AS born, -1e300::DOUBLE AS busy FROM f
  UNION ALL SELECT lane, k, moment, CASE WHEN reset THEN epoch + 1 ELSE epoch END, CASE WHEN reset THEN 1 ELSE n + 1 END, CASE WHEN reset OR born IS NULL THEN moment ELSE born END, greatest(busy, until) FROM (
    SELECT w.lane, f.k, f.moment, f.until, w.epoch, w.n, w.born, w.busy, w.born IS NOT NULL AND f.moment >= w.busy AND (w.n >= 25 OR f.moment - w.born >= 300000) AS reset FROM w JOIN f ON f.lane = w.lane AND f.k = w.k + 1))
  SELECT lane, moment AS "at", epoch FROM w WHERE k > 0""")
def runner_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    at = F.col("event_id") * 1000.0
    return segmentation.runner_epochs(e.select(F.col("user_id").cast("string").alias("lane"), at.alias("at"), (at + 20 * F.col("value")).alias("until")))


@query("""SELECT event_id, CAST(0 AS INT) AS idx, value AS start, value + 1 AS "end", event_type AS text FROM events""")
def recognised_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of recogniser output made from events, offsets in seconds."""
    e = load(spark, sf_dir, "events")
    segment = F.struct(F.col("value").alias("start"), (F.col("value") + 1).alias("end"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("text"))
    blank = F.struct(F.col("value").alias("start"), F.col("value").alias("end"), F.lit(" ").alias("text"))
    return files.recognised_segments(e.select("event_id", F.to_json(F.struct(F.array(segment, blank).alias("segments"))).alias("json")), "event_id", "json")
