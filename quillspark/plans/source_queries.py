"""Queries over files: material readers, sound, manifests and small selections."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import markdown, repair
from quillspark.functions.arrow import arrow_function
from quillspark.operators import lineage, segments
from quillspark.session import load
from quillspark.sources import files

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


def _letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", " "))


_D_LETTERS = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"


@arrow_function("binary")
def _zipped(names: pd.Series, bodies: pd.Series) -> pd.Series:
    """Archives with the named entries, as an office file is one."""
    out = []
    for entries, texts in zip(names, bodies, strict=True):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as archive:
            for name, text in zip(entries, texts, strict=True):
                archive.writestr(zipfile.ZipInfo(name), text)
        out.append(held.getvalue())
    return pd.Series(out)


@query(f"""SELECT path, reader, left(t, 500000) AS text, CAST(length(t) AS INT) AS characters, length(t) > 500000 AS truncated, length(t) >= 20 AS readable FROM (SELECT
  CAST(doc_id AS VARCHAR) || '.' || CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'html' WHEN 2 THEN 'PDF' WHEN 3 THEN 'docx' ELSE 'pptx' END AS path,
  CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'markup' WHEN 2 THEN 'pdf' ELSE 'ooxml' END AS reader,
  trim(CASE doc_id % 5 WHEN 0 THEN a || chr(10) || 'end' WHEN 1 THEN a || chr(10) || 'x & <y>' WHEN 2 THEN CASE WHEN a = '' THEN 'One (two)' ELSE lower(a) || chr(10) || 'One (two)' END
    WHEN 3 THEN a || chr(10) || ' last' ELSE '## Slide 2' || chr(10) || ' ' || a || ' ' || chr(10) END, ' ' || chr(10)) AS t FROM (SELECT doc_id, {_D_LETTERS} AS a FROM documents))""")
def extracted_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as plain, markup, PDF and office files, and read again."""
    d, k = load(spark, sf_dir, "documents").withColumn("a", _letters(F.col("text"))), F.col("doc_id") % 5
    path = F.concat(F.col("doc_id").cast("string"), F.lit("."), F.when(k == 0, "txt").when(k == 1, "html").when(k == 2, "PDF").when(k == 3, "docx").otherwise("pptx"))
    plain = F.when(k == 0, F.concat("a", F.lit("\nend"))).when(k == 1, F.concat(F.lit("<p>"), "a", F.lit("</p>x &amp; &lt;y&gt;"))).when(k == 2, F.concat(F.lit("%PDF-1.4\nBT ("), F.lower("a"), F.lit(") Tj T* (One \\(two\\)) Tj ET")))
    document = F.concat(F.lit("<w:body><w:p>"), "a", F.lit("</w:p><w:p>last</w:p></w:body>"))
    slide = F.concat(F.lit("<a:p>"), "a", F.lit("</a:p>"))
    office = _zipped(
        F.when(k == 3, F.array(F.lit("word/document.xml"))).otherwise(F.array(F.lit("ppt/slides/slide2.xml"))),
        F.array(F.when(k == 3, document).otherwise(slide)),
    )
    content = F.when(k < 3, F.encode(plain, "UTF-8")).otherwise(office)
    return files.extract_materials(d.select(path.alias("path"), content.alias("content")))


@query("""SELECT event_id, true AS valid, 16000::BIGINT AS sample_rate, CAST(1 AS INT) AS channels, CAST(16 AS INT) AS bits, (2 * (event_id % 40))::BIGINT AS data_bytes, 44::BIGINT AS data_start, (event_id % 40) / 16000.0::DOUBLE AS seconds FROM events WHERE event_id % 9 <> 0
  UNION ALL SELECT event_id, false, 0, 0, 0, 0, 0, 0.0 FROM events WHERE event_id % 9 = 0""")
def wav_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of sounds that are as long as an event's number says; every ninth is no sound."""
    n = F.col("event_id") % 40
    events = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, n).alias("n"))
    return events.select("event_id", files.wav_header(_sound(F.col("n"))).alias("w")).select("event_id", "w.*")


@arrow_function("binary")
def _sound(n: pd.Series) -> pd.Series:
    return pd.Series([b"no sound" if x != x or x is None else files.wav_file(files.encode_samples([((k % 7) - 3) / 3 for k in range(int(x))]), 16_000) for x in n])


@query("""SELECT recording, CAST(44 + 2 * total AS BIGINT) AS bytes, total / 16000.0::DOUBLE AS seconds FROM (SELECT CAST(user_id AS VARCHAR) AS recording, sum(event_id % 40) AS total FROM events GROUP BY 1)""")
def combined_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sounds under one header."""
    chunks = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording"), F.col("event_id").alias("sequence"), _sound(F.col("event_id") % 40).alias("content"))
    joined = files.combine_wavs(chunks)
    return joined.select("recording", F.octet_length("content").cast("long").alias("bytes"), files.wav_header(F.col("content"))["seconds"].alias("seconds"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 6 = 0 THEN 'repeated' WHEN doc_id % 7 = 1 THEN 'missing' WHEN doc_id % 5 = 2 THEN 'changed' ELSE 'verified' END AS status FROM documents""")
def verified_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's entries against the files: repeated, missing, changed or verified."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    listed = d.select("k", "path", F.when(F.col("k") % 5 == 2, F.lit("0" * 64)).otherwise(F.sha2("content", 256)).alias("sha256"))
    manifest = listed.select("path", "sha256").union(listed.where(F.col("k") % 6 == 0).select("path", "sha256"))
    return files.verified_manifest(manifest, d.where(F.col("k") % 7 != 1).select("path", "content"))


@query("""SELECT sha256(string_agg(lang || ':' || h, chr(10) ORDER BY lang)) AS identity FROM (SELECT lang, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY lang)""")
def code_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fingerprint of a folder with a file for each language."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    folder = load(spark, sf_dir, "documents").groupBy(F.col("lang").alias("path")).agg(F.encode(ids, "UTF-8").alias("content"))
    return files.code_identity(folder)


@query("SELECT url AS path FROM pages WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 <> 3 AND url IS NOT NULL)")
def unexpected_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in an output folder that no plan permits."""
    found = load(spark, sf_dir, "pages").where(F.col("url").isNotNull()).select("page_id", F.col("url").alias("path"))
    return files.unexpected_outputs(found, found.where(F.col("page_id") % 4 != 3).select("path")).select("path")


@query()
def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as Markdown rendered to HTML."""
    return load(spark, sf_dir, "documents").select("doc_id", markdown.markdown_html(F.col("text")).alias("html"))


@query("""SELECT doc_id AS session, text AS transcript, lang, length(trim(coalesce(text, ''))) > 0 AS has_transcript FROM documents""")
def public_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without what only the owner may see."""
    d = load(spark, sf_dir, "documents")
    return segments.public_session(d.select(F.col("doc_id").alias("session"), F.col("text").alias("transcript"), "lang", F.col("source").alias("stored_path"), F.col("text").alias("extracted_text")))


@query("""SELECT session, paragraph, coalesce(string_agg(t, ' ' ORDER BY ordinal) FILTER (t <> ''), '') AS text FROM (SELECT g.session, g.paragraph, g.ordinal, trim(coalesce(c.text, '')) AS t FROM (
  SELECT DISTINCT conv_id AS session, turn // 3 AS paragraph, unnest([3 * (turn // 3), 3 * (turn // 3) + 1, 3 * (turn // 3) + 2]) AS ordinal FROM conversations) g LEFT JOIN conversations c ON c.conv_id = g.session AND c.turn = g.ordinal) GROUP BY 1, 2""")
def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of paragraphs that name their segments; segments that aren't there are empty."""
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), "text")
    paragraph = F.floor(F.col("ordinal") / 3)
    groups = turns.select("session", paragraph.alias("paragraph")).distinct().withColumn("ordinals", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: 3 * F.col("paragraph") + i))
    return segments.segment_texts(groups, turns)


@query("""SELECT session, CAST(sum(coalesce(accepted, 0)) AS BIGINT) AS accepted, CAST(sum(coalesce(rejected, 0)) AS BIGINT) AS rejected, sum(coalesce(accepted, 0)) > 0 AS retained FROM (SELECT user_id AS session, CASE WHEN event_type <> 'error' THEN event_id % 3 END AS accepted, CASE WHEN event_type <> 'error' THEN event_id % 2 END AS rejected FROM events) GROUP BY 1""")
def repair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected edits of each session over its windows' attempts."""
    e, k = load(spark, sf_dir, "events"), F.col("event_id")
    attempts = F.when(F.col("event_type") != "error", F.array(F.struct((k % 3).alias("accepted"), (k % 2).alias("rejected"))))
    return segments.repair_totals(e.select(F.col("user_id").alias("session"), attempts.alias("attempts")))


@query("""SELECT doc_id AS "case", CASE WHEN doc_id % 4 = 0 THEN 'start' WHEN doc_id % 11 = 5 THEN 'refuse' WHEN doc_id % 3 <> 1 AND doc_id % 5 <> 2 THEN 'keep' ELSE 'rerun' END AS action FROM documents""")
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rerun does with each case."""
    d, k = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("case")), F.col("case")
    cases = d.select(k, F.lit("r1").alias("run_fp"), (k % 2).cast("string").alias("case_fp"))
    done = d.where(k % 4 != 0).select(
        k, F.when(k % 11 == 5, "r0").otherwise("r1").alias("run_fp"), F.when(k % 3 == 1, "x").otherwise((k % 2).cast("string")).alias("case_fp"), F.when(k % 5 == 2, "degraded").otherwise("complete").alias("status")
    )
    return segments.resume_plan(cases, done)


@query("SELECT event_id FROM events WHERE event_id % 3 = user_id % 3 AND event_id % 2 = 1")
def current_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose token and revision are still the current ones."""
    e = load(spark, sf_dir, "events")
    rows = e.select("event_id", (F.col("event_id") % 3).alias("token"), (F.col("user_id") % 3).alias("current_token"), (F.col("event_id") % 2).alias("source_revision"), F.lit(1).alias("current_revision"))
    return lineage.latest_attempts(rows, ["event_id"])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'qwen' WHEN 1 THEN 'gemma:latest' WHEN 2 THEN 'base' ELSE event_type END AS model FROM events""")
def fallback_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that answers a request for one: itself, its latest tag, the default or the first there is."""
    e, k = load(spark, sf_dir, "events"), F.col("event_id") % 4
    asked = F.when(k == 0, "qwen").when(k == 1, "gemma").otherwise("none")
    installed = F.when(k < 3, F.array(F.lit("tiny"), F.lit("qwen"), F.lit("gemma:latest"), F.lit("base"))).otherwise(F.array(F.col("event_type"), F.lit("tiny")))
    return e.select("event_id", segments.fallback_model(asked, installed, "base").alias("model"))


def _patch(number: int, start: int, text: str, kind: str) -> dict:
    return {"id": f"C{number}", "start": start, "stop": start + 5, "edit": repair.Edit("Beyes", text, "name", "M1:S1", "the Bayes theorem and BAYES rule", 1)}


_SOURCE = "We use Beyes theorem here with prior evidence today and posterior evidence after that."
_SNIPPETS = {"M1:S1": "We use the Bayes theorem and BAYES rule with prior evidence and posterior evidence."}


@arrow_function("text string, accepted int, reasons array<string>")
def _selected(chosen: pd.Series) -> pd.DataFrame:
    offered = [_patch(1, 7, "Bayes", "name"), _patch(2, 7, "BAYES", "name")]
    rows = []
    for ids in chosen:
        done = repair.apply_selection(_SOURCE, list(ids), offered, _SNIPPETS)
        rows.append((done["text"], len(done["accepted"]), [reason for _, reason in done["rejected"]]))
    return pd.DataFrame(rows, columns=["text", "accepted", "reasons"])


_D_DONE = "'" + _SOURCE.replace("Beyes", "Bayes") + "'"


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_D_DONE} WHEN 3 THEN {_D_DONE} ELSE '{_SOURCE}' END AS text, CAST(event_id % 4 IN (0, 3) AS INT) AS accepted,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'conflicting-candidate-selection,conflicting-candidate-selection' WHEN 2 THEN 'invalid-candidate-id' ELSE 'invalid-candidate-id' END AS reasons FROM events""")
def applied_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a choice among offered edits makes of a text: applied, in conflict, or of unknown ids."""
    k = F.col("event_id") % 4
    chosen = F.when(k == 0, F.array(F.lit("C1"))).when(k == 1, F.array(F.lit("C1"), F.lit("C2"))).when(k == 2, F.array(F.lit("C9"))).otherwise(F.array(F.lit("C1"), F.lit("C7")))
    rows = load(spark, sf_dir, "events").select("event_id", _selected(chosen).alias("s"))
    return rows.select("event_id", "s.text", "s.accepted", F.array_join("s.reasons", ",").alias("reasons"))
