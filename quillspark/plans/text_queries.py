"""Queries over texts: tokens, sentences, ratios, markup, paragraphs and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.functions.vocabulary import FILLERS, GENERIC_WORDS, TRANSITION_CUES
from quillspark.operators import paragraphs, retrieval
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


def listed(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# DuckDB forms of the text functions.
def d_space(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{T.SPACE}+', ' ', 'g'))"


def d_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({d_space(x)}), '{T.TOKEN}')"


def d_words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{T.WORD}')"


def d_word_set(x: str) -> str:
    return f"list_distinct(list_filter({d_words(x)}, lambda w: length(w) > 2))"


D_STEM1 = "CASE WHEN length(t) > 4 AND t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is|es)$') THEN left(t, length(t) - 1) ELSE t END"
D_ANCHORS = f"""SELECT DISTINCT id, term FROM (
  SELECT id, t, CASE WHEN length(s) > 5 AND s LIKE '%ing' THEN left(s, length(s) - 3) ELSE s END AS term
  FROM (SELECT id, t, {D_STEM1} AS s FROM (SELECT id, unnest({d_tokens("text")}) AS t FROM src)))
  WHERE length(term) >= 3 AND regexp_matches(term, '^\\p{{L}}+$') AND term NOT IN ({listed(GENERIC_WORDS)}) AND t NOT IN ({listed(GENERIC_WORDS)})"""


@query(f"""SELECT doc_id, len({d_tokens("text")}) AS n_tokens, len({d_words("text")}) AS n_words,
  len(list_filter({d_tokens("text")}, lambda t: NOT (t IN ({listed(FILLERS)})))) AS n_meaningful, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS token_estimate FROM documents""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    # Tokens are found once, as a column of their own, and counted twice.
    found = load(spark, sf_dir, "documents").select("doc_id", T.tokens(text).alias("tokens"), F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(T.WORD)).alias("n_words"), T.token_estimate(text).alias("token_estimate"))
    meaningful = F.size(F.filter("tokens", lambda t: ~t.isin(*FILLERS)))
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), "n_words", meaningful.alias("n_meaningful"), "token_estimate")


@query(f"""SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS fp FROM documents
  QUALIFY row_number() OVER (PARTITION BY lower({d_space("text")}) ORDER BY doc_id) = 1""")
def text_fingerprint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    identity = F.sha2(F.lower(T.normalise_space(F.col("text"))), 256)
    rows = docs.select("doc_id", T.fingerprint(F.col("text")).alias("fp"), identity.alias("identity"))
    return rows.groupBy("identity").agg(F.min(F.struct("doc_id", "fp")).alias("first")).select("first.doc_id", "first.fp")


def _sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.stable_sentences(F.col("text"))).alias("idx", "sentence"))


D_SENTENCES = f"""SELECT doc_id, generate_subscripts(s, 1) - 1 AS idx, unnest(s) AS sentence FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all({d_space("text")}, '{T.STABLE_SENTENCE.replace("'", "''")}'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)"""


@query(f"SELECT doc_id, CAST(idx AS INT) AS idx, sentence FROM ({D_SENTENCES})")
def stable_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(load(spark, sf_dir, "documents"))


D_TAIL = f"regexp_extract({d_space('text')}, '[^.!?。！？…]*$')"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches({d_space("text")}, '[^.!?。！？…][.!?。！？…]') THEN {d_space(f"regexp_replace({D_TAIL}, '^[\"''”’»)]*', '')")} ELSE {d_space("text")} END AS tail FROM documents""")
def unfinished_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.unfinished_tail(F.col("text")).alias("tail"))


@query(f"""SELECT doc_id, CAST(idx AS INT) AS idx, substr(sha256(sentence), 1, 16) || ':' || CAST(row_number() OVER (PARTITION BY doc_id, sentence ORDER BY idx) - 1 AS VARCHAR) AS key FROM ({D_SENTENCES})""")
def sentence_occurrence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(load(spark, sf_dir, "documents")).withColumn("fp", T.fingerprint(F.col("sentence")))
    number = F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy("idx")) - 1
    return rows.select("doc_id", "idx", F.concat_ws(":", "fp", number.cast("string")).alias("key"))


@query(f"""SELECT doc_id, idx, list_aggregate(list(sentence) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 'string_agg', ' ') AS context
  FROM (SELECT doc_id, CAST(idx AS INT) AS idx, sentence FROM ({D_SENTENCES}))""")
def preceding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finished sentence's three predecessors."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(-3, -1)
    rows = _sentences(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "idx", F.nullif(F.array_join(F.collect_list("sentence").over(before), " "), F.lit("")).alias("context"))


@query(f"""SELECT doc_id, round(CASE WHEN {d_space("text")} = '' THEN 0.0 ELSE len(regexp_extract_all({d_space("text")}, '{T.CJK}')) / length({d_space("text")}) END, 6) AS cjk,
  round(len(regexp_extract_all(left(trim(coalesce(text, '')), 100000), '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f-\\x{{9f}}]')) / greatest(1, length(left(trim(coalesce(text, '')), 100000))), 6) AS control FROM documents""")
def script_and_control_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(T.script_ratio(F.col("text")), 6).alias("cjk"), F.round(T.control_ratio(F.col("text")), 6).alias("control"))


@query("""SELECT doc_id, length(trim(coalesce(text, ''))) >= 20 AND len(regexp_extract_all(left(trim(coalesce(text, '')), 100000), '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f-\\x{9f}]'))
  / greatest(1, length(left(trim(coalesce(text, '')), 100000))) <= 0.02 AS readable FROM documents""")
def readable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.is_readable(F.col("text")).alias("readable"))


@query(f"""SELECT doc_id, CAST(CASE WHEN {d_space("text")} = '' THEN 0 ELSE len(string_split({d_space("text")}, ' ')) END AS INT) AS measure FROM documents""")
def content_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.content_measure(F.col("text")).cast("int").alias("measure"))


_D_MARKUP = "coalesce(html, '')"
for _a, _b in (
    (r"<w:tab\s*/>", "chr(9)"), (r"<w:br\s*/>|<a:br\s*/>", "chr(10)"), (r"</w:p>|</a:p>|</p>|</h\d>", "chr(10)"), (r"<[^>]+>", "' '"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"),
    ("(?i)&quot;", "'\"'"), ("(?i)&apos;", "chr(39)"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), (r"[ \t]+\n", "chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)"),
):
    _D_MARKUP = f"regexp_replace({_D_MARKUP}, '{_a}', {_b}, 'g')"
_D_MARKUP = f"regexp_replace({_D_MARKUP}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"


@query(f"SELECT page_id, {_D_MARKUP} AS text FROM pages")
def markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.markup_to_text(F.col("html")).alias("text"))


@query(f"""SELECT page_id, left(t, 500000) AS text, length(t) AS characters, length(t) > 500000 AS truncated FROM (SELECT page_id,
  regexp_replace(regexp_replace(regexp_replace(replace(coalesce(html, ''), chr(0), ''), '\\r\\n?', chr(10), 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS t FROM pages)""")
def material_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.normalise_material(F.col("html")).alias("m")).select("page_id", "m.*")


@query("""SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '^.*[/\\\\]', ''), '[^\\p{L}\\p{N}._ -]+', '_', 'g'), '^\\.+', ''), 140), ''), 'file') AS filename FROM pages""")
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("filename"))


@query("""SELECT page_id, CASE WHEN ext IN ('txt', 'md', 'csv', 'tsv', 'json', 'yaml', 'srt', 'vtt') THEN 'text' WHEN ext IN ('html', 'htm', 'xml') THEN 'markup'
  WHEN ext IN ('docx', 'pptx') THEN 'ooxml' WHEN ext = 'pdf' THEN 'pdf' ELSE 'unsupported' END AS reader FROM (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages)""")
def extension_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.sources.materials import reader_for

    return load(spark, sf_dir, "pages").select("page_id", reader_for(F.col("url")).alias("reader"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), "role", "text", (2.0 * F.col("turn")).alias("start"), (2.0 * F.col("turn") + 1).alias("end"))


def _next(column: str) -> Column:
    return F.lead(column).over(Window.partitionBy("session").orderBy("ordinal"))


D_PAIRS = "SELECT conv_id AS session, turn AS ordinal, text, lead(text) OVER w AS right_text, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
D_OVERLAP = f"""CASE WHEN least(len({d_word_set("text")}), len({d_word_set("right_text")})) = 0 THEN 1.0
  ELSE len(list_intersect({d_word_set("text")}, {d_word_set("right_text")})) / least(len({d_word_set("text")}), len({d_word_set("right_text")})) END"""


@query(f"SELECT session, ordinal, round({D_OVERLAP}, 6) AS overlap FROM ({D_PAIRS}) WHERE next IS NOT NULL")
def overlap_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _turns(spark, sf_dir).select("session", "ordinal", "text", _next("text").alias("right"), _next("ordinal").alias("next")).where("next IS NOT NULL")
    return pairs.select("session", "ordinal", F.round(T.overlap(F.col("text"), F.col("right")), 6).alias("overlap"))


@query(f"""SELECT session, ordinal, CASE WHEN trim(coalesce(text, '')) = '' THEN trim(coalesce(right_text, '')) WHEN trim(coalesce(right_text, '')) = '' THEN trim(coalesce(text, ''))
  ELSE trim(text) || ' ' || trim(right_text) END AS joined FROM ({D_PAIRS})""")
def appended_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("session", "ordinal", T.append_text(F.col("text"), _next("text")).alias("joined"))


@query(f"""SELECT conv_id AS session, turn AS ordinal, len(list_filter(range(1, len(t) - 8), lambda i: t[i:i+4] = t[i+5:i+9])) > 0 AS repeated
  FROM (SELECT conv_id, turn, {d_tokens("text")} AS t FROM conversations)""")
def repeated_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("session", "ordinal", "text")
    return rows.select("session", "ordinal", T.has_repeated_ngram(F.col("text")).alias("repeated"))


ACCENTS = "áàâäãåéèêëíìîïóòôöõúùûüñçßœæ"
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ01"


def d_distance(a: str, b: str) -> str:
    """Code-point distance of lower-case words: DuckDB counts bytes, so letters beyond ASCII become other single bytes."""
    return f"levenshtein(translate({a}, '{ACCENTS}', '{PLAIN}'), translate({b}, '{ACCENTS}', '{PLAIN}'))"


def _d_meaningful(x: str) -> str:
    return f"list_transform(list_filter({d_tokens(x)}, lambda t: NOT (t IN ({listed(FILLERS)}))), lambda t: translate(t, '{ACCENTS}', '{PLAIN}'))"


_D_ALIKE = """(length(t) >= 4 AND length(o) >= 4 AND (regexp_replace(t, 's$', '') = regexp_replace(o, 's$', '') OR (abs(length(t) - length(o)) <= 5 AND (contains(t, o) OR contains(o, t)))))
  OR (length(t) >= 5 AND length(o) >= 5 AND abs(length(t) - length(o)) <= 1 AND levenshtein(t, o) <= 1)"""


@query(f"""SELECT session, ordinal, round(CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_filter(want, lambda t: list_contains(have, t) OR len(list_filter(have, lambda o: {_D_ALIKE})) > 0)) / len(want) END, 6) AS coverage
  FROM (SELECT session, ordinal, {_d_meaningful("text")} AS want, list_distinct({_d_meaningful("right_text")}) AS have FROM ({D_PAIRS}) WHERE right_text IS NOT NULL)""")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a turn the next one covers, by tokens that are alike."""
    pairs = _turns(spark, sf_dir).select("session", "ordinal", "text", _next("text").alias("right")).where("right IS NOT NULL")
    return pairs.select("session", "ordinal", F.round(T.token_coverage(F.col("text"), F.col("right")), 6).alias("coverage"))


@query("""SELECT doc_id, f AS formula FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)(?:\\d+(?:\\.\\d+)?\\s*[×x÷/*+−–—=-]\\s*)+\\d+(?:\\.\\d+)?|[λμσαβγθπ]\\s*=\\s*[^\\s,.;]+'),
  lambda f: translate(regexp_replace(lower(f), '[\\s×]', '', 'g'), 'x−–—', '*---'))) AS f FROM documents)""")
def formula_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(T.formulas(F.col("text"))).alias("formula"))


_CUES = "|".join(TRANSITION_CUES).replace("'", "''")
D_BOUNDARIES = f"""SELECT session, after, next, pause, sentence, transition, long, topic_shift, from_end, least(0.99, raw) AS score,
  CASE WHEN long THEN raw >= 0.22 ELSE sentence AND raw >= 0.48 END AS enabled FROM (SELECT *, (CASE WHEN pause >= 2.0 THEN 0.28::DOUBLE WHEN pause >= 1.1 THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN sentence THEN 0.24::DOUBLE ELSE 0 END) + (CASE WHEN transition THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN topic_shift THEN 0.30::DOUBLE ELSE 0 END) + (CASE WHEN long THEN 0.22::DOUBLE ELSE 0 END) AS raw FROM (
  SELECT session, ordinal AS after, next, 1.0::DOUBLE AS pause, sentence, regexp_matches(right_text, '(?i)^(?:{_CUES})\\b') AS transition, so_far >= 120 OR n_words >= 180 AS long,
  sentence AND n_words >= 5 AND {D_OVERLAP} < 0.12 AS topic_shift, from_end FROM (SELECT *, regexp_matches(text, '{T.SENTENCE_END.replace("'", "''")}') AS sentence,
  lead(text) OVER w AS right_text, lead(ordinal) OVER w AS next, sum(n_words) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far, count(*) OVER (PARTITION BY session) - row_number() OVER w AS from_end FROM (
  SELECT conv_id AS session, turn AS ordinal, trim(text) AS text, len({d_words("text")}) AS n_words FROM conversations WHERE text IS NOT NULL AND trim(text) <> '') WINDOW w AS (PARTITION BY session ORDER BY ordinal)) WHERE next IS NOT NULL))"""
D_NUMBERED = f"""SELECT c.session, c.ordinal, c.text, 1 + coalesce(sum(CASE WHEN b.enabled THEN 1 ELSE 0 END) OVER (PARTITION BY c.session ORDER BY c.ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paragraph
  FROM (SELECT conv_id AS session, turn AS ordinal, text FROM conversations) c LEFT JOIN ({D_BOUNDARIES}) b ON b.session = c.session AND b.after = c.ordinal"""


@query(f"SELECT session, after, next, sentence, transition, long, topic_shift, round(score, 6) AS score, enabled FROM ({D_BOUNDARIES})")
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.boundary_candidates(_turns(spark, sf_dir))
    return found.select("session", "after", "next", "sentence", "transition", "long", "topic_shift", F.round("score", 6).alias("score"), "enabled")


@query(f"SELECT session, ordinal, CAST(paragraph AS BIGINT) AS paragraph FROM ({D_NUMBERED})")
def paragraph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return paragraphs.paragraph_numbers(turns, paragraphs.boundary_candidates(turns)).drop("text")


@query(f"""SELECT session, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS text FROM (
  SELECT session, paragraph, string_agg(trim(text), ' ' ORDER BY ordinal) FILTER (trim(coalesce(text, '')) <> '') AS text FROM ({D_NUMBERED}) GROUP BY ALL) GROUP BY session""")
def rendered_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return paragraphs.render(paragraphs.paragraph_numbers(turns, paragraphs.boundary_candidates(turns)))


@query(f"""SELECT n.session, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS n_segments, round(coalesce(min(CASE WHEN b.enabled THEN b.score END), 1.0), 6) AS confidence
  FROM ({D_NUMBERED}) n LEFT JOIN ({D_BOUNDARIES}) b ON b.session = n.session AND b.after = n.ordinal GROUP BY 1, 2""")
def paragraph_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    edges = paragraphs.boundary_candidates(turns).withColumn("locked", F.lit(False))
    return paragraphs.paragraphs(turns, edges).select("session", "paragraph", "n_segments", F.round("confidence", 6).alias("confidence"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "benchmark").select("item_id", "text", F.col("item_id").cast("string").alias("label"), F.lit(0).alias("idx"))
    return retrieval.distinct_snippets(rows)


D_ITEMS = f"SELECT item_id AS id, text FROM benchmark QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(text, '{T.SPACE}+', ' ', 'g')) ORDER BY CAST(item_id AS VARCHAR)) = 1"


@query(f"WITH src AS ({D_ITEMS}) SELECT term, count(*) AS df FROM ({D_ANCHORS}) GROUP BY term")
def anchor_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_frequency(retrieval.anchor_index(_items(spark, sf_dir), "item_id"))


@query(f"""WITH items AS ({D_ITEMS}), ia AS (WITH src AS (SELECT * FROM items) {D_ANCHORS}), qa AS (WITH src AS (SELECT doc_id AS id, text FROM documents) {D_ANCHORS}),
  df AS (SELECT term, round(1 + ln(((SELECT count(*) FROM items) + 1) / (count(*) + 1)), 9) AS weight FROM ia GROUP BY term), na AS (SELECT id, count(*) AS n FROM ia GROUP BY id),
  s AS (SELECT qa.id AS doc_id, ia.id AS item_id, count(*) AS shared, round(sum(weight) * least(1.0, count(*) / sqrt(greatest(1, any_value(n)))), 3) AS score
    FROM qa JOIN ia USING (term) JOIN df USING (term) JOIN na ON na.id = ia.id GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT doc_id, item_id, shared, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CAST(item_id AS VARCHAR)) AS rank FROM s) WHERE rank <= 3""")
def lexical_retrieval_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ranked_evidence(load(spark, sf_dir, "documents"), _items(spark, sf_dir)).where(F.col("rank") <= retrieval.TOP)


@query("""WITH r AS (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
  SELECT source, doc_id, left(text, CAST(least(length(text), greatest(0, 180000 - before)) AS BIGINT)) AS kept FROM r WHERE least(length(text), greatest(0, 180000 - before)) > 0""")
def budgeted_selection_truncating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a source that fill its budget of 180,000 characters in order of id."""
    return retrieval.truncating_budget(load(spark, sf_dir, "documents"), "source", "doc_id", "text", 180_000).select("source", "doc_id", "kept")


@query(f"""WITH RECURSIVE src AS (SELECT session, ordinal, length(text) AS n, row_number() OVER (PARTITION BY session ORDER BY ordinal) AS k FROM (SELECT conv_id AS session, turn AS ordinal, text FROM conversations)),
  walk AS (SELECT session, 0::BIGINT AS k, 0::BIGINT AS used, 0 AS taken, NULL::BIGINT AS picked FROM (SELECT DISTINCT session FROM src)
    UNION ALL SELECT w.session, s.k, CASE WHEN w.taken < 3 AND w.used + s.n + (CASE WHEN w.taken > 0 THEN 2 ELSE 0 END) <= {retrieval.CHARACTERS} THEN w.used + s.n + (CASE WHEN w.taken > 0 THEN 2 ELSE 0 END) ELSE w.used END,
      w.taken + (CASE WHEN w.taken < 3 AND w.used + s.n + (CASE WHEN w.taken > 0 THEN 2 ELSE 0 END) <= {retrieval.CHARACTERS} THEN 1 ELSE 0 END),
      CASE WHEN w.taken < 3 AND w.used + s.n + (CASE WHEN w.taken > 0 THEN 2 ELSE 0 END) <= {retrieval.CHARACTERS} THEN s.ordinal END FROM walk w JOIN src s ON s.session = w.session AND s.k = w.k + 1)
  SELECT session, picked AS ordinal FROM walk WHERE picked IS NOT NULL""")
def budgeted_selection_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three turns of a conversation within 2,400 characters; one too long is passed over."""
    turns = _turns(spark, sf_dir).where("text IS NOT NULL")
    ranked = turns.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.length("text").alias("n")))).alias("ranked"))
    taken = retrieval.greedy_budget(F.col("ranked"), lambda e: e["n"], F.lit(retrieval.CHARACTERS), retrieval.TOP)
    return ranked.select("session", F.explode(taken).alias("t")).select("session", F.col("t.ordinal").alias("ordinal"))
