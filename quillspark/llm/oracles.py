"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_CASELESS = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = _CASELESS + "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"

#: Kind, pattern, group that is measured and its least length, in the order of the scanner's kinds.
_KINDS = (
    ("assign", _ASSIGN, 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("forge_token", "\\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,})", 0, 1),
    ("chat_token", "\\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", "\\beyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
)


def _spans(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """``doc_id, place, kind, start, stop`` of a rule: matches lie between the pieces that they split a text into."""
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, start, start + length(m) AS stop FROM (
      SELECT doc_id, m, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start FROM (
        SELECT doc_id, p, f, generate_subscripts(f, 1) AS i, unnest(f) AS m FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS p FROM d) WHERE len(f) > 0))
      WHERE length(regexp_extract(m, '{pattern}', {group})) >= {least}"""


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  s AS ({" UNION ALL ".join(_spans(k, *rule) for k, rule in enumerate(_KINDS))}),
  a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM s GROUP BY doc_id)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
  FROM documents LEFT JOIN a USING (doc_id)"""

WARC = """SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN bytes >= 1000 AND page_id < last THEN last END AS refers_to
  FROM (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(encode(coalesce(html, ''))) AS digest FROM pages))"""

#: Every 50-byte string with the smallest id of a document that has it; runs of places that an earlier document has, and what is left between them.
SUFFIX = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), g AS (SELECT doc_id, i, b[i + 1 : i + 50] AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM d WHERE octet_length(b) >= 50)),
  f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s), x AS (SELECT g.doc_id, g.i FROM g JOIN f USING (s) WHERE f.first < g.doc_id),
  r AS (SELECT doc_id, min(i) AS start, max(i) + 50 AS stop FROM (SELECT *, sum(CAST(coalesce(i - before > 50, true) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM x)) GROUP BY doc_id, run),
  k AS (SELECT doc_id, coalesce(lag(stop) OVER w, 0) AS a, start AS z FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY start) UNION ALL SELECT d.doc_id, coalesce(max(stop), 0), any_value(octet_length(b)) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
  h AS (SELECT doc_id, sha256(unhex(string_agg(hex(b[a + 1 : z]), '' ORDER BY a))) AS kept_sha256 FROM k JOIN d USING (doc_id) GROUP BY doc_id), n AS (SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
  SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""


#: Terms by language, their exact shares in each source and in the language, gaps of all pairs of sources and of terms.
DIVERGENCE = """WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d), kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
  g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
  c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL), cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
  s AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM cell JOIN v USING (lang)),
  l AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cell GROUP BY lang, term) JOIN v USING (lang)),
  pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
  term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 200"""


def _lloyd(rounds: int) -> str:
    """CTEs ``a0, b1, a1, ...``: assignments ``vec_id, part, d * 64 + entry`` to a codebook, and the codebook of their floored means."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} AS (SELECT vec_id, part, min(d * 64 + entry) AS de FROM (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d FROM x JOIN b{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            out.append(f"""b{k + 1} AS (SELECT b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.v) AS v FROM b{k} b LEFT JOIN (
      SELECT x.part, a.de % 64 AS entry, x.pos, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} a USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos))""")
    return ",\n  ".join(out)


#: Lloyd rounds by all distances; a part has four components, as vectors of the supplied tables have 64.
YINYANG = f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  x AS (SELECT vec_id, i // (n // 16) AS part, i % (n // 16) AS pos, v FROM (SELECT vec_id, len(embedding) AS n, generate_subscripts(embedding, 1) - 1 AS i, unnest(list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT))) AS v FROM e)),
  b0 AS (SELECT part, entry, pos, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT 64) USING (vec_id)),
  {_lloyd(2)},
  c AS (SELECT vec_id, string_agg(printf('%02x', de % 64), '' ORDER BY part) AS code, CAST(sum(de // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256 FROM c JOIN e USING (vec_id)"""

#: Sets of shingles, pairs by a count of what they share, and components by a walk from every document.
PARITY = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS x FROM d),
  u AS (SELECT x, min(doc_id) AS node, len(x) AS n FROM s WHERE len(x) > 0 GROUP BY x), t AS (SELECT node, n, unnest(x) AS g FROM u),
  e AS (SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.g = b.g AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  r AS (SELECT node, node AS seen FROM u UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
  SELECT s.doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s LEFT JOIN u ON u.x = s.x LEFT JOIN c ON c.node = u.node"""
