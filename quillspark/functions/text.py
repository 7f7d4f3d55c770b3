"""Text expressions that stay in the JVM. Offsets and lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.vocabulary import FILLERS, GENERIC_WORDS, TRANSITION_CUES

#: White space as text processing understands it, ASCII and beyond.
SPACE = r"[\t-\r    -     　﻿]"
TOKEN = r"[\p{L}\p{N}_]+"
WORD = r"[\p{L}\p{N}]+"
CJK = r"[㐀-䶿一-鿿豈-﫿]"
FORMULA = r"(?iu)(?:\d+(?:\.\d+)?\s*[×x÷/*+−–—=-]\s*)+\d+(?:\.\d+)?|[λμσαβγθπ]\s*=\s*[^\s,.;]+"
SENTENCE_END = r"[.!?。！？][\"'’”)]*$"
STABLE_SENTENCE = r"[^.!?。！？…]+[.!?。！？…]+[\"'”’»)]*"
#: The same, or an unfinished end: it never fails where it starts, so a search for all is linear. What is no mark is given
#: by ranges, which Java compares one by one; a negated set of marks beyond Latin-1 takes six times as long.
STABLE_RUN = "[\\x00-\\x20\\x22-\\x2d\\x2f-\\x3e\\x40-\\u2025\\u2027-\\u3001\\u3003-\\uff00\\uff02-\\uff1e\\uff20-\\x{10ffff}]+(?:[.!?。！？…]+[\"'”’»)]*|\\z)"
CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f]"


def normalise_space(x: Column) -> Column:
    """Runs of white space become one space; ends are trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), f"{SPACE}+", " "))


def tokens(x: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(normalise_space(x)), F.lit(TOKEN), 0)


def words(x: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(WORD), 0)


def word_set(x: Column) -> Column:
    """Different words of more than two characters."""
    return F.array_distinct(F.filter(words(x), lambda w: F.length(w) > 2))


def meaningful_tokens(x: Column) -> Column:
    return F.filter(tokens(x), lambda t: ~t.isin(*FILLERS))


def stem(term: Column) -> Column:
    """Drops a plain plural s of words of over four letters, and then ing of those that still have over five.

    One chain of replacements, so that a token is read once however often its stem is asked about.
    """
    single = F.regexp_replace(F.lower(term), "^(.{3,}[^suie])s$", "$1")
    return F.regexp_replace(single, "^(.{3,})ing$", "$1")


def is_anchor_term(term: Column, form: Column, generic: tuple[str, ...] = GENERIC_WORDS) -> Column:
    """Whether a stemmed term can identify a topic: letters only, three or more, not generic in either form."""
    return term.rlike(r"^\p{L}{3,}$") & ~term.isin(*generic) & ~form.isin(*generic)


def anchor_terms(x: Column, generic: tuple[str, ...] = GENERIC_WORDS) -> Column:
    """Different stemmed terms of a text that can identify a topic."""
    pairs = F.transform(tokens(x), lambda t: F.struct(t.alias("form"), stem(t).alias("term")))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: is_anchor_term(p["term"], p["form"], generic)), lambda p: p["term"]))


def fingerprint(x: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(F.coalesce(x, F.lit("")), 256), 1, 16)


def composite_fingerprint(*parts: Column) -> Column:
    return fingerprint(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def script_ratio(x: Column) -> Column:
    """The share of CJK characters in the normalised text; 0 for an empty one."""
    text = normalise_space(x)
    return F.when(text == "", F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(CJK)) / F.length(text))


def control_ratio(x: Column, sample: int = 100_000) -> Column:
    """The share of control characters in the first ``sample`` characters."""
    head = F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, sample)
    return F.regexp_count(head, F.lit(CONTROL)) / F.greatest(F.lit(1), F.length(head))


def is_readable(x: Column) -> Column:
    """At least 20 characters and at most two in a hundred control characters."""
    return (F.length(F.trim(F.coalesce(x, F.lit("")))) >= 20) & (control_ratio(x) <= 0.02)


def ends_sentence(x: Column) -> Column:
    return x.rlike(SENTENCE_END)


def opens_topic(x: Column) -> Column:
    cues = "|".join(TRANSITION_CUES)
    return x.rlike(f"(?i)^(?:{cues})(?:(?<=[a-z0-9_])(?![a-z0-9_])|(?<![a-z0-9_])(?=[a-z0-9_]))")


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller word set; 1 where either is empty."""
    left, right = word_set(a), word_set(b)
    least = F.least(F.size(left), F.size(right))
    return F.when(least == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / least)


def formulas(x: Column) -> Column:
    """Arithmetic found in a text, without spaces, with one sign for each operation."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(FORMULA), 0)
    return F.transform(found, lambda f: F.translate(F.regexp_replace(F.lower(f), r"[\s×]", ""), "x−–—", "*---"))


def stable_sentences(x: Column) -> Column:
    """Finished sentences of a growing text: runs that end in a terminator, with closers."""
    runs = F.regexp_extract_all(normalise_space(x), F.lit(STABLE_RUN), 0)
    return F.filter(F.transform(F.filter(runs, lambda s: s.rlike("[.!?。！？…]")), normalise_space), lambda s: s != "")


def unfinished_tail(x: Column) -> Column:
    """What follows the last finished sentence; the whole text where there is none."""
    text = normalise_space(x)
    rest = F.regexp_replace(text, r"(?s)\A.*[.!?。！？…]", "")  # back from the end to the last mark
    finished = text.rlike(r"[^.!?。！？…][.!?。！？…]")
    return normalise_space(F.when(finished, F.regexp_replace(rest, "^[\"'”’»)]*", "")).otherwise(text))


def token_estimate(x: Column) -> Column:
    return F.ceil(F.length(F.coalesce(x, F.lit(""))) / 4)


def content_measure(x: Column) -> Column:
    """Characters of East Asian scripts where they dominate, else words between white space."""
    text = normalise_space(x)
    wide = F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))
    count = F.when(text == "", 0).otherwise(F.size(F.split(text, " ", -1)))
    return F.when(wide >= F.greatest(F.lit(4), 2 * count), wide).otherwise(count)


def append_text(prefix: Column, addition: Column) -> Column:
    """Two texts with one space between them, where both say something."""
    a, b = F.trim(F.coalesce(prefix, F.lit(""))), F.trim(F.coalesce(addition, F.lit("")))
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat_ws(" ", a, b))


def whole_phrase(text: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` stand in ``text`` in a row."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(words(phrase), " "), F.lit(" ")))


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, also where lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_repeated_ngram(x: Column, n: int = 5) -> Column:
    """Whether ``n`` tokens are followed at once by the same ``n``."""
    return let(
        tokens(x),
        lambda t: F.when(F.size(t) < 2 * n, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), F.size(t) - 2 * n + 1), lambda i: F.slice(t, i, n) == F.slice(t, i + n, n))),
    )


def equivalent_token(a: Column, b: Column) -> Column:
    """Equal, equal but for a last s, one inside the other, or one edit apart, by length."""
    la, lb = F.length(a), F.length(b)
    long4, long5 = (la >= 4) & (lb >= 4), (la >= 5) & (lb >= 5)
    plain = F.regexp_replace(a, "s$", "") == F.regexp_replace(b, "s$", "")
    inside = (F.abs(la - lb) <= 5) & (a.contains(b) | b.contains(a))
    near = (F.abs(la - lb) <= 1) & F.levenshtein(a, b, 1).isin(0, 1)
    return (a == b) | (long4 & (plain | inside)) | (long5 & near)


def token_coverage(source: Column, output: Column) -> Column:
    """The share of the source's meaningful tokens that an equivalent output token covers; 1 without any."""
    from quillspark.functions.guard import covered_share

    return covered_share(meaningful_tokens(source), F.array_distinct(meaningful_tokens(output)))


def markup_to_text(x: Column) -> Column:
    """Office and web markup as text: breaks and paragraph ends stay, tags go, common entities are decoded."""
    steps = (
        (r"<w:tab\s*/>", "\t"), (r"<w:br\s*/>|<a:br\s*/>", "\n"), (r"</w:p>|</a:p>|</p>|</h\d>", "\n"), (r"<[^>]+>", " "),
        ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&apos;", "'"), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"),
        (r"[ \t]+\n", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"),
    )
    out = F.coalesce(x, F.lit(""))
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return F.regexp_replace(out, rf"^{SPACE}+|{SPACE}+$", "")


def normalise_material(x: Column, limit: int = 500_000) -> Column:
    """``text, characters, truncated``: NUL dropped, line ends unified, gaps of lines shortened, trimmed, cut."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\x00", ""), "\r\n?", "\n"), "\n{4,}", "\n\n\n")
    text = F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")
    return F.struct(F.substring(text, 1, limit).alias("text"), F.length(text).alias("characters"), (F.length(text) > limit).alias("truncated"))


def safe_filename(x: Column) -> Column:
    """A base name of harmless characters, at most 140 of them."""
    base = F.regexp_replace(F.coalesce(x, F.lit("")), r"^.*[/\\]", "")
    kept = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}._ -]+", "_"), r"^\.+", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, 140), F.lit("")), F.lit("file"))
