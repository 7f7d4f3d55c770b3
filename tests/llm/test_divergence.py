import random
import re
from collections import Counter

import pyarrow as pa

from quillspark.llm import divergence

DDL = "doc_id long, text string, lang string, source string"


def plain_audit(rows, min_docs=3, top=200):
    """The whole result by dictionaries and Python's integers."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(fold))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= min_docs)
        uses = {s: Counter(t for d in mine if d[1] == s for t in d[2] if in_docs[t] >= min_docs) for s in {d[1] for d in mine}}
        whole = sum(uses.values(), Counter())

        def share(counter, t, kept=kept):
            return 1 + 1_000_000_000 * (counter[t] + 1) // (sum(counter.values()) + len(kept))

        for s, own in uses.items():
            pairs = [(-sum((share(own, t) - share(b, t)) ** 2 // share(b, t) for t in kept), o) for o, b in uses.items() if o != s]
            terms = [(-((share(own, t) - share(whole, t)) ** 2 // share(whole, t)), t) for t in kept if own[t] and share(own, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def result(spark, rows, **more):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DDL), **more).collect())


def sample():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "éte", "ÉTE", "日本", "x", "don't", "a1b", "zeta\U0001f600"]
    rows = [(i, " ".join(rng.choices(words, [1 + (i % 3 == k % 3) * 4 for k in range(len(words))], k=rng.randint(0, 40))), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "Ä", None])) for i in range(60)]
    return rows + [rows[0], rows[0], (None, None, "en", "silent"), (7, "", "lone", "only"), (8, "word word word", "few", "p"), (9, "word", "few", "q"), (10, "tie " * 200_000, "en", "long")]


def test_equals_plain_version(spark):
    rows = sample()
    got = result(spark, rows)
    assert got == plain_audit(rows)
    assert {r[4] for r in got if r[0] == "few"} == {0} and not [r for r in got if r[0] == "lone"]
    assert result(spark, rows, top=2, min_docs=1) == plain_audit(rows, 1, 2)


def test_full_tables_of_counts_are_handed_on(spark, monkeypatch):
    rows = sample()
    monkeypatch.setattr(divergence, "HELD_COUNTS", 3)
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", 0)
    assert result(spark, rows) == plain_audit(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (["en", "en"], ["a", "a"], ["one two one three four", "one"])], ["lang", "source", "text"])
    handed = [r for b in divergence._counted(iter([batch])) for r in b.to_pylist()]
    assert [(r["uses"], r["docs"]) for r in handed if r["term"] == "one"] == [(2, 1), (1, 1)]


def test_clashing_columns_and_empty_table(spark):
    rows = sample()
    frame = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS at", "2 AS uses", "3 AS term", "4 AS docs", "5 AS value", "6 AS rank", "7 AS sources")
    assert sorted(tuple(r) for r in divergence.audit(frame).collect()) == plain_audit(rows)
    assert divergence.audit(frame.where("false")).collect() == []


def test_terms_are_byte_runs():
    assert divergence.terms_of("Ab-c\x00D_e[f]`g{h}~ÀB9日本") == [t.encode() for t in ("ab", "c", "d", "e", "f", "g", "h", "Àb", "日本")]
    assert divergence.terms_of(None) == [] and divergence.terms_of("123 _") == []
