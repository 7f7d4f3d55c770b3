"""How the sources of each language differ in their terms, exactly.

Each kept term of a language becomes a wide vector, indexed by the sources of the language
that use it. Higher-order functions turn a vector into the contributions of all pairs of
sources that have the term; map-side aggregation sums them. What a term contributes to a
pair that lacks it on one side depends on one count, and on both sides on none: such
terms are counted by source and use, and multiplied.

Texts are counted where they are read: a task holds one table of counts, hands it on
when it is full, and only counts by language, source and term are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_BYTES, bound_batches
from quillspark.session import durable, share_code

#: Documents of a language that a term needs, ranks of a group's terms, and the scale of shares.
MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 600_000
#: Every byte outside of terms becomes a space, A-Z become a-z; bytes of other code points stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of letters and of code points beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


_COUNTS = "lang string, source string, term string, uses long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for group, (uses, docs) in held.items():
            names = [pa.array([x], pa.string()).take(pa.array([0] * len(uses), pa.int32())) for x in group]
            counts = [pa.array(list(uses.values()), pa.int64()), pa.array([docs[t] for t in uses], pa.int64())]
            yield pa.RecordBatch.from_arrays([*names, pa.array(list(uses), pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "uses", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            uses, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(uses)
            found = terms_of(text)
            uses.update(found)
            docs.update(set(found))
            size += len(uses) - before
            if size >= HELD_COUNTS:
                yield from handed()
                size = 0
    yield from handed()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, uses, docs``: how often a group uses a term, and in how many documents."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)))
    bound_batches(docs.sparkSession)
    share_code(docs.sparkSession)
    parts = named.mapInArrow(_counted, _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def _share(uses: str, total: str) -> str:
    """SQL of a share among kept terms; the product may leave the range of a long, the quotient never does."""
    return f"1 + (CAST({uses} + 1 AS DECIMAL(20,0)) * {SCALE}BD) div ({total} + n_terms)"


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each language and source that occurs.

    Part ``pair`` has each other source of the language, ``term`` the source's terms that
    are more frequent there than in the language, the ``top`` first. Nulls in the three
    columns read as empty strings, which are a language, a source and a text without
    terms; a document counts once for each of its rows. A language without a kept term
    has pairs of value 0; a language with one source has none. Texts are counted whole;
    ties go by the bytes of the item. Other columns are not read; an empty table gives no
    rows. A term's vector has one place for each source that uses it.
    """
    groups = durable(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct())
    placed = durable(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    send = F.broadcast if placed.count() * 64 <= BROADCAST_BYTES else lambda table: table
    counts = term_counts(docs, lang_col, source_col, text_col)
    cells = counts.join(send(placed), ["lang", "source"]).groupBy("lang", "term")
    wide = durable(cells.agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"), F.collect_list(F.struct("at", "uses")).alias("cells")).where(F.col("docs") >= min_docs))

    totals = wide.select("lang", F.inline("cells")).groupBy("lang", "at").agg(F.sum("uses").alias("total"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("uses").alias("lang_total"))
    filled = placed.join(totals, ["lang", "at"], "left").select("lang", F.struct("at", "source", F.coalesce("total", F.lit(0)).alias("total")).alias("s"))
    listed = filled.groupBy("lang").agg(F.array_sort(F.collect_list("s")).alias("sources")).join(kept, "lang", "left").na.fill(0, ["n_terms", "lang_total"])
    base = F.expr(f"IF(n_terms = 0, transform(sources, s -> 1L), transform(sources, s -> {_share('0L', 's.total')}))")
    langs = durable(listed.withColumn("base", base))

    return _pairs(wide, langs, send).unionByName(_terms(wide, langs, send, top))


def _pairs(wide: DataFrame, langs: DataFrame, send) -> DataFrame:
    """Sums over all kept terms, in four parts: as if no source had any, what the terms of one side change, and what those of both do besides."""
    # A place of a term's vector: its source, its share there, and the share of a term that isn't there.
    vector = F.expr(f"transform(cells, c -> struct(c.at AS at, {_share('c.uses', 'sources[c.at].total')} AS p, base[c.at] AS b))")
    each = wide.join(send(langs), "lang").select("lang", vector.alias("vector")).select("lang", F.explode("vector").alias("x"), "vector")
    both = each.select("lang", "x", F.explode(F.expr("filter(vector, y -> y.at <> x.at)")).alias("y")).selectExpr("lang", "x.at AS i", "x.p AS p", "x.b AS b", "y.at AS j", "y.p AS q", "y.b AS c")
    shared = both.select("lang", "i", "j", F.expr(f"{_gap('p', 'q')} - {_gap('p', 'c')} - {_gap('b', 'q')} + {_gap('b', 'c')}").alias("change"))
    alike = wide.select("lang", F.inline("cells")).groupBy("lang", "at", "uses").agg(F.count("*").alias("n")).join(send(langs), "lang")
    alike = alike.select("lang", "at", "n", F.expr(_share("uses", "sources[at].total")).alias("p"), F.expr("base[at]").alias("b"), F.posexplode("base").alias("other", "c")).where("other <> at")
    first = alike.select("lang", F.col("at").alias("i"), F.col("other").alias("j"), F.expr(f"n * ({_gap('p', 'c')} - {_gap('b', 'c')})").alias("change"))
    second = alike.select("lang", F.col("other").alias("i"), F.col("at").alias("j"), F.expr(f"n * ({_gap('c', 'p')} - {_gap('c', 'b')})").alias("change"))
    sums = shared.unionByName(first).unionByName(second).groupBy("lang", "i", "j").agg(F.sum("change").alias("change"))
    places = langs.select("lang", "n_terms", "base", "sources", F.posexplode("sources").alias("i", "one"))
    pairs = places.select("lang", "n_terms", "base", "i", F.col("one.source").alias("source"), F.posexplode("sources").alias("j", "other")).where("i <> j")
    pairs = pairs.select("lang", "source", "i", "j", F.col("other.source").alias("item"), F.expr(f"n_terms * ({_gap('base[i]', 'base[j]')})").alias("none"))
    values = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", "item", (F.col("none") + F.coalesce("change", F.lit(0))).alias("value"))
    return _ranked(values, "pair")


def _terms(wide: DataFrame, langs: DataFrame, send, top: int) -> DataFrame:
    used = wide.join(send(langs), "lang").select("lang", "term", "n_terms", F.expr(_share("uses", "lang_total")).alias("q"), "sources", F.inline("cells"))
    both = used.select("lang", F.expr("sources[at].source").alias("source"), F.col("term").alias("item"), F.expr(_share("uses", "sources[at].total")).alias("p"), "q")
    return _ranked(both.where("p > q").select("lang", "source", "item", F.expr(_gap("p", "q")).alias("value")), "term").where(F.col("rank") <= top)


def _ranked(values: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
