"""SimHash near-duplicates through a positional byte index with count filtering.

A fingerprint has 64 bits, eight positional bytes. Two fingerprints that differ in at
most two bits differ in at most two bytes, so they share at least six positional bytes:
the guaranteed minimum of the count filter. The index therefore posts each distinct
fingerprint under its 28 choices of six positions; a pair's tally reaches six exactly if
it meets in one of these postings, and a pair that does not is never formed.

Members of a posting agree in six bytes, so the other two bytes tell them apart: a
posting holds at most 65,536 fingerprints however many documents there are. Links inside
a posting are found by looking up the 136 patterns of one or two flipped bits, in
proportion to its members, never by listing its pairs, and a posting gives back a
spanning forest of its links, which keeps components whole. What the postings give is
tallied over all eight positions, held against the guaranteed minimum and verified by
its differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import join_counted, map_rows, own_names, row_key, small
from quillspark.llm.components import connected_components
from quillspark.session import durable

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
POSITIONS = 8


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text; zero for a text without words.

    A-Z are lower-cased, words are the runs between ASCII white space, shingles are
    three words joined by a space with repeats counted (the whole sequence if there are
    fewer). A bit is set where over half of the XXH64 values have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(SHINGLE_WORDS, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def text_key(text_col: str = "text") -> Column:
    """A 64-bit name of a text, null counting as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``doc_id, text_key, fp`` for each row of ``docs`` (null text: fingerprint zero)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, key, text in rows:
            yield doc_id, key, fingerprint(text)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return map_rows(source, run, "doc_id long, text_key long, fp long")


def _six_byte_keys(fp: Column) -> Column:
    """The 28 postings of a fingerprint: which two bytes are left out, and the other six."""
    keys = []
    for x, y in combinations(range(POSITIONS), 2):
        mask = ~((0xFF << (8 * x)) | (0xFF << (8 * y))) & 0xFFFFFFFFFFFFFFFF
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(8 * x + y).cast("byte").alias("out"), fp.bitwiseAND(F.lit(signed)).alias("rest")))
    return F.array(*keys)


def _patterns() -> np.ndarray:
    """All 16-bit numbers of one or two set bits."""
    one = [1 << i for i in range(16)]
    return np.array(one + [a | b for a, b in combinations(one, 2)], np.int64)


def posting_links(out: int, members: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most ``MAX_BITS`` bits) inside one posting."""
    x, y = divmod(out, 8)
    fps = np.array(members, np.int64).view(np.uint64)
    low = ((fps >> np.uint64(8 * x)) & np.uint64(0xFF)).astype(np.int64) | (((fps >> np.uint64(8 * y)) & np.uint64(0xFF)).astype(np.int64) << 8)
    if len(members) == 2:
        close = bin(int(low[0] ^ low[1])).count("1") <= MAX_BITS
        return [(members[0], members[1])] if close else []
    place = np.full(1 << 16, -1, np.int64)
    place[low] = np.arange(len(members))
    seen = np.zeros(len(members), bool)
    links: list[tuple[int, int]] = []
    flips = _patterns()
    for first in range(len(members)):
        if seen[first]:
            continue
        seen[first] = True
        front = [first]
        while front:
            here = front.pop()
            near = place[low[here] ^ flips]
            for other in near[near >= 0].tolist():
                if not seen[other]:
                    seen[other] = True
                    front.append(other)
                    links.append((members[here], members[other]))
    return links


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of a pair: at how many of the eight positions the two fingerprints have the same byte."""
    apart = a.bitwiseXOR(b)
    return sum((F.when(F.shiftrightunsigned(apart, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for k in range(POSITIONS)), F.lit(0))


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints (column ``fp``) that span every component.

    A pair that a posting gives is tallied over all positions, kept if the tally reaches
    the guaranteed minimum, and then verified by its differing bits.
    """
    slots = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    posted = distinct.select("fp").repartition(slots).select(F.col("fp"), F.explode(_six_byte_keys(F.col("fp"))).alias("k")).select("k.out", "k.rest", "fp")
    postings = posted.groupBy("out", "rest").agg(F.count("*").alias("n"), F.collect_list("fp").alias("members")).where("n > 1").select("out", "members")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for out, members in rows:
            yield from posting_links(out, sorted(members))

    pairs = map_rows(postings, run, "a long, b long")
    counted = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= POSITIONS - MAX_BITS)
    return counted.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)


def classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(fp, n, least, root; root, component_id)`` of durable ``fingerprints`` rows."""
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = durable(connected_components(durable(link_fingerprints(distinct))).select(F.col("node").alias("fp"), "root"))
    found = durable(distinct.join(roots, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    return found, found.groupBy("root").agg(F.min("least").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``doc_id, fp, component_id`` for each document.

    ``component_id`` is the smallest doc_id that links of at most two bits reach.
    Repeated rows keep their number and share a component; a null doc_id is kept and
    never names a component unless no member has an id; an empty table gives no rows.
    Columns other than the two named ones are not read.
    """
    prints = durable(fingerprints(docs, id_col, text_col))
    found, least = classes(prints)
    named = durable(found.join(least, "root").select("fp", "n", "component_id"))
    return join_counted(prints.select("doc_id", "fp"), named, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_rows: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` less all but one row of each near-duplicate component.

    The row with the smallest doc_id stays, of several different texts with that id the
    one with the smallest hash; a row that repeats it as a whole goes. Decisions are by
    row: rows that share an id and differ in text are judged each by its text. Rows
    without an id can't be told apart and stay. Columns are those of ``docs``; an empty
    table gives no rows. ``first_rows`` (``doc_id, text_key``) are the rows that stay if
    the components are not to be those of ``near_duplicates``.
    """
    if first_rows is None:
        prints = durable(fingerprints(docs, id_col, text_col))
        found, _ = classes(prints.where(F.col("doc_id").isNotNull()))
        texts = prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
        first_rows = texts.join(found, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    names = own_names(docs.columns, "keep_id", "keep_key")
    keep = small(durable(first_rows.select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1]))), 32)
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(keep, (docs[id_col].cast("long") == keep[names[0]]) & (text_key(text_col) == keep[names[1]]), "left_semi")
    kept = _one_for_each_row(kept, id_col, text_col)
    return kept.union(docs.where(F.col(id_col).isNull()))


def _one_for_each_row(kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``kept`` with one row for each id and text; only where such a row is repeated are rows compared."""
    key = row_key(id_col, text_col)
    repeated = durable(kept.groupBy(key.alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again"))
    if repeated.isEmpty():
        return kept
    (name,) = own_names(kept.columns, "again")
    again = small(repeated.withColumnRenamed("__again", name), 16)
    same = key == again[name]
    return kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").withColumn(name, key).dropDuplicates([name]).drop(name))
