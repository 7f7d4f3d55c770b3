"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a run of tokens; the tokens under its zeros are ignored, so
a substitution there does not hide a match. Seeds of test items and of documents are
joined on their hashes. A hit gives a diagonal of an item along a document; around it
the two are compared token by token, and an overlap counts if at least ``SIMILARITY`` of
its tokens agree, substitutions included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import join_counted, map_rows, row_key, without
from quillspark.session import durable

#: Masks of equal weight. Together they hit every run of 8 to 20 tokens of which 80 % agree, wherever the others are (by enumeration).
MASKS = ("1111011", "110010111", "1110100011", "1011111", "11101101", "101100111")
#: Tokens that an overlap has at least, or the whole of a shorter item.
OVERLAP_TOKENS = 20
#: Items with fewer tokens are matched whole and without substitutions.
SHORT_TOKENS = 8
SIMILARITY = 0.8
#: Seeds of test items up to which they are sent to every task (16 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000
_TOKEN = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of the lower-cased text."""
    words = _TOKEN.findall((text or "").lower())
    seen: dict[str, int] = {}
    digest = xxhash.xxh64_intdigest
    return np.fromiter((seen[w] if w in seen else seen.setdefault(w, digest(w.encode("utf-8", "surrogatepass"))) for w in words), np.uint64, len(words))


def seeds(tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``mask, hashes``: the hash of each placement of each mask.

    A run that is too short for every mask has one seed, of all its tokens, under the
    mask number -1 - its length.
    """
    if 0 < len(tokens) < SHORT_TOKENS:
        yield -1 - len(tokens), _combine(tokens, range(len(tokens)), 1, len(tokens))
        return
    for k, mask in enumerate(MASKS):
        n = len(tokens) - len(mask) + 1
        if n > 0:
            yield k, _combine(tokens, [i for i, c in enumerate(mask) if c == "1"], n, k + 100)


def _combine(tokens: np.ndarray, places, n: int, salt: int) -> np.ndarray:
    out = np.full(n, salt, np.uint64) * _MIX
    for p in places:
        out = (out ^ tokens[p : p + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def item_seeds(items: DataFrame) -> DataFrame:
    """``seed, item_id, at`` for every placement of every mask over the test items."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item_id, text in rows:
            for _, hashes in seeds(token_hashes(text)):
                for at, h in enumerate(_signed(hashes)):
                    yield h, item_id, at

    return map_rows(items.select(F.col("item_id").cast("long"), "text"), run, "seed long, item_id long, at int")


def _lengths(items: DataFrame) -> list[int]:
    """The lengths of items that are too short for the masks: a few numbers."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in rows:
            if 0 < (n := len(token_hashes(text))) < SHORT_TOKENS:
                yield (n,)

    return sorted(r[0] for r in map_rows(items.select("text"), run, "n int").distinct().collect())


def _document_seeds(tokens: np.ndarray, short: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    for k, mask in enumerate(MASKS):
        n = len(tokens) - len(mask) + 1
        if n > 0:
            yield k, _combine(tokens, [i for i, c in enumerate(mask) if c == "1"], n, k + 100)
    for length in short:
        n = len(tokens) - length + 1
        if n > 0:
            yield -1 - length, _combine(tokens, range(length), n, length)


def overlap(document: np.ndarray, item: np.ndarray, diagonal: int) -> int:
    """Tokens of the longest overlap on a diagonal (document place less item place); 0 if it does not count.

    An overlap is a run of at least ``OVERLAP_TOKENS`` tokens, or the whole of a shorter
    item, of which ``SIMILARITY`` agree. Tokens at either end may differ, and places of
    the item before or after the document count as differing.
    """
    least = min(len(item), OVERLAP_TOKENS)
    lo, hi = max(0, -diagonal), min(len(item), len(document) - diagonal)
    same = np.zeros(len(item), bool)
    if hi > lo:
        same[lo:hi] = document[lo + diagonal : hi + diagonal] == item[lo:hi]
    if len(item) < SHORT_TOKENS:
        return len(item) if same.all() else 0
    # A run i..j counts if the sum of (same - SIMILARITY) over it isn't negative.
    sums = np.concatenate([[0.0], np.cumsum(same - SIMILARITY)])
    floor = np.minimum.accumulate(sums)
    starts = np.searchsorted(-floor, -(sums[1:] + 1e-9), side="left")
    best = int((np.arange(1, len(sums)) - starts).max())
    return best if best >= least else 0


def _verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, tokens`` from ``doc_id, item_id, lead, stretch`` rows.

    ``stretch`` holds the document's token hashes along the item and ``lead`` the item's
    place where it starts.
    """
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_id"])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, item_id, lead, stretch, text in rows:
            n = overlap(np.frombuffer(stretch, np.uint64), token_hashes(text), -lead)
            if n:
                yield doc_id, item_id, n

    joined = pairs.join(texts, "item_id").select("doc_id", "item_id", "lead", "stretch", "text")
    return map_rows(joined, run, "doc_id long, item_id long, tokens int").groupBy("doc_id", "item_id").agg(F.max("tokens").alias("tokens"))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row ``doc_id, item_id, tokens`` for each document and test item that overlap.

    Null and empty texts overlap with nothing; repeated rows give one row for each pair;
    null ids are ids like any other on the document side and take no part on the item
    side; other columns are not read. Items of fewer tokens than ``SHORT_TOKENS`` must
    occur as they are.
    """
    items = items.where(F.col("item_id").isNotNull())
    probes = durable(item_seeds(items))
    short = _lengths(items)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lengths = map_rows(items.select(F.col("item_id").cast("long"), "text"), lambda rows: ((i, len(token_hashes(t))) for i, t in rows), "item_id long, n int").dropDuplicates(["item_id"])
    if probes.count() <= broadcast_seeds:
        pairs = _near(source, probes, lengths, short)
    else:
        pairs = _far(source, probes, lengths, short)
    return _verified(durable(pairs), items)


def _near(source: DataFrame, probes: DataFrame, lengths: DataFrame, short: list[int]) -> DataFrame:
    """Hits where the items' seeds are few enough for every task to hold them."""
    spark = source.sparkSession
    table = probes.join(lengths, "item_id").select("seed", "item_id", "at", "n").toPandas().sort_values(["seed", "item_id", "at"])
    held = spark.sparkContext.broadcast((table["seed"].to_numpy(np.int64), table["item_id"].to_numpy(np.int64), table["at"].to_numpy(np.int64), table["n"].to_numpy(np.int64)))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        seed, item, at, size = held.value
        keys = np.unique(seed)
        # A bit for each value of a hash's first bits tells most misses apart.
        first = np.zeros(1 << 22, bool)
        first[(keys.view(np.uint64) >> np.uint64(42)).astype(np.int64)] = True
        for doc_id, text in rows:
            tokens = token_hashes(text)
            found = set()
            for _, hashes in _document_seeds(tokens, short):
                maybe = np.flatnonzero(first[(hashes >> np.uint64(42)).astype(np.int64)])
                if not len(maybe):
                    continue
                signed = hashes[maybe].view(np.int64)
                lo, hi = np.searchsorted(seed, signed, "left"), np.searchsorted(seed, signed, "right")
                for place, a, b in zip(maybe[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                    found.update((int(item[k]), place - int(at[k]), int(size[k])) for k in range(a, b))
            for item_id, diagonal, n in sorted(found):
                yield (doc_id, item_id, *_stretch(tokens, diagonal, n))

    return map_rows(source, run, "doc_id long, item_id long, lead int, stretch binary")


def _far(source: DataFrame, probes: DataFrame, lengths: DataFrame, short: list[int]) -> DataFrame:
    """Hits by a shuffle join of all seeds, for test sets of any size.

    Seeds that a great part of the documents' seeds are equal to are joined apart, so that
    one of them doesn't meet in a task. A document is named by its id and a hash of its
    text; what is brought back to it are numbers.
    """

    def spread(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, key, text in rows:
            for _, hashes in _document_seeds(token_hashes(text), short):
                for place, h in enumerate(_signed(hashes)):
                    yield h, doc_id, key, place

    keyed = source.select("doc_id", row_key().alias("key"), "text")
    spreaded = map_rows(keyed, spread, "seed long, doc_id long, key long, place int")
    wanted = durable(probes.select("seed").distinct())
    asked = durable(spreaded.join(wanted, "seed", "left_semi"))
    counts = asked.groupBy("seed").agg(F.count("*").alias("n"))
    listed = durable(probes.groupBy("seed").agg(F.collect_list(F.struct("item_id", "at")).alias("items")).join(counts, "seed"))
    hits = join_counted(asked, listed, "seed", F.size("items") * 16 + 32).select("doc_id", "key", "place", F.explode("items").alias("x"))
    diagonals = hits.select("doc_id", "key", "x.item_id", (F.col("place") - F.col("x.at")).alias("diagonal")).distinct().join(lengths, "item_id")
    by_doc = diagonals.groupBy(F.col("key").alias("__key")).agg(F.collect_set(F.struct("item_id", "diagonal", "n")).alias("hits"))
    joined = keyed.join(by_doc, F.col("key") == F.col("__key")).select("doc_id", "text", "hits")

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, hits in rows:
            tokens = token_hashes(text)
            for hit in hits:
                if hit["diagonal"] + hit["n"] > 0 and hit["diagonal"] < len(tokens):
                    yield (doc_id, hit["item_id"], *_stretch(tokens, hit["diagonal"], hit["n"]))

    return map_rows(joined, cut, "doc_id long, item_id long, lead int, stretch binary")


def _stretch(tokens: np.ndarray, diagonal: int, n: int) -> tuple[int, bytes]:
    start = max(0, diagonal)
    return start - diagonal, tokens[start : max(start, diagonal + n)].tobytes()


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no test item; rows without an id stay.

    Columns are those of ``docs``, whatever their names. A row is judged by its own text:
    rows that share an id may part, repeated rows stay or go together. Null and empty
    texts stay; an empty table gives no rows.
    """
    keyed = docs.where(F.col("doc_id").isNotNull()).select(row_key().alias("key"), F.col("text").alias("text"))
    return without(docs, overlaps(keyed, items, id_col="key").select(F.col("doc_id").alias("key")))
