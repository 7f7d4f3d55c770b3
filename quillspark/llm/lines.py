"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens,
where a token with a digit is a variable field. The leaf it reaches holds groups of
lines; a line joins the first group whose founder has at least ``SIMILARITY`` of its
tokens in the same places, else it founds one. What differs inside a group are further
variable fields, so a group is a template. A template that recurs across documents is
boilerplate: it stays in the document with the smallest id that has it and is dropped
from all others.

Documents that are copies as wholes share nearly all their lines; removing them is
another operator's work. A document is a copy of its origin if templates that first stand
there hold at least ``COPY`` of the words of the longer one's distinct lines. A template
counts as recurring only if it also stands in several documents that are no copies of one
another, whatever lines stand beside it, and copies of its first document keep it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_BYTES, join_counted, map_rows, own_names
from quillspark.session import durable

LEADING = 3
SIMILARITY = 0.8
#: The evidence that a template of at least so many fixed tokens needs: documents that have
#: it, and among them documents that are no copies of one another.
EVIDENCE = ((51, 2, 2), (21, 4, 3), (0, 8, 5))
#: The share of words from which a document is a copy of another.
COPY = 0.8
#: Parts into which the distinct lines of every leaf, large or small, are dealt at first; founders of the parts are then grouped again.
PARTS = 64
_DIGIT = re.compile(r"\d")
_ROWS = "key long, doc_id long, line int, leaf long, sig binary, fresh int, size long, fixed int"


_MASKED = np.frombuffer(xxhash.xxh32_digest(b"<*>")[:2], np.uint16)[0]


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def line_keys(text: str) -> list[tuple[int, bytes] | None]:
    """For each line its leaf and its tokens' 16-bit hashes in order; None for a blank line."""
    memo: dict[str, bytes] = {}
    out: list[tuple[int, bytes] | None] = []
    for line in text.split("\n"):
        tokens = line.split()
        if not tokens:
            out.append(None)
            continue
        if _DIGIT.search(line):
            tokens = ["<*>" if _DIGIT.search(t) else t for t in tokens]
        leaf = _hash("\x1f".join([str(len(tokens)), *tokens[:LEADING]]).encode("utf-8", "surrogatepass"))
        sig = b"".join([memo[t] if t in memo else memo.setdefault(t, xxhash.xxh32_digest(t.encode("utf-8", "surrogatepass"))[:2]) for t in tokens])
        out.append((leaf, sig))
    return out


def _line_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row for each line that isn't blank.

    ``fresh`` is 1 at the first such line of the document and ``size`` counts the tokens
    of its distinct lines; it is null but in the document's first row. ``fixed`` counts
    the line's tokens that are no variable fields.
    """
    for key, doc_id, text in rows:
        known: set[tuple[int, bytes]] = set()
        out = []
        for n, k in enumerate(line_keys(text or "")):
            if k is not None:
                out.append((n, *k, int(k not in known)))
                known.add(k)
        size = sum(len(sig) // 2 for _, sig in known)
        for n, leaf, sig, fresh in out:
            yield key, doc_id, n, leaf, sig, fresh, size, int((np.frombuffer(sig, np.uint16) != _MASKED).sum())
            size = None


def _least(tokens: int) -> int:
    """Tokens that agree in lines of one template."""
    return int(np.ceil(SIMILARITY * tokens - 1e-9))


class _Groups:
    """The founders of one part, found by bands: tokens that differ leave one of the bands as it is."""

    def __init__(self, tokens: int) -> None:
        self.need = _least(tokens)
        apart = tokens - self.need  # so many tokens may differ; the leading ones never do
        self.cuts = np.linspace(min(LEADING, tokens), tokens, apart + 2).round().astype(int).tolist()
        self.founders, self.keys, self.n = np.zeros((4, tokens), np.uint16), [], 0
        self.places: dict[tuple[int, bytes], list[int]] = {}

    def first(self, sig: bytes) -> int | None:
        """The key of the first founder that the line agrees with; else None, and the line is one."""
        tokens = np.frombuffer(sig, np.uint16)
        bands = [(k, sig[2 * a : 2 * b]) for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]
        near = sorted({p for band in bands for p in self.places.get(band, ())})
        if near:
            hits = np.flatnonzero((self.founders[near] == tokens).sum(1) >= self.need)
            if len(hits):
                return self.keys[near[hits[0]]]
        if self.n == len(self.founders):
            self.founders = np.concatenate([self.founders, np.zeros_like(self.founders)])
        self.founders[self.n] = tokens
        for band in bands:
            self.places.setdefault(band, []).append(self.n)
        self.n += 1
        return None


def _group(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``leaf, sig_key, founder_key, founder, n_docs`` for ``part, leaf, sig_key, sig, n_docs`` rows that come by part.

    ``founder`` is the signature where the line founds a group, else null. What is held
    are the founders of one part.
    """
    last, groups = None, _Groups(0)
    for part, leaf, sig_key, sig, n_docs in rows:
        if part != last:
            last, groups = part, _Groups(len(sig) // 2)
        found = groups.first(sig)
        if found is None:
            groups.keys.append(sig_key)
        yield leaf, sig_key, sig_key if found is None else found, sig if found is None else None, n_docs


_GROUP = "leaf long, sig_key long, founder_key long, founder binary, n_docs long"


def _grouped(lines: DataFrame) -> DataFrame:
    """``_group`` over rows with ``part, leaf, sig_key, sig, n_docs``, the most frequent line first."""
    ordered = lines.repartition("part").sortWithinPartitions("part", F.desc("n_docs"), "sig")
    return map_rows(ordered.select("part", "leaf", "sig_key", "sig", "n_docs"), _group, _GROUP)


def _evidence(which: int) -> Column:
    """How many documents (1), or different documents (2), a template of ``fixed`` tokens needs."""
    least = F.lit(EVIDENCE[-1][which])
    for step in reversed(EVIDENCE[:-1]):
        least = F.when(F.col("fixed") >= step[0], step[which]).otherwise(least)
    return least


def _members(rows: DataFrame) -> DataFrame:
    """``sig_key, template, n`` of the distinct lines whose leaf may recur; ``n`` is in how many documents."""
    every = durable(rows.groupBy("leaf", "sig").agg(F.sum("fresh").alias("n_docs"), F.max("fixed").alias("fixed")))
    leaves = every.groupBy("leaf").agg(F.sum("n_docs").alias("n_docs"), F.max("fixed").alias("fixed"), F.count("*").alias("n"))
    hot = durable(leaves.where(F.col("n_docs") >= _evidence(1)).select("leaf", "n"))
    lines = durable(join_counted(every.select("leaf", "sig", "n_docs"), hot, "leaf").withColumn("sig_key", F.xxhash64("leaf", "sig")))
    first = durable(_grouped(lines.withColumn("part", F.xxhash64("leaf", F.pmod("sig_key", F.lit(PARTS))))))
    founders = first.where(F.col("founder").isNotNull()).select(F.col("leaf").alias("part"), "leaf", "sig_key", F.col("founder").alias("sig"), "n_docs")
    second = durable(_grouped(founders).select(F.col("sig_key").alias("founder_key"), F.col("founder_key").alias("joined")).where("founder_key <> joined"))
    # A line that is no founder follows its founder only if it agrees with the new one too.
    sigs = lines.select("sig_key", "sig")
    moved = first.where(F.col("founder").isNull()).select("sig_key", "founder_key").join(second, "founder_key").join(sigs, "sig_key")
    moved = moved.join(sigs.select(F.col("sig_key").alias("joined"), F.col("sig").alias("other")), "joined")
    agreed = map_rows(moved.select("sig_key", "sig", "joined", "other"), _agreeing, "sig_key long, joined long")
    follows = agreed.union(second.select(F.col("founder_key").alias("sig_key"), "joined"))
    return durable(first.join(follows, "sig_key", "left").select("sig_key", F.coalesce("joined", "founder_key").alias("template"), F.col("n_docs").alias("n")))


def _agreeing(rows: Iterator[tuple]) -> Iterator[tuple]:
    for sig_key, sig, joined, other in rows:
        tokens = np.frombuffer(sig, np.uint16)
        if (tokens == np.frombuffer(other, np.uint16)).sum() >= _least(len(tokens)):
            yield sig_key, joined


def _classes(held: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, origin`` of each document that is a copy of an earlier one."""
    first = durable(held.groupBy("template").agg(F.min("doc_id").alias("origin"), F.count("*").alias("n")).where("n > 1"))
    sizes = durable(rows.where(F.col("size").isNotNull()).groupBy("key", "doc_id").agg(F.max("size").alias("size"), F.count("*").alias("copies")))
    shared = join_counted(held.where("fresh = 1"), first, "template").where("doc_id <> origin").groupBy("key", "origin").agg(F.sum("words").alias("shared"))
    of_origin = sizes.groupBy(F.col("doc_id").alias("origin")).agg(F.max("size").alias("origin_size"))
    shared = durable(shared.join(sizes, "key"))
    counted = durable(of_origin.join(shared.groupBy("origin").agg(F.count("*").alias("n")), "origin"))
    both = join_counted(shared, counted, "origin")
    return both.where(F.col("shared") >= F.greatest("size", "origin_size") * F.col("copies") * COPY - 1e-6).select("key", "origin")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, drop``: the numbers (from 0) of the lines to drop from each document that has any.

    ``key`` is the hash of id and text by which ``document_key`` names a row.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(document_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = durable(map_rows(source, _line_rows, _ROWS))
    slim = rows.select("key", "doc_id", "line", F.xxhash64("leaf", "sig").alias("sig_key"), "fresh", "fixed", F.expr("length(sig) div 2").alias("words"))
    held = durable(join_counted(slim, _members(rows), "sig_key").drop("sig_key"))
    copies = durable(_classes(held, rows))
    classed = held.join(copies, "key", "left").select("key", "doc_id", "line", "template", "fresh", "fixed", F.coalesce("origin", "doc_id").alias("class"))
    per_class = classed.groupBy("template", "class").agg(F.sum("fresh").alias("n"), F.min("doc_id").alias("doc_id"), F.min("fixed").alias("fixed"))
    totals = per_class.groupBy("template").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_different"), F.min(F.struct("doc_id", "class")).alias("first"), F.min("fixed").alias("fixed"))
    out = durable(totals.where((F.col("n_docs") >= _evidence(1)) & (F.col("n_different") >= _evidence(2))).select("template", F.col("first.class").alias("home"), F.col("n_docs").alias("n")))
    marked = join_counted(classed, out, "template").where(F.col("class") != F.col("home"))
    return marked.groupBy("key").agg(F.collect_set("line").alias("drop"))


def document_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its recurring lines dropped, and a last column ``__dropped`` with how many.

    Every row stays, its text less the dropped lines (and their line ends). A text that
    loses none is unchanged, a null text stays null, a row without an id takes no part
    and is unchanged, repeated rows are changed alike, and an empty table gives no rows.
    Any column may be there already; the last one then has underscores added to its name.
    """
    out, own, key, drop = own_names(docs.columns, "__dropped", "__own", "__key", "__drop")
    drops = durable(recurring_lines(docs, id_col, text_col)).select(F.col("key").alias(key), F.col("drop").alias(drop))
    if (drops.agg(F.sum(F.size(drop) * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        drops = F.broadcast(drops)  # texts stay where they are read
    keyed = docs.withColumn(own, F.when(F.col(id_col).isNotNull(), document_key(id_col, text_col)))
    joined = keyed.join(drops, F.col(own) == F.col(key), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col(drop), i)), "\n")
    text = F.when(F.col(drop).isNotNull(), kept).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.coalesce(F.size(drop), F.lit(0)).alias(out))
