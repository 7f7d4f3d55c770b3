"""Near-duplicates by the Jaccard similarity of five-word shingles.

A 64-bit SimHash within a few bits finds all-but-identical texts; copies with edits all
over lie further apart. Here MinHash bands name buckets: at a similarity of 0.8 a pair
shares one of 16 bands of four with probability 0.9998. Equal texts are one node.

In a bucket texts are compared by sketches of 512 bins, which tell a similarity to about
0.02. Pairs that are surely similar join at once; a text that may be similar to members
of a group it isn't joined to is paired with the nearest of them. So a bucket yields
about a pair for each member, however many pairs it has, and a text that all but repeats
another isn't compared with later ones. Every pair is then verified by its exact
similarity; what is lost are links whose nearest neighbour in a group failed though
another one would have passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.common import join_counted, map_rows, small
from quillspark.llm.components import connected_components
from quillspark.session import durable

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
#: Bins of a sketch, and how far from ``SIMILARITY`` an estimate leaves doubt (three deviations).
BINS, DOUBT = 512, 0.055
#: Estimates from which a text is not compared with later ones.
SAME = 0.93
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; one, of all its words, if it has fewer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    seen: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((seen[w] if w in seen else seen.setdefault(w, digest(w)) for w in tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    out = np.full(n, width, np.uint64)
    for p in range(width):
        out = (out ^ hashes[p : p + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_values(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingles that isn't empty."""
    return np.array([(hashes * f).min() >> np.uint64(32) for f in _FACTORS], np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each bin eight bits (never zero) of the least hash that falls into it; zero where none does."""
    mixed = hashes * _FACTORS[0]
    order = np.sort(mixed)
    bins = (order >> np.uint64(65 - BINS.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = (order[first] >> np.uint64(8)).astype(np.uint64) % np.uint64(255) + np.uint64(1)
    return out


def estimates(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarities of sketches with one: equal bins among those that either fills."""
    equal = ((many == one) & (one > 0)).sum(1)
    return equal / np.maximum(((many | one) > 0).sum(1), 1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


class _Bucket:
    """The members of a bucket so far that later ones are compared with."""

    def __init__(self) -> None:
        self.sketches, self.nodes, self.group = np.zeros((4, BINS), np.uint8), [], np.zeros(4, np.int64)  # group: the place of one of its members

    def add(self, node: int, own: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
        """Pairs of a new member: one for each group that it surely or perhaps belongs to."""
        n = len(self.nodes)
        near = estimates(self.sketches[:n], own)
        joined, tried = n, set()
        for k in np.argsort(-near, kind="stable").tolist():
            if near[k] < least - DOUBT:
                break
            root = int(self.group[k])
            if root == joined or root in tried:
                continue
            yield self.nodes[k], node
            if near[k] >= least + DOUBT:
                if joined < n:  # the new member brings two groups together
                    self.group[:n][self.group[:n] == root] = joined
                else:
                    joined = root
            else:
                tried.add(root)
        if n and near.max() >= SAME:
            return
        if n == len(self.sketches):
            self.sketches = np.concatenate([self.sketches, np.zeros_like(self.sketches)])
            self.group = np.concatenate([self.group, np.zeros_like(self.group)])
        self.sketches[n], self.group[n] = own, joined
        self.nodes.append(node)


def _paired(least: float):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        """``a, b`` for ``bucket, node, sketch`` rows that come by bucket; held are the members of one."""
        last, held = None, _Bucket()
        for bucket, node, own in rows:
            if bucket != last:
                last, held = bucket, _Bucket()
            for other, this in held.add(node, np.frombuffer(own, np.uint8), least):
                yield min(other, this), max(other, this)

    return run


def links(texts: DataFrame, words: int = SHINGLE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """Verified links ``a, b`` (nodes) of ``node, text`` rows; texts without a word have none.

    Rows of equal nodes have equal texts and count once.
    """

    def sign(rows: Iterator[tuple]) -> Iterator[tuple]:
        for node, text in rows:
            hashes = shingles(text, words)
            if len(hashes):
                values = band_values(hashes)
                yield node, sketch(hashes).tobytes(), [xxhash.xxh64_intdigest(values[k : k + BAND_ROWS].tobytes(), k) - (1 << 63) for k in range(0, len(values), BAND_ROWS)]

    def sets(rows: Iterator[tuple]) -> Iterator[tuple]:
        for node, text in rows:
            yield node, shingles(text, words).tobytes()

    def verify(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, x, y in rows:
            if similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least:
                yield a, b

    rows = map_rows(texts.select("node", "text"), sign, "node long, sketch binary, bands array<long>")
    signed = durable(rows.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    posted = signed.select("node", F.explode("bands").alias("bucket"))
    shared = durable(posted.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "n", F.col("n").alias("size")))
    members = join_counted(posted, shared, "bucket").groupBy("node").agg(F.collect_list("bucket").alias("buckets"), F.sum("size").alias("degree"))
    once = signed.join(members, "node")
    # Texts that share most buckets with others come first: they are in the middle of their groups.
    ordered = once.select("node", "sketch", "degree", F.explode("buckets").alias("bucket"))
    ordered = ordered.repartition("bucket").sortWithinPartitions("bucket", F.desc("degree"), "node").select("bucket", "node", "sketch")
    pairs = durable(map_rows(ordered, _paired(least), "a long, b long").distinct())
    named = small(durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), 16)
    held = durable(map_rows(texts.join(named, "node", "left_semi").select("node", "text"), sets, "node long, x binary").dropDuplicates(["node"]))
    both = pairs.join(held.withColumnsRenamed({"node": "a"}), "a").join(held.withColumnsRenamed({"node": "b", "x": "y"}), "b")
    return map_rows(both.select("a", "b", "x", "y"), verify, "a long, b long").distinct()


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key`` of the first row of each group that SimHash or five-word similarity links.

    Links of both kinds are between texts, so a group's first row is the one with its
    smallest id (and the smaller key of two texts with that id). Rows without an id take
    no part. An empty table gives no rows; repeated rows are one node.
    """
    named = docs.where(F.col(id_col).isNotNull())
    prints = durable(simhash.fingerprints(named, id_col, text_col))
    found, _ = simhash.classes(prints)
    distinct = durable(prints.groupBy("text_key").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("doc_id")))
    rooted = distinct.join(found.select("fp", "root"), "fp")
    stars = rooted.groupBy("root").agg(F.min("text_key").alias("centre"), F.count("*").alias("n")).where("n > 1")
    same_print = rooted.join(stars, "root").where(F.col("text_key") != F.col("centre")).select(F.col("centre").alias("a"), F.col("text_key").alias("b"))
    texts = named.select(simhash.text_key(text_col).alias("node"), F.col(text_col).alias("text"))
    edges = durable(links(texts).union(same_print))
    roots = durable(connected_components(edges))
    nodes = distinct.join(roots, distinct["text_key"] == roots["node"], "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("root"))
    return nodes.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key")
