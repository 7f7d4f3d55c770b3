"""Similarity join of shingle sets through parity sketches.

A sketch is a string of bits, and each shingle of a set flips one of them. The sketches of
two sets differ in at most as many bits as the sets differ in shingles: Hamming distances
bound symmetric differences from below. A Jaccard similarity bounds the symmetric
difference from above, by the sizes of the sets.

Sets are dealt to bands of sizes; a set near the lower end of its band joins the band
below too. In a band at most ``d`` shingles differ in a pair that links, so that of
``d + 1 + z`` pieces of the two sketches at least ``1 + z`` are equal. Each set posts all
its pieces but the first ``z`` by an order that all sets share (pieces of few shingles,
which unlike sets have in common, come first): of a pair's equal pieces the last is
posted by both. A piece's name holds its bits and the exclusive or of its shingles'
hashes, so that unlike pieces don't meet by chance.

Postings are combined where they are read: of the sets of a task that share a piece, one
stands for the others. Members of a posting are held against its smallest set first: by
size, by Hamming distance, then by their shingles. Postings that still hold sets of
several components are compared as a whole, by sketches and in square cells of bounded
size; sets with a near enough sketch have their shingles compared in the same cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches, join_counted, map_rows, small
from quillspark.llm.components import connected_components
from quillspark.llm.jaccard import shingles
from quillspark.llm.simhash import text_key
from quillspark.session import checkpoint_dir, durable, share_code

SHINGLE_WORDS, PER_CENT = 4, 85
#: Sizes of a band, largest to smallest.
BAND_RATIO = 1.4
#: Postings that a task combines at a time; sets, and bytes of shingles, in a side of a cell.
HELD_POSTINGS, CELL_SETS, CELL_BYTES = 1 << 21, 1024, 48 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _band(k: int) -> tuple[int, int]:
    """Least and largest size of a band."""
    low = 1
    for _ in range(k):
        low = max(low + 1, int(np.ceil(low * BAND_RATIO)))
    return low, max(low + 1, int(np.ceil(low * BAND_RATIO))) - 1


def most_apart(a, b, per_cent: int = PER_CENT):
    """The largest symmetric difference of two linked sets by their sizes."""
    return (100 - per_cent) * (a + b) // (100 + per_cent)


@cache
def pieces_of_band(k: int, per_cent: int = PER_CENT) -> tuple[int, int]:
    """``d, z`` of the pairs whose smaller set is in a band: shingles that differ at most, pieces that are left out."""
    largest = _band(k)[1]
    d = most_apart(largest, largest * 100 // per_cent, per_cent)
    return d, 1 + d // 4


def bands_of(n: int, per_cent: int = PER_CENT) -> list[int]:
    """The band of a size, and the one below if it holds a size that may link with it."""
    k = 0
    while _band(k)[1] < n:
        k += 1
    return [k, k - 1] if k and 100 * (_band(k)[0] - 1) >= per_cent * n else [k]


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def postings(tokens: np.ndarray, per_cent: int = PER_CENT) -> np.ndarray:
    """Names of the pieces that a set (hashes of its shingles) posts in its bands."""
    out = []
    places = _scrambled(tokens)
    bits = np.uint64(1) << (places & np.uint64(63))
    for band in bands_of(len(tokens), per_cent):
        d, z = pieces_of_band(band, per_cent)
        if not d:  # only equal sets link
            continue
        n = d + 1 + z
        piece = ((places >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        order = np.argsort(piece, kind="stable")
        found, starts, sizes = np.unique(piece[order], return_index=True, return_counts=True)
        at = found.astype(np.int64)
        parity, check, held = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        parity[at] = np.bitwise_xor.reduceat(bits[order], starts)
        check[at] = np.bitwise_xor.reduceat(tokens[order], starts)
        held[at] = sizes
        names = _scrambled(_scrambled(parity ^ (np.arange(n, dtype=np.uint64) + (np.uint64(band) << np.uint64(48)))) ^ check)
        out.append(names[np.lexsort((names, held))[z:]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Bytes of a parity sketch of two to four bits for each shingle, a power of two of them."""
    m = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    at = (_scrambled(tokens) >> np.uint64(7)) & np.uint64(m - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=m) & 1).astype(np.uint8))


def folded(own: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bytes; it bounds symmetric differences too."""
    return np.bitwise_xor.reduce(own.reshape(-1, size), axis=0)


def _words(sketches: list[np.ndarray]) -> np.ndarray:
    size = min(map(len, sketches))
    return np.stack([folded(s, size) for s in sketches]).view(np.uint64)


def near_places(rows: np.ndarray, n: np.ndarray, k: int, others: slice, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places among ``others`` whose size and sketch allow a link with row ``k``, and their Hamming distances."""
    apart = np.bitwise_count(rows[others] ^ rows[k]).sum(1, dtype=np.int64)
    sizes = n[others]
    fits = (apart <= most_apart(sizes, n[k], per_cent)) & (100 * np.minimum(sizes, n[k]) >= per_cent * np.maximum(sizes, n[k]))
    found = np.flatnonzero(fits)
    return found + (others.start or 0), apart[found]


def linked(x: np.ndarray, y: np.ndarray, per_cent: int = PER_CENT) -> bool:
    """Whether two sets of hashes reach the similarity."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= per_cent * (len(x) + len(y) - shared)


def _name(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    """A set's 64-bit name and 64 more bits that confirm it."""
    whole = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed)
    return (whole & (1 << 64) - 1) - (1 << 63), (whole >> 64) - (1 << 63)


def _posted(words: int, per_cent: int, seed: int):
    """``key, node, centre`` of texts; of the nodes of a chunk that share a key, one has no other centre."""

    def combined(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        key = np.concatenate(keys).view(np.int64)
        node = np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        return _starred(key[fresh], node[fresh], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, size = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py(), words)
                own = postings(tokens, per_cent)
                if not len(own):
                    continue
                keys.append(own)
                nodes.append(_name(tokens, seed)[0])
                size += len(own)
                if size >= HELD_POSTINGS:
                    yield combined(keys, nodes)
                    keys, nodes, size = [], [], 0
        if keys:
            yield combined(keys, nodes)

    return run


def _starred(key: np.ndarray, node: np.ndarray, also: np.ndarray | None) -> pa.RecordBatch:
    """Sorted distinct ``key, node`` with the first node of each key as centre.

    A key's only node has no centre; with ``also`` (others of the key are elsewhere) it is its own.
    """
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    alone = sizes == 1
    if also is not None and len(key):
        alone &= ~np.logical_or.reduceat(also, starts)
    centre = pa.array(np.repeat(node[starts], sizes), mask=np.repeat(alone, sizes))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), centre], ["key", "node", "centre"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members ``key, node, centre`` of keys with several nodes, from rows that come by key and node.

    Rows that have another centre already pass; the last key of a batch waits for the next.
    A key's waiting rows are one for each chunk of postings at most.
    """
    key, node, also = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def stars() -> pa.RecordBatch:
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        flags = np.logical_or.reduceat(also, first) if len(first) else also
        batch = _starred(key[fresh], node[fresh], flags)
        return batch.filter(batch.column("centre").is_valid())

    for batch in batches:
        k, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
        known = batch.column("centre").is_valid().to_numpy(zero_copy_only=False)
        centre = batch.column("centre").fill_null(0).to_numpy(zero_copy_only=False)
        settled = known & (centre != v)
        if settled.any():
            yield batch.filter(pa.array(settled))
        rest = ~settled
        key, node, also = np.concatenate([key, k[rest]]), np.concatenate([node, v[rest]]), np.concatenate([also, known[rest]])
        if len(key):
            last = int(np.searchsorted(key, key[-1]))
            waiting = key[last:], node[last:], also[last:]
            key, node, also = key[:last], node[:last], also[:last]
            yield stars()
            key, node, also = waiting
    yield stars()



class _Join:
    """One run of the join; its sets and sketches are in a folder of their own."""

    def __init__(self, docs: DataFrame, words: int, per_cent: int) -> None:
        self.docs, self.words, self.per_cent, self.spark = docs, words, per_cent, docs.sparkSession
        self.folder = f"{checkpoint_dir(self.spark)}/parity-{uuid.uuid4().hex}"

    def signed(self) -> tuple[DataFrame, DataFrame]:
        """Rows ``doc_id, text_key, n, node`` and nodes ``node, least, text_key, rows``; names are proven to be unique."""
        words = self.words
        for seed in range(8):

            def sign(rows: Iterator[tuple], seed: int = seed) -> Iterator[tuple]:
                for doc_id, key, text in rows:
                    tokens = shingles(text, words)
                    yield doc_id, key, len(tokens), *_name(tokens, seed)

            signed = durable(map_rows(self.docs.select("doc_id", "text_key", "text"), sign, "doc_id long, text_key long, n long, node long, check long"))
            nodes = signed.where("n > 0").groupBy("node").agg(
                F.min("doc_id").alias("least"), F.first("text_key").alias("text_key"), F.count("*").alias("rows"), F.min("check").alias("low"), F.max("check").alias("high")
            )
            nodes = durable(nodes)
            if nodes.where("low <> high").isEmpty():
                self.seed = seed
                return signed, nodes
        raise RuntimeError("sets kept sharing names under every seed")

    def members(self) -> DataFrame:
        bound_batches(self.spark)
        share_code(self.spark)
        ddl = "key long, node long, centre long"
        posted = self.docs.select("text").mapInArrow(_posted(self.words, self.per_cent, self.seed), ddl)
        place = F.when(F.col("centre").isNull() | (F.col("centre") == F.col("node")), F.col("key")).otherwise(F.xxhash64("key", "node"))
        return durable(posted.repartition(place).sortWithinPartitions("key", "node").mapInArrow(_gathered, ddl))

    def store_sets(self, pairs: DataFrame, nodes: DataFrame) -> None:
        """Writes sketch and shingles of each node that a pair names."""
        words, seed = self.words, self.seed

        def sets(rows: Iterator[tuple]) -> Iterator[tuple]:
            for (text,) in rows:
                tokens = shingles(text, words)
                yield _name(tokens, seed)[0], len(tokens), sketch(tokens).tobytes(), tokens.tobytes()

        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        keys = small(durable(nodes.join(named, "node", "left_semi").select("text_key").distinct()), 16)
        found = map_rows(self.docs.join(keys, "text_key", "left_semi").select("text"), sets, "node long, n long, sketch binary, x binary")
        found.dropDuplicates(["node"]).write.parquet(f"{self.folder}/sets")

    def stored(self, *columns: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/sets").select(*columns)

    def _beside(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """Pairs with columns of both ends; an end that many pairs have doesn't meet them all in one task."""
        out = pairs
        for end in ("a", "b"):
            counts = durable(pairs.groupBy(end).agg(F.count("*").alias("n_pairs")))
            own = self.stored("node", *columns).join(counts, F.col("node") == F.col(end)).select(end, F.col("n_pairs").alias("n"), *(F.col(c).alias(f"{c}_{end}") for c in columns))
            width = sum((F.octet_length(f"{c}_{end}") for c in columns if c in ("sketch", "x")), F.lit(16))
            out = join_counted(out, own, end, width)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        per_cent = self.per_cent

        def near(rows: Iterator[tuple]) -> Iterator[tuple]:
            for a, b, n, m, x, y in rows:
                both = _words([np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)])
                if len(near_places(both, np.array([n, m]), 0, slice(1, 2), per_cent)[0]):
                    yield a, b

        def exact(rows: Iterator[tuple]) -> Iterator[tuple]:
            for a, b, x, y in rows:
                if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), per_cent):
                    yield a, b

        sized = self._beside(pairs, "n", "sketch").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        close = durable(map_rows(sized, near, "a long, b long"))
        return map_rows(self._beside(close, "x").select("a", "b", "x_a", "x_b"), exact, "a long, b long")

    def left_over(self, members: DataFrame, roots: DataFrame) -> DataFrame | None:
        """Links inside the postings that hold several components still: a spanning forest of each cell."""
        rooted = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        rooted = durable(rooted)
        mixed = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("centre"))
        mixed = durable(mixed.where("low <> high").select("key", "n", "centre"))
        if mixed.isEmpty():
            return None
        beside = durable(join_counted(rooted, mixed, "key").select("centre", "node", "root").distinct())
        sizes = durable(
            beside.join(self.stored("node", "n").withColumnRenamed("n", "tokens"), "node").groupBy("centre").agg(F.count("*").alias("n"), F.sum(F.col("tokens") * 8).alias("bytes"))
        ).withColumn("blocks", F.greatest(F.ceil(F.col("n") / CELL_SETS), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int"))
        dealt = join_counted(beside, sizes.drop("bytes"), "centre").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        cells = dealt.select("centre", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cells = cells.select("centre", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
        close = durable(self._cells(cells, "sketch", self._doubtful, "centre long, i int, j int, own int, node long, root long"))
        return self._cells(close, "x", self._forest, "a long, b long")

    def _cells(self, cells: DataFrame, column: str, work, ddl: str) -> DataFrame:
        whole = cells.join(self.stored("node", "n", column), "node").select("centre", "i", "j", "own", "node", "root", "n", column)
        return map_rows(whole.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "own", "node"), _by_cell(work), ddl)

    def _pairs_of_cell(self, cell: list[tuple], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each row the later places that a link is possible with, and how far they are."""
        n, own = np.array([r[6] for r in cell]), np.array([r[3] for r in cell])
        cross = cell[0][1] != cell[0][2]
        second = int(np.searchsorted(own, cell[0][2])) if cross else 0
        for k in range(second if cross else len(cell)):
            places, apart = near_places(rows, n, k, slice(second if cross else k + 1, len(cell)), self.per_cent)
            yield k, places, apart

    def _doubtful(self, cell: list[tuple]) -> Iterator[tuple]:
        roots = np.array([r[5] for r in cell])
        wanted = np.zeros(len(cell), bool)
        for k, places, _ in self._pairs_of_cell(cell, _words([np.frombuffer(r[7], np.uint8) for r in cell])):
            places = places[roots[places] != roots[k]]
            wanted[places] = True
            wanted[k] |= bool(len(places))
        yield from (cell[k][:6] for k in np.flatnonzero(wanted))

    def _forest(self, cell: list[tuple]) -> Iterator[tuple]:
        sets = [np.frombuffer(r[7], np.uint64) for r in cell]
        group = np.unique([r[5] for r in cell], return_inverse=True)[1]
        found = [(d, k, p) for k, places, apart in self._pairs_of_cell(cell, _words([sketch(x) for x in sets])) for p, d in zip(places.tolist(), apart.tolist(), strict=True) if group[p] != group[k]]
        for _, k, p in sorted(found):
            if group[k] != group[p] and linked(sets[k], sets[p], self.per_cent):
                group[group == group[p]] = group[k]
                yield cell[k][4], cell[p][4]

    def __getstate__(self) -> dict:
        return {"per_cent": self.per_cent}


def _by_cell(work):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        for row in rows:
            if held and row[:3] != held[0][:3]:
                if len(held) > 1:
                    yield from work(held)
                held = []
            held.append(row)
        if len(held) > 1:
            yield from work(held)

    return run


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; sets link from ``per_cent`` of Jaccard similarity on.

    Equal sets are one node. A null, empty or blank text has no shingles and links with
    nothing; a text of fewer words than a shingle has one. Repeated rows are kept, each
    with its component. A null doc_id is kept and names a component only as null, where no
    member has an id. An empty table gives no rows; other columns are not read. Shingles
    are told apart by 64-bit hashes within a pair, sets by 128 bits.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    join = _Join(named, words, per_cent)
    signed, nodes = join.signed()
    members = join.members()
    pairs = durable(members.where("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    join.store_sets(pairs, nodes)
    edges = durable(join.verified(pairs))
    roots = durable(connected_components(edges))
    more = join.left_over(members, roots)
    if more is not None:
        more = durable(more)
        if not more.isEmpty():
            roots = durable(connected_components(edges.union(more)))
    rooted = nodes.join(roots, "node", "left").select("node", "least", "rows", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    parts = durable(rooted.join(least, "root").select("node", F.col("rows").alias("n"), "component_id"))
    linked_rows = join_counted(signed.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "node"), parts, "node").select("doc_id", "n_shingles", "component_id")
    _delete(spark, join.folder)
    return linked_rows.unionByName(signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
