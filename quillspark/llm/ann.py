"""Nearest neighbours by additive quantisation, with a bound that loses none of them.

A vector's direction is the sum of one full-dimensional codeword from each of several
codebooks, and its length is stored beside the code. Codebooks are fitted to residuals on
a bounded sample; encoding keeps a beam of partial sums instead of the single best one. A
query's lookup tables hold its inner product with every codeword, so a code is scored by
adding table entries. What a code leaves of a vector is stored as a length too: no inner
product can be further from its table score than that times the query's length. A block
of codes first gives a query's likeliest rows and so a score that its nearest reach; the
original vectors of all rows that may reach it are then compared exactly. Where codes fit
badly more rows are compared; none is lost, whatever the sample said.

Equal vectors have equal codes and tie in every score, so they are indexed once, with as
many of their smallest ids as a result can hold; no id beyond those can be in a result.

An inner product is one of vectors of equal length: a query is compared with all rows of
its own. Each of the most frequent lengths has codebooks; rows of the others have none,
and are all compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.session import durable

#: Vectors on which codebooks are fitted, at most.
SAMPLE_ROWS = 8192
CODEBOOKS, CODEWORDS, BEAM, ROUNDS = 32, 256, 4, 8
#: Bytes of vectors in a block and in a part of the queries, about; codes whose vectors set a query's bound.
BLOCK_BYTES, RERANK = 16 << 20, 256
#: Lengths of vectors with codebooks, at most, and rows that a length must have for them.
CODED_LENGTHS, CODED_ROWS = 8, 64
#: Queries that are scored at a time, and codes at a time (their scores fit in a core's cache).
_STEP, _CODES = 128, 1024


@dataclass
class Codebooks:
    words: np.ndarray  # codebook, codeword, dimension

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the directions of ``x``, its lengths, and how far a direction's inner product with a unit vector may be from its table score."""
        codes, norms, spreads = np.zeros((len(x), len(self.words)), np.uint8), lengths(x), np.zeros(len(x))
        sizes = lengths(self.words.astype(np.float64).reshape(-1, self.words.shape[2])).reshape(self.words.shape[:2])
        rounding = (self.words.shape[2] + len(self.words) + 16) * 2.0**-23
        for at in range(0, len(x), 1024):
            part = slice(at, at + 1024)
            unit = directions(x[part])
            codes[part] = self._encode(unit.astype(np.float32), beam)
            rest, size = unit, np.ones(len(unit))
            for m, book in enumerate(self.words):
                rest, size = rest - book[codes[part, m]], size + sizes[m, codes[part, m]]
            spreads[part] = lengths(rest) + rounding * size
        return codes, norms, spreads

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, d = x.shape
        residual, codes = x[:, None, :], np.zeros((n, 1, 0), np.int64)
        rows = np.arange(n)[:, None]
        for book in self.words:
            size = (residual**2).sum(2, keepdims=True)
            error = size - 2 * (residual.reshape(-1, d) @ book.T).reshape(n, residual.shape[1], -1) + (book**2).sum(1)
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = np.divmod(best, len(book))
            residual = residual[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None]], axis=2)
        last = (residual**2).sum(2).argmin(1)
        rows = rows[:, 0]
        return codes[rows, last].astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with codewords: codebook, codeword, query."""
        return np.ascontiguousarray(self.words @ q.astype(np.float32).T)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths; the largest component is taken out first, so that no square overflows or vanishes."""
    most = np.abs(x).max(1, initial=0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1))


def directions(x: np.ndarray) -> np.ndarray:
    """Rows (none is zero) at length one."""
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def fit(sample: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = ROUNDS, seed: int = 7) -> Codebooks:
    """Residual codebooks by k-means, each on what the earlier ones leave."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32).copy()
    books = []
    for _ in range(codebooks):
        k = min(codewords, len(rest))
        words = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = _nearest(rest, words)
            sizes = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            full = np.flatnonzero(sizes)
            words[full] = np.add.reduceat(rest[order], np.concatenate([[0], sizes[full].cumsum()[:-1]]), axis=0) / sizes[full, None]
        rest -= words[_nearest(rest, words)]
        books.append(np.concatenate([words, np.zeros((codewords - k, words.shape[1]), np.float32)]))
    return Codebooks(np.stack(books).astype(np.float32))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * x @ words.T).argmin(1)


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` rows (doubles) that take part in a search.

    Left out are null ids and vectors that are null, empty, zero or hold null or
    non-finite components.
    """
    vector = F.col(vector_col).cast("array<double>")
    return table.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )


def build_index(vectors: DataFrame, keep_ids: int) -> tuple[DataFrame, dict[int, Codebooks]]:
    """``(index rows, codebooks by length)`` over every usable vector.

    An index row is a distinct vector with its length ``d``, its hash ``key``, its
    ``keep_ids`` smallest ids (found in two steps, so that no task gathers a frequent
    vector's rows), code, Euclidean length and spread (see ``Codebooks.encode``). Where a
    length has no codebooks the code is empty and the spread infinite.
    """
    salted = vectors.distinct().groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(64)).alias("__salt")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep_ids).alias("ids"))
    distinct = durable(salted.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep_ids).alias("ids")).withColumn("d", F.size("vector")))
    coded = distinct.groupBy("d").count().where(F.col("count") >= CODED_ROWS).orderBy(F.desc("count"), "d").limit(CODED_LENGTHS).select("d").collect()
    books = {}
    for (d,) in coded:
        sample = distinct.where(F.col("d") == d).select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE_ROWS).toPandas()
        books[d] = fit(directions(np.array(sample["vector"].tolist())))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, rows in frame.groupby("d"):
                x = np.array(rows["vector"].tolist())
                if d in books:
                    codes, norms, spreads = books[d].encode(x)
                    yield rows.assign(code=[c.tobytes() for c in codes], norm=norms, spread=spreads)
                else:
                    yield rows.assign(code=b"", norm=lengths(x), spread=np.inf)

    slots = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = distinct.repartition(slots).select("d", F.xxhash64("vector").alias("key"), "vector", "ids")
    return durable(keyed.mapInPandas(run, "d int, key long, vector array<double>, ids array<long>, code binary, norm double, spread double")), books


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def search(
    table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, measure: str = "inner", block_rows: int | None = None
) -> DataFrame:
    """The ``k`` rows of ``table`` that are nearest to each query row.

    ``measure`` is ``inner``, the largest inner product, or ``l2``, the smallest squared
    distance, whose negative is the score. One row ``query_id, rank, vec_id, score`` for
    each place; ties go to the smaller id, a query's own id is no candidate, and there are
    fewer rows where there are fewer candidates. ``queries`` has the two columns as well.
    Only vectors of a query's own length are compared with it. See ``usable_vectors`` for
    what takes no part; repeated rows of an id and vector count
    once, and a query id that has several vectors is answered for its largest vector in
    array order. Empty tables give no rows, other columns are not read.
    """
    spark = table.sparkSession
    index, books = build_index(usable_vectors(table, id_col, vector_col), k + 1)
    asked = durable(usable_vectors(queries, id_col, vector_col).groupBy("id").agg(F.max("vector").alias("vector")).withColumn("d", F.size("vector")))
    by_distance, cores = measure == "l2", spark.sparkContext.defaultParallelism
    # A cell is a block of the index and a part of the queries of one length, each of bounded size; what it gives back is k + 1 rows for each query, in Arrow columns.
    rows = F.lit(block_rows) if block_rows else F.greatest(F.lit(256), F.floor(F.lit(BLOCK_BYTES // 8) / F.col("d")))
    blocks = F.greatest(F.ceil(F.col("n") / rows), F.least(F.lit(2 * cores), F.ceil(F.col("n") / 4096))).cast("int")
    parts = F.ceil(F.col("m") / rows).cast("int")
    sizes = index.groupBy("d").agg(F.count("*").alias("n")).join(asked.groupBy("d").agg(F.count("*").alias("m")), "d")
    grid = durable(sizes.select("d", blocks.alias("blocks"), parts.alias("parts")))
    cells = index.join(grid, "d").select(
        "d", F.pmod("key", F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", F.col("ids")[0].alias("first"), "code", "norm", "spread", "vector",
    )
    wanted = asked.join(grid, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "vector")

    def best(own: pa.Table, asked_of: pa.Table) -> pa.Table:
        ids = asked_of["id"].to_numpy()
        if len(ids) and own.num_rows:
            d = own["d"][0].as_py()
            known = books.get(d, Codebooks(np.zeros((0, 1, d), np.float32)))
            codes = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(own.num_rows, len(known.words))
            block = Block(codes, own["norm"].to_numpy(), own["spread"].to_numpy(), _matrix(own["vector"], d), own["first"].to_numpy(), own["key"].to_numpy())
            query, place, score = block.nearest(_matrix(asked_of["vector"], d), known, k + 1, max(rerank, k + 1), by_distance)
        else:
            query, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        first, key = (own[c].to_numpy()[place] if len(place) else place for c in ("first", "key"))
        return pa.table({"query_id": ids[query], "away": -score, "first": first, "key": key})

    hits = cells.groupBy("d", "block", "part").cogroup(wanted.groupBy("d", "block", "part")).applyInArrow(best, "query_id long, away double, first long, key long")
    # Of the k + 1 nearest vectors by score and smallest id, one may hold the query's own id alone.
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("away", "first", "key"))
    near = hits.withColumn("place", last).where(F.col("place") <= k + 1).select("query_id", "key", (-F.col("away")).alias("score"))
    both = near.join(index.select("key", F.explode("ids").alias("vec_id")), "key").where(F.col("vec_id") != F.col("query_id"))
    scored = both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@dataclass
class Block:
    """Rows of an index: codes, lengths, spreads, vectors, smallest ids and keys."""

    codes: np.ndarray
    norms: np.ndarray
    spreads: np.ndarray
    vectors: np.ndarray
    firsts: np.ndarray
    keys: np.ndarray

    def nearest(self, q: np.ndarray, books: Codebooks, most: int, keep: int, by_distance: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, places in the block and exact scores of the ``most`` nearest rows of each query."""
        out = []
        for at in range(0, len(q), _STEP):
            part = q[at : at + _STEP]
            table = self._table_scores(books.tables(directions(part)))
            for row, (own, size) in enumerate(zip(part, lengths(part), strict=True)):
                place, score = self._nearest(own, size, table[row], most, keep, by_distance)
                out.append((np.full(len(place), at + row), place, score))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _table_scores(self, tables: np.ndarray) -> np.ndarray:
        """Inner products of directions by codes: query, row."""
        score = np.empty((tables.shape[2], len(self.codes)), np.float32)
        for lo in range(0, len(self.codes), _CODES):
            codes = self.codes[lo : lo + _CODES]
            total = np.zeros((len(codes), tables.shape[2]), np.float32)
            for m, table in enumerate(tables):
                total += table[codes[:, m]]
            score[:, lo : lo + _CODES] = total.T
        return score

    def _nearest(self, q: np.ndarray, size: float, table: np.ndarray, most: int, keep: int, by_distance: bool) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            likely = self._worth(size, table * self.norms, by_distance)
            n = len(likely)
            if n <= 2 * keep:
                near = np.arange(n)
            else:  # the best of each of ``keep`` stretches: nearly the best of all, without a sort
                wide = n // keep
                near = likely[: wide * keep].reshape(keep, wide).argmax(1) + np.arange(keep) * wide
            score = self._exact(q, near, by_distance)
            if n > 2 * keep:
                reached = np.partition(score, keep - most)[keep - most]
                # What is not a number is compared too.
                near = np.flatnonzero(~(self._worth(size, (table + self.spreads) * self.norms, by_distance, 2.0**-40) < reached))
                score = self._exact(q, near, by_distance)
            if len(score) > most:
                good = np.flatnonzero(~(score < np.partition(score, len(score) - most)[len(score) - most]))
                near, score = near[good], score[good]
            order = np.lexsort((self.keys[near], self.firsts[near], -score))[:most]
            return near[order], score[order]

    def _worth(self, size: float, inner: np.ndarray, by_distance: bool, slack: float = 0.0) -> np.ndarray:
        """Scores by inner products with the query's direction."""
        return 2 * size * inner - (1 - slack) * (size * size + self.norms**2) if by_distance else size * inner

    def _exact(self, q: np.ndarray, places: np.ndarray, by_distance: bool) -> np.ndarray:
        out = np.empty(len(places))
        for at in range(0, len(places), 4096):
            x = self.vectors[places[at : at + 4096]]
            out[at : at + 4096] = -((x - q) ** 2).sum(1) if by_distance else (x * q).sum(1)
        return out
