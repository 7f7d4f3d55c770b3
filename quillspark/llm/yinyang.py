"""Codes for vectors: integer product quantisation whose codebooks are made by Yinyang Lloyd rounds.

Vectors are turned into integers and cut into consecutive parts; each part position has a
codebook. The entries of a codebook are clustered into a few groups. A part keeps its
entry, an upper bound of its distance to it, and one lower bound for each group: no other
entry of the group is nearer. When entries move, the bounds move by as much, and only
groups whose lower bound isn't above the upper bound are scanned. Scans compare integers,
so that ties are ties; bounds are rounded outwards, so that no group with a tie is left out.

Each round reads the vectors with their bounds from files in the shared folder, writes
them anew and sums the parts of each entry where they are read. Only sums, as many as the
codebooks have numbers, reach the driver, and codebooks are all that tasks are sent.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches, join_counted
from quillspark.session import checkpoint_dir, durable, share_code

PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 16, 64, 2, 256, 6
#: Components are held within this of zero, so that sums of squares stay exact.
LIMIT = 1 << 26
#: Largest half-precision number, and what bounds are widened by for the rounding of roots and sums.
_HALF, _SLACK = 65504.0, 1e-9


@dataclass
class Codebook:
    """Entries of all part positions of vectors of one length, and what the last update moved."""

    words: np.ndarray  # part, entry, position within the part
    groups: np.ndarray  # part, entry: the group of an entry
    moved: np.ndarray  # part, entry: at most how far it moved

    @staticmethod
    def start(words: np.ndarray, groups: int = GROUPS) -> Codebook:
        return Codebook(words, np.stack([cluster(w, groups) for w in words]), np.zeros(words.shape[:2]))

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Codebook:
        """With the floors of the means as entries; unused entries stay."""
        words = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.words)
        return Codebook(words, self.groups, np.sqrt(((words - self.words) ** 2).sum(2)) * (1 + _SLACK))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.words.ravel().tolist())).encode()).hexdigest()


def cluster(words: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each entry by plain Lloyd rounds from spread-out entries; groups without entries have no number."""
    x = words.astype(np.float64)
    centres = [x[0]] if len(x) else []
    while len(centres) < min(groups, len(x)):
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        if not len(x):
            break
        own = ((x[:, None] - np.array(centres)[None]) ** 2).sum(2).argmin(1)
        centres = [x[own == g].mean(0) if (own == g).any() else c for g, c in enumerate(centres)]
    return np.unique(own, return_inverse=True)[1]


def integers(flat: np.ndarray, rows: int, parts: int, scale: int) -> np.ndarray:
    """``row, part, position`` from the components of equally long vectors, filled up with zeros."""
    x = np.clip(np.floor(flat.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64).reshape(rows, -1)
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(rows, parts, width)


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of both."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(words).max(initial=0)))
    if largest * largest * max(x.shape[1], 1) < 1 << 50:  # whole numbers that doubles hold
        a, b = x.astype(np.float64), words.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :] - words[None]) ** 2).sum(2)


_FAR = np.iinfo(np.int64).max


def _roots(squares: np.ndarray, up: bool) -> np.ndarray:
    return np.where(squares == _FAR, np.inf, np.sqrt(squares.astype(np.float64)) * (1 + _SLACK if up else 1 - _SLACK))


def _least_by_group(d: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    return np.stack([d[:, groups == g].min(1) for g in range(n)], axis=1)


def first_assignment(x: np.ndarray, words: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``entry, upper, lower`` of every row, by all distances."""
    d = distances(x, words)
    rows, own = np.arange(len(x)), d.argmin(1)
    upper = _roots(d[rows, own], True)
    d[rows, own] = _FAR
    return own, upper, _roots(_least_by_group(d, groups, int(groups.max()) + 1), False)


def next_assignment(x: np.ndarray, words: np.ndarray, groups: np.ndarray, moved: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """``entry, upper, lower`` after entries moved, and how many groups were scanned; the arguments' bounds are changed."""
    upper += moved[own]
    lower -= np.array([moved[groups == g].max() for g in range(lower.shape[1])])
    doubt = np.flatnonzero(lower.min(1) <= upper)
    if not len(doubt):
        return own, upper, lower, 0
    old = own[doubt]
    exact = ((x[doubt] - words[old]) ** 2).sum(1)
    upper[doubt] = _roots(exact, True)
    scans = lower[doubt] <= upper[doubt, None]
    best, entry, rest = np.full(scans.shape, _FAR), np.zeros(scans.shape, np.int64), np.full(scans.shape, _FAR)
    for g in range(scans.shape[1]):
        rows = np.flatnonzero(scans[:, g])
        if not len(rows):
            continue
        members = np.flatnonzero(groups == g)
        d = distances(x[doubt[rows]], words[members])
        d[old[rows, None] == members[None]] = _FAR
        at, k = np.arange(len(rows)), d.argmin(1)
        best[rows, g], entry[rows, g] = d[at, k], members[k]
        d[at, k] = _FAR
        rest[rows, g] = d.min(1)
    # The nearest of the scanned groups, ties to the lower entry, against the entry that the part had.
    rows = np.arange(len(doubt))
    winner = np.lexsort((entry, best), axis=1)[:, 0] if best.shape[1] > 1 else np.zeros(len(doubt), np.int64)
    found, name = best[rows, winner], entry[rows, winner]
    change = (found < exact) | ((found == exact) & (name < old))
    bounds = np.where(scans, _roots(best, False), lower[doubt])
    bounds[rows[change], winner[change]] = _roots(rest, False)[rows[change], winner[change]]
    left = groups[old[change]]
    bounds[rows[change], left] = np.minimum(bounds[rows[change], left], _roots(exact[change], False))
    lower[doubt] = bounds
    own[doubt[change]] = name[change]
    upper[doubt[change]] = _roots(found[change], True)
    return own, upper, lower, int(scans.sum())


def _narrow(values: np.ndarray, up: bool) -> np.ndarray:
    """Half-precision bounds, rounded outwards."""
    if not up:
        values = np.clip(values, -_HALF, _HALF)
    with np.errstate(over="ignore"):
        half = values.astype(np.float16)
        wrong = half.astype(np.float64) < values if up else half.astype(np.float64) > values
        return np.where(wrong, np.nextafter(half, np.float16(np.inf if up else -np.inf)), half)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of an array."""
    data = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8) if rows.size else np.zeros((len(rows), 0), np.uint8)
    return pa.array([r.tobytes() for r in data], pa.binary())


_STATE = "id long, label string, vector array<double>, own binary, upper binary, lower binary"


def _by_length(batches: Iterator[pa.RecordBatch], books: dict[int, Codebook], parts: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Codebook]]:
    """Rows of one length at a time, as integers, with their codebook."""
    for whole in batches:
        lengths = whole.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths).tolist():
            rows = whole if (lengths == length).all() else whole.filter(pa.array(lengths == length))
            for at in range(0, rows.num_rows, 4096):
                batch = rows.slice(at, 4096)
                yield batch, integers(batch.column("vector").flatten().to_numpy(zero_copy_only=False), batch.num_rows, parts, scale), books[length]


def _assigned(batch: pa.RecordBatch, x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``row, part`` entries and upper bounds, and the lower bounds of each part."""
    n, parts = x.shape[:2]
    own, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), []
    seen = None
    if "own" in batch.schema.names:
        seen = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, -1) for c, t in (("own", np.uint8), ("upper", np.float16), ("lower", np.float16))]
    at = 0
    for p in range(parts):
        groups = book.groups[p]
        if seen is None:
            own[:, p], upper[:, p], low = first_assignment(x[:, p], book.words[p], groups)
        else:
            many = int(groups.max()) + 1
            before = seen[0][:, p].astype(np.int64), seen[1][:, p].astype(np.float64), seen[2][:, at : at + many].astype(np.float64)
            own[:, p], upper[:, p], low, _ = next_assignment(x[:, p], book.words[p], groups, book.moved[p], *before)
            at += many
        lower.append(low)
    return own, upper, lower


def _kept_state(books: dict[int, Codebook], parts: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, book in _by_length(batches, books, parts, scale):
            own, upper, lower = _assigned(batch, x, book)
            columns = [batch.column(c) for c in ("id", "label", "vector")]
            bounds = _narrow(upper, True), _narrow(np.concatenate(lower, axis=1), False)
            yield pa.RecordBatch.from_arrays([*columns, *map(_binary, (own, *bounds))], ["id", "label", "vector", "own", "upper", "lower"])

    return run


def _coded(books: dict[int, Codebook], parts: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, book in _by_length(batches, books, parts, scale):
            own, _, _ = _assigned(batch, x, book)
            error = sum(((x[:, p] - book.words[p][own[:, p]]) ** 2).sum(1) for p in range(parts))
            codes = pa.array([row.tobytes().hex() for row in own], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), codes, pa.array(error), pa.array([book.digest()] * len(x))], ["id", "label", "code", "error", "digest"])

    return run


def _summed(books: dict[int, Codebook], parts: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch, x, book in _by_length(batches, books, parts, scale):
            length = int(batch.column("vector").value_lengths()[0].as_py())
            sums, counts = totals.setdefault(length, (np.zeros_like(book.words), np.zeros(book.words.shape[:2], np.int64)))
            own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(len(x), -1)
            for p in range(parts):
                np.add.at(sums[p], own[:, p], x[:, p])
                counts[p] += np.bincount(own[:, p], minlength=counts.shape[1])
        for length, (sums, counts) in totals.items():
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), length)), pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
                ["length", "part", "entry", "n", "sums"],
            )

    return run


def _update(state: DataFrame, books: dict[int, Codebook], parts: int, scale: int) -> dict[int, Codebook]:
    """Codebooks from the sums of all tasks: as many numbers as the codebooks have."""
    partial = state.select("vector", "own").mapInArrow(_summed(books, parts, scale), "length long, part long, entry long, n long, sums array<long>")
    each = partial.select("length", "part", "entry", "n", F.posexplode_outer("sums").alias("at", "v"))
    found = each.groupBy("length", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    totals = {length: (np.zeros_like(b.words), np.zeros(b.words.shape[:2], np.int64)) for length, b in books.items()}
    for r in found:
        sums, counts = totals[r["length"]]
        counts[r["part"], r["entry"]] = r["n"]
        if r["at"] is not None:
            sums[r["part"], r["entry"], r["at"]] = r["v"]
    return {length: b.updated(*totals[length]) for length, b in books.items()}


def finite_vectors(table: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), vector.alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def compress(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` for each vector without null or non-finite components.

    A code has two hex digits for each part. Codebooks start from the vectors with the
    smallest ids (fewer vectors: fewer entries); of equal ids the smaller vector comes
    first, null ids come last and are coded too. Repeated rows are coded alike and count
    each. Vectors of different lengths have codebooks of their own; a length that ``parts``
    doesn't divide is filled up with zeros. Components beyond ``LIMIT`` after scaling are
    held there; a sum of errors beyond a long is null. An empty table gives no rows;
    columns other than the three named ones are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    spark = table.sparkSession
    bound_batches(spark)
    share_code(spark)
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    rows = finite_vectors(table, id_col, vector_col, label)
    first = Window.partitionBy(F.size("vector")).orderBy(F.col("id").asc_nulls_last(), "vector")
    seeds = rows.select("id", "vector", F.row_number().over(first).alias("k")).where(F.col("k") <= entries).orderBy("k").collect()
    by_length: dict[int, list[list[float]]] = {}
    for r in seeds:
        by_length.setdefault(len(r["vector"]), []).append(r["vector"])
    books = {n: Codebook.start(integers(np.array(v, np.float64).ravel(), len(v), parts, scale).transpose(1, 0, 2)) for n, v in by_length.items()}

    folder, state = f"{checkpoint_dir(spark)}/yinyang-{uuid.uuid4().hex}", rows
    for k in range(rounds):
        state.mapInArrow(_kept_state(books, parts, scale), _STATE).write.parquet(f"{folder}/round-{k}")
        state = spark.read.parquet(f"{folder}/round-{k}")
        books = _update(state, books, parts, scale)
        if k:
            _delete(spark, f"{folder}/round-{k - 1}")
    coded = durable(state.mapInArrow(_coded(books, parts, scale), "id long, label string, code string, error long, digest string"))
    _delete(spark, folder)
    labels = durable(coded.groupBy("label").agg(F.count("*").alias("n"), F.expr("try_sum(error)").alias("label_error")))
    joined = join_counted(coded, labels, "label")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.col("digest").alias("codebooks_sha256"))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
