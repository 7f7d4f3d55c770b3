"""Exact substring dedup by distributed prefix doubling.

Every position of every document starts with its byte as rank. Ranks of prefixes of
twice the length are names of pairs ``(rank at p, rank at p + offset)``; up to 24 bytes a
document needs no other document for that, because names are content-derived 64-bit
values, equal for equal strings wherever they stand. Then Spark takes over:

* Round 24 sorts the ranks of the 24-byte prefixes by ranges. A prefix that stands in
  one document alone is unique and its positions need no further round. Not every
  position is sorted: a 50-byte string is represented by the least of the 27 ranks in
  it, which is the same for equal strings, so a document sends these least ranks only.
* Round 50 sorts, for the positions that are left, the pairs of the ranks at offset 0 and
  at offset 32 (the 18 bytes to the threshold), by ranges of the pair's name, with the
  documents' ids. The threshold is reached: a position whose pair also stands in a document
  with a smaller id is covered.

Whole copies are settled before by one round on the ranks of whole documents. Documents
are packed into blocks, kept in a bucketed table; what a round sends is one row for each
block and range, holding each rank once (that of the block's smallest id), so a passage
that is everywhere costs a rank for each block and not one for each document. Answers
are bits in the order in which the ranks were sent.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows
from quillspark.session import durable

THRESHOLD = 50
GRAM = 24
WINDOW = THRESHOLD - GRAM + 1
BLOCK_BYTES = 4 << 20
#: A text of more bytes is cut into pieces of so many starts each, which overlap by a string less a byte.
PIECE_BYTES = 4 << 20
#: Ranks that a range of a round holds, about.
RANGE_RANKS = 1_000_000
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_C, _D = _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def _pair(a: np.ndarray, b: np.ndarray, m: np.uint64 = _A, f: np.uint64 = _B) -> np.ndarray:
    """The name of pairs of ranks."""
    x = (a * m) ^ (b + (a >> _U(32)))
    x *= f
    x ^= x >> _U(29)
    return x


class Ranks:
    """Names of a document's prefixes by doubling."""

    def __init__(self, raw: np.ndarray) -> None:
        self.n = len(raw) - THRESHOLD + 1
        self.by = {1: raw.astype(np.uint64)}
        k = 1
        while k < 32:
            self.by[2 * k] = _pair(self.by[k][:-k], self.by[k][k:])
            k *= 2

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """For each 50-byte string the least rank of the 24-byte strings in it, as runs: starts and ranks."""
        grams = _pair(self.by[16][:-8], self.by[8][16:])
        k = 1
        while 2 * k <= WINDOW:
            grams, k = np.minimum(grams[:-k], grams[k:]), 2 * k
        if k < WINDOW:
            grams = np.minimum(grams[: len(grams) - (WINDOW - k)], grams[WINDOW - k :])
        starts = np.concatenate([[0], np.flatnonzero(grams[1:] != grams[:-1]) + 1])
        return starts, grams[starts]

    def whole(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names of the 50-byte strings at ``at``: their rank, and one to choose its range."""
        first, rest = self.by[32][at], _pair(self.by[16][at + 32], self.by[2][at + 48])
        return _pair(first, rest), _pair(rest, first, _C, _D)


def _fold(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers below ``n`` from the high bits of 64-bit names."""
    return ((x >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _grams_range(x: np.ndarray, n: int) -> np.ndarray:
    """The range of a 24-byte rank; least ranks crowd at the low end, so they are mixed once more."""
    return _fold((x ^ (x >> _U(31))) * _C, n)


def _pieces(rows: Iterator[tuple], most: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """``doc_id, offset, digest of the text, digest of the piece, bytes``; the offset is -1 for a whole text."""
    for doc_id, text in rows:
        raw = (text or "").encode("utf-8", "surrogatepass")
        digest = hashlib.sha256(raw).digest()[:16]
        if len(raw) <= most:
            yield doc_id, -1, digest, digest, raw
            continue
        for at in range(0, len(raw) - THRESHOLD + 1, most):
            yield doc_id, at, digest, hashlib.sha256(digest + at.to_bytes(8, "big")).digest()[:16], raw[at : at + most + THRESHOLD - 1]


def _pack(rows: Iterator[tuple], block_bytes: int, piece_bytes: int) -> Iterator[tuple]:
    """Blocks of whole texts and of pieces of long ones, in the order of their ids."""
    held, size = [], 0

    def block() -> tuple:
        held.sort(key=lambda r: (r[0], r[1], r[2]))
        ids = np.array([r[0] for r in held], np.int64).tobytes()
        offsets = np.array([r[1] for r in held], np.int64).tobytes()
        texts, digests = b"".join(r[2] for r in held), b"".join(r[3] for r in held)
        lens = np.array([len(r[4]) for r in held], np.int64).tobytes()
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(r[4] for r in held))
        return xxhash.xxh64_intdigest(ids + offsets + digests) - (1 << 63), size, ids, offsets, lens, texts, digests, data

    for piece in _pieces(rows, piece_bytes):
        held.append(piece)
        size += len(piece[4])
        if size >= block_bytes:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def _send(block: int, where: np.ndarray, names: np.ndarray, width: int, ids: np.ndarray | None) -> Iterator[tuple]:
    """A packet for each range: the low ``width`` bytes of its names, in order, and the ids of their documents.

    Ids come as the different ones and a number into them for each name.
    """
    if not len(where):
        return
    order = np.argsort(where, kind="stable")
    ranges, starts = np.unique(where[order], return_index=True)
    for r, part in zip(ranges.tolist(), np.split(order, starts[1:]), strict=True):
        packed = names[part].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        if ids is None:
            yield int(r), block, len(part), packed, None, None
        else:
            own, place = np.unique(ids[part], return_inverse=True)
            yield int(r), block, len(part), packed, own.tobytes(), place.astype(np.min_scalar_type(max(1, len(own) - 1))).tobytes()


_PACKETS = "part long, block long, n int, names binary, ids binary, place binary"


def _names(packed: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(np.uint64).ravel()


def _judge(packets: DataFrame, width: int, by_id: bool) -> DataFrame:
    """``block, answers``: for each packet of a block whether its ranks stand elsewhere too.

    With ``by_id`` only elsewhere in a document with a smaller id counts. A task sorts the
    ranks of one range.
    """

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        names, sizes = _names(frame["names"].tolist(), width), frame["n"].to_numpy()
        order = np.argsort(names, kind="stable")
        ranked = names[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        counts = np.diff(np.append(starts, len(ranked)))
        if by_id:
            ids = []
            for n, own, place in zip(sizes.tolist(), frame["ids"], frame["place"], strict=True):
                known = np.frombuffer(own, np.int64)
                ids.append(known[np.frombuffer(place, np.dtype(f"u{len(place) // n}"))])
            owner = np.concatenate(ids)
            yes = owner[order] > np.repeat(np.minimum.reduceat(owner[order], starts), counts)
        else:
            yes = np.repeat(counts > 1, counts)
        bits = np.empty(len(names), bool)
        bits[order] = yes
        ends = np.cumsum(sizes)
        return pd.DataFrame({"block": frame["block"], "part": frame["part"], "bits": [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]})

    answers = packets.groupBy("part").applyInPandas(sort, "block long, part long, bits binary")
    return durable(answers.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("answers")))


def _heard(where: np.ndarray, answers: list) -> np.ndarray:
    """The answers in the order of the ranks that ``_send`` was given."""
    out = np.zeros(len(where), bool)
    if not len(where):
        return out
    order = np.argsort(where, kind="stable")
    bits = {a["part"]: a["bits"] for a in answers}
    ranges, counts = np.unique(where, return_counts=True)
    out[order] = np.concatenate([np.unpackbits(np.frombuffer(bits[r], np.uint8), count=int(n)) for r, n in zip(ranges.tolist(), counts.tolist(), strict=True)]).astype(bool)
    return out


class _Block:
    """A block's documents and what the rounds so far said about them."""

    def __init__(self, ids: bytes, lens: bytes, digests: bytes, parts: tuple[int, int, int]) -> None:
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.digests, self.parts = np.frombuffer(digests, np.uint64).reshape(-1, 2), parts

    def copies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Round on whole documents: ranges, ranks and ids to send, and what the block itself knows."""
        name = self.digests[:, 0]
        first = _first(name)
        sent = np.flatnonzero(first == np.arange(len(name)))
        return _fold(self.digests[sent, 1], self.parts[0]), sent, first, self.ids[first] < self.ids

    def copied(self, answers: list) -> np.ndarray:
        where, sent, first, known = self.copies()
        elsewhere = np.zeros(len(self.ids), bool)
        elsewhere[sent] = _heard(where, answers)
        return known | elsewhere[first]

    def documents(self, data: bytes, copied: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Place and bytes of the documents that still matter."""
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if self.lens.sum() else np.zeros(0, np.uint8)
        ends = np.cumsum(self.lens)
        for k in np.flatnonzero(~copied & (self.lens >= THRESHOLD)).tolist():
            yield k, raw[ends[k] - self.lens[k] : ends[k]]

    def grams(self, data: bytes, copied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least ranks of the block, sorted, and which of them two of its documents have."""
        each = [np.unique(Ranks(raw).least()[1]) for _, raw in self.documents(data, copied)]
        if not each:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        names, counts = np.unique(np.concatenate(each), return_counts=True)
        return names, counts > 1

    def shared(self, data: bytes, copied: np.ndarray, answers: list) -> np.ndarray:
        names, known = self.grams(data, copied)
        return names[known | _heard(_grams_range(names, self.parts[1]), answers)]

    def strings(self, data: bytes, copied: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document place, position, rank and range name of the strings that may stand elsewhere."""
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for k, raw in self.documents(data, copied) if len(shared) else ():
            ranks = Ranks(raw)
            starts, least = ranks.least()
            hit = shared[np.minimum(np.searchsorted(shared, least), len(shared) - 1)] == least
            at = np.flatnonzero(np.repeat(hit, np.diff(np.append(starts, ranks.n))))
            if len(at):
                found.append((np.full(len(at), k, np.int32), at.astype(np.int32), *ranks.whole(at)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))  # type: ignore[return-value]


def _first(names: np.ndarray) -> np.ndarray:
    """For each place the first place with the same name (documents come by id, so the smallest id)."""
    _, first, inverse = np.unique(names, return_index=True, return_inverse=True)
    return first[inverse]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for each row of ``docs``.

    Removed is each byte covered by a 50-byte string that also starts in a document with
    a smaller id; ``spans`` lists the maximal removed runs as ``start, stop``. A null
    text is empty and loses nothing, as does a text of under 50 bytes and a row without
    an id, which takes no part. Repeated rows (equal ids) don't count against each other.
    An empty table gives no rows; other columns are not read. Two different strings are
    taken for equal only if their ranks meet in 56 bits within a range of about a
    million, and two texts only if 128 bits of SHA-256 do. A long text is worked on in
    pieces, so that a task's memory depends on its own text as Spark holds it and not on
    a multiple of it.
    """
    spark = docs.sparkSession
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = f"quill_blocks_{uuid.uuid4().hex}"
    packed = map_rows(named, lambda rows: _pack(rows, block_bytes, piece_bytes), "block long, size long, ids binary, offsets binary, lens binary, texts binary, digests binary, data binary")
    packed.write.bucketBy(slots, "block").saveAsTable(table)
    blocks = spark.table(table)
    total, count = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0))).first()
    parts = tuple(max(slots, -(-int(n) // RANGE_RANKS)) for n in (count, total * 0.07, total * 0.2))
    try:
        result = durable(_rounds(blocks, parts))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    whole = result.where(F.col("n_bytes").isNotNull()).drop("text")
    if not result.where(F.col("n_bytes").isNull()).isEmpty():
        whole = whole.union(_joined_pieces(named, result.where(F.col("n_bytes").isNull()), piece_bytes))
    text = F.coalesce(F.col(text_col), F.lit(""))
    unnamed = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(text, 256).alias("kept_sha256"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
    )
    return whole.union(unnamed)


def _joined_pieces(named: DataFrame, pieces: DataFrame, piece_bytes: int) -> DataFrame:
    """The rows of long texts from the removed runs of their pieces; ``pieces`` has a row for each."""
    spans = pieces.groupBy(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).agg(F.flatten(F.collect_list("spans")).alias("found"))
    long = named.where(F.octet_length("text") > piece_bytes)
    joined = long.join(spans, (F.col("doc_id") == F.col("__id")) & (F.substring(F.sha2("text", 256), 1, 32) == F.col("__text")))

    def finish(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, found in rows:
            merged: list[tuple[int, int]] = []
            for start, stop in sorted((x["start"], x["stop"]) for x in found):
                if merged and start <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
                else:
                    merged.append((start, stop))
            yield _finished(doc_id, text.encode("utf-8", "surrogatepass"), merged)

    return map_rows(joined.select("doc_id", "text", "found"), finish, _RESULT)


def _finished(doc_id: int, raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    kept, last = hashlib.sha256(), 0
    for start, stop in spans:
        kept.update(memoryview(raw)[last:start])
        last = stop
    kept.update(memoryview(raw)[last:])
    return doc_id, len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "stop": e} for s, e in spans]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"


def _rounds(blocks: DataFrame, parts: tuple[int, int, int]) -> DataFrame:
    def copies(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block, ids, lens, digests in rows:
            own = _Block(ids, lens, digests, parts)
            where, sent, *_ = own.copies()
            yield from _send(block, where, own.digests[sent, 0].copy(), 8, own.ids[sent])

    first = _judge(map_rows(blocks.select("block", "ids", "lens", "digests"), copies, _PACKETS), 8, by_id=True)
    known = blocks.join(first.withColumnRenamed("answers", "r0"), "block")

    def grams(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block, ids, lens, digests, data, r0 in rows:
            own = _Block(ids, lens, digests, parts)
            names, _ = own.grams(data, own.copied(r0))
            yield from _send(block, _grams_range(names, parts[1]), _low(names), 4, None)

    second = _judge(map_rows(known.select("block", "ids", "lens", "digests", "data", "r0"), grams, _PACKETS), 4, by_id=False)
    known = known.join(second.withColumnRenamed("answers", "r1"), "block", "left")

    def strings(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block, ids, lens, digests, data, r0, r1 in rows:
            own = _Block(ids, lens, digests, parts)
            copied = own.copied(r0)
            doc, _, name, choice = own.strings(data, copied, own.shared(data, copied, r1 or []))
            sent = np.flatnonzero(_first(name) == np.arange(len(name)))
            yield from _send(block, _fold(choice[sent], parts[2]), name[sent], 7, own.ids[doc[sent]])

    third = _judge(map_rows(known.select("block", "ids", "lens", "digests", "data", "r0", "r1"), strings, _PACKETS), 7, by_id=True)
    known = known.join(third.withColumnRenamed("answers", "r2"), "block", "left")

    def remove(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, ids, offsets, lens, texts, digests, data, r0, r1, r2 in rows:
            own = _Block(ids, lens, digests, parts)
            copied = own.copied(r0)
            doc, at, name, choice = own.strings(data, copied, own.shared(data, copied, r1 or []))
            first = _first(name)
            sent = np.flatnonzero(first == np.arange(len(name)))
            elsewhere = np.zeros(len(name), bool)
            elsewhere[sent] = _heard(_fold(choice[sent], parts[2]), r2 or [])
            gone = (own.ids[doc[first]] < own.ids[doc]) | elsewhere[first]
            yield from _results(own, np.frombuffer(offsets, np.int64), texts, data, copied, doc[gone], at[gone])

    return map_rows(known.select("block", "ids", "offsets", "lens", "texts", "digests", "data", "r0", "r1", "r2"), remove, f"{_RESULT}, text string")


def _low(names: np.ndarray) -> np.ndarray:
    """Names of 24-byte ranks with the bits to send at the low end."""
    return (names * _D) >> _U(32)


def _results(own: _Block, offsets: np.ndarray, texts: bytes, data: bytes, copied: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """A finished row for each whole text; for a piece its removed runs, and which text it is a piece of."""
    raw = zstandard.ZstdDecompressor().decompress(data) if own.lens.sum() else b""
    ends = np.cumsum(own.lens)
    starts = np.searchsorted(doc, np.arange(len(own.ids) + 1))
    for k, (doc_id, n, end, offset) in enumerate(zip(own.ids.tolist(), own.lens.tolist(), ends.tolist(), offsets.tolist(), strict=True)):
        if copied[k] and n >= THRESHOLD:
            spans = [(0, n)]
        else:
            places = at[starts[k] : starts[k + 1]].astype(np.int64)
            new = np.flatnonzero(np.diff(places) > THRESHOLD) + 1
            spans = [(int(p[0]), int(p[-1]) + THRESHOLD) for p in np.split(places, new)] if len(places) else []
        if offset < 0:
            yield *_finished(doc_id, raw[end - n : end], spans), None
        else:
            yield doc_id, None, None, None, None, [{"start": s + offset, "stop": e + offset} for s, e in spans], texts[16 * k : 16 * k + 16].hex()
