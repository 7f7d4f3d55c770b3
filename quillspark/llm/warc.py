"""WARC archives: a writer and a sequential reader with one gzip member per record.

Archives are ordinary ``.warc.gz`` files in a folder that all executors share. The
writer gives each record its own gzip member; the reader streams a file in pieces,
inflates member by member with incremental zlib, frames each record by its
Content-Length and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_BYTES, join_counted, map_rows, text_or_empty
from quillspark.session import checkpoint_dir, durable

#: Payloads from this size on are stored once; equal ones revisit that record.
REVISIT_BYTES = 1000
#: A writer begins another archive after so many stored bytes.
ARCHIVE_BYTES = 256 << 20
#: Bytes of a digest that several pages have, with the id it stands for, about.
SHARED_ROW_BYTES = 96
PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and payload of an HTTP response block."""
        head, gap, payload = self.block.partition(b"\r\n\r\n")
        if not gap:
            raise WarcError("no end of the HTTP headers")
        return _fields(head.split(b"\r\n")[1:]), payload


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise WarcError(f"no header: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _uri(url: str | None, page_id: int | None) -> str:
    """A URL that fits a header line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as one gzip member; with ``refers_to`` a revisit, without the payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Members:
    """Bytes of one gzip member after another, inflated a piece at a time."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.rest, self.inflater, self.held, self.over = file, b"", None, bytearray(), True

    def begin(self) -> bool:
        """Moves to the next member; False at the end of the file."""
        if not self.rest:
            self.rest = self.file.read(PIECE)
        if not self.rest:
            return False
        self.inflater, self.held, self.over = zlib.decompressobj(31), bytearray(), False
        return True

    def _more(self) -> bool:
        if self.over:
            return False
        piece = self.rest or self.file.read(PIECE)
        if not piece:
            raise WarcError("the file ends inside a gzip member")
        self.held += self.inflater.decompress(piece, PIECE)
        self.rest = self.inflater.unconsumed_tail
        if self.inflater.eof:
            self.over, self.rest = True, self.inflater.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                raise WarcError(f"no {mark!r} before the end of a member")
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise WarcError(f"{len(self.held)} bytes where {n} are promised")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def end(self) -> bytes:
        while self._more():
            pass
        return bytes(self.held)


def read_records(file: BinaryIO) -> Iterator[Record]:
    """The records of an archive in order; any fault raises ``WarcError``."""
    members = Members(file)
    while members.begin():
        lines = members.until(b"\r\n\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/1."):
            raise WarcError(f"not a record: {lines[0][:60]!r}")
        headers = _fields(lines[1:])
        block = members.exactly(int(headers["content-length"]))
        if members.end() != b"\r\n\r\n":
            raise WarcError("the record's end is not where its Content-Length puts it")
        record = Record(headers, block)
        if headers.get("warc-block-digest", _digest(block)) != _digest(block):
            raise WarcError("a block fails its digest")
        if record.kind == "response" and "warc-payload-digest" in headers and _digest(record.http()[1]) != headers["warc-payload-digest"]:
            raise WarcError("a payload fails its digest")
        yield record


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to`` for each page: what to store and what to revisit.

    Of equal payloads of at least ``REVISIT_BYTES`` the one with the largest page_id is
    stored. Payloads stay where they are read: digests and ids alone are grouped, and what
    is joined back is a row for each digest that several pages have, sent to every task if
    these are counted to be few. Where they are many, a row for each revisit is joined by
    page id and digest, so that a payload that is everywhere doesn't meet in one task. Rows
    that repeat the largest id itself are stored as well.
    """
    html = text_or_empty("html")
    payload = F.encode(html, "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    slim = durable(pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= REVISIT_BYTES).drop("bytes"))
    shared = durable(slim.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"))
    if shared.count() * SHARED_ROW_BYTES <= BROADCAST_BYTES:
        marked = rows.join(F.broadcast(shared.drop("n")), "sha", "left")
    else:
        revisits = join_counted(slim, shared, "sha").where(F.col("page_id") != F.col("last")).distinct()
        marked = rows.join(revisits, ["page_id", "sha"], "left")
    return marked.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("last"), F.col("last")).alias("refers_to"))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder by its URI; Spark's names of object stores are understood too."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``plan_records`` rows as archives in ``folder``; one row ``path, records, bytes`` each.

    A file's name holds a token of the attempt that wrote it, and only rows of attempts
    that succeed come back: a task that is run again leaves an orphan, never half a file
    that a reader would be given. The result must be kept by the caller (it is computed
    again, with other files, by each action).
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        file, path, count, size = None, "", 0, 0
        for page_id, url, payload, refers_to in rows:
            if file is None:
                path, count, size = f"{base}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                file = store.open_output_stream(path, compression=None)
            data = encode_record(page_id, url, bytes(payload), refers_to)
            file.write(data)
            count, size = count + 1, size + len(data)
            if size >= ARCHIVE_BYTES:
                file.close()
                file = None
                yield path, count, size
        if file is not None:
            file.close()
            yield path, count, size

    return map_rows(records.select("page_id", "url", "payload", "refers_to"), run, "path string, records long, bytes long")


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the archives at ``path``, read in sequence and verified."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        store, _ = _store(folder)
        for (path,) in rows:
            with store.open_input_stream(path, compression=None) as file:
                for record in read_records(file):
                    http, payload = record.http()
                    digest = base64.b32decode(record.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    refers = record.headers.get("warc-refers-to")
                    size = len(payload) if record.kind == "response" else int(http["content-length"])
                    yield _page(record.headers["warc-record-id"]), record.headers["warc-target-uri"], size, digest, record.kind, _page(refers) if refers else None, payload if record.kind == "response" else None

    return map_rows(paths.select("path"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return None if number == "None" else int(number)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for every page, then reads the archives back.

    A null html is an empty payload, a null url is written as a URN of the page, a null
    page_id is kept, repeated rows give repeated records, an empty table gives none, and
    other columns are not read. A record is held as a whole while it is written or
    verified, as Spark holds a row.
    """
    shared = checkpoint_dir(spark) if folder is None else folder
    target = f"{shared if '://' in shared or shared.startswith('file:') else 'file://' + shared}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(plan_records(pages), target).checkpoint()
    return read_archives(manifest.repartition(max(1, min(manifest.count(), 100_000)), "path"), target)
