"""Readers of files that hold text or sound in other formats than Spark's own."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.arrow import arrow_function
from quillspark.functions.text import is_readable, markup_to_text, normalise_material
from quillspark.sources.materials import reader_for

_STREAM = re.compile(rb"stream\r?\n(.*?)endstream", re.S)
_STRING = re.compile(r"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>", re.S)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "(": "(", ")": ")", "\\": "\\"}


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: each file whole, as it is."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _pdf_string(raw: str) -> str:
    if raw[0] == "<":
        return bytes.fromhex(re.sub(r"\s", "", raw[1:-1]).ljust(2, "0")[: len(re.sub(r"\s", "", raw[1:-1])) // 2 * 2]).decode("latin-1")

    def one(m: re.Match) -> str:
        return chr(int(m[1], 8) & 255) if m[1].isdigit() else _ESCAPES.get(m[1], "" if m[1] == "\n" else m[1])

    return re.sub(r"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.S)


def pdf_text(data: bytes) -> str:
    """The strings that a PDF's text operators show, its deflated streams included."""
    parts = [data]
    for found in _STREAM.finditer(data):
        try:
            parts.append(zlib.decompressobj().decompress(found[1]))
        except zlib.error:
            continue  # another filter; the outer bytes are looked at anyway
    out = []
    for part in parts:
        for shown in re.findall(r"\bBT\b(.*?)\bET\b", part.decode("latin-1"), re.S):
            lines = ["".join(_pdf_string(s) for s in _STRING.findall(op)) for op in re.split(r"(?:T\*|\bTd\b|\bTD\b|')", shown)]
            out.append("\n".join(x for x in (line.strip() for line in lines) if x))
    return "\n\n".join(x for x in out if x)


def ooxml_markup(data: bytes) -> str:
    """The body of a document, or the slides of a presentation in numeric order under headings."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        if "word/document.xml" in names:
            return archive.read("word/document.xml").decode("utf-8", "replace")
        slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return "</p></p>".join(f"## Slide {k}</p>" + archive.read(n).decode("utf-8", "replace") for k, n in slides)


@arrow_function("string")
def pdf_to_text(content: pd.Series) -> pd.Series:
    return content.map(lambda b: pdf_text(bytes(b)), na_action="ignore")


@arrow_function("string")
def ooxml_to_markup(content: pd.Series) -> pd.Series:
    def one(data: bytes) -> str | None:
        try:
            return ooxml_markup(bytes(data))
        except (zipfile.BadZipFile, KeyError):
            return None

    return content.map(one, na_action="ignore")


def extract_materials(files: DataFrame) -> DataFrame:
    """``path, reader, text, characters, truncated, readable`` of ``path, content`` files."""
    kind = reader_for(F.col("path"))
    plain = F.decode(F.col("content"), "UTF-8")
    raw = (
        F.when(kind == "text", plain).when(kind == "markup", markup_to_text(plain)).when(kind == "pdf", pdf_to_text(F.when(kind == "pdf", F.col("content"))))
        .when(kind == "ooxml", markup_to_text(ooxml_to_markup(F.when(kind == "ooxml", F.col("content")))))
    )
    rows = files.select("path", kind.alias("reader"), normalise_material(raw).alias("m"))
    return rows.select("path", "reader", "m.*", is_readable(F.col("m.text")).alias("readable"))


def read_wav_header(data: bytes) -> dict:
    """Rate, channels, sample bits and size of the sound in a WAV file; ``valid`` for mono 16-bit PCM."""
    out = {"valid": False, "sample_rate": 0, "channels": 0, "bits": 0, "data_bytes": 0, "data_start": 0, "seconds": 0.0}
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return out
    at, form = 12, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            form, out["channels"], out["sample_rate"], _, _, out["bits"] = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            out["data_bytes"], out["data_start"] = min(size, len(data) - at - 8), at + 8
        at += 8 + size + size % 2
    out["valid"] = (form, out["channels"], out["bits"]) == (1, 1, 16) and out["data_start"] > 0
    rate = out["sample_rate"] * out["channels"] * out["bits"] // 8
    out["seconds"] = out["data_bytes"] / rate if out["valid"] and rate else 0.0
    return out


WAV_DDL = "valid boolean, sample_rate long, channels int, bits int, data_bytes long, data_start long, seconds double"


@arrow_function(WAV_DDL)
def wav_header(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_wav_header(bytes(b) if b is not None else b"") for b in content])


def wav_file(samples: bytes, rate: int) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(samples)) + samples


def encode_samples(samples: list[float]) -> bytes:
    """Samples in -1..1 as 16-bit PCM; negative ones reach one step further."""
    clipped = (max(-1.0, min(1.0, s)) for s in samples)
    return struct.pack(f"<{len(samples)}h", *(int(s * (0x8000 if s < 0 else 0x7FFF)) for s in clipped))


def combine_wavs(chunks: DataFrame) -> DataFrame:
    """``recording, content``: a recording's chunks in order under one header; equal rates only."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [bytes(b) for b in frame.sort_values("sequence")["content"]]
        heads = [read_wav_header(p) for p in parts]
        if not all(h["valid"] for h in heads) or len({h["sample_rate"] for h in heads}) > 1:
            raise ValueError("chunks of a recording must be mono 16-bit PCM of one rate")
        sound = b"".join(p[h["data_start"] : h["data_start"] + h["data_bytes"]] for p, h in zip(parts, heads, strict=True))
        return pd.DataFrame({"recording": [frame["recording"].iloc[0]], "content": [wav_file(sound, heads[0]["sample_rate"])]})

    return chunks.groupBy("recording").applyInPandas(join, "recording string, content binary")


RESULT_DDL = (
    "text string, segments array<struct<start:double,end:double,offsets:struct<from:double,to:double>,text:string,tokens:array<struct<text:string>>>>, "
    "transcription array<struct<start:double,end:double,offsets:struct<from:double,to:double>,text:string,tokens:array<struct<text:string>>>>"
)


def recognised_segments(results: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, idx, start, end, text`` of recogniser output: offsets in seconds or milliseconds, text or tokens, blanks dropped."""
    parsed = results.select(id_col, F.from_json(json_col, RESULT_DDL).alias("r"))
    each = parsed.select(id_col, F.posexplode(F.coalesce("r.segments", "r.transcription")).alias("idx", "s"))
    tokens = F.array_join(F.transform("s.tokens", lambda t: F.coalesce(t["text"], F.lit(""))), "")
    text = F.trim(F.coalesce("s.text", tokens, F.lit("")))
    start, end = F.coalesce(F.col("s.start"), F.col("s.offsets.from") / 1000), F.coalesce(F.col("s.end"), F.col("s.offsets.to") / 1000)
    return each.select(id_col, "idx", start.alias("start"), end.alias("end"), text.alias("text")).where("text <> ''")


def verified_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, status``: whether each file of a ``path, sha256`` manifest is there, once, and unchanged."""
    have = files.select("path", F.sha2("content", 256).alias("found"))
    counted = manifest.groupBy("path").agg(F.first("sha256").alias("sha256"), F.count("*").alias("n"))
    status = F.when(F.col("n") > 1, "repeated").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").otherwise("verified")
    return counted.join(have, "path", "left").select("path", status.alias("status"))


def code_identity(files: DataFrame) -> DataFrame:
    """One fingerprint of a folder: its names and contents in the order of names."""
    each = files.select("path", F.sha2("content", 256).alias("h"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: F.concat_ws(":", x["path"], x["h"]))
    return each.agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("identity"))


def write_once(df: DataFrame, path: str) -> None:
    """Writes a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def unexpected_outputs(found: DataFrame, permitted: DataFrame) -> DataFrame:
    return found.join(permitted, "path", "left_anti")


def file_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def chunk_bytes(data: bytes, size: int) -> Iterator[bytes]:
    for at in range(0, len(data), size):
        yield data[at : at + size]
