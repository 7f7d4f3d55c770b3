"""Readers of course material by file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What reads which extension.
READERS = {
    "text": ("txt", "md", "csv", "tsv", "json", "yaml", "srt", "vtt"),
    "markup": ("html", "htm", "xml"),
    "ooxml": ("docx", "pptx"),
    "pdf": ("pdf",),
}


def reader_for(name: Column) -> Column:
    """The kind of reader for a file name; ``unsupported`` for any other extension."""
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("unsupported")
    for kind, extensions in READERS.items():
        out = F.when(extension.isin(*extensions), F.lit(kind)).otherwise(out)
    return out
