"""Secret scans over an incremental ledger of content-addressed blobs.

Every text is addressed by its SHA-256. The ledger holds one row for each pair of blob
and rule version that was ever scanned, with its findings; a run scans only the pairs
that the ledger lacks, once each however many paths or versions hold the blob, and then
joins findings back to every path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import join_counted, map_rows, schema_of, text_or_empty
from quillspark.session import durable

@dataclass(frozen=True)
class RuleSet:
    """Rules with a name that must change with any of them.

    A rule is a kind, a pattern, the group that is measured and its least length. A text
    without any of the marks that ``needs`` lists for a kind has no match of it, whatever
    its letters' case.
    """

    version: str
    rules: tuple[tuple[str, re.Pattern, int, int], ...]
    needs: dict[str, tuple[str, ...]]


BASE = RuleSet(
    "base-1",
    (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
    ),
    {"assign": (":", "="), "access": ("AKIA",)},
)
#: What the scanner adds, listed after the base kinds.
EXTRA = RuleSet(
    "extra-2",
    (
        ("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), 0, 1),
        ("forge_token", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,})"), 0, 1),
        ("chat_token", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
        ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    ),
    {"private_key": ("PRIVATE KEY",), "forge_token": ("gh", "github_pat_", "glpat-"), "chat_token": ("xox",), "jwt": ("eyJ",)},
)
RULE_SETS = (BASE, EXTRA)
ORDER = {kind: k for k, (kind, *_) in enumerate(rule for rules in RULE_SETS for rule in rules.rules)}
BASE_KINDS = tuple(kind for kind, *_ in BASE.rules)
_SPANS = "array<struct<start:long,place:int,stop:long,kind:string>>"
LEDGER_DDL = f"blob string, rule_version string, spans {_SPANS}"


def find_spans(text: str, rule_sets: Sequence[RuleSet] = RULE_SETS) -> list[tuple[str, int, int]]:
    """All spans ``kind, start, stop`` in code points, by start and then by kind as listed.

    Within a kind matches are the leftmost that do not overlap; one that is too short is
    dropped after it was matched, so it still takes its place.
    """
    found = []
    for own in rule_sets:
        for kind, pattern, group, least in own.rules:
            if kind in own.needs and not any(x in text for x in own.needs[kind]):
                continue
            found += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[1], ORDER.get(x[0], len(ORDER)), x[0]))


def scan_blobs(blobs: DataFrame, rule_sets: Sequence[RuleSet]) -> DataFrame:
    """Ledger rows for ``blob, missing, text`` rows, one for each rule version that ``missing`` lists."""
    by_version = {x.version: x for x in rule_sets}

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for blob, missing, text in rows:
            for version in missing:
                spans = find_spans(text, (by_version[version],))
                yield blob, version, [{"start": s, "place": ORDER.get(k, len(ORDER)), "stop": e, "kind": k} for k, s, e in spans]

    return map_rows(blobs.select("blob", "missing", "text"), run, LEDGER_DDL)


class Ledger:
    """Which pairs of blob and rule version were ever scanned, with their findings: Parquet files in a shared folder.

    A run appends its rows as a whole once its job has ended; rows of a run that was
    lost half-way are not there, or there as whole rows, and are not scanned again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        """``blob, rule_version, spans``; a pair that two runs wrote at once has two equal rows."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], LEDGER_DDL)
        return self.spark.read.schema(schema_of(LEDGER_DDL)).parquet(self.path)

    def extend(self, versions: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",), rule_sets: Sequence[RuleSet] = RULE_SETS) -> None:
        """Scans what the ledger lacks of the texts of ``versions``, each blob once however many rows hold it."""
        text = text_or_empty(text_col)
        name = F.xxhash64(*id_cols)
        paths = versions.select(name.alias("path"), F.sha2(text, 256).alias("blob"))
        # One path stands for each blob. Only names and digests are grouped; texts move once, by path.
        asked = paths.groupBy("blob").agg(F.min("path").alias("first"))
        done = self.entries().groupBy("blob").agg(F.collect_set("rule_version").alias("done"))
        wanted = F.array(*(F.lit(x.version) for x in rule_sets))
        missing = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        picks = asked.join(done, "blob", "left").select(F.col("blob").alias("picked"), "first", missing.alias("missing")).where(F.size("missing") > 0)
        texts = versions.select(name.alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))
        chosen = texts.join(picks.hint("shuffle_hash"), (F.col("path") == F.col("first")) & (F.col("blob") == F.col("picked")))
        fresh = scan_blobs(chosen, rule_sets).dropDuplicates(["blob", "rule_version"])
        fresh.write.mode("append").parquet(self.path)

    def findings(self, versions: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",), rule_sets: Sequence[RuleSet] = RULE_SETS) -> DataFrame:
        """One row ``id_cols, blob, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``versions``.

        Only blobs that the ledger has under every rule version asked for have findings.
        """
        paths = durable(versions.select(*id_cols, F.sha2(text_or_empty(text_col), 256).alias("blob")))
        counts = paths.groupBy("blob").agg(F.count("*").alias("n"))
        asked = [x.version for x in rule_sets]
        own = self.entries().where(F.col("rule_version").isin(asked)).dropDuplicates(["blob", "rule_version"])
        known = own.groupBy("blob").agg(F.count("*").alias("sets"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).where(F.col("sets") == len(asked)).drop("sets")
        known = durable(known.join(counts, "blob"))
        joined = join_counted(paths, known, "blob", F.size("spans") * 48 + 128)
        base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
        numbers = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
        return joined.select(*id_cols, "blob", *numbers, F.sha2(join_spans(base), 256).alias("base_sha256"), "spans")


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def join_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def scan(docs: DataFrame, ledger: Ledger, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",), rule_sets: Sequence[RuleSet] = RULE_SETS) -> DataFrame:
    """Extends ``ledger`` by what it lacks and gives the findings of every row of ``docs``.

    ``docs`` may hold any number of historical versions of a path, one row each. A null
    text is the empty blob, a null id is a path like any other, repeated rows share a
    blob, texts of any length are scanned whole, an empty table gives no rows, and other
    columns are not read.
    """
    ledger.extend(docs, text_col, id_cols, rule_sets)
    return ledger.findings(docs, text_col, id_cols, rule_sets)
