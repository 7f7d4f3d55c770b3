"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are gathered by Arrow batches, a model is fitted on a bounded
sample of labelled rows, and its trees are flattened into arrays that numpy walks for a
batch of rows at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows, row_key, without
from quillspark.session import durable

#: Most labelled rows that a fit may gather on the driver (about 200 bytes each).
SAMPLE_ROWS = 20_000
#: Share of rows, by their id's checksum, that never train.
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2
ACCEPT = 0.7

FEATURES = (
    "log_words", "mean_word", "sd_word", "share_long", "share_short", "distinct", "log_repeat", "adjacent_equal", "share_letters", "share_upper",
    "share_digits", "share_space", "share_mark", "share_symbol", "share_bar", "share_bang", "share_wide", "upper_words", "bare_words", "stop_end",
    "log_lines", "mean_line", "distinct_lines", "share_comma", "worst_symbol", "worst_equal", "worst_upper", "top_word",
)

_CLASS = np.zeros(256, np.int64)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b" \t\n\r\x0b\x0c")] = 4
_CLASS[list(b".;:?'\"()-")] = 5
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{}~")] = 6
_CLASS[ord("|")] = 7
_CLASS[ord("!")] = 8
_CLASS[ord(",")] = 9
_CLASS[128:] = 10
#: Words in a stretch for which the worst share is taken, so that a part of junk shows in a long text.
STRETCH = 64


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11) if raw else np.zeros(11, np.int64)
    share = counts / max(1, len(raw))
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    equal = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, max(0, n - 1)) if n > 1 else np.zeros(1, bool)
    upper = np.fromiter((w.isupper() and len(w) > 1 for w in words), bool, n) if n else np.zeros(1, bool)
    symbol = np.fromiter((w[-1] in b"#$%&*|!" for w in words), bool, n) if n else np.zeros(1, bool)
    bare = sum(w.isalpha() for w in words)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = raw.split(b"\n")
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), float((lengths > 12).mean()), float((lengths < 3).mean()), len(tally) / max(1, n),
        float(np.log1p(max(tally.values(), default=0))), float(equal.mean()), float(share[1] + share[2]), float(share[2]), float(share[3]), float(share[4]), float(share[5]),
        float(share[6]), float(share[7]), float(share[8]), float(share[10]), float(upper.mean()), bare / max(1, n), sum(w.endswith(b".") for w in words) / max(1, n),
        float(np.log1p(len(lines))), len(raw) / len(lines), len(set(lines)) / len(lines), float(share[9]), _worst(symbol), _worst(equal), _worst(upper),
        max(tally.values(), default=0) / max(1, n),
    ]


def _worst(marks: np.ndarray) -> float:
    """The largest share of marks in any stretch; the last one ends with the text."""
    if len(marks) <= STRETCH:
        return float(marks.mean())
    whole = marks[: len(marks) // STRETCH * STRETCH].reshape(-1, STRETCH).mean(1)
    return float(max(whole.max(), marks[-STRETCH:].mean()))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``doc_id, x`` (an array of ``FEATURES``) for each row of ``docs``."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            yield key, statistics(text)

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, x array<float>")


@dataclass
class Forest:
    """Flattened trees. Node k of a tree sends a row left if its feature is at most the cut."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    right: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    depth: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in zip(self.feature, self.cut, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):  # a leaf leads to itself
                at = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
            total += value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, leaf_rows: int = 5, penalty: float = 1.0) -> Forest:
    """Boosted trees of the logistic loss on quantile histograms.

    Without rows, or with one label alone, the forest has no trees and gives the
    smoothed share of label 1 (0.5 without rows).
    """
    y = y.astype(np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    forest = Forest(base=float(np.log(share / (1 - share))), depth=depth)
    if len(y) == 0 or y.min() == y.max():
        return forest
    x = x.astype(np.float64)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        raw += _grow(forest, binned, edges, p - y, np.maximum(p * (1 - p), 1e-9), depth, rate, bins, leaf_rows, penalty)
    return forest


def _grow(forest: Forest, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, bins: int, leaf_rows: int, penalty: float) -> np.ndarray:
    feature, cut, left, right, value = [0], [0.0], [0], [0], [0.0]
    step = np.zeros(len(g))
    level = [(0, np.arange(len(g)))]
    for d in range(depth + 1):
        following = []
        for node, rows in level:
            value[node] = float(-rate * g[rows].sum() / (h[rows].sum() + penalty))
            best = _best_split(binned[rows], g[rows], h[rows], bins, leaf_rows, penalty) if d < depth and len(rows) >= 2 * leaf_rows else None
            if best is None:
                left[node] = right[node] = node
                step[rows] = value[node]
                continue
            j, b = best
            feature[node], cut[node], left[node], right[node] = j, float(edges[j][b]), len(feature), len(feature) + 1
            goes = binned[rows, j] <= b
            for part in (rows[goes], rows[~goes]):
                following.append((len(feature), part))
                for column, start in ((feature, 0), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
                    column.append(start)
        level = following
    for name, column, kind in (("feature", feature, np.int64), ("cut", cut, np.float64), ("left", left, np.int64), ("right", right, np.int64), ("value", value, np.float64)):
        getattr(forest, name).append(np.array(column, kind))
    return step


def _best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, leaf_rows: int, penalty: float) -> tuple[int, int] | None:
    n, m = binned.shape
    flat = (binned + np.arange(m) * bins).ravel()
    sums = [np.bincount(flat, np.repeat(v, m), m * bins).reshape(m, bins).cumsum(1) for v in (g, h, np.ones(n))]
    (gl, hl, nl), (gt, ht) = sums, (g.sum(), h.sum())
    gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
    gain[(nl < leaf_rows) | (n - nl < leaf_rows)] = -np.inf
    j, b = divmod(int(gain.argmax()), bins)
    return (j, b) if gain[j, b] > 1e-6 else None


def held_out(id_col: Column) -> Column:
    """True for rows that never train; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % HELD_OUT_MODULUS == HELD_OUT_REMAINDER, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A forest from the labelled rows that are not held out.

    At most ``sample_rows`` of them, those that come first by a hash of the id, reach
    the driver; a threshold on the hash keeps the rest from being sent at all. Null labels
    are left out; where an id has several, the largest counts.
    """
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).alias("y"))
    rows = stats.where(~held_out(F.col("doc_id"))).join(marked, "doc_id").select("doc_id", "x", "y")
    n = stats.select("doc_id").where(~held_out(F.col("doc_id"))).join(marked, "doc_id").count()
    if n > 2 * sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * 1.2 * sample_rows / n))
    taken = rows.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id").limit(sample_rows).select("x", "y").toPandas()
    if taken.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array(taken["x"].tolist(), np.float32), (taken["y"].to_numpy() > 0).astype(int))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row ``doc_id, held_out, score, predicted`` for each row of ``docs``.

    A null text is scored as the empty text. Repeated rows get equal scores, a null id is
    kept, an empty table gives no rows, and other columns are not read.
    """
    stats = durable(document_statistics(docs, id_col, text_col))
    forest = train(stats, labels, label_col, sample_rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": forest.score(np.array(frame["x"].tolist(), np.float32))})

    scored = stats.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; rows without an id stay.

    Columns are those of ``docs``, whatever their names. A row is judged by its own text,
    so rows that share an id may part and repeated rows stay or go together. A null text
    is judged as the empty one; an empty table gives no rows.
    """
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").alias("text"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, key, text in rows:
            yield doc_id, key, statistics(text)

    stats = durable(map_rows(slim, run, "doc_id long, key long, x array<float>"))
    forest = train(stats, labels, label_col)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                out = forest.score(np.array(frame["x"].tolist(), np.float32)) < accept
                yield frame.loc[out, ["key"]]

    return without(docs, stats.mapInPandas(judge, "key long"))
