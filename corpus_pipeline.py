"""From raw documents to a mixed training corpus, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; all but the last give
the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, jaccard, lines, mixing, quality, simhash
from quillspark.session import checkpoint_dir, load


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_accepted(docs, load(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines whose template recurs across documents."""
    changed = lines.drop_recurring(docs).select(*docs.columns)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that SimHash or five-word similarity of 0.8 links."""
    return simhash.keep_representatives(docs, first_rows=jaccard.first_rows(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap with a benchmark item."""
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with their shard and pass."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", accept_quality),
    ("line_dedup", drop_recurring_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: Classifiers and near-duplicates have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def _finished(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages applied to ``documents``; what each gives is written to the shared folder and read again.

    A run that is given the ``folder`` of one that broke off goes on after its last
    finished stage; without one it has a folder of its own.
    """
    target = folder or f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{target}/{name}"
        if not _finished(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
