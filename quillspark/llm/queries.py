"""Queries over the supplied tables, one for each operator of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import ann, decontaminate, divergence, lines, mixing, oracles, parity, quality, secrets, simhash, sitestyle, suffix, warc, yinyang
from quillspark.session import checkpoint_dir, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {"op3_suffix": oracles.SUFFIX, "op6_secrets": oracles.SECRETS, "op8_warc": oracles.WARC, "op11_yinyang": oracles.YINYANG, "op12_parity": oracles.PARITY, "op13_divergence": oracles.DIVERGENCE}


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES["op4_simhash"] = op4_simhash


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of its own, so that a run doesn't depend on what earlier ones left."""
    ledger = secrets.Ledger(spark, f"{checkpoint_dir(spark)}/secrets-{uuid.uuid4().hex}")
    found = secrets.scan(load(spark, sf_dir, "documents"), ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.join_spans(F.col("spans")).alias("spans"))


QUERIES["op6_secrets"] = op6_secrets


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, load(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES |= {"op7_quality": op7_quality, "op8_warc": op8_warc}


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(table, table.where(F.col("vec_id") % 20 == 0), k=20)


QUERIES["op10_ann"] = op10_ann


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sitestyle.extract(load(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


QUERIES["op1_html"] = op1_html


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and where: the shard that the tree deals each pass to, and its order there."""
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken"),
        F.col("places.shard").alias("shards"), F.col("places.at").alias("orders"),
    )


QUERIES["op2_mixing"] = op2_mixing


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: how many items it overlaps, which, and the longest overlap."""
    docs = load(spark, sf_dir, "documents")
    found = decontaminate.overlaps(docs, load(spark, sf_dir, "benchmark"))
    per_doc = found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("tokens").alias("longest"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    joined = docs.select("doc_id").join(per_doc, "doc_id", "left")
    return joined.select(
        "doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("longest", F.lit(0)).alias("longest_tokens"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
    )


QUERIES["op9_decontaminate"] = op9_decontaminate


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its lines, how many were dropped, and a digest of the rest."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    out = lines.drop_recurring(docs)
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.col(out.columns[-1]).cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES["op5_lines"] = op5_lines


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.substring_dedup(load(spark, sf_dir, "documents")).drop("spans")


QUERIES["op3_suffix"] = op3_suffix


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


QUERIES["op13_divergence"] = op13_divergence


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.compress(load(spark, sf_dir, "embeddings"))


QUERIES["op11_yinyang"] = op11_yinyang


def op12_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.similarity_classes(load(spark, sf_dir, "documents"))


QUERIES["op12_parity"] = op12_parity
