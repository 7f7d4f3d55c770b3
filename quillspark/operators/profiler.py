"""Latencies from lifecycle events: event pairing, as-of joins and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pair_events(starts: DataFrame, ends: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """``key, started, ended``: each end with the start of its key; starts without an end are dropped."""
    return starts.select(key, F.col(time).alias("started")).join(ends.select(key, F.col(time).alias("ended")), key)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, retained: int | None = None) -> DataFrame:
    """``left`` with ``matched``: the latest right time of its key that is not later.

    One pass over both sides sorted by time: no pairs are formed. With ``retained`` only
    that many of the last right rows up to then are remembered, which changes nothing for
    the latest one.
    """
    a = left.withColumn("__side", F.lit(1)).withColumn("__t", F.col(time)).withColumn("__r", F.lit(None).cast(right.schema[right_time].dataType))
    b = right.select(key, F.lit(0).alias("__side"), F.col(right_time).alias("__t"), F.col(right_time).alias("__r"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("matched", F.last("__r", ignorenulls=True).over(w)).where("__side = 1").drop("__side", "__t", "__r")


def latency_summary(samples: DataFrame, key: str, value: Column) -> DataFrame:
    return samples.groupBy(key).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.95), 6).alias("p95"), F.max(value).alias("largest")
    )


def bounded_events(events: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The last ``limit`` events of each key: what a bounded log still holds."""
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")


def frame_energy(samples: Column) -> Column:
    """The root mean square of a frame; 0 for an empty one."""
    total = F.aggregate(F.transform(samples, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def runtime_totals(chunks: DataFrame) -> DataFrame:
    """Different chunks, their bytes and sessions; a chunk that came several times counts once, at its largest."""
    once = chunks.groupBy("session", "recording", "sequence").agg(F.max("bytes").alias("bytes"))
    return once.agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"), F.count_distinct("session").alias("sessions"))
