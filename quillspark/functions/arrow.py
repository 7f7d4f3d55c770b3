"""Arrow functions that can be declared before there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of the rows that a Python worker is given at a time. Spark's own limits (10,000 rows, and bytes far beyond) let a
#: worker's memory grow with the length of texts and, up to that many rows, of a split.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches of bounded bytes for the session's Arrow functions; a tighter limit in plain bytes stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name).lower().rstrip("b")
    if not (given.isdigit() and 0 < int(given) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def arrow_function(ddl: str) -> Callable:
    """A pandas function as a column function of the given type; it is made when it is first used."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def column(*columns: Column | str) -> Column:
            bounded_batches(SparkSession.active())
            return F.pandas_udf(f, ddl)(*columns)

        return column

    return wrap
