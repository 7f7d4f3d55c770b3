"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillspark.session import durable, share_code

#: Rows that go back to Spark in one Arrow batch.
OUT_ROWS = 4096


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small by bytes, whatever the length of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple[Any, ...]]], ddl: str) -> DataFrame:
    """``rows`` over each partition: it gets an iterator of tuples and yields tuples.

    The input streams in and the output streams out, so that a task holds a batch of
    either at a time besides what ``rows`` keeps.
    """
    bound_batches(df.sparkSession)
    share_code(df.sparkSession)
    schema = schema_of(ddl)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def read() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for n, c in zip(names, columns, strict=True)], schema=arrow)

        for row in rows(read()):
            held.append(row)
            if len(held) >= OUT_ROWS:
                yield batch()
                held.clear()
        if held:
            yield batch()

    return df.mapInArrow(run, schema)


#: Keys whose rows are joined by broadcast at most, and rows that a key has then at least.
HOT_KEYS, HOT_ROWS = 2000, 5000
#: Bytes of a table of numbers up to which it is sent to every task.
BROADCAST_BYTES = 32 << 20


def join_counted(left: DataFrame, counted: DataFrame, key: str, width: Column | None = None) -> DataFrame:
    """``left`` joined with ``counted``, one row for each key, by ``key``.

    ``counted`` has a column ``n`` (dropped here): how many rows of ``left`` have the key.
    Keys that hold at least a ``HOT_KEYS``-th of all rows, so no more than that many, are
    sent to every task; a shuffle deals only the others. Both are read twice, so they
    should be durable. Null keys have no partner. ``width`` measures the bytes of a row
    of ``counted`` that may be long; only rows that are short enough for all to be sent are.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    is_hot = F.col("n") >= least
    if width is not None:
        is_hot &= width <= BROADCAST_BYTES // HOT_KEYS
    if counted.where(is_hot).isEmpty():
        return left.join(counted.drop("n"), key)
    rest, hot = counted.where(~is_hot).drop("n"), F.broadcast(counted.where(is_hot).drop("n"))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(rest, key))


def small(numbers: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``numbers`` (durable), marked for broadcast if its rows are counted to be few enough."""
    return F.broadcast(numbers) if numbers.count() * row_bytes <= BROADCAST_BYTES else numbers


def own_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that no column of ``taken`` has (case aside)."""
    known = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit name of a row by its id and text, null counting as empty."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def without(docs: DataFrame, out: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no ``key`` (``row_key``) of ``out`` names; rows without an id stay.

    Texts move only where the keys are counted to be too many to be sent to every task.
    """
    (name,) = own_names(docs.columns, "out_key")
    gone = small(durable(out.select(F.col("key").alias(name)).distinct()), 16)
    return docs.join(gone, F.col(id_col).isNotNull() & (row_key(id_col, text_col) == gone[name]), "left_anti")


def text_or_empty(column: str = "text") -> Any:
    return F.coalesce(F.col(column), F.lit(""))
