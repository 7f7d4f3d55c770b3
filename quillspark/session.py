"""Sessions, table loading and durable intermediate results."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did.

    Workers on other machines need it there too (``--py-files`` or an installed package).
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


class NotFoundError(LookupError):
    """A row that was asked for by its id isn't there."""


def find_one(rows: DataFrame, key: str, value: object) -> Row:
    """The row of an id (the first of repeated ones); one that isn't there, or a blank id, is an error."""
    if value is None or not str(value).strip():
        raise ValueError(f"{key} is required")
    found = rows.where(F.col(key) == F.lit(value)).limit(1).collect()
    if not found:
        raise NotFoundError(f"no {key} {value!r}")
    return found[0]


def read_state(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """A small JSON state file anywhere that Spark reads; the default where it is missing or no object."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return dict(default or {})
    text = spark.read.text(path, wholetext=True).first()
    try:
        value = json.loads(text[0]) if text else {}
    except json.JSONDecodeError:
        return dict(default or {})
    return value if isinstance(value, dict) else dict(default or {})


#: Tables whose rows are long texts: much work for their bytes.
TEXT_TABLES = ("documents", "pages")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory; any path that Spark's readers can open.

    Tables are read as they are stored. Only a table of long texts whose files make fewer
    splits than the session has cores, here or on a cluster, is dealt to all of them.
    """
    share_code(spark)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if table in TEXT_TABLES and rows.rdd.getNumPartitions() < cores else rows


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The session's own ``spark.checkpoint.dir`` wins, then what was set on its context.
    Only a session on one machine may do without: a temporary folder is made for it. On
    a cluster executors wouldn't see such a folder, so there it is an error.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if given is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    return given or sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    The files are reliable: a lost executor costs a re-read, not a recomputation.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
