"""Optimistic commits to a table of files on a shared file system.

A version is a small manifest that names folders of rows. Rows are staged in a folder of
their own first, where no reader looks. A version appears at once, by one step that fails
if another writer has taken its number: a hard link on a local file system, a rename that
may not replace elsewhere. A writer says what the rows that it changes were when it read
them; it is refused if they are others by the time it commits, and tries again by itself
if only other rows changed meanwhile. Readers see whole versions: folders never change.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import fingerprint
from quillspark.session import durable

#: Tries of one commit, the first pause between them, and layers from which reading them gets slow.
TRIES, PAUSE_S, MOST_LAYERS = 8, 0.05, 16


class ConflictError(RuntimeError):
    """Rows that a writer wanted to change are no longer what it had read."""


def row_fingerprint(columns: list[str]) -> Column:
    """A fingerprint of a row's values; null and empty differ."""
    return fingerprint(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


@dataclass
class CommittedTable:
    spark: SparkSession
    path: str
    keys: list[str]

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, fs = self._hadoop(f"{self.path}/versions")
        if not fs.exists(where):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(where))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int:
        """The newest version; 0 where nothing was committed."""
        return max(self.versions(), default=0)

    def _layers(self, version: int) -> list[str]:
        if not version:
            return []
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0])["layers"]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with ``row_fp``, the newest of each key; None for version 0."""
        layers = self._layers(self.current() if version is None else version)
        if not layers:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/rows/{name}").withColumn("__layer", F.lit(k)) for k, name in enumerate(layers)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        values = [c for c in rows.columns if c not in (*self.keys, "__layer")]
        if len(layers) > 1:
            newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "__layer").alias("__row"))
            rows = newest.select(*self.keys, *(F.col("__row")[c].alias(c) for c in values))
        rows = rows.drop("__layer")
        return rows.withColumn("row_fp", row_fingerprint(rows.columns))

    def _publish(self, version: int, layers: list[str]) -> bool:
        """Whether this writer got the version's number."""
        target = f"{self.path}/versions/{version:012d}.json"
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        where, fs = self._hadoop(draft)
        out = fs.create(where, True)
        out.write(bytearray(json.dumps({"version": version, "layers": layers}).encode()))
        out.close()
        final, _ = self._hadoop(target)
        fs.mkdirs(final.getParent())
        jvm, hadoop = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs
        try:
            if fs.getUri().getScheme() == "file":
                files, paths = jvm.java.nio.file.Files, jvm.java.nio.file.Paths
                root = self.spark._sc._gateway.new_array(jvm.java.lang.String, 0)
                files.createLink(paths.get(final.toUri().getPath(), root), paths.get(where.toUri().getPath(), root))
                return True
            options = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
            options[0] = getattr(hadoop.Options.Rename, "NONE")
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(where, final, options)
            return True
        except Exception as error:
            if "AlreadyExists" in str(getattr(error, "java_exception", error)):
                return False
            raise
        finally:
            fs.delete(where, False)

    def commit(self, rows: DataFrame, tries: int = TRIES) -> int:
        """The version that ``rows`` were committed as.

        ``rows`` has the keys, ``expected_fp`` (the ``row_fp`` that the row of the key had
        when it was read, null where there was none) and the values. One row for each key;
        keys may not be null. Nothing of a refused commit can be read.
        """
        staged = durable(rows)
        repeated = staged.groupBy(*self.keys).count().where(F.col("count") > 1)
        missing = staged.where(" OR ".join(f"`{k}` IS NULL" for k in self.keys))
        if not repeated.isEmpty() or not missing.isEmpty():
            raise ValueError("a commit has one row for each key, and no null keys")
        layer = uuid.uuid4().hex
        staged.drop("expected_fp").write.parquet(f"{self.path}/rows/{layer}")
        for attempt in range(tries):
            version = self.current()
            self._verify(staged, version)
            if self._publish(version + 1, [*self._layers(version), layer]):
                return version + 1
            time.sleep(PAUSE_S * 2**attempt)
        raise ConflictError(f"other writers were faster {tries} times")

    def _verify(self, staged: DataFrame, version: int) -> None:
        now = self.read(version)
        if now is None:
            changed = staged.where(F.col("expected_fp").isNotNull())
        else:
            asked = staged.select(*self.keys, "expected_fp")
            changed = asked.join(now.select(*self.keys, "row_fp"), self.keys, "left").where(~F.col("expected_fp").eqNullSafe(F.col("row_fp")))
        n = changed.count()
        if n:
            raise ConflictError(f"{n} rows are not what they were when they were read")

    def compact(self) -> int:
        """The same rows as one layer, as a version of its own; gives up where another writer was faster."""
        version = self.current()
        layers = self._layers(version)
        if len(layers) < 2:
            return version
        layer = uuid.uuid4().hex
        self.read(version).drop("row_fp").write.parquet(f"{self.path}/rows/{layer}")
        return version + 1 if self._publish(version + 1, [layer]) else self.current()
