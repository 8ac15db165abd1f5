"""Tables that can be updated: whole versions in Parquet, and a pointer that moves from one to the next at once.

A version is written to a folder of its own, then the pointer is renamed into place. So readers see the old or the new
state and nothing between, a failed write leaves a folder that nobody looks into, and a table can be read while it is
being rewritten from itself. One writer at a time is assumed; another one's version is noticed before the pointer moves.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from agora.operators import merge


class Conflict(RuntimeError):
    """Someone else moved the pointer meanwhile."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> dict | None:
        """What the pointer says: version (from 1), folder, the last batch of each source, the schema; None for no table."""
        if not self._files().exists(self._path("pointer.json")):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/pointer.json", wholetext=True).first()[0])

    def read(self, schema: str | None = None) -> DataFrame:
        """The present version; ``schema``: of the empty table that is read where there is none yet."""
        now = self.state()
        if now is None:
            if schema is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(now["schema"]).parquet(f"{self.path}/{now['folder']}")

    def write(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> bool:
        """Makes ``rows``, which may be read from this table, its next version. A batch that its source has sent before changes nothing."""
        now = self.state()
        if self.seen(source, batch, now):
            return False
        folder = f"v{(now['version'] if now else 0) + 1:09d}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{folder}")
        if self.state() != now:
            raise Conflict(self.path)
        batches = (now["batches"] if now else {}) | ({source: batch} if source is not None else {})
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        self._point({"version": (now["version"] if now else 0) + 1, "folder": folder, "batches": batches, "schema": fields})
        return True

    def seen(self, source: str | None, batch: int | None, now: dict | None) -> bool:
        return source is not None and now is not None and now["batches"].get(source, -1) >= batch

    def _point(self, to: dict) -> None:
        jvm, name = self.spark._jvm, f"pointer-{uuid.uuid4().hex[:12]}"
        out = self._files().create(self._path(name))
        out.write(bytearray(json.dumps(to).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(name), self._path("pointer.json"), options)

    def _change(self, change: Callable[[DataFrame], DataFrame], like: DataFrame, source: str | None, batch: int | None) -> bool:
        now = self.state()
        if self.seen(source, batch, now):
            return False
        old = self.read() if now else like.limit(0)
        return self.write(change(old), source, batch)

    def upsert(self, new: DataFrame, keys: Sequence[str], policy: dict[str, str] | str = "coalesce", source: str | None = None, batch: int | None = None) -> bool:
        return self._change(lambda old: merge.upsert(old, new, keys, policy), new, source, batch)

    def insert_absent(self, new: DataFrame, keys: Sequence[str], source: str | None = None, batch: int | None = None) -> bool:
        return self._change(lambda old: merge.insert_absent(old, new, keys), new, source, batch)

    def replace_children(self, new: DataFrame, parent: str, keys: Sequence[str], source: str | None = None, batch: int | None = None) -> bool:
        return self._change(lambda old: merge.replace_children(old, new, parent, keys), new, source, batch)

    def delete(self, gone: DataFrame, keys: Sequence[str], source: str | None = None, batch: int | None = None) -> bool:
        return self._change(lambda old: merge.delete(old, gone, keys), self.read(), source, batch)

    def sink(self, keys: Sequence[str], policy: dict[str, str] | str = "overwrite", source: str = "stream") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: upserts each batch once, however often it is sent. A batch's rows must differ in their keys."""
        return lambda rows, batch: self.upsert(rows, keys, policy, source, batch) and None

    def clean(self) -> None:
        """Removes the folders of all but the present version. Only when nobody reads older ones."""
        now, files = self.state(), self._files()
        for status in files.listStatus(self._path("")) if now else []:
            name = status.getPath().getName()
            if name not in (now["folder"], "pointer.json"):
                files.delete(status.getPath(), True)
