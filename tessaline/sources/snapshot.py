"""Tables that change by statements: every change writes a new version and moves a pointer.

A version is a Parquet folder of its own name; the pointer is a file for each
step, named by the step's number and created only if no such file exists, so a
reader sees the old version or the new one, a failed job leaves the old one,
and of two writers that start from the same step the first one wins: the other
gets `ConcurrentChange` and its version is never seen.  Files are reached
through the file system of the path; creation must be atomic there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DuplicateKey(ValueError):
    pass


class ConcurrentChange(RuntimeError):
    pass


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str] | None = None, defaults: dict | None = None):
        self.spark, self.path, self.schema, self.key, self.defaults = spark, path.rstrip("/"), schema, key or [], defaults or {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: list[str] | None = None, defaults: dict | None = None) -> SnapshotTable:
        table = cls(spark, path, schema, key, defaults)
        table._publish(spark.createDataFrame([], schema), 0)
        return table

    def _files(self):
        """(file system, folder of pointers)."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_steps")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def version(self) -> int:
        """The last step."""
        fs, folder = self._files()
        return max(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())

    def _folder(self, step: int) -> str:
        fs, folder = self._files()
        file = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{step:08d}"))
        try:
            return file.readUTF()
        finally:
            file.close()

    def read(self, version: int | None = None, row_id: str | None = None) -> DataFrame:
        """The current or an earlier version; with `row_id` a column of that name tells a row's file and place, the same in each reading of a version."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._folder(version or self.version())}")
        return rows if row_id is None else rows.select("*", F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias(row_id))

    def _publish(self, df: DataFrame, base: int) -> int:
        """Write rows as the step after `base`."""
        folder = f"v{base + 1:08d}-{uuid.uuid4().hex}"
        df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(f"{self.path}/{folder}")
        return self._point(folder, base)

    def _point(self, folder: str, base: int) -> int:
        fs, steps = self._files()
        jvm = self.spark._jvm
        try:
            file = fs.create(jvm.org.apache.hadoop.fs.Path(steps, f"{base + 1:08d}"), False)
        except Py4JJavaError as e:
            raise ConcurrentChange(f"another change of {self.path} came first") from e
        file.writeUTF(folder)
        file.close()
        return base + 1

    def restore(self, version: int) -> int:
        """Make an earlier version the current one, as a step of its own."""
        return self._point(self._folder(version), self.version())

    def _complete(self, rows: DataFrame | Iterable[dict]) -> DataFrame:
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([tuple(r.get(f.name, self.defaults.get(f.name)) for f in self.schema) for r in rows], T.StructType([T.StructField(f.name, f.dataType) for f in self.schema]))
        missing = [f for f in self.schema if f.name not in rows.columns]
        rows = rows.select("*", *[F.lit(self.defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in missing]).select(*self.schema.names)
        required = [f.name for f in self.schema if not f.nullable] + self.key
        if required and rows.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])).limit(1).count():
            raise ValueError("a null for a NOT NULL column")
        return rows

    def insert(self, rows: DataFrame | Iterable[dict], on_duplicate: dict[str, Column] | None = None) -> int:
        """INSERT; with `on_duplicate`, present keys are updated (expressions see old.* and new.*)."""
        base = self.version()
        now, new = self.read(base), self._complete(rows)
        if not self.key:
            out = now.unionByName(new)
        else:
            if new.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
                raise DuplicateKey("the inserted rows repeat a key")
            same = reduce(lambda a, b: a & b, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in self.key])
            met = now.alias("old").join(new.alias("new"), same)
            if on_duplicate is None:
                if met.limit(1).count():
                    raise DuplicateKey("a key is already present")
                out = now.unionByName(new)
            else:
                changed = met.select(*[on_duplicate.get(c, F.col(f"old.{c}")).alias(c) for c in self.schema.names])  # a changed key is not checked again
                out = now.join(new, self.key, "left_anti").unionByName(changed).unionByName(new.join(now, self.key, "left_anti").select(*self.schema.names))
        return self._publish(out, base)

    def update(self, assignments: dict[str, Column], where: Column) -> int:
        """Rows where the condition is true get new values; all others, unknown ones included, stay."""
        hit = F.coalesce(where, F.lit(False))
        base = self.version()
        return self._publish(self.read(base).select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in self.schema.names]), base)

    def delete(self, where: Column) -> int:
        base = self.version()
        return self._publish(self.read(base).where(~F.coalesce(where, F.lit(False))), base)
