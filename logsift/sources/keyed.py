"""A Parquet table kept by entity id: bucketed, copy-on-write, one flip.

Rows lie in hash buckets of their id and, within a bucket, in files sorted
by id.  A change rewrites only the buckets whose ids it touches, into a new
folder, and then publishes a manifest (bucket -> folder) under the next
version number by one rename; a reader takes the highest version, so a run
that dies before the rename leaves the old state.  The manifest grows with
the bucket count alone.  Each written folder has a table of its files' least
and greatest id, by which a lookup opens the file that can hold the id.

All rows of an id are one entity: an upsert replaces all of them.  There is
one writer at a time; a second one that meets the same version number fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "kt_bucket"


class ConcurrentWrite(RuntimeError):
    """Another writer published the version this one was to publish."""


class KeyedTable:
    """``key``: the id column.  ``order``: columns that order an entity's rows
    (they also spread the rows of one very large entity over files)."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: Sequence[str] = (), buckets: int = 64):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, list(order)
        self._new_buckets = buckets

    # ------------------------------------------------------------ manifest
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifest")
        return sorted(int(s.getPath().getName()[:-5]) for s in (fs.listStatus(p) if fs.exists(p) else [])
                      if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The published state; None before the first write."""
        known = self.versions()
        if not known:
            return None
        fs, p = self._fs(f"{self.path}/manifest/{version or known[-1]:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        final = f"{self.path}/manifest/{state['version']:012d}.json"
        fs, tmp = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = self._fs(final)[1]
        if fs.exists(target) or not fs.rename(tmp, target):
            fs.delete(tmp, False)
            raise ConcurrentWrite(final)

    # --------------------------------------------------------------- reads
    def _folders(self, state: dict, buckets=None) -> list[str]:
        wanted = state["folders"] if buckets is None else {str(b): state["folders"][str(b)] for b in buckets if str(b) in state["folders"]}
        return [f"{self.path}/data/{tag}/{BUCKET}={b}" for b, tag in wanted.items()]

    def _frame(self, state: dict, paths: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        state = self.manifest(version)
        return None if state is None else self._frame(state, self._folders(state))

    def bucket_of(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")

    def files_of(self, value) -> list[str]:
        """The files that can hold an id."""
        state = self.manifest()
        if state is None:
            return []
        bucket = self.spark.range(1).select(self.bucket_of(F.lit(value), state["buckets"])).head()[0]
        tag = state["folders"].get(str(bucket))
        if tag is None:
            return []
        files = self.spark.read.parquet(f"{self.path}/files/{tag}/{BUCKET}={bucket}")
        return [r["file"] for r in files.where((F.col("lo") <= value) & (F.col("hi") >= value)).select("file").collect()]

    def get(self, value) -> DataFrame:
        """All rows of one id, read from the file that can hold it."""
        state = self.manifest()
        if state is None:
            raise LookupError(f"nothing has been written to {self.path}")
        return self._frame(state, self.files_of(value)).where(F.col(self.key) == value)

    def rows_of(self, ids: DataFrame) -> DataFrame | None:
        """The rows of the ids in ``ids``; only their buckets are read."""
        state = self.manifest()
        if state is None:
            return None
        ids = ids.select(self.key).distinct()
        return self._frame(state, self._folders(state, sorted(self._touched(ids, state)))).join(ids, self.key, "left_semi")

    # -------------------------------------------------------------- writes
    def _write(self, rows: DataFrame, state: dict, touched: set[int], batch: tuple[str, int] | None) -> int:
        """Write the new contents of the ``touched`` buckets and publish."""
        tag = f"{state['version'] + 1:012d}-{uuid.uuid4().hex}"
        data = f"{self.path}/data/{tag}"
        lie = [BUCKET, self.key, *self.order]
        (rows.withColumn(BUCKET, self.bucket_of(F.col(self.key), state["buckets"]))
         .repartitionByRange(*lie).sortWithinPartitions(*lie).write.partitionBy(BUCKET).parquet(data))
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        written: list[int] = []
        if self._has_files(data):
            files = (self.spark.read.schema(T.StructType([schema[self.key], T.StructField(BUCKET, T.IntegerType())])).parquet(data)
                     .groupBy(BUCKET, F.col("_metadata.file_path").alias("file"))
                     .agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi"), F.count("*").alias("rows")))
            files.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/files/{tag}")
            written = [r[0] for r in self.spark.read.parquet(f"{self.path}/files/{tag}").select(BUCKET).distinct().collect()]
        folders = {b: t for b, t in state["folders"].items() if int(b) not in touched} | {str(b): tag for b in written}
        applied = state["applied"] | ({batch[0]: batch[1]} if batch else {})
        self._publish(state | {"version": state["version"] + 1, "folders": folders, "applied": applied})
        return state["version"] + 1

    def _has_files(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p) and any(s.isDirectory() for s in fs.listStatus(p))

    def _start(self, schema: T.StructType) -> dict:
        return {"version": 0, "key": self.key, "buckets": self._new_buckets, "folders": {}, "applied": {}, "schema": schema.json()}

    def _replayed(self, state: dict, batch: tuple[str, int] | None) -> bool:
        return batch is not None and state["applied"].get(batch[0], -1) >= batch[1]

    def _touched(self, ids: DataFrame, state: dict) -> set[int]:
        return {r[0] for r in ids.select(self.bucket_of(F.col(self.key), state["buckets"]).alias("b")).distinct().collect()}

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None, absent_only: bool = False) -> int:
        """Replace the entities in ``rows`` (with ``absent_only``: add those
        that are not there yet).  ``batch`` = (source, number): a number that
        was already applied changes nothing.  Rows without an id are an
        error.  Returns the table's version."""
        state = self.manifest() or self._start(rows.schema)
        if self._replayed(state, batch):
            return state["version"]
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        if rows.schema.simpleString() != schema.simpleString():
            raise ValueError(f"columns differ from the table's: {rows.schema.simpleString()}, {schema.simpleString()}")
        rows = rows.withColumn(self.key, F.when(F.col(self.key).isNull(), F.raise_error(F.lit("row without an id")))
                               .otherwise(F.col(self.key)))
        touched = self._touched(rows, state)
        if not touched:
            return state["version"]
        stored = self._frame(state, self._folders(state, sorted(touched)))
        if absent_only:
            merged = stored.unionByName(rows.join(stored.select(self.key).distinct(), self.key, "left_anti"))
        else:
            merged = stored.join(rows.select(self.key).distinct(), self.key, "left_anti").unionByName(rows)
        return self._write(merged, state, touched, batch)

    def delete(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Drop the entities whose id is in ``ids``; buckets without one stay
        as they are."""
        state = self.manifest()
        if state is None or self._replayed(state, batch):
            return state["version"] if state else 0
        ids = ids.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        touched = self._touched(ids, state) & {int(b) for b in state["folders"]}
        if not touched:
            return state["version"]
        kept = self._frame(state, self._folders(state, sorted(touched))).join(ids, self.key, "left_anti")
        return self._write(kept, state, touched, batch)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last ``keep`` versions uses, and
        the older manifests; returns the removed folder names."""
        known = self.versions()
        used = {t for v in known[-keep:] for t in self.manifest(v)["folders"].values()}
        gone = []
        for top in ("data", "files"):
            fs, p = self._fs(f"{self.path}/{top}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in used:
                    fs.delete(s.getPath(), True)
                    gone.append(s.getPath().getName())
        for v in known[:-keep]:
            fs, p = self._fs(f"{self.path}/manifest/{v:012d}.json")
            fs.delete(p, False)
        return sorted(set(gone))
