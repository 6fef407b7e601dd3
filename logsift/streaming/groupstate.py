"""Failure groups kept up to date batch by batch, without reading history.

The state table holds one mergeable row per fingerprint.  A batch is rolled
up by itself, meets the rows of the fingerprints it touches and replaces
them.  Cases delivered before are told by a redelivery index: every batch's
ids lie in files by hash bucket, with a Bloom filter each; a later batch
tests the filters of its own buckets and opens only files that may hold one
of its ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.operators.groups import MEMBER_CAP, dedupe_cases
from logsift.sources.keyed import KeyedTable
from logsift.sources.sinks import read_table

HASHES, BITS_PER_ID = 7, 10


def _slots(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    step = h2.astype(np.uint64) | np.uint64(1)
    return (h1.astype(np.uint64)[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


class RedeliveryIndex:
    def __init__(self, spark: SparkSession, path: str, key: str = "case_id", buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _hashed(self, rows: DataFrame) -> DataFrame:
        k = F.col(self.key).cast("string")
        return rows.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct().withColumns({
            "bucket": F.pmod(F.xxhash64(k), F.lit(self.buckets)).cast("int"),
            "h1": F.xxhash64(F.lit(1), k), "h2": F.xxhash64(F.lit(2), k)})

    def record(self, rows: DataFrame, batch_id: int) -> None:
        """Store the ids of a batch (a replay overwrites its own files)."""
        ids = self._hashed(rows)

        def bloom(g: pd.DataFrame) -> pd.DataFrame:
            bits = max(64, BITS_PER_ID * len(g))
            on = np.zeros(bits, bool)
            on[_slots(g["h1"].to_numpy(), g["h2"].to_numpy(), bits).reshape(-1).astype(np.int64)] = True
            return pd.DataFrame({"bits": [bits], "filter": [np.packbits(on).tobytes()], "bucket": [g["bucket"].iloc[0]]})

        def put(df: DataFrame, name: str) -> None:
            (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").partitionBy("bucket", "batch_id")
             .option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}"))
        put(ids.select(self.key, "bucket"), "ids")
        put(ids.groupBy("bucket").applyInPandas(bloom, "bits long, filter binary, bucket int"), "filters")

    def suspects(self, rows: DataFrame, batch_id: int) -> list[tuple[int, int]]:
        """(bucket, batch) files that may hold an id of ``rows``."""
        ids = self._hashed(rows)
        touched = [r[0] for r in ids.select("bucket").distinct().collect()]
        filters = read_table(self.spark, f"{self.path}/filters")
        if filters is None or not touched:
            return []
        filters = filters.where(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id))

        def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            h1, h2, hits = left["h1"].to_numpy(), left["h2"].to_numpy(), []
            for r in right.itertuples():
                at = _slots(h1, h2, r.bits).astype(np.int64)
                byte = np.frombuffer(r.filter, np.uint8)
                if len(at) and ((byte[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1).any():
                    hits.append((r.bucket, r.batch_id))
            return pd.DataFrame(hits, columns=["bucket", "batch_id"])
        found = (ids.groupBy("bucket").cogroup(filters.groupBy("bucket"))
                 .applyInPandas(test, "bucket int, batch_id long").collect())
        return sorted((r[0], r[1]) for r in found)

    def unseen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The rows whose id no other batch has recorded."""
        files = self.suspects(rows, batch_id)
        if not files:
            return rows
        known = self.spark.read.parquet(*[f"{self.path}/ids/bucket={b}/batch_id={n}" for b, n in files]).select(self.key)
        return rows.join(known.distinct(), self.key, "left_anti")


def partial_groups(cases: DataFrame, seq: str = "seq", seen: str = "seen_at", member_cap: int = MEMBER_CAP) -> DataFrame:
    """One mergeable row per fingerprint of distinct cases: the values of
    ``groups.group_rollup`` with the order that picked them."""
    at = F.struct(F.col(seq).cast("long").alias("seq"), F.col("case_id").alias("case_id"))

    def newest(value: str, usable: Column) -> Column:
        return F.max(F.when(usable, F.struct(at.alias("at"), F.col(value).alias("value")))).alias(value)
    base = cases.groupBy("fingerprint").agg(
        F.count("*").alias("occurrence_count"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
        newest("signature", F.coalesce("signature", F.lit("")) != ""), newest("failure_class", F.col("failure_class").isNotNull()),
        newest("business_code", F.col("business_code").isNotNull()))
    verdicts = (cases.where(F.col("verdict").isNotNull()).groupBy("fingerprint", "verdict").agg(F.count("*").alias("n"))
                .groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("verdict", "n"))).alias("corroboration_history")))
    order = Window.partitionBy("fingerprint").orderBy(F.desc(seq), F.desc("case_id"))
    members = (cases.select("fingerprint", "case_id", seq).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= member_cap)
               .groupBy("fingerprint").agg(F.sort_array(F.collect_list(at), asc=False).alias("members")))
    none = F.create_map().cast("map<string,bigint>")
    return (base.join(verdicts, "fingerprint", "left").join(members, "fingerprint")
            .withColumn("corroboration_history", F.coalesce("corroboration_history", none)))


def merge_groups(rows: DataFrame, member_cap: int = MEMBER_CAP) -> DataFrame:
    """Partial rows of the same fingerprint as one."""
    none = F.create_map().cast("map<string,bigint>")
    add = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0).cast("long")) + F.coalesce(y, F.lit(0).cast("long")))
    out = rows.groupBy("fingerprint").agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *[F.max(c).alias(c) for c in ("signature", "failure_class", "business_code")],
        F.aggregate(F.collect_list("corroboration_history"), none, add).alias("corroboration_history"),
        F.slice(F.sort_array(F.flatten(F.collect_list("members")), asc=False), 1, member_cap).alias("members"))
    return out.select(*rows.columns)


def group_table(spark: SparkSession, path: str, buckets: int = 32) -> KeyedTable:
    return KeyedTable(spark, path, "fingerprint", buckets=buckets)


def update_group_state(state: KeyedTable, index: RedeliveryIndex, batch: DataFrame, batch_id: int, member_cap: int = MEMBER_CAP) -> None:
    """Add a micro-batch of analysed cases.  Cases of earlier batches count
    once; a replayed batch changes nothing: the state knows the batch's
    number, and the index leaves the batch's own ids out."""
    fresh = index.unseen(dedupe_cases(batch), batch_id).where(F.col("fingerprint").isNotNull()).checkpoint()
    part = partial_groups(fresh, member_cap=member_cap)
    old = state.rows_of(part)
    state.upsert(part if old is None else merge_groups(part.unionByName(old), member_cap), ("groups", batch_id))
    index.record(fresh, batch_id)


def group_view(state: KeyedTable) -> DataFrame:
    """The groups in the shape of ``groups.group_rollup``."""
    rows = state.read()
    return rows.select(
        "fingerprint", "occurrence_count", "first_seen", "last_seen",
        *[F.col(c)["value"].alias(c) for c in ("signature", "failure_class", "business_code")], "corroboration_history",
        F.transform(F.reverse("members"), lambda m: m["case_id"]).alias("members"))
