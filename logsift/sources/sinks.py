"""Sinks: envelopes, hand-off records, snapshots, casebook/status tables.

Tables are plain parquet folders written by Spark; "upserts" are append-only
event tables plus a latest-per-key read, so a rerun after an executor loss
simply rewrites the same micro-batch (writes are keyed by batch id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values (must equal the behaviour being matched) -----------------
CASEBOOK_SCHEMA_VERSION = "1.2"
DLT_CASEBOOK_SCHEMA_VERSION = "1.0"
REASON_CODE_CSV_COLUMNS = ["code", "description", "category", "category_source", "failure_class", "stage", "section",
                           "numeric_id"]
# ---------------------------------------------------------------------------


def dlq_envelope(df: DataFrame, payload: str = "raw_text", error: str = "poison_reason") -> DataFrame:
    """``{"original_payload": ..., "dlq_error": ...}`` as a JSON value column."""
    return df.select(F.to_json(F.struct(F.col(payload).alias("original_payload"),
                                        F.col(error).alias("dlq_error"))).alias("value"))


def handoff(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Records unchanged, plus extra columns (evidence gaps, log window), as JSON."""
    out = df.withColumns(extra or {})
    return out.select(F.to_json(F.struct(*[F.col(c) for c in out.columns])).alias("value"))


def reason_code_csv(df: DataFrame, path: str) -> None:
    """Reason-code catalog as CSV with the 8 columns; refuses an empty catalog."""
    if df.limit(1).count() == 0:
        raise ValueError("refusing to write an empty reason-code catalog")
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
            for c in REASON_CODE_CSV_COLUMNS]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def append_batch(df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Idempotent micro-batch append: each batch owns ``batch_id=<n>``, so a
    replayed batch overwrites its own output instead of duplicating it."""
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .partitionBy("batch_id", *partition_by).option("partitionOverwriteMode", "dynamic").parquet(path))


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table at ``path``; None only when nothing has been written there."""
    try:
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest_by_key(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Latest row per key (max-by aggregate: partial, skew-safe)."""
    cols = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select(*key, "_r.*")


def insert_if_absent(new: DataFrame, existing: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not yet captured (capture-once)."""
    return new if existing is None else new.join(existing.select(*key).distinct(), list(key), "left_anti")


def replay_queue(nominations: DataFrame, category: str | None = None) -> DataFrame:
    """Replay nominations filtered case-insensitively by category."""
    if category is None:
        return nominations
    return nominations.where(F.lower(F.col("category")) == category.lower())
