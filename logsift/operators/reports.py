"""Roll-up reports over parsed / normalised log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dump_profile(dump: DataFrame, by: Sequence[str] = ("pod", "app", "format"),
                 line: str = "out_line", ts: str = "timestamp") -> DataFrame:
    """Lines, bytes (line + newline) and string min/max time per key."""
    return dump.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length(F.col(line)) + 1).cast("bigint").alias("bytes"),
        F.min(ts).alias("oldest"), F.max(ts).alias("newest"))


def safe_since_hours(oldest: DataFrame, now_col: str = "now", oldest_col: str = "oldest",
                     default_hours: float = 2.0, slack_hours: float = 0.05) -> DataFrame:
    """Largest look-back (hours) that will not flag a false rotation gap:
    NULL when the dump is older than the default look-back."""
    age = (F.unix_micros(F.col(now_col)) - F.unix_micros(F.try_to_timestamp(F.col(oldest_col)))) / 3.6e9 - slack_hours
    return oldest.withColumn("since_hours", F.when(age >= default_hours, F.lit(None).cast("double"))
                             .otherwise(F.greatest(F.lit(0.1), F.round(age, 2))))


# --- fixed values (must equal the behaviour being matched) -----------------
DURATION_BUCKETS = [1, 5, 10, 30, 60, 120, 300, 600]
EVAL_PASS_SHARE = 0.8
# ---------------------------------------------------------------------------


def counter(df: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """A labelled counter: one row per label combination."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit(name))


def histogram(df: DataFrame, value: str, labels: Sequence[str] = (), bounds: Sequence[float] = tuple(DURATION_BUCKETS),
              name: str = "duration_seconds") -> DataFrame:
    """Cumulative histogram: count of observations <= each bound (plus +Inf),
    sum and count -- one pass, one row per (labels, bucket)."""
    aggs = [F.count_if(F.col(value) <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    agg = df.groupBy(*labels).agg(*aggs, F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"))
    le = F.array(*[F.struct(F.lit(str(float(b))).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)],
                 F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return (agg.select(*labels, "count", "sum", F.explode(le).alias("_b"))
            .select(*labels, F.lit(name).alias("metric"), F.col("_b.le").alias("le"), F.col("_b.n").alias("bucket_count"),
                    "count", "sum"))


def keyword_recall(cases: DataFrame, outputs: DataFrame, key: str = "refid", keywords: str = "expected_evidence_keywords",
                   text: str = "output", pass_share: float = EVAL_PASS_SHARE) -> DataFrame:
    """Share of expected keywords found (case-insensitive) in each case's
    output; an empty keyword list scores 1.0; PASS at >= 0.8."""
    j = cases.join(outputs, key, "left")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.size(F.filter(F.coalesce(F.col(keywords), F.array().cast("array<string>")),
                            lambda k: low.contains(F.lower(k))))
    n = F.size(F.coalesce(F.col(keywords), F.array().cast("array<string>")))
    share = F.when(n == 0, F.lit(1.0)).otherwise(found / n)
    return j.select(key, found.alias("found"), n.alias("expected"), share.alias("recall"),
                    F.when(share >= pass_share, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("result"))


def retention_plan(casebooks: DataFrame, now: Column, days: int, terminal: Sequence[str], updated: str = "updated_at",
                   size: str = "size_bytes") -> DataFrame:
    """Per casebook: ELIGIBLE (terminal and older than the cutoff),
    SKIPPED_RECENT (terminal, newer) or SKIPPED_ACTIVE (not terminal)."""
    cutoff = now - F.expr(f"INTERVAL {days} DAYS")
    term = F.col("status").isin(*terminal)
    state = (F.when(~term | F.col("status").isNull(), F.lit("SKIPPED_ACTIVE"))
             .when(F.col(updated) <= cutoff, F.lit("ELIGIBLE")).otherwise(F.lit("SKIPPED_RECENT")))
    return casebooks.withColumn("retention", state)


def reclaimable(plan: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Counts per retention state and the bytes an eligible prune frees."""
    return plan.agg(F.count_if(F.col("retention") == "ELIGIBLE").alias("eligible"),
                    F.count_if(F.col("retention") == "SKIPPED_RECENT").alias("skipped_recent"),
                    F.count_if(F.col("retention") == "SKIPPED_ACTIVE").alias("skipped_active"),
                    F.coalesce(F.sum(F.when(F.col("retention") == "ELIGIBLE", F.col(size))), F.lit(0))
                    .cast("bigint").alias("reclaimable_bytes"))
