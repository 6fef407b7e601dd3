"""Readers for the stored tables and captured files (schemas declared, no
inference): casebooks, runbooks, outcomes, groups, template catalog,
evaluation cases, captured dead-letter corpora and exported CSV logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.operators.windows import chunked_running_sum

EXPORT_RECORD = T.StructType([T.StructField("@timestamp", T.StringType()), T.StructField("level", T.StringType()),
                              T.StructField("message", T.StringType()), T.StructField("application_name", T.StringType())])
RUNBOOK_SCHEMA = ("schema_version STRING, runbook_id STRING, reason_code STRING, enrolment_type STRING, status STRING, "
                  "version INT, rule_fingerprint STRING, resolution STRUCT<rejection_description: STRING, synthesis: "
                  "STRING, action: STRING, resident_action: STRING>, provenance STRUCT<source_event_ids: ARRAY<STRING>, "
                  "source_casebook_count: INT>, approved_by STRING, approved_at STRING")
OUTCOME_SCHEMA = ("event_id STRING, verdict STRING, verified_by STRING, verified_at STRING, notes STRING, "
                  "reason_code STRING, enrolment_type STRING, resolution_source STRING, agent_action STRING, "
                  "corrected_action STRING, confidence DOUBLE, abstained BOOLEAN, shadow_action STRING, "
                  "shadow_runbook_id STRING, shadow_agreed BOOLEAN, prompt_fingerprint STRING")
GROUP_SCHEMA = ("fingerprint STRING, signature STRING, failure_class STRING, business_code STRING, first_seen DOUBLE, "
                "last_seen DOUBLE, occurrence_count BIGINT, members ARRAY<STRING>, recommendation_state STRING, "
                "corroboration_history MAP<STRING, BIGINT>")
EVAL_SCHEMA = "refid STRING, expected_outcome STRING, expected_evidence_keywords ARRAY<STRING>"
CATALOG_SCHEMA = "template_id STRING, template STRING, classification STRING, pct_flows DOUBLE"


def _json(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    # Spark skips files starting with "_" or "."; unreadable documents are
    # left out here and listed by ``unreadable``.
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "DROPMALFORMED").json(path)


def unreadable(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """The documents a reader leaves out: file, raw text and the fields that
    could be read."""
    raw = (spark.read.schema(f"{schema}, _corrupt_record STRING").option("multiLine", multiline)
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    fields = F.struct(*[c for c in raw.columns if c != "_corrupt_record"])       # what could be read of it
    return (raw.select(F.col("_metadata.file_path").alias("file"), F.col("_corrupt_record").alias("raw_text"), fields.alias("fields"))
            .where(F.col("raw_text").isNotNull()))


def read_casebooks(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``<root>/<event_id>/casebook.json`` with the id taken from the path."""
    return (_json(spark, f"{root}/*/casebook.json", schema)
            .withColumn("event_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/casebook\.json$", 1)))


def read_runbooks(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, RUNBOOK_SCHEMA)


def read_outcomes(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, f"{root}/*/outcome.json", OUTCOME_SCHEMA)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Failure groups, newest activity first."""
    return _json(spark, path, GROUP_SCHEMA).orderBy(F.col("last_seen").desc_nulls_last())


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, EVAL_SCHEMA)


def read_template_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Template catalog entries; the last entry for a template id wins."""
    df = _json(spark, path, CATALOG_SCHEMA).withColumn("_pos", F.monotonically_increasing_id())
    return df.groupBy("template_id").agg(F.max_by(F.struct("template", "classification", "pct_flows"), "_pos")
                                         .alias("_r")).select("template_id", "_r.*")


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Captured dead-letter records (one JSON document per file)."""
    return _json(spark, path, schema)


def export_records(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Exported-CSV log lines -> (records, rejects): the text between the
    first ``{`` and the last ``}`` with doubled quotes undone, parsed as one
    JSON record; header/blank lines are skipped; unparseable JSON goes to
    rejects."""
    body = F.regexp_replace(F.regexp_extract(F.col(line), r"(?s)(\{.*\})", 1), '""', '"')
    cand = lines.withColumn("_j", F.nullif(body, F.lit(""))).where(F.col("_j").isNotNull())
    ok = F.json_object_keys(F.col("_j")).isNotNull()
    parsed = cand.withColumn("_r", F.when(ok, F.from_json(F.col("_j"), EXPORT_RECORD)))
    rejects = parsed.where(F.col("_r").isNull()).select(F.col(line).alias("raw_text"))
    rec = parsed.where(F.col("_r").isNotNull()).select(
        F.coalesce(F.col("_r.`@timestamp`"), F.lit("UNKNOWN_TIME")).alias("timestamp"),
        F.coalesce(F.col("_r.level"), F.lit("INFO")).alias("level"),
        F.coalesce(F.col("_r.message"), F.col("_j")).alias("message"),
        F.coalesce(F.col("_r.application_name"), F.lit("unknown-service")).alias("app_name"))
    return rec, rejects


def newest_per_partition(records: DataFrame, limit: int, partitions: int, partition: str = "partition",
                         offset: str = "offset", from_start: bool = False) -> DataFrame:
    """Capture sample: per topic partition the last ceil(limit/partitions)
    records (or the first ones from the start), then ``limit`` overall."""
    per = -(-limit // max(1, partitions))
    o = F.col(offset).asc() if from_start else F.col(offset).desc()
    ranked = records.withColumn("_rk", F.row_number().over(Window.partitionBy(partition).orderBy(o)))
    return ranked.where(F.col("_rk") <= per).drop("_rk").orderBy(partition, offset).limit(limit)
