"""Rejection-record intake: payload parse with a poison split, identifiers,
first reason code, eligibility against terminal casebooks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the behaviour being matched) -----------------
EVENT_ID_PATTERN = r"^[A-Za-z0-9_.:-]{1,128}$"
SEARCH_FIELDS = ["eventId", "refId"]
REJECTED = "REJECTED"
SKIP_NON_REJECTED = "non-rejected packet"
SKIP_TERMINAL = "terminal casebook already exists"
# ---------------------------------------------------------------------------

ERROR_DATA = T.ArrayType(T.StructType([T.StructField("type", T.StringType()),
                                       T.StructField("errorReasonCode", T.StringType())]))
MESSAGE_SCHEMA = T.StructType([
    T.StructField("eventId", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("eventType", T.StringType()), T.StructField("eventTimestamp", T.StringType()),
    T.StructField("sourceTopic", T.StringType()),
    T.StructField("flowMetaData", T.StructType([T.StructField("stage", T.StringType()),
                                                T.StructField("subStage", T.StringType())])),
    T.StructField("packetMetaData", T.StructType([T.StructField(n, T.StringType()) for n in
                                                  ["refId", "srn", "enrolmentType", "pktSource", "uid"]])),
    T.StructField("packetExecutionSummary", T.StructType([
        T.StructField("hasExecutionErrors", T.BooleanType()), T.StructField("hasValidationErrors", T.BooleanType()),
        T.StructField("packetStatus", T.StringType()), T.StructField("errorData", ERROR_DATA),
        T.StructField("isExecutionSuccess", T.BooleanType()), T.StructField("isValidationSuccess", T.BooleanType())])),
    T.StructField("_corrupt_record", T.StringType()),
])


def parse_rejections(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid messages, poison) from raw topic values.

    Poison: not a JSON object, an eventId failing the id pattern, or no
    packetExecutionSummary.  Poison rows keep the raw text and a reason.
    """
    parsed = raw.withColumn("msg", F.from_json(F.col(value), MESSAGE_SCHEMA,
                                               {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    obj = F.coalesce(F.trim(F.col(value)).startswith("{") & F.json_object_keys(F.col(value)).isNotNull(), F.lit(False))
    eid = F.col("msg.eventId")
    reason = (F.when(~obj, F.lit("payload is not a JSON object"))
              .when(eid.isNull(), F.lit("eventId missing"))
              .when(~eid.rlike(EVENT_ID_PATTERN), F.lit("eventId does not match the id pattern"))
              .when(F.col("msg.packetExecutionSummary").isNull(), F.lit("packetExecutionSummary missing")))
    tagged = parsed.withColumn("poison_reason", reason)
    poison = tagged.where(F.col("poison_reason").isNotNull()).select(F.col(value).alias("raw_text"), "poison_reason")
    good = tagged.where(F.col("poison_reason").isNull()).select("msg.*").drop("_corrupt_record")
    return good, poison


def first_reason_code(error_data: Column) -> Column:
    """First non-empty errorReasonCode of an error array."""
    hits = F.filter(F.coalesce(error_data, F.array().cast(ERROR_DATA)),
                    lambda e: F.coalesce(e["errorReasonCode"], F.lit("")) != "")
    return F.try_element_at(hits, F.lit(1))["errorReasonCode"]


def search_identifiers(msg_id: Column, meta: Column, fields: Sequence[str] = tuple(SEARCH_FIELDS),
                       top: Column | None = None) -> Column:
    """Correlation ids for log search: configured fields, packetMetaData
    before the top level, distinct, first occurrence kept, blanks dropped."""
    vals = []
    for f in fields:
        vals.append(F.trim(meta.getField(f)) if f in ("refId", "srn", "enrolmentType", "pktSource", "uid") else F.lit(None))
        if f == "eventId":
            vals.append(F.trim(msg_id))
    arr = F.array_compact(F.array(*[F.nullif(v.cast("string"), F.lit("")) for v in vals]))
    return F.array_distinct(arr)


def eligibility(messages: DataFrame, terminal_ids: DataFrame, id_col: str = "eventId") -> DataFrame:
    """skip_reason: non-rejected packet, or a terminal casebook already
    exists (left join on the id -- a semi/anti split without a second scan)."""
    t = terminal_ids.select(F.col("event_id").alias("_tid")).distinct().withColumn("_term", F.lit(True))
    j = messages.join(t, messages[id_col] == F.col("_tid"), "left")
    reason = (F.when(F.coalesce(F.col("packetExecutionSummary.packetStatus"), F.lit("")) != REJECTED,
                     F.lit(SKIP_NON_REJECTED))
              .when(F.col("_term"), F.lit(SKIP_TERMINAL)))
    return j.withColumn("skip_reason", reason).drop("_tid", "_term")


def narrow_payload(messages: DataFrame) -> DataFrame:
    """The four payload fields the analysis reads (nested pruning applies)."""
    return messages.select("eventId", "flowMetaData", "packetMetaData", "packetExecutionSummary")


def lookup_residents(keys: DataFrame, residents: DataFrame, srn: str = "srn", uid: str = "uid") -> DataFrame:
    """Resident rows per request: by SRN first, else by UID (two equi-joins,
    the SRN match taking priority)."""
    r = residents.select([F.col(c).alias(f"r_{c}") for c in residents.columns])
    by_srn = keys.join(r, keys[srn].isNotNull() & (keys[srn] == F.col(f"r_{srn}")), "left") \
        .withColumn("_hit", F.col(f"r_{srn}").isNotNull())
    has_srn = by_srn.where("_hit").select(*keys.columns).distinct()
    rest = keys.join(has_srn, list(keys.columns), "left_anti")
    by_uid = rest.join(r, rest[uid].isNotNull() & (rest[uid] == F.col(f"r_{uid}")), "left") \
        .withColumn("matched_by", F.when(F.col(f"r_{uid}").isNotNull(), F.lit("uid")))
    return (by_srn.where("_hit").drop("_hit").withColumn("matched_by", F.lit("srn"))
            .unionByName(by_uid, allowMissingColumns=True))
