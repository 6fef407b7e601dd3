"""Registered queries: rejection intake, model-output contract, validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import intake as I
from logsift.operators import policy as P
from logsift.operators.outcomes import TERMINAL_STATUSES
from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import table, v_casebook, v_rejection

_TERMINAL = ", ".join(f"'{s}'" for s in TERMINAL_STATUSES)


def _intake(spark, sf_dir):
    return I.parse_rejections(v_rejection(spark, sf_dir))


@query("rejection_poison", ov.with_views(ov.V_REJECTION) +
       " SELECT value AS raw_text, poison_reason FROM rj3 WHERE poison_reason IS NOT NULL")
def rejection_poison(spark, sf_dir):
    """Undecodable or structurally invalid topic values (to the DLQ)."""
    return _intake(spark, sf_dir)[1]


@query("rejection_intake", ov.with_views(ov.V_REJECTION, ov.V_CASEBOOK) + f"""
, ok AS (SELECT * FROM rj3 WHERE poison_reason IS NULL),
codes AS (
  SELECT msg_offset, eid, value,
    list_filter(json_extract_string(value, '$.packetExecutionSummary.errorData[*].errorReasonCode'),
                lambda c: coalesce(c, '') <> '')[1] AS first_reason_code
  FROM ok),
term AS (SELECT DISTINCT event_id FROM v_casebook WHERE status IN ({_TERMINAL}))
SELECT eid AS event_id, first_reason_code,
       json_extract_string(value, '$.packetMetaData.refId') AS ref_id,
       array_to_string(list_distinct_ordered, ',') AS search_ids,
       CASE WHEN coalesce(json_extract_string(value, '$.packetExecutionSummary.packetStatus'), '') <> 'REJECTED' THEN 'non-rejected packet'
            WHEN t.event_id IS NOT NULL THEN 'terminal casebook already exists' END AS skip_reason
FROM (SELECT *, list_filter([trim(eid), trim(json_extract_string(value, '$.packetMetaData.refId'))], lambda x: coalesce(x, '') <> '')
        AS list_distinct_ordered FROM codes) c
LEFT JOIN term t ON t.event_id = c.eid""")
def rejection_intake(spark, sf_dir):
    """Valid rejection messages: first reason code, search ids, skip reason."""
    good = I.narrow_payload(_intake(spark, sf_dir)[0])
    term = v_casebook(spark, sf_dir).where(F.col("status").isin(*TERMINAL_STATUSES)).select("event_id")
    e = I.eligibility(good, term)
    return e.select(F.col("eventId").alias("event_id"),
                    I.first_reason_code(F.col("packetExecutionSummary.errorData")).alias("first_reason_code"),
                    F.col("packetMetaData.refId").alias("ref_id"),
                    F.array_join(I.search_identifiers(F.col("eventId"), F.col("packetMetaData")), ",").alias("search_ids"),
                    "skip_reason")


def v_response(spark, sf_dir):
    """Model responses derived from assistant turns: fenced / bare / broken
    JSON with valid and invalid enum values and confidences."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    k = F.col("conv_id") * 7 + F.col("turn")
    acts = F.array(*[F.lit(a) for a in P.ACTIONS + ["REPLAY_PACKET"]])
    ras = F.array(*[F.lit(a) for a in P.RESIDENT_ACTIONS])
    body = F.concat(F.lit('{"rejection_description":"d","synthesis":"'), F.regexp_replace("text", '["\\\\\n]', " "),
                    F.lit('","action":"'), F.element_at(acts, (k % 7 + 1).cast("int")),
                    F.lit('","resident_action":"'), F.element_at(ras, (k % 4 + 1).cast("int")),
                    F.lit('","confidence":'), ((k % 12) / 10.0).cast("string"), F.lit("}"))
    text = (F.when(k % 5 == 0, F.concat(F.lit("Here is my answer:\n```json\n"), body, F.lit("\n```")))
            .when(k % 5 == 1, F.concat(F.lit("Result: "), body, F.lit(" done")))
            .when(k % 5 == 2, body)
            .when(k % 5 == 3, F.lit("I could not decide."))
            .otherwise(F.concat(F.lit("{\"action\": \"REPLAY\", broken"))))
    return c.select("conv_id", "turn", text.alias("response"), F.col("text").alias("source_text"))


@query("synthesis_contract")
def synthesis_contract(spark, sf_dir):
    """Model output checked against the contract, then gap cap / abstention."""
    chk = P.check_synthesis(v_response(spark, sf_dir))
    pol = P.confidence_policy(chk.withColumn("has_gap", F.col("turn") % 2 == 1), threshold=0.3)
    return pol.select("conv_id", "turn", "valid", F.array_join("errors", "; ").alias("errors"), "action",
                      "resident_action", "confidence", "policy_confidence", "abstained", "policy_action",
                      "policy_resident_action")


@query("text_validators")
def text_validators(spark, sf_dir):
    """Learning-rule and generic-text validators, reviewer approval test,
    over every conversation turn (whole texts)."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn",
                    F.array_join(P.validate_learning_rule(F.col("text")), " | ").alias("rule_violations"),
                    F.array_join(P.validate_generic_text(F.col("text"), F.array(F.col("role"))), " | ")
                    .alias("generic_violations"),
                    P.is_reviewer_approved(F.col("text")).alias("approved"))


_RESP_SQL = f"""
WITH c AS (SELECT *, conv_id * 7 + turn AS k FROM conversations WHERE role = 'assistant'),
b AS (
  SELECT *, '{{"rejection_description":"d","synthesis":"' || regexp_replace(text, '["\\\\\\n]', ' ', 'g')
         || '","action":"' || ({ov._sql_str(str(P.ACTIONS + ["REPLAY_PACKET"]).replace("'", '"'))}::JSON->>(CAST(k % 7 AS INTEGER)))
         || '","resident_action":"' || ({ov._sql_str(str(P.RESIDENT_ACTIONS).replace("'", '"'))}::JSON->>(CAST(k % 4 AS INTEGER)))
         || '","confidence":' || CAST((k % 12) / 10.0 AS VARCHAR) || '}}' AS body FROM c),
r AS (
  SELECT conv_id, turn, CASE k % 5 WHEN 0 THEN 'Here is my answer:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```'
                          WHEN 1 THEN 'Result: ' || body || ' done' WHEN 2 THEN body WHEN 3 THEN 'I could not decide.'
                          ELSE '{{"action": "REPLAY", broken' END AS response FROM b),
x AS (
  SELECT *, coalesce(nullif(regexp_extract(response, '(?s)```(?:json)?\\s*([\\{{\\[].*?[\\}}\\]])\\s*```', 1), ''),
                     nullif(regexp_extract(response, '(?s)(\\{{.*\\}})', 1), ''),
                     CASE WHEN starts_with(trim(response), '{{') OR starts_with(trim(response), '[') THEN trim(response) END) AS blk
  FROM r),
y0 AS (SELECT *, coalesce(starts_with(blk, '{{') AND json_valid(blk), false) AS obj FROM x),
y AS (SELECT *, CASE WHEN obj THEN blk END AS j FROM y0),
z AS (
  SELECT *, json_extract_string(j, '$.action') AS action,
            json_extract_string(j, '$.resident_action') AS resident_action,
            TRY_CAST(json_extract(j, '$.confidence') AS DOUBLE) AS confidence FROM y),
e AS (
  SELECT *, list_filter([CASE WHEN blk IS NULL THEN 'Response contained no JSON object.' END,
      CASE WHEN blk IS NOT NULL AND NOT obj THEN 'Response was not a JSON object.' END,
      CASE WHEN obj AND (action IS NULL OR action NOT IN {tuple(P.ACTIONS)}) THEN 'field ''action'': must be one of {", ".join(P.ACTIONS)}' END,
      CASE WHEN obj AND (resident_action IS NULL OR resident_action NOT IN {tuple(P.RESIDENT_ACTIONS)}) THEN 'field ''resident_action'': must be one of {", ".join(P.RESIDENT_ACTIONS)}' END,
      CASE WHEN obj AND (confidence < 0 OR confidence > 1) THEN 'field ''confidence'': must be between 0 and 1' END],
      lambda m: m IS NOT NULL) AS errs FROM z),
p AS (
  SELECT *, CASE WHEN turn % 2 = 1 AND confidence IS NOT NULL AND confidence > 0.6 THEN 0.6 ELSE confidence END AS pc FROM e)
SELECT conv_id, turn, len(errs) = 0 AS valid, array_to_string(errs, '; ') AS errors, action, resident_action, confidence,
       pc AS policy_confidence, coalesce(pc IS NOT NULL AND pc < 0.3, false) AS abstained,
       CASE WHEN coalesce(pc IS NOT NULL AND pc < 0.3, false) THEN 'MANUAL_REVIEW' ELSE action END AS policy_action,
       CASE WHEN coalesce(pc IS NOT NULL AND pc < 0.3, false) THEN 'PENDING' ELSE resident_action END AS policy_resident_action
FROM p"""

from logsift.plans.registry import ORACLES  # noqa: E402

ORACLES["synthesis_contract"] = _RESP_SQL

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31)"
_GEN = ("list_filter([CASE WHEN regexp_matches({t}, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') "
        "THEN 'Contains a UUID.' END, CASE WHEN regexp_matches({t}, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T\\s]\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?(?:Z|[+-]\\d{{2}}:?\\d{{2}})?') "
        "OR regexp_matches({t}, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') THEN 'Contains a timestamp or date literal.' END, "
        "CASE WHEN regexp_matches({t}, '\\d{{10,}}') THEN 'Contains a digit run of 10 or more (e.g. SRN, EID).' END], lambda v: v IS NOT NULL)")
_MARKERS = "[" + ", ".join(ov._sql_str(m) for m in P.INJECTION_MARKERS) + "]"
ORACLES["text_validators"] = f"""
WITH s AS (SELECT *, trim(coalesce(text, ''), {_WS}) AS t FROM conversations)
SELECT conv_id, turn,
  array_to_string(CASE WHEN t = '' THEN ['Rule is empty.'] ELSE
    list_concat(CASE WHEN length(t) > 500 THEN ['Rule is ' || CAST(length(t) AS VARCHAR) || ' characters; the limit is 500.'] ELSE [] END,
                list_transform(list_filter({_MARKERS}, lambda m: contains(lower(t), m)), lambda m: 'Contains instruction-shaped text: ''' || m || ''''),
                CASE WHEN contains(t, '```') THEN ['Contains a fenced code block.'] ELSE [] END,
                {_GEN.format(t='t')}) END, ' | ') AS rule_violations,
  array_to_string(list_concat({_GEN.format(t='text')},
                  CASE WHEN length(role) > 3 AND contains(text, role) THEN ['Contains source value: ' || role] ELSE [] END), ' | ') AS generic_violations,
  starts_with(upper(trim(trim(coalesce(text, ''), {_WS}), '*_`"'' ' || chr(9) || chr(10) || chr(13))), 'APPROVED') AS approved
FROM s"""
