"""Registered queries: rules, runbooks and their joins to casebooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import rules as R
from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import reason_codes, v_casebook, v_rule, v_runbook

_NORM_TYPE = ("CASE upper(trim({x})) WHEN 'U' THEN 'UPDATE' WHEN 'UPDATE' THEN 'UPDATE' WHEN 'E' THEN 'ENROLMENT' "
              "WHEN 'ENROLMENT' THEN 'ENROLMENT' WHEN 'ENROLLMENT' THEN 'ENROLMENT' END")


@query("rule_lookup", ov.with_views(ov.V_CASEBOOK, ov.V_RULE) + f"""
, j AS (
  SELECT c.event_id, r.*, {_NORM_TYPE.format(x='c.enrolment_type')} AS target,
         json_valid(r.rule_data) AS parsed,
         CASE WHEN json_valid(r.rule_data) THEN json_extract_string(r.rule_data, '$.statement.Condition.StringEquals.enrolmentType') END AS rtype
  FROM v_casebook c JOIN v_rule r ON r.reject_reason_code = c.reason_code),
k AS (SELECT *, coalesce(target IS NULL OR NOT parsed OR coalesce(rtype, '') = '' OR rtype = target, true) AS keep FROM j),
a AS (SELECT event_id, bool_or(keep) AS any_keep FROM k GROUP BY event_id)
SELECT event_id, reject_reason_code AS matched_code, rule_pos, rule_description, is_active, rule_data
FROM k JOIN a USING (event_id) WHERE keep OR NOT any_keep""")
def rule_lookup(spark, sf_dir):
    """Rules per casebook: by reason code, then by enrolment type or untyped,
    falling back to every rule of the code."""
    out = R.rules_for_cases(v_casebook(spark, sf_dir), v_rule(spark, sf_dir))
    return out.select("event_id", F.col("reject_reason_code").alias("matched_code"), "rule_pos",
                      "rule_description", "is_active", "rule_data")


@query("runbook_match", ov.with_views(ov.V_CASEBOOK, ov.V_RUNBOOK) + """
, ct AS (SELECT *, CASE WHEN coalesce(upper(trim(enrolment_type)), '') = '' THEN 'ANY' ELSE upper(trim(enrolment_type)) END AS case_type
         FROM v_casebook),
j AS (
  SELECT ct.event_id, r.runbook_id, r.version, r.rule_fingerprint, r.action, r.rb_type,
         CASE WHEN r.rb_type = ct.case_type THEN 0 ELSE 1 END AS rnk
  FROM ct JOIN v_rb_valid r ON r.reason_code = ct.reason_code AND (r.rb_type = ct.case_type OR r.rb_type = 'ANY')),
best AS (SELECT event_id, arg_min({'id': runbook_id, 'v': version, 'fp': rule_fingerprint, 'a': action, 't': rb_type},
                                  (rnk, -version, runbook_id)) AS b FROM j GROUP BY event_id)
SELECT c.event_id, c.reason_code, c.enrolment_type, c.agent_action, b.b.id AS runbook_id, b.b.v AS runbook_version,
       b.b.t AS runbook_type, b.b.a AS runbook_action,
       CASE WHEN b.b.id IS NOT NULL THEN c.agent_action IS NOT DISTINCT FROM b.b.a END AS shadow_agreed
FROM v_casebook c LEFT JOIN best b USING (event_id)""")
def runbook_match(spark, sf_dir):
    """Runbook per casebook (exact type, else ANY) and shadow agreement with
    the agent's action."""
    m = R.match_runbooks(v_casebook(spark, sf_dir), v_runbook(spark, sf_dir))
    m = R.shadow_comparison(m.drop("shadow_agreed"))
    return m.select("event_id", "reason_code", "enrolment_type", "agent_action", "runbook_id", "runbook_version",
                    "runbook_type", "runbook_action", "shadow_agreed")


def current_fingerprints(spark, sf_dir):
    rb = R.valid_runbooks(v_runbook(spark, sf_dir)).select("reason_code", R.runbook_type(F.col("enrolment_type"))
                                                           .alias("rule_type")).distinct()
    keys = rb.select(F.concat_ws("__", "reason_code", "rule_type").alias("event_id"), "reason_code",
                     F.when(F.col("rule_type") == "ANY", F.lit(None)).otherwise(F.col("rule_type")).alias("enrolment_type"))
    rows = R.rules_for_cases(keys, v_rule(spark, sf_dir))
    fp = R.rule_fingerprint(rows, ["event_id"], ["reject_reason_code", "rule_description", "is_active", "rule_data"],
                            "rule_pos")
    return fp.select(F.substring_index("event_id", "__", 1).alias("reason_code"),
                     F.substring_index("event_id", "__", -1).alias("rule_type"), "rule_fingerprint")


@query("runbook_staleness", ov.with_views(ov.V_RUNBOOK, ov.V_RULE) + f"""
, keys AS (SELECT DISTINCT reason_code, rb_type FROM v_rb_valid),
j AS (
  SELECT k.reason_code, k.rb_type, r.*, CASE WHEN k.rb_type = 'ANY' THEN NULL ELSE {_NORM_TYPE.format(x='k.rb_type')} END AS target,
         json_valid(r.rule_data) AS parsed,
         CASE WHEN json_valid(r.rule_data) THEN json_extract_string(r.rule_data, '$.statement.Condition.StringEquals.enrolmentType') END AS rtype
  FROM keys k JOIN v_rule r ON r.reject_reason_code = k.reason_code),
kk AS (SELECT *, coalesce(target IS NULL OR NOT parsed OR coalesce(rtype, '') = '' OR rtype = target, true) AS keep FROM j),
a AS (SELECT reason_code, rb_type, bool_or(keep) AS any_keep FROM kk GROUP BY ALL),
fp AS (
  SELECT reason_code, rb_type, 'sha256:' || sha256(to_json(list({{'is_active': is_active, 'reject_reason_code': reject_reason_code,
           'rule_data': rule_data, 'rule_description': rule_description}} ORDER BY rule_pos))) AS current_fingerprint
  FROM kk JOIN a USING (reason_code, rb_type) WHERE keep OR NOT any_keep GROUP BY ALL)
SELECT r.runbook_id, r.reason_code, r.enrolment_type, r.rule_fingerprint, fp.current_fingerprint,
       CASE WHEN fp.current_fingerprint IS NULL THEN 'MISSING_RULE' WHEN fp.current_fingerprint <> r.rule_fingerprint THEN 'STALE'
            ELSE 'CURRENT' END AS staleness
FROM v_rb_valid r LEFT JOIN fp ON fp.reason_code = r.reason_code AND fp.rb_type = r.rb_type""")
def runbook_staleness(spark, sf_dir):
    """Final runbooks whose rule fingerprint no longer matches the rules."""
    return R.runbook_staleness(v_runbook(spark, sf_dir), current_fingerprints(spark, sf_dir))


@query("runbook_promotion", ov.with_views(ov.V_RUNBOOK) + """
, nt AS (SELECT *, CASE WHEN coalesce(upper(trim(enrolment_type)), '') = '' THEN 'ANY' ELSE upper(trim(enrolment_type)) END AS kt
         FROM v_runbook),
cur AS (SELECT reason_code, kt, max(version) AS existing FROM nt WHERE status = 'final' GROUP BY ALL)
SELECT d.runbook_id, d.reason_code, d.enrolment_type, 'final' AS status,
       CAST(coalesce(cur.existing, 0) + 1 AS INTEGER) AS version, 'operator' AS approved_by
FROM nt d LEFT JOIN cur ON cur.reason_code = d.reason_code AND cur.kt = d.kt
WHERE d.status = 'draft' AND d.schema_version = '1.1'""")
def runbook_promotion(spark, sf_dir):
    """Approved drafts (here: drafts on the current schema) promoted to final
    with version = existing final + 1."""
    rb = v_runbook(spark, sf_dir)
    drafts = rb.where(F.col("status") == "draft")
    approved = drafts.where(F.col("schema_version") == "1.1").select("runbook_id")
    out = R.promote_drafts(drafts, approved, rb.where(F.col("status") == "final"), F.lit("operator"),
                           F.lit(None).cast("timestamp"))
    return out.select("runbook_id", "reason_code", "enrolment_type", "status", "version", "approved_by")


@query("code_descriptions", ov.with_views(ov.V_CASEBOOK) + """
SELECT DISTINCT reason_code AS code, 'Unknown error code.' AS description FROM v_casebook""")
def code_descriptions(spark, sf_dir):
    """Reason code -> published description (default text on a miss)."""
    codes = v_casebook(spark, sf_dir).select(F.col("reason_code").alias("code")).distinct()
    return R.describe_codes(codes, reason_codes(spark))


_SRC_SQL = """
WITH src AS (
  SELECT 'Codes.java' AS file, p_partkey AS line_no,
    CASE WHEN p_partkey % 50 = 1 THEN '// ## Stage ' || CAST(p_partkey // 50 AS VARCHAR) || ' :: DONE'
         WHEN p_partkey % 10 = 2 THEN '// Section ' || CAST(p_partkey // 10 AS VARCHAR)
         WHEN p_partkey % 37 = 3 THEN '// ' || e
         WHEN p_partkey = 1000 THEN '    private static Map tempMap = new HashMap<>();'
         WHEN p_partkey > 1000 THEN m ELSE e END AS line
  FROM (SELECT *, '    CODE_' || CAST(p_partkey % 700 AS VARCHAR) || '("CODE_' || CAST(p_partkey % 700 AS VARCHAR) || '", "'
                  || replace(p_name, '"', '') || '", ReasonCategory.' || ['BUSINESS_VALIDATION_ERROR', 'BUSINESS_EXCEPTION', 'TECHNICAL_EXCEPTION'][p_partkey % 3 + 1] || '),' AS e,
               '        tempMap.put(' || ['17', '37', '12', '23'][p_partkey % 4 + 1] || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0')
                  || ', new ReasonCode("CODE_' || CAST(p_partkey % 700 AS VARCHAR) || '", "' || replace(p_name, '"', '') || '"));' AS m
        FROM part)),
s1 AS (
  SELECT *, trim(line) AS st, CASE WHEN contains(line, 'tempMap = new HashMap') THEN 1 ELSE 0 END AS is_marker FROM src),
s2 AS (
  SELECT *, coalesce(sum(is_marker) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mb FROM s1),
s3 AS (
  SELECT *, is_marker = 1 AND mb = 0 AS first_marker, CASE WHEN mb > 0 OR (is_marker = 1 AND mb = 0) THEN 1 ELSE 0 END AS blk,
         starts_with(st, '//') AS is_comment,
         starts_with(st, '//') AND (contains(st, 'tempMap.put') OR regexp_matches(regexp_replace(st, '^/+', ''), '^\\s*([A-Z][A-Z0-9_]*)\\s*\\(\\s*"([^"]+)"\\s*,\\s*"([^"]*)"\\s*,\\s*((?:Error)?ReasonCategory)\\.([A-Z_]+)\\s*\\)')) AS commented,
         regexp_extract(st, '^//\\s*##\\s*(.+?)\\s*$', 1) AS stage_txt FROM s2),
s4 AS (
  SELECT *, CASE WHEN is_comment AND NOT commented AND stage_txt <> '' THEN trim(split_part(trim(stage_txt), '::', 1)) END AS stage_set,
            CASE WHEN is_comment AND NOT commented AND stage_txt = '' THEN trim(split_part(trim(regexp_replace(st, '^/+', '')), '::', 1)) END AS section_set,
            first_marker OR is_comment AS skip FROM s3),
s5 AS (
  SELECT *, sum(CASE WHEN stage_set IS NOT NULL OR first_marker THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seg FROM s4),
s6 AS (
  SELECT *, coalesce(last_value(stage_set IGNORE NULLS) OVER (PARTITION BY file, blk ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS stage,
            coalesce(last_value(section_set IGNORE NULLS) OVER (PARTITION BY file, seg ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS section
  FROM s5),
body AS (SELECT * FROM s6 WHERE NOT skip),
en AS (
  SELECT regexp_extract(line, '^\\s*([A-Z][A-Z0-9_]*)\\s*\\(\\s*"([^"]+)"\\s*,\\s*"([^"]*)"\\s*,\\s*((?:Error)?ReasonCategory)\\.([A-Z_]+)\\s*\\)', 2) AS code,
         trim(regexp_extract(line, '^\\s*([A-Z][A-Z0-9_]*)\\s*\\(\\s*"([^"]+)"\\s*,\\s*"([^"]*)"\\s*,\\s*((?:Error)?ReasonCategory)\\.([A-Z_]+)\\s*\\)', 3)) AS description,
         regexp_extract(line, '^\\s*([A-Z][A-Z0-9_]*)\\s*\\(\\s*"([^"]+)"\\s*,\\s*"([^"]*)"\\s*,\\s*((?:Error)?ReasonCategory)\\.([A-Z_]+)\\s*\\)', 5) AS category,
         stage, section, line_no
  FROM body WHERE regexp_matches(line, '^\\s*([A-Z][A-Z0-9_]*)\\s*\\(\\s*"([^"]+)"\\s*,\\s*"([^"]*)"\\s*,\\s*((?:Error)?ReasonCategory)\\.([A-Z_]+)\\s*\\)')),
mp AS (
  SELECT regexp_extract(line, '^\\s*tempMap\\.put\\(\\s*(\\d+)\\s*,\\s*new ReasonCode\\(\\s*"([^"]+)"\\s*,\\s*"([^"]*)"\\s*\\)\\s*\\)', 2) AS code,
         trim(regexp_extract(line, '^\\s*tempMap\\.put\\(\\s*(\\d+)\\s*,\\s*new ReasonCode\\(\\s*"([^"]+)"\\s*,\\s*"([^"]*)"\\s*\\)\\s*\\)', 3)) AS description,
         regexp_extract(line, '^\\s*tempMap\\.put\\(\\s*(\\d+)\\s*,\\s*new ReasonCode\\(\\s*"([^"]+)"\\s*,\\s*"([^"]*)"\\s*\\)\\s*\\)', 1) AS numeric_id,
         stage, section, line_no
  FROM body WHERE regexp_matches(line, '^\\s*tempMap\\.put\\(\\s*(\\d+)\\s*,\\s*new ReasonCode\\(\\s*"([^"]+)"\\s*,\\s*"([^"]*)"\\s*\\)\\s*\\)')),
e AS (SELECT code, arg_max({'d': description, 'c': category, 's': stage, 'x': section}, line_no) AS r FROM en GROUP BY code),
m AS (SELECT code, arg_min({'d': description, 'n': numeric_id, 's': stage, 'x': section}, line_no) AS r,
             arg_max(numeric_id, line_no) AS last_id FROM mp GROUP BY code),
j AS (SELECT coalesce(e.code, m.code) AS code, e.r AS er, m.r AS mr, m.last_id,
             CASE substr(m.r.n, 1, 2) WHEN '17' THEN 'BUSINESS_EXCEPTION' WHEN '37' THEN 'TECHNICAL_EXCEPTION'
                  WHEN '12' THEN 'TECHNICAL_EXCEPTION' ELSE '' END AS inferred
      FROM e FULL OUTER JOIN m ON e.code = m.code),
k AS (SELECT *, CASE WHEN er IS NOT NULL THEN er.c ELSE inferred END AS category FROM j)
SELECT code, CASE WHEN er IS NOT NULL THEN er.d ELSE mr.d END AS description, category,
       CASE WHEN er IS NOT NULL THEN 'declared' WHEN inferred <> '' THEN 'inferred' ELSE '' END AS category_source,
       CASE category WHEN 'BUSINESS_VALIDATION_ERROR' THEN 'A' WHEN 'BUSINESS_EXCEPTION' THEN 'A' WHEN 'TECHNICAL_EXCEPTION' THEN 'C' ELSE '' END AS failure_class,
       CASE WHEN er IS NOT NULL THEN er.s ELSE mr.s END AS stage, CASE WHEN er IS NOT NULL THEN er.x ELSE mr.x END AS section,
       coalesce(last_id, '') AS numeric_id
FROM k"""


@query("codes_from_source", _SRC_SQL)
def codes_from_source(spark, sf_dir):
    """Reason-code catalog extracted from source text: declared enum rows,
    inferred id-map rows, carried stage/section context, merged on code."""
    from logsift.operators.catalogs import codes_from_source as cfs
    from logsift.plans.views import v_code_source
    return cfs(v_code_source(spark, sf_dir)).drop("_order")


@query("casebook_groups", ov.with_views(ov.V_CASEBOOK) + """
, clean AS (SELECT *, upper(trim(enrolment_type)) AS t FROM v_casebook
            WHERE status IN ('COMPLETED', 'REJECTED') AND NOT contains(coalesce(synthesis, ''), 'ESCALATED TO HUMAN REVIEW')
              AND reason_code IS NOT NULL AND enrolment_type IS NOT NULL),
g AS (SELECT reason_code, t AS enrolment_type, count(*) AS samples,
             array_to_string(list_sort(list(event_id ORDER BY event_id)[1:5]), ',') AS example_ids FROM clean GROUP BY ALL)
SELECT * FROM g WHERE samples >= 3""")
def casebook_groups(spark, sf_dir):
    """Clean terminal casebooks grouped by (code, type) with >= 3 samples and
    five example ids (the drafting input; drafting itself is a model call)."""
    g = R.group_casebooks(v_casebook(spark, sf_dir))
    return g.select("reason_code", "enrolment_type", "samples", F.array_join("example_ids", ",").alias("example_ids"))
