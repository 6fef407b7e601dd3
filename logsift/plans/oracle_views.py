"""The test views of ``views.py`` restated as DuckDB SQL (for the oracle)."""

from __future__ import annotations

V_LOG = """
v_log AS (
  SELECT 'flow-' || CAST(user_id AS VARCHAR) AS flow_id,
         event_id AS line_id,
         ts,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning'
              WHEN 'click' THEN 'debug' WHEN 'purchase' THEN 'INFO' ELSE 'info' END AS level_raw,
         'svc-' || CAST(event_id % 3 AS VARCHAR) AS app_name,
         'pod-' || CAST(event_id % 5 AS VARCHAR) AS pod_name,
         '1' || lpad(CAST(user_id AS VARCHAR), 11, '0') AS ref_id,
         event_type || ' value=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
           || ' k=' || json_extract_string(props, '$.k')
           || CASE event_id % 10
                WHEN 0 THEN CASE (event_id // 10) % 5
                  WHEN 0 THEN ' refId=1' || lpad(CAST(user_id AS VARCHAR), 11, '0')
                  WHEN 1 THEN ' failed for 1' || lpad(CAST(user_id AS VARCHAR), 11, '0') || '.'
                  WHEN 2 THEN ' id:1' || lpad(CAST(user_id AS VARCHAR), 11, '0') || ':failed'
                  WHEN 3 THEN ' svc-1' || lpad(CAST(user_id AS VARCHAR), 11, '0') || ' x'
                  ELSE ' run91' || lpad(CAST(user_id AS VARCHAR), 11, '0') || '7' END
                WHEN 1 THEN ' mobile 9' || lpad(CAST(event_id % 1000000000 AS VARCHAR), 9, '0')
                WHEN 2 THEN ' vid ' || lpad(CAST(event_id AS VARCHAR), 16, '4')
                WHEN 3 THEN ' aadhaar 2345 6789 ' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')
                WHEN 4 THEN ' contact user' || CAST(user_id AS VARCHAR) || '@example.org'
                WHEN 5 THEN ' decision: packet status REJECTED'
                ELSE '' END AS message
  FROM events)"""

# v_log regrouped into long, quiet and short flows (views.v_flow_log); named v_log for V_REC.
V_FLOW_LOG = V_LOG.replace("v_log AS (", "v_log0 AS (") + """,
v_flow AS (SELECT *, CAST(substr(ref_id, 2) AS BIGINT) AS usr FROM v_log0),
v_log AS (
  SELECT * EXCLUDE (usr) REPLACE (
    CASE WHEN usr % 12 < 8 THEN 'flow-long-' || CAST(usr // 24 AS VARCHAR)
         WHEN usr % 12 < 10 THEN flow_id || '-' || CAST(line_id % 2 AS VARCHAR) ELSE flow_id END AS flow_id,
    CASE WHEN level_raw = 'error' AND (usr % 12 >= 10 OR (usr % 12 < 8 AND day(ts) NOT BETWEEN 12 AND 18)) THEN 'warning'
         ELSE level_raw END AS level_raw)
  FROM v_flow)"""

# Level normalisation + redaction of v_log (allow-list: flow_id, ref_id).
_RX = {
    "vid": r"\b\d{16}\b",
    "aad1": r"\b\d{4}[ -]\d{4}[ -]\d{4}\b",
    "aad2": r"\b\d{12}\b",
    "mob": r"\b[6-9]\d{9}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}


def _norm_level(col: str) -> str:
    return (f"CASE upper(trim({col})) WHEN 'WARNING' THEN 'WARN' WHEN 'FATAL' THEN 'ERROR' "
            f"WHEN 'CRITICAL' THEN 'ERROR' WHEN 'SEVERE' THEN 'ERROR' "
            f"ELSE CASE WHEN upper(trim({col})) IN ('CRITICAL','ERROR','WARNING','WARN','INFO','DEBUG','TRACE','FATAL') "
            f"THEN upper(trim({col})) END END")


V_REC = f"""
r0 AS (
  SELECT *, CASE WHEN ref_id IS NOT NULL AND ref_id <> '' THEN replace(message, ref_id, '#ALLOW1#') ELSE message END AS m0
  FROM v_log),
r1 AS (SELECT *, len(regexp_extract_all(m0, '{_RX['vid']}')) AS c_vid,
              regexp_replace(m0, '{_RX['vid']}', '[REDACTED:VID]', 'g') AS m1 FROM r0),
r2 AS (SELECT *, len(regexp_extract_all(m1, '{_RX['aad1']}')) AS c_a1,
              regexp_replace(m1, '{_RX['aad1']}', '[REDACTED:AADHAAR]', 'g') AS m2 FROM r1),
r3 AS (SELECT *, len(regexp_extract_all(m2, '{_RX['aad2']}')) AS c_a2,
              regexp_replace(m2, '{_RX['aad2']}', '[REDACTED:AADHAAR]', 'g') AS m3 FROM r2),
r4 AS (SELECT *, len(regexp_extract_all(m3, '{_RX['mob']}')) AS c_mob,
              regexp_replace(m3, '{_RX['mob']}', '[REDACTED:MOBILE]', 'g') AS m4 FROM r3),
r5 AS (SELECT *, len(regexp_extract_all(m4, '{_RX['email']}')) AS c_email,
              regexp_replace(m4, '{_RX['email']}', '[REDACTED:EMAIL]', 'g') AS m5 FROM r4),
v_rec AS (
  SELECT flow_id, line_id, ts, timestamp, app_name, pod_name, ref_id,
         coalesce({_norm_level('level_raw')}, 'INFO') AS level,
         CASE WHEN ref_id IS NOT NULL AND ref_id <> '' THEN replace(m5, '#ALLOW1#', ref_id) ELSE m5 END AS message,
         c_vid, c_a1 + c_a2 AS c_aadhaar, c_mob, c_email
  FROM r5)"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _cents(c: str) -> str:
    return f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)"


_LVL = ("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'click' THEN 'debug' "
        "WHEN 'purchase' THEN 'Info' ELSE 'info' END")

V_RAW_LINE = f"""
v_raw_line AS (
  SELECT 'ns-' || CAST(user_id % 3 AS VARCHAR) AS namespace,
         'pod-' || CAST(user_id % 10 AS VARCHAR) AS pod,
         CASE WHEN event_id % 9 = 0 THEN 'previous' ELSE 'current' END AS instance,
         event_id AS line_id, ts,
         CASE WHEN event_id % 50 = 7 THEN ''
              WHEN event_id % 50 = 11 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '123Z' || ' [1,2]'
              WHEN event_id % 50 = 13 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '123Z' || ' {{"level": "ERROR", broken '
              WHEN event_id % 4 = 3 THEN
                '{{"severity":"' || {_LVL} || '","msg":"' || event_type || ' value=' || {_cents('value')} || ' user=' || CAST(user_id AS VARCHAR)
                || '","service":"svc-' || CAST(event_id % 3 AS VARCHAR) || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}}'
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '123Z' || ' ' ||
                CASE event_id % 4
                  WHEN 0 THEN '{{"@timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","level":"' || {_LVL}
                    || '","message":"' || event_type || ' value=' || {_cents('value')} || ' user=' || CAST(user_id AS VARCHAR)
                    || '","application_name":"svc-' || CAST(event_id % 3 AS VARCHAR) || '"}}'
                  WHEN 1 THEN upper({_LVL}) || ' [main] ' || event_type || ' value=' || {_cents('value')} || ' user=' || CAST(user_id AS VARCHAR)
                  ELSE 'processed ' || event_type || ' value=' || {_cents('value')} || ' user=' || CAST(user_id AS VARCHAR)
                END
         END AS line
  FROM events)"""

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_KUB = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))\s+"


def _first_json(col: str, keys: list[str]) -> str:
    parts = [f"nullif(json_extract_string({col}, '$.\"{k}\"'), '')" for k in keys]
    return "coalesce(" + ", ".join(parts) + ")"


def _is_obj(col: str) -> str:
    guarded = f"CASE WHEN starts_with({col}, '{{') AND json_valid({col}) THEN {col} END"
    return f"coalesce(json_type({guarded}) = 'OBJECT', false)"


LEVEL_TOKEN = r"(?i)\b(CRITICAL|ERROR|WARNING|WARN|INFO|DEBUG|TRACE|FATAL|SEVERE)\b"

V_PARSED = f"""
p0 AS (
  SELECT *, nullif(regexp_extract(line, '{_KUB}', 1), '') AS kts,
         {_STRIP.format(x=f"regexp_replace(line, '{_KUB}', '')")} AS rest
  FROM v_raw_line WHERE {_STRIP.format(x='line')} <> ''),
p1a AS (
  SELECT *, {_is_obj('rest')} AS was_json FROM p0),
p1 AS (
  SELECT *, CASE WHEN was_json THEN rest END AS j FROM p1a),
p2 AS (
  SELECT *,
    coalesce({_norm_level(_first_json('j', ['level', 'severity', 'log_level', 'loglevel', 'lvl']))},
             {_norm_level(f"nullif(regexp_extract(substr(rest, 1, 80), '{LEVEL_TOKEN}', 1), '')")}) AS lvl
  FROM p1),
v_parsed AS (
  SELECT namespace, pod, instance, line_id, ts,
    coalesce(kts, {_first_json('j', ['@timestamp', 'timestamp', 'time', 'ts'])}, '') AS timestamp,
    coalesce(lvl, 'INFO') AS level,
    CASE WHEN was_json THEN coalesce({_first_json('j', ['message', 'msg', 'log', 'text'])}, rest) ELSE rest END AS message,
    CASE WHEN was_json THEN coalesce({_first_json('j', ['application_name', 'app', 'service', 'logger_name', 'service_name'])}, 'unknown-service')
         ELSE 'unknown-service' END AS app_name,
    lvl IS NOT NULL AS level_parsed, was_json
  FROM p2)"""


V_DUMP_LINE = """
v_dump_line AS (
  SELECT 'dump-' || CAST(user_id % 5 AS VARCHAR) || '.log' AS file,
         CAST(trunc(event_id / 1000) AS BIGINT) AS chunk, event_id AS line_no,
         CASE event_id % 6
           WHEN 0 THEN '{"@timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","message":"' || event_type
                 || ' value=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '","application_name":"App_'
                 || CAST(event_id % 3 AS VARCHAR) || '","HOSTNAME":"Host-' || CAST(user_id % 4 AS VARCHAR) || '.Pod"}'
           WHEN 1 THEN '"Jan 1, 2024 @ 00:00:00.000","{""timestamp"":""' || strftime(ts, '%Y-%m-%d %H:%M:%S')
                 || '"",""msg"":""' || event_type || ' value=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
                 || '"",""app"":""App_' || CAST(event_id % 3 AS VARCHAR) || '""}"'
           WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || event_type || ' value=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
           WHEN 3 THEN '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+05:30], ' || event_type || ' value=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
           WHEN 4 THEN '  select x from t where id=' || CAST(event_id AS VARCHAR)
           ELSE '   ' END AS line
  FROM events)"""

_RFC = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})"
_LEAD = r"^\[?(" + _RFC + r")\]?[\s,]*"


def _sanitise(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN 'unknown' ELSE {s} END"


def _first_json_nested(col: str, keys: list[str]) -> str:
    parts = []
    for k in keys:
        v = f"json_extract_string({col}, '$.\"{k}\"')"
        if "." in k:
            v = f"coalesce({v}, json_extract_string({col}, '$.{k}'))"
        parts.append(f"nullif({v}, '')")
    return "coalesce(" + ", ".join(parts) + ")"


def _norm_ts(x: str) -> str:
    t = f"trim({x})"
    parsed = f"TRY_CAST(regexp_replace({t}, 'Z$', '+00:00') AS TIMESTAMPTZ)"
    iso = (f"CASE WHEN microsecond({parsed}) % 1000000 = 0 THEN strftime({parsed} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') "
           f"ELSE strftime({parsed} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f+00:00') END")
    return (f"CASE WHEN coalesce({t}, '') = '' THEN '' WHEN regexp_full_match({t}, '{_RFC}') THEN {t} "
            f"ELSE coalesce({iso}, '') END")


V_DUMP = f"""
d0 AS (
  SELECT *, {_STRIP.format(x='line')} AS st FROM v_dump_line WHERE {_STRIP.format(x='line')} <> ''),
d1 AS (
  SELECT *, {_is_obj('st')} AS bare,
         replace(regexp_extract(st, '(?s)"(\\{{.*\\}})"\\s*(?:,|$)', 1), '""', '"') AS cand FROM d0),
d2 AS (
  SELECT *, CASE WHEN bare THEN st WHEN NOT starts_with(st, '{{') AND {_is_obj('cand')} THEN cand END AS p,
         nullif(regexp_extract(line, '{_KUB}', 1), '') AS kub,
         nullif(regexp_extract(line, '{_LEAD}', 1), '') AS lead FROM d1),
d3 AS (
  SELECT file, chunk, line_no,
    CASE WHEN p IS NOT NULL THEN 'json' WHEN kub IS NOT NULL THEN 'kubelet'
         WHEN lead IS NOT NULL THEN 'plain-dated' ELSE 'plain' END AS format,
    nullif(CASE WHEN p IS NOT NULL THEN {_norm_ts(_first_json_nested('p', ['@timestamp', 'timestamp', 'time', 'ts']))}
         WHEN kub IS NOT NULL THEN kub WHEN lead IS NOT NULL THEN lead ELSE '' END, '') AS ts_raw,
    nullif(trim({_first_json_nested('p', ['HOSTNAME', 'hostname', 'kubernetes.pod_name', 'pod_name', 'host'])}), '') AS pod_raw,
    nullif(trim({_first_json_nested('p', ['application_name', 'app', 'service', 'service_name'])}), '') AS app_raw,
    CASE WHEN p IS NOT NULL THEN p WHEN kub IS NOT NULL THEN regexp_replace(line, '{_KUB}', '')
         WHEN lead IS NOT NULL THEN regexp_replace(line, '{_LEAD}', '') ELSE line END AS body
  FROM d2),
d4 AS (
  SELECT *, last_value(ts_raw IGNORE NULLS) OVER (PARTITION BY file ORDER BY chunk, line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts_f FROM d3),
d5 AS (
  SELECT *, CASE WHEN pod_raw IS NOT NULL THEN {_sanitise('pod_raw')} END AS pod_s,
            CASE WHEN app_raw IS NOT NULL THEN {_sanitise('app_raw')} END AS app_s
  FROM d4 WHERE ts_f IS NOT NULL),
d6 AS (
  SELECT *, last_value(pod_s IGNORE NULLS) OVER w AS pod_f, last_value(app_s IGNORE NULLS) OVER w AS app_f
  FROM d5 WINDOW w AS (PARTITION BY file ORDER BY chunk, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d7 AS (
  SELECT *, first_value(app_f) OVER (PARTITION BY file ORDER BY chunk, line_no) AS first_app FROM d6),
v_dump AS (
  SELECT file, chunk, line_no, format, ts_f AS timestamp,
         coalesce(pod_f, {_sanitise("coalesce(first_app, 'unknown-service') || '-offline-0'")}) AS pod,
         coalesce(app_f, 'unknown-service') AS app, body, ts_f || ' ' || body AS out_line
  FROM d7)"""


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def v_deadletter_sql() -> str:
    from logsift.plans.dlt_fixture import TRACES, TYPE_A, TYPE_B
    traces = ", ".join(f"({i}, {_sql_str(t)})" for i, t in enumerate(TRACES))
    return f"""
dl_traces(i, t) AS (VALUES {traces}),
dl0 AS (
  SELECT e.*, epoch_us(ts) // 1000 AS ms,
         substr(md5('ref' || CAST(user_id AS VARCHAR)), 1, 24) AS ref,
         substr(md5('other' || CAST(event_id AS VARCHAR)), 1, 24) AS other,
         replace(t.t, '{{n}}', CAST(event_id % 97 + 1 AS VARCHAR)) AS trace
  FROM events e JOIN dl_traces t ON t.i = e.event_id % 8),
v_deadletter AS (
  SELECT 'enrolment.requests.dlt' AS dlt_topic, CAST(event_id % 4 AS INTEGER) AS dlt_partition,
         event_id AS dlt_offset, make_timestamp((ms + (event_id % 600) * 1000 + 250) * 1000) AS dlt_timestamp,
         ts, user_id, event_id,
         CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'bad key!' ELSE ref END AS key,
         CASE WHEN event_id % 23 <> 0 THEN
              CASE WHEN event_id % 97 = 0 THEN 'enrolment/' || repeat('very-long-topic-', 10) ELSE 'enrolment.requests' END
         END AS h_topic,
         CASE WHEN event_id % 23 <> 0 THEN ' ' || CAST(event_id % 6 AS VARCHAR) || ' ' END AS h_partition,
         CASE WHEN event_id % 23 <> 0 THEN CAST(event_id * 10 AS VARCHAR) END AS h_offset,
         CASE WHEN event_id % 19 = 0 THEN 'garbage' ELSE CAST(ms - 154800000 AS VARCHAR) END AS h_orig_ts,
         'grp-' || CAST(event_id % 2 AS VARCHAR) AS h_group,
         'org.springframework.kafka.listener.ListenerExecutionFailedException' AS h_fqcn,
         'java.lang.RuntimeException' AS h_cause,
         CASE WHEN event_id % 8 = 6 THEN '[SCORE_THRESHOLD_BREACH] score below threshold'
              WHEN event_id % 8 = 5 THEN 'Listener failed; nested [PACKET_STATUS_INVALID]'
              ELSE 'Listener failed' END AS h_msg,
         CASE WHEN event_id % 8 <> 6 THEN trace END AS h_trace,
         '3' AS h_attempts,
         hex(ms - 154800000) AS h_retry_orig,
         CASE WHEN event_id % 7 <> 0 THEN hex(ms) END AS h_backoff,
         CASE WHEN event_id % 2 = 0 THEN {_sql_str(TYPE_A)} ELSE {_sql_str(TYPE_B)} END AS h_type,
         CASE WHEN event_id % 13 = 0 THEN 'not json {{'
              WHEN event_id % 2 = 0 THEN '{{"event_id":"' || md5(CAST(event_id AS VARCHAR)) || '","response":{{"refId":"'
                 || CASE WHEN event_id % 11 = 0 THEN other ELSE ref END || '","requestId":"req-' || CAST(event_id AS VARCHAR)
                 || '","results":{{"referenceId":"' || CASE WHEN event_id % 11 = 0 THEN other ELSE ref END
                 || '","matches":[{{"engine":"E' || CAST(event_id % 3 AS VARCHAR) || '","candidates":[{{"candidateRefId":"c'
                 || CAST(event_id AS VARCHAR) || '","score":' || CAST(event_id % 100 AS VARCHAR) || '}}]}}]}}}}}}'
              ELSE '{{"eventId":"' || md5(CAST(event_id AS VARCHAR)) || '","data":{{"meta":{{"refId":"'
                 || CASE WHEN event_id % 11 = 0 THEN other ELSE ref END || '","flag":true}}}},"items":[{{"ref_id":"zz'
                 || CAST(event_id AS VARCHAR) || '"}}]}}'
         END AS payload
  FROM dl0)"""


def _dec_epoch(x: str) -> str:
    s = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    dec = f"CASE WHEN regexp_full_match({s}, '\\d{{1,18}}') THEN CAST({s} AS BIGINT) END"
    hx = (f"CASE WHEN regexp_full_match({s}, '[0-9A-Fa-f]{{1,15}}') THEN "
          f"CAST(('0x' || {s}) AS BIGINT) END")
    ok = "CASE WHEN {v} BETWEEN 946684800000 AND 4102444800000 THEN {v} END"
    return f"coalesce({ok.format(v=dec)}, {ok.format(v=hx)})"


def _as_str(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


def _as_int(x: str) -> str:
    s = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN regexp_full_match({s}, '[+-]?\\d{{1,18}}') THEN CAST({s} AS BIGINT) END"


def _case_id(topic: str, part: str, off: str) -> str:
    clean = f"regexp_replace({topic}, '[^A-Za-z0-9_.:-]', '-', 'g')"
    suffix = f"('-' || CAST({part} AS VARCHAR) || '-' || CAST({off} AS VARCHAR))"
    plain = f"('dlt-' || {clean} || {suffix})"
    room = f"greatest(0, 113 - length({suffix}))"
    cut = f"('dlt-' || substr({clean}, 1, {room}) || '-' || substr(sha256({topic}), 1, 10) || {suffix})"
    cid = f"(CASE WHEN length({plain}) > 128 THEN {cut} ELSE {plain} END)"
    return (f"CASE WHEN {topic} IS NOT NULL AND {part} IS NOT NULL AND {off} IS NOT NULL "
            f"AND regexp_full_match({cid}, '[A-Za-z0-9_.:-]{{1,128}}') THEN {cid} END")


def v_dlt_headers_sql() -> str:
    return f"""
dh0 AS (
  SELECT *, {_as_str('h_topic')} AS original_topic, {_as_int('h_partition')} AS original_partition,
         {_as_int('h_offset')} AS original_offset, {_dec_epoch('h_orig_ts')} AS original_timestamp_ms,
         {_as_str('h_group')} AS consumer_group, {_as_str('h_fqcn')} AS exception_fqcn,
         {_as_str('h_cause')} AS exception_cause_fqcn, {_as_str('h_msg')} AS exception_message,
         {_as_str('h_trace')} AS stacktrace, {_as_int('h_attempts')} AS attempts,
         {_dec_epoch('h_retry_orig')} AS retry_original_timestamp_ms, {_dec_epoch('h_backoff')} AS backoff_timestamp_ms,
         {_as_str('h_type')} AS type_id
  FROM v_deadletter),
v_dlt AS (
  SELECT *, coalesce(backoff_timestamp_ms, original_timestamp_ms) AS last_attempt_ms,
         backoff_timestamp_ms IS NULL AS anchor_is_fallback,
         coalesce({_case_id('original_topic', 'original_partition', 'original_offset')},
                  {_case_id('dlt_topic', 'dlt_partition', 'dlt_offset')}) AS case_id,
         CASE WHEN regexp_full_match({_as_str('key')}, '[A-Za-z0-9][A-Za-z0-9_.:-]{{7,127}}') THEN {_as_str('key')} END AS key_ref_id
  FROM dh0)"""


_FR = r"^\s*at\s+([^\s(]+)(?:\((.*)\))?\s*$"
_EL = r"^\s*\.\.\.\s+(\d+)\s+more\s*$"
_FQ = r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*$"
_SYN = (r"\$\$(?:SpringCGLIB|EnhancerBySpringCGLIB|FastClassBySpringCGLIB|Lambda)"
        r"|GeneratedMethodAccessor\d+|GeneratedConstructorAccessor\d+|\$Proxy\d+")
_CODE = r"\[([A-Z][A-Z0-9_]{2,})\]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def v_failures_sql(app_prefix: str = "com.example.app.", boiler: str = "com.example.app.common.ErrorFactory") -> str:
    from logsift.operators.deadletter import CLASS_BY_CATEGORY, DEFAULT_CLASS_MAP
    from logsift.plans.dlt_fixture import REASON_CODES
    cmap = ", ".join(f"({_sql_str(k)}, {_sql_str(v)})" for k, v in sorted(DEFAULT_CLASS_MAP.items()))
    rc = ", ".join("(" + ", ".join(_sql_str(x) for x in row) + ")" for row in REASON_CODES)
    by_cat = " ".join(f"WHEN {_sql_str(k)} THEN {_sql_str(v)}" for k, v in CLASS_BY_CATEGORY.items())
    return f"""
class_map(prefix, mapped_class) AS (VALUES {cmap}),
rc(code, description, category, category_source, failure_class, stage, section, numeric_id) AS (VALUES {rc}),
rc_cls AS (
  SELECT *, CASE WHEN upper(trim(failure_class)) IN ('A', 'C') THEN upper(trim(failure_class))
                 ELSE coalesce(CASE upper(trim(category)) {by_cat} END, '') END AS catalog_class FROM rc),
f0 AS (
  SELECT *, stacktrace IS NULL OR {_strip_sql('stacktrace')} = '' AS blank,
         string_split(stacktrace, chr(10) || 'Caused by: ') AS blocks FROM v_dlt),
f1 AS (
  SELECT *, CASE WHEN blank THEN 0 ELSE len(blocks) END AS chain_depth,
         string_split(blocks[-1], chr(10)) AS lines FROM f0),
f2 AS (
  SELECT *, list_position(list_transform(lines, lambda l: regexp_matches(l, '{_FR}') OR regexp_matches(l, '{_EL}')), true) AS fi,
         list_transform(list_filter(lines, lambda l: regexp_matches(l, '{_FR}')),
                        lambda l: regexp_replace(regexp_extract(l, '{_FR}', 1), '^[^/]*/', '')) AS raw_frames,
         list_filter(lines, lambda l: regexp_matches(l, '{_EL}')) AS el_lines FROM f1),
f3 AS (
  SELECT *, {_strip_sql("array_to_string(CASE WHEN fi IS NULL THEN lines ELSE lines[1:fi - 1] END, chr(10))")} AS hdr FROM f2),
f4 AS (
  SELECT *, instr(hdr, ': ') AS pos FROM f3),
f5 AS (
  SELECT *, CASE WHEN pos > 0 THEN substr(hdr, 1, pos - 1) ELSE hdr END AS cand,
            CASE WHEN pos > 0 THEN {_strip_sql('substr(hdr, pos + 2)')} ELSE '' END AS rest FROM f4),
f6 AS (
  SELECT *,
    CASE WHEN blank THEN NULL WHEN regexp_full_match(cand, '{_FQ}') AND hdr <> '' THEN cand ELSE '' END AS root_fqcn,
    CASE WHEN blank THEN '' WHEN regexp_full_match(cand, '{_FQ}') AND hdr <> '' THEN rest ELSE hdr END AS root_message,
    blank OR (len(raw_frames) = 0 AND len(el_lines) = 0) AS truncated,
    CASE WHEN blank THEN [] ELSE list_filter(raw_frames, lambda f: f <> '' AND starts_with(f, '{app_prefix}')
         AND NOT regexp_matches(f, '{_SYN}') AND NOT starts_with(f, '{boiler}')) END AS frames
  FROM f5),
f_map AS (
  SELECT root_fqcn, arg_max(mapped_class, length(prefix)) AS mapped_class
  FROM (SELECT DISTINCT root_fqcn FROM f6 WHERE root_fqcn <> '') d JOIN class_map ON starts_with(d.root_fqcn, prefix)
  GROUP BY root_fqcn),
f7 AS (
  SELECT f6.*, m.mapped_class,
    coalesce(root_fqcn, '') = '' AS no_root,
    (ends_with(coalesce(root_fqcn, ''), 'BusinessException') AND coalesce(root_fqcn, '') <> '') AS biz,
    nullif(regexp_extract(coalesce(exception_message, ''), '{_CODE}', 1), '') AS hdr_code,
    coalesce(nullif(regexp_extract(root_message, '{_CODE}', 1), ''),
             nullif(regexp_extract(coalesce(exception_message, ''), '{_CODE}', 1), '')) AS both_code
  FROM f6 LEFT JOIN f_map m USING (root_fqcn)),
f8 AS (
  SELECT *, CASE WHEN no_root THEN hdr_code WHEN biz OR mapped_class = 'A' THEN both_code END AS code,
            CASE WHEN no_root THEN hdr_code ELSE both_code END AS code_cand FROM f7),
f9 AS (
  SELECT f8.*, r.catalog_class, r.description, r.category, r.category_source, r.stage,
    coalesce(r.catalog_class, '') = 'C' AS cat_c
  FROM f8 LEFT JOIN rc_cls r ON r.code = f8.code_cand),
f10 AS (
  SELECT *,
    CASE WHEN no_root AND code IS NOT NULL AND cat_c THEN 'C' WHEN no_root AND code IS NOT NULL THEN 'A'
         WHEN no_root THEN 'U' WHEN biz AND code IS NOT NULL AND cat_c THEN 'C' WHEN biz THEN 'A'
         WHEN mapped_class = 'B' THEN 'B' WHEN mapped_class = 'C' THEN 'C' WHEN mapped_class = 'A' THEN 'A'
         ELSE 'U' END AS failure_class,
    CASE WHEN no_root AND code IS NOT NULL AND cat_c THEN 'stacktrace unparseable; code ' || code || ' recovered from the kafka_exception-message header and declared a technical fault by the reason-code catalog'
         WHEN no_root AND code IS NOT NULL THEN 'stacktrace unparseable; business code recovered from the kafka_exception-message header'
         WHEN no_root THEN 'stacktrace absent or unparseable'
         WHEN biz AND code IS NOT NULL AND cat_c THEN 'raised as a business exception, but the reason-code catalog declares ' || code || ' a technical fault'
         WHEN biz AND code IS NOT NULL THEN 'business exception carrying code ' || code
         WHEN biz THEN 'business exception with no enumerated code in its message'
         WHEN mapped_class = 'B' THEN 'code defect; no source access, so it is routed to the development team undiagnosed'
         WHEN mapped_class = 'C' THEN 'technical or transient fault'
         WHEN mapped_class = 'A' THEN 'mapped to business class by DLT_CLASS_MAP'
         ELSE 'unrecognised root exception ' || coalesce(root_fqcn, '') || '; add it to DLT_CLASS_MAP once its treatment is known' END AS class_reason
  FROM f9),
v_failures AS (
  SELECT *, CASE WHEN failure_class IN ('A', 'C') THEN code END AS business_code,
    CASE WHEN failure_class IN ('A', 'C') AND code IS NOT NULL AND code = code_cand THEN description END AS registry_description,
    CASE WHEN failure_class IN ('A', 'C') AND code IS NOT NULL AND code = code_cand THEN category END AS registry_category,
    CASE WHEN failure_class IN ('A', 'C') AND code IS NOT NULL AND code = code_cand THEN category_source END AS registry_category_source,
    CASE WHEN failure_class IN ('A', 'C') AND code IS NOT NULL AND code = code_cand THEN stage END AS registry_stage,
    sha256({_strip_sql("coalesce(root_fqcn, '')")} || '|' || {_strip_sql("coalesce(CASE WHEN failure_class IN ('A', 'C') THEN code END, '')")}
           || '|' || array_to_string(frames[1:5], chr(10))) AS fingerprint,
    CASE WHEN coalesce(root_fqcn, '') = '' THEN 'UnknownException' ELSE regexp_extract(root_fqcn, '([^.]*)$', 1) END
      || CASE WHEN coalesce(CASE WHEN failure_class IN ('A', 'C') THEN code END, '') <> ''
              THEN '[' || code || ']' ELSE '' END
      || CASE WHEN len(frames) > 0 THEN ' @ ' || regexp_extract(frames[1], '([^.]*\\.[^.]*)$', 1) ELSE '' END AS signature
  FROM f10)"""


def _json_scalar(doc: str, path: str) -> str:
    guarded = f"CASE WHEN json_valid({doc}) THEN {doc} END"
    ty = f"json_type({guarded}, '{path}')"
    val = f"{_strip_sql(f'json_extract_string({guarded}, {chr(39)}{path}{chr(39)})')}"
    return f"CASE WHEN {ty} IN ('VARCHAR', 'BIGINT', 'UBIGINT') AND {val} <> '' THEN {val} END"


def v_ref_ids_sql() -> str:
    from logsift.plans.dlt_fixture import TYPE_A
    # For the fixture's two payload shapes the breadth-first search resolves
    # to these paths, in this order.
    by_type = (f"CASE WHEN type_id = {_sql_str(TYPE_A)} THEN coalesce({_json_scalar('payload', '$.response.refId')}, "
               f"{_json_scalar('payload', '$.response.results.referenceId')}) END")
    search = f"coalesce({_json_scalar('payload', '$.data.meta.refId')}, {_json_scalar('payload', '$.items[0].ref_id')})"
    return f"""
ri0 AS (
  SELECT *, {by_type} AS by_type FROM v_dlt),
ri1 AS (
  SELECT *, CASE WHEN by_type IS NULL THEN {search} END AS by_search FROM ri0),
v_ref_ids AS (
  SELECT *, {_as_str('key')} AS record_key, coalesce(by_type, by_search) AS payload_ref_id,
         coalesce(key_ref_id, by_type, by_search) AS ref_id,
         CASE WHEN key_ref_id IS NOT NULL THEN 'record_key' WHEN by_type IS NOT NULL THEN 'type_path'
              WHEN by_search IS NOT NULL THEN 'search' ELSE 'none' END AS ref_id_source,
         coalesce(key_ref_id IS NOT NULL AND coalesce(by_type, by_search) IS NOT NULL
                  AND coalesce(by_type, by_search) <> key_ref_id, false) AS ref_id_mismatch
  FROM ri1)"""


def v_case_log_sql() -> str:
    from logsift.plans.dlt_fixture import DECLARED_IN_LOGS
    decl = ", ".join(f"({i}, {_sql_str(t)})" for i, t in enumerate(DECLARED_IN_LOGS))
    return f"""
decl(i, t) AS (VALUES {decl}),
cl0 AS (
  SELECT e.event_id, e.user_id, e.ts, j.j FROM events e, (SELECT unnest(range(0, 6)) AS j) j WHERE j.j < e.event_id % 7),
v_case_log AS (
  SELECT substr(md5('ref' || CAST(user_id AS VARCHAR)), 1, 24) AS ref_id,
         make_timestamp(epoch_us(ts) - j * 40000000) AS ts, event_id * 10 + j AS line_id,
         CASE (event_id + j) % 5
           WHEN 0 THEN 'ERROR [svc] failure: ' || d.t
           WHEN 1 THEN 'ERROR [svc] org.example.db.PoolExhaustedException: pool exhausted'
           WHEN 2 THEN 'INFO [svc] step ' || CAST(j AS VARCHAR) || ' done'
           WHEN 3 THEN 'WARN [svc] slow call in DedupServiceImpl.lookupMaster'
           ELSE 'FATAL [svc] worker stopped' END AS line
  FROM cl0 JOIN decl d ON d.i = cl0.event_id % 8)"""


_ERR = r"\b(ERROR|FATAL|SEVERE)\b"
_FQ_TXT = r"\b((?:[a-z][\w$]*\.){2,}[A-Z][\w$]*(?:Exception|Error|Throwable))\b"


def v_corroboration_sql(now: str, max_age: int) -> str:
    return f"""
cs0 AS (
  SELECT f.*, r.record_key, r.payload_ref_id, r.ref_id, r.ref_id_source, r.ref_id_mismatch,
         f.last_attempt_ms - 300000 AS ws_ms, f.last_attempt_ms + 120000 AS we_ms,
         greatest(0.0, (epoch_ms(TIMESTAMP '{now}') - (f.last_attempt_ms - 300000)) / 1000.0) AS age
  FROM v_failures f JOIN v_ref_ids r USING (case_id)),
cs AS (
  SELECT *, (ref_id IS NULL OR last_attempt_ms IS NULL OR age > {max_age}) AS fetch_skipped,
         CASE WHEN coalesce(root_fqcn, '') = '' THEN '' ELSE regexp_extract(root_fqcn, '([^.]*)$', 1) END AS simple
  FROM cs0),
cl AS (
  SELECT c.case_id, l.ts, l.line_id, l.line FROM cs c JOIN v_case_log l
    ON l.ref_id = c.ref_id AND l.ts >= make_timestamp(c.ws_ms * 1000) AND l.ts <= make_timestamp(c.we_ms * 1000)
  WHERE NOT c.fetch_skipped),
el AS (
  SELECT cl.*, trim(line) AS l, c.root_fqcn, c.business_code, c.simple, c.frames,
         row_number() OVER (PARTITION BY cl.case_id ORDER BY cl.ts, cl.line_id) AS rk
  FROM cl JOIN cs c USING (case_id) WHERE regexp_matches(line, '{_ERR}')),
el2 AS (
  SELECT *, coalesce(root_fqcn, '') <> '' AND contains(l, root_fqcn) AS h_fq,
            simple <> '' AND contains(l, simple) AS h_simple,
            coalesce(business_code, '') <> '' AND contains(l, business_code) AS h_code,
            regexp_extract_all(l, '{_FQ_TXT}', 1) AS seen
  FROM el),
agg AS (
  SELECT case_id, count(*) AS n_err, bool_or(h_fq) AS m_fq, bool_or(h_simple) AS m_simple, bool_or(h_code) AS m_code,
         list_sort(list_distinct(flatten(list(seen)))) AS exc,
         string_agg(CASE WHEN rk <= 20 THEN l END, chr(10) ORDER BY rk) AS cites
  FROM el2 GROUP BY case_id),
nl AS (SELECT case_id, count(*) AS n_lines FROM cl GROUP BY case_id),
co0 AS (
  SELECT cs.*, coalesce(nl.n_lines, 0) AS n_lines, coalesce(agg.n_err, 0) AS n_err,
    CASE WHEN agg.m_fq THEN 'fqcn' WHEN agg.m_simple THEN 'simple name' WHEN agg.m_code THEN 'business code' END AS matched_on,
    list_filter(coalesce(agg.exc, []), lambda x: x <> coalesce(cs.root_fqcn, '') AND regexp_extract(x, '([^.]*)$', 1) <> cs.simple) AS unexpl,
    agg.cites
  FROM cs LEFT JOIN nl USING (case_id) LEFT JOIN agg USING (case_id)),
v_corr AS (
  SELECT *,
    CASE WHEN fetch_skipped OR n_lines = 0 OR n_err = 0 THEN 'UNVERIFIABLE'
         WHEN matched_on IS NOT NULL AND len(unexpl) = 0 THEN 'CORROBORATED'
         WHEN matched_on IS NOT NULL THEN 'PARTIAL' WHEN len(unexpl) > 0 THEN 'CONTRADICTED'
         ELSE 'UNVERIFIABLE' END AS verdict,
    CASE WHEN fetch_skipped THEN 'the log fetch was skipped or failed'
         WHEN n_lines = 0 THEN 'the log source returned no lines for this identifier'
         WHEN n_err = 0 THEN 'logs were fetched but contain no error-level lines'
         WHEN matched_on IS NOT NULL AND len(unexpl) = 0 THEN 'the declared root appears in the logs (matched on its ' || matched_on || ')'
         WHEN matched_on IS NOT NULL THEN 'the declared root appears, but the window also holds errors it does not explain'
         WHEN len(unexpl) > 0 THEN 'the declared root (' || CASE WHEN simple = '' THEN 'unknown' ELSE simple END
              || ') does not appear in the logs, but '
              || array_to_string(list_transform(unexpl[1:3], lambda x: regexp_extract(x, '([^.]*)$', 1)), ', ') || ' did'
         ELSE 'error lines were found but none names an exception type' END AS corroboration_reason,
    coalesce(NOT fetch_skipped AND n_lines > 0 AND n_err > 0 AND matched_on IS NOT NULL, false) AS matched_declared,
    CASE WHEN NOT fetch_skipped AND n_lines > 0 THEN n_err ELSE 0 END AS error_lines_seen,
    fetch_skipped AS could_not_look,
    CASE WHEN NOT fetch_skipped AND n_lines > 0 AND n_err > 0 THEN coalesce(cites, '') ELSE '' END AS citations_text,
    CASE WHEN NOT fetch_skipped AND n_lines > 0 AND n_err > 0 THEN array_to_string(unexpl, ',') ELSE '' END AS unexplained_text
  FROM co0)"""


def _tmpl(text: str, **cols: str) -> str:
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", text):
        parts.append(_sql_str(text[pos:m.start()]))
        parts.append(f"coalesce({cols[m.group(1)]}, '')")
        pos = m.end()
    parts.append(_sql_str(text[pos:]))
    return "(" + " || ".join(parts) + ")"


def _policy(prefix: str, action: str, conf: str, reused: str) -> str:
    """DLT ceilings over columns of the current relation (every seventh record's trace has gaps)."""
    hit = "(registry_description IS NOT NULL AND registry_description <> '')"
    labels = (f"list_filter([CASE WHEN failure_class IN ('B', 'U') THEN 'class_' || lower(failure_class) END, "
              f"CASE WHEN verdict = 'UNVERIFIABLE' THEN 'unverifiable' END, "
              f"CASE WHEN verdict = 'CONTRADICTED' THEN 'contradicted' END, "
              f"CASE WHEN failure_class = 'A' AND NOT {hit} THEN 'registry_miss' END, "
              f"CASE WHEN event_id % 7 = 0 THEN 'evidence_gap' END, "
              f"CASE WHEN {conf} IS NOT NULL AND {reused} THEN 'reuse_decay' END], lambda x: x IS NOT NULL)")
    ceiling = (f"least(1.0, CASE WHEN failure_class IN ('B', 'U') THEN 0.3 ELSE 1.0 END, "
               f"CASE WHEN verdict = 'UNVERIFIABLE' THEN 0.5 ELSE 1.0 END, CASE WHEN verdict = 'CONTRADICTED' THEN 0.6 ELSE 1.0 END, "
               f"CASE WHEN failure_class = 'A' AND NOT {hit} THEN 0.5 ELSE 1.0 END, "
               f"CASE WHEN event_id % 7 = 0 THEN 0.6 ELSE 1.0 END)")
    conf_out = f"CASE WHEN {conf} IS NULL THEN NULL ELSE least(CASE WHEN {reused} THEN {conf} * 0.95 ELSE {conf} END, {ceiling}) END"
    act_out = (f"CASE WHEN failure_class IN ('B', 'U') AND NOT ({action} IN ('NEEDS_MANUAL_REVIEW', 'ROUTE_TO_DEV')) "
               f"THEN 'NEEDS_MANUAL_REVIEW' ELSE {action} END")
    return f"{conf_out} AS {prefix}confidence, {act_out} AS {prefix}action, {labels} AS {prefix}ceilings"


def v_decisions_sql() -> str:
    from logsift.operators import policy as P
    seen = ("CASE WHEN occurrence = 0 THEN 'This is the first recorded occurrence of this failure signature.' "
            "ELSE CAST(occurrence AS VARCHAR) || ' ' || CASE WHEN occurrence = 1 THEN 'occurrence' ELSE 'occurrences' END "
            "|| ' of this signature recorded' || CASE WHEN group_first_seen IS NOT NULL THEN ' first seen ' "
            "|| strftime(group_first_seen, '%Y-%m-%d %H:%M UTC') ELSE '' END || '.' END")
    prov = ("CASE WHEN registry_category_source = 'declared' THEN " + _sql_str(P.PROVENANCE_DECLARED)
            + " WHEN registry_category_source = 'inferred' THEN " + _sql_str(P.PROVENANCE_INFERRED)
            + " ELSE " + _sql_str(P.PROVENANCE_OTHER) + " END")
    detail = ("CASE WHEN coalesce(registry_description, '') <> '' THEN ' (\"' || registry_description || '\")' ELSE '' END")
    note = (f"CASE WHEN coalesce(business_code, '') <> '' AND registry_category = 'TECHNICAL_EXCEPTION' THEN "
            f"{_tmpl(P.CATALOG_NOTE, code='business_code', detail=detail, provenance=prov)} ELSE '' END")
    sig = "coalesce(nullif(signature, ''), nullif(root_fqcn, ''), 'unknown failure')"
    return f"""
v_agent AS (
  SELECT event_id, event_id % 3 <> 0 AS agent_ok,
         ['NEEDS_MANUAL_REVIEW', 'ROUTE_TO_DEV', 'REDRIVE_AFTER_RECOVERY', 'DATA_FIX_REQUIRED', 'NO_ACTION'][event_id % 5 + 1] AS agent_action,
         (event_id % 100) / 100.0 AS agent_confidence FROM events),
dd0 AS (
  SELECT v.*, a.agent_ok, a.agent_action, a.agent_confidence,
    count(*) OVER (PARTITION BY fingerprint ORDER BY dlt_timestamp, case_id ROWS UNBOUNDED PRECEDING) AS occurrence,
    coalesce(sum(CASE WHEN failure_class = 'A' AND coalesce(a.agent_ok, false) THEN 1 ELSE 0 END)
      OVER (PARTITION BY fingerprint ORDER BY dlt_timestamp, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_ok,
    min(dlt_timestamp) OVER (PARTITION BY fingerprint) AS group_first_seen
  FROM v_corr v LEFT JOIN v_agent a USING (event_id)),
dd1 AS (
  SELECT *,
    CASE WHEN failure_class <> 'A' THEN 'CANNED' WHEN verdict IN ('CONTRADICTED', 'PARTIAL') THEN 'LLM_REQUIRED'
         WHEN prior_ok = 0 THEN 'LLM_REQUIRED' ELSE 'REUSE_GROUP' END AS decision,
    CASE WHEN failure_class <> 'A' THEN 'class ' || failure_class || ' has a fixed treatment; no model involved'
         WHEN verdict IN ('CONTRADICTED', 'PARTIAL') THEN 'corroboration came back ' || verdict || '; the discrepancy leads the finding'
         WHEN prior_ok = 0 THEN 'novel fingerprint; no recommendation on file for this group'
         WHEN verdict = 'CORROBORATED' THEN 'known fingerprint, logs corroborate the trace; serving the group''s recommendation'
         ELSE 'known fingerprint but corroboration was unverifiable; serving the group''s recommendation at a capped confidence' END AS decision_reason,
    CASE failure_class
      WHEN 'C' THEN {_tmpl(P.C_NARRATIVE, signature=sig, seen=seen, catalog_note=note)}
      WHEN 'B' THEN {_tmpl(P.B_NARRATIVE, signature=sig, seen=seen)}
      WHEN 'U' THEN {_tmpl(P.U_NARRATIVE, signature=sig, seen=seen, class_reason='class_reason')} END AS canned_narrative,
    CASE failure_class WHEN 'C' THEN {_sql_str(P.C_RECOMMENDATION)} WHEN 'B' THEN {_sql_str(P.B_RECOMMENDATION)}
      WHEN 'U' THEN {_sql_str(P.U_RECOMMENDATION)} END AS canned_recommendation,
    CASE failure_class WHEN 'C' THEN 'REDRIVE_AFTER_RECOVERY' WHEN 'B' THEN 'ROUTE_TO_DEV'
      WHEN 'U' THEN 'NEEDS_MANUAL_REVIEW' END AS canned_action
  FROM dd0),
dd2 AS (
  SELECT *, CASE WHEN decision = 'CANNED' THEN 'canned' WHEN decision = 'REUSE_GROUP' THEN 'group_reuse'
                 WHEN coalesce(agent_ok, false) THEN 'agent' ELSE 'failed_synthesis' END AS provenance FROM dd1),
dd3 AS (
  SELECT *, CASE provenance WHEN 'canned' THEN canned_action WHEN 'agent' THEN agent_action
                 WHEN 'failed_synthesis' THEN 'NEEDS_MANUAL_REVIEW' END AS action0,
            CASE provenance WHEN 'agent' THEN agent_confidence WHEN 'failed_synthesis' THEN 0.0 END AS conf0 FROM dd2),
dd4 AS (SELECT *, {_policy('p1_', 'action0', 'conf0', 'false')} FROM dd3),
dd5 AS (
  SELECT *, last_value(CASE WHEN provenance = 'agent' THEN {{'a': p1_action, 'c': p1_confidence}} END IGNORE NULLS)
            OVER (PARTITION BY fingerprint ORDER BY dlt_timestamp, case_id ROWS UNBOUNDED PRECEDING) AS rec
  FROM dd4),
dd6 AS (
  SELECT *, CASE WHEN provenance = 'group_reuse' THEN rec.a ELSE action0 END AS action1,
            CASE WHEN provenance = 'group_reuse' THEN rec.c ELSE conf0 END AS conf1,
            provenance = 'group_reuse' AS reused FROM dd5),
v_decisions AS (SELECT *, {_policy('final_', 'action1', 'conf1', 'reused')} FROM dd6)"""


_ACTS6 = "['REPLAY', 'WHITELISTING', 'QC_REPLAY', 'RO_APPROVAL', 'RESIDENT_PACKET_RESUBMIT', 'MANUAL_REVIEW']"

V_CASEBOOK = f"""
cb0 AS (
  SELECT *, 'RC_' || replace(upper(substr(o_orderpriority, 3, 100)), ' ', '_') AS code,
         CASE o_orderstatus WHEN 'F' THEN 'NEW' WHEN 'O' THEN 'UPDATE' END AS etype,
         {_ACTS6}[o_orderkey % 6 + 1] AS action FROM orders),
cb1 AS (
  SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'RB_' || code || '_' || coalesce(etype, 'ANY') END AS shadow_id FROM cb0),
v_casebook AS (
  SELECT 'EV' || CAST(o_orderkey AS VARCHAR) AS event_id,
         CASE o_orderkey % 11 WHEN 0 THEN 'IN_PROGRESS' WHEN 1 THEN 'LOGS_FETCHED' WHEN 2 THEN 'FAILED_TIMEOUT'
              WHEN 3 THEN 'DLQ' WHEN 4 THEN 'REJECTED' WHEN 5 THEN 'NEEDS_MANUAL_REVIEW' ELSE 'COMPLETED' END AS status,
         code AS reason_code, etype AS enrolment_type,
         CASE (o_orderkey // 2) % 4 WHEN 1 THEN 'runbook:' || code WHEN 3 THEN NULL ELSE 'agent' END AS resolution_source,
         action AS agent_action,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0 END AS confidence,
         o_orderkey % 13 = 0 AS abstained,
         CASE WHEN shadow_id IS NOT NULL THEN {_ACTS6}[(o_orderkey // 7) % 6 + 1] END AS shadow_action,
         shadow_id AS shadow_runbook_id,
         CASE WHEN shadow_id IS NOT NULL THEN {_ACTS6}[(o_orderkey // 7) % 6 + 1] = action END AS shadow_agreed,
         'pf-' || CAST(o_orderkey % 3 AS VARCHAR) AS prompt_fingerprint, o_orderdate AS updated_at, o_custkey AS customer,
         CASE WHEN o_orderkey % 17 = 0 THEN 'ESCALATED TO HUMAN REVIEW: low confidence' ELSE 'resolved' END AS synthesis
  FROM cb1)"""

V_VERDICT = f"""
vv0 AS (SELECT * FROM orders),
v_verdict AS (
  SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'EVX' ELSE 'EV' END || CAST(o_orderkey AS VARCHAR) AS event_id,
         CASE o_custkey % 5 WHEN 0 THEN 'CORRECT' WHEN 1 THEN ' incorrect ' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'correct'
              ELSE 'MAYBE' END AS verdict,
         'op' || CAST(o_custkey % 3 AS VARCHAR) AS verified_by, o_orderdate + INTERVAL 1 DAY AS verified_at, '' AS notes,
         CASE WHEN o_custkey % 5 = 1 THEN {_ACTS6}[(o_orderkey + 1) % 6 + 1] END AS corrected_action
  FROM vv0
  UNION ALL
  SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'EVX' ELSE 'EV' END || CAST(o_orderkey AS VARCHAR), 'CORRECT', 'op-review',
         o_orderdate + INTERVAL 2 DAY, 'revised', NULL
  FROM vv0 WHERE o_orderkey % 10 = 0)"""

V_OUTCOME = """
vo0 AS (SELECT *, upper(trim(coalesce(verdict, ''))) AS v FROM v_verdict),
vo1 AS (
  SELECT event_id, arg_max({'verdict': v, 'verified_by': verified_by, 'verified_at': verified_at, 'notes': notes,
                             'corrected_action': corrected_action}, verified_at) AS o
  FROM vo0 WHERE v IN ('CORRECT', 'INCORRECT', 'PARTIAL') GROUP BY event_id),
v_outcome AS (
  SELECT vo1.event_id, o.verdict AS verdict, o.verified_by AS verified_by, o.verified_at AS verified_at, o.notes AS notes,
         o.corrected_action AS corrected_action, c.reason_code, c.enrolment_type, c.resolution_source, c.agent_action,
         c.confidence, c.abstained, c.shadow_action, c.shadow_runbook_id, c.shadow_agreed, c.prompt_fingerprint
  FROM vo1 JOIN v_casebook c USING (event_id)),
v_acc AS (
  SELECT coalesce(reason_code, 'unknown') AS reason_code, coalesce(enrolment_type, 'unknown') AS enrolment_type,
         CASE WHEN coalesce(resolution_source, 'unknown') LIKE 'runbook:%' THEN 'runbook' ELSE coalesce(resolution_source, 'unknown') END AS resolution_source,
         count(*) FILTER (WHERE verdict = 'CORRECT') AS "CORRECT", count(*) FILTER (WHERE verdict = 'INCORRECT') AS "INCORRECT",
         count(*) FILTER (WHERE verdict = 'PARTIAL') AS "PARTIAL"
  FROM v_outcome GROUP BY ALL),
v_acc2 AS (
  SELECT *, "CORRECT" + "INCORRECT" + "PARTIAL" AS total,
         CASE WHEN "CORRECT" + "INCORRECT" + "PARTIAL" > 0 THEN round_even("CORRECT" / ("CORRECT" + "INCORRECT" + "PARTIAL"), 4) ELSE 0.0 END AS accuracy
  FROM v_acc),
v_shadow AS (
  SELECT coalesce(reason_code, 'unknown') AS reason_code, coalesce(enrolment_type, 'unknown') AS enrolment_type,
         shadow_runbook_id AS runbook_id, count(*) AS shadowed,
         count(*) FILTER (WHERE coalesce(shadow_agreed, false)) AS agreed, count(*) FILTER (WHERE NOT coalesce(shadow_agreed, false)) AS disagreed,
         count(*) FILTER (WHERE verdict = 'CORRECT' AND coalesce(shadow_agreed, false)) AS would_be_correct,
         count(*) FILTER (WHERE verdict = 'CORRECT') AS agent_correct,
         count(*) FILTER (WHERE verdict IN ('CORRECT', 'INCORRECT', 'PARTIAL')) AS verdicts
  FROM v_outcome WHERE coalesce(shadow_runbook_id, '') <> '' GROUP BY ALL),
v_shadow2 AS (
  SELECT *, CASE WHEN shadowed > 0 THEN round_even(agreed / shadowed, 4) ELSE 0.0 END AS agreement_rate,
         CASE WHEN verdicts > 0 THEN round_even(would_be_correct / verdicts, 4) ELSE 0.0 END AS would_be_accuracy,
         CASE WHEN verdicts > 0 THEN round_even(agent_correct / verdicts, 4) ELSE 0.0 END AS agent_accuracy
  FROM v_shadow)"""


V_RULE = """
v_rule AS (
  SELECT CASE WHEN p_partkey <= 40 THEN ['RC_URGENT', 'RC_HIGH', 'RC_MEDIUM', 'RC_NOT_SPECIFIED', 'RC_LOW'][p_partkey % 5 + 1]
              ELSE 'RC_PART_' || CAST(p_partkey AS VARCHAR) END AS reject_reason_code,
         p_name AS rule_description, p_size % 7 <> 0 AS is_active,
         CASE p_partkey % 6 WHEN 0 THEN '{"statement":{"Condition":{"StringEquals":{"enrolmentType":"UPDATE"}}}}'
              WHEN 1 THEN '{"statement":{"Condition":{"StringEquals":{"enrolmentType":"ENROLMENT"}}}}'
              WHEN 2 THEN '{"statement":{"Condition":{"StringEquals":{"enrolmentType":"U"}}}}'
              WHEN 3 THEN '{"statement":{"Condition":{}}}' WHEN 4 THEN '{broken'
              ELSE '{"statement":{"Effect":"Deny"}}' END AS rule_data,
         p_partkey AS rule_pos
  FROM part)"""

V_RUNBOOK = f"""
v_runbook AS (
  SELECT 'RB_' || CAST(p_partkey AS VARCHAR) AS runbook_id,
         CASE WHEN p_size % 9 = 0 THEN '2.0' ELSE '1.1' END AS schema_version,
         CASE WHEN p_partkey <= 200 THEN ['RC_URGENT', 'RC_HIGH', 'RC_MEDIUM', 'RC_NOT_SPECIFIED', 'RC_LOW'][(p_partkey // 7) % 5 + 1]
              ELSE 'RC_PART_' || CAST(p_partkey AS VARCHAR) END AS reason_code,
         ['NEW', 'UPDATE', 'ANY', ' update ', NULL][p_partkey % 5 + 1] AS enrolment_type,
         CASE WHEN p_size % 4 = 0 THEN 'draft' ELSE 'final' END AS status,
         CAST((p_partkey // 1000) % 3 + 1 AS INTEGER) AS version,
         'sha256:' || sha256(p_name) AS rule_fingerprint,
         'desc' AS rejection_description, CASE WHEN p_size % 11 = 0 THEN NULL ELSE 'syn' END AS synthesis,
         {_ACTS6}[p_partkey % 6 + 1] AS action, 'PENDING' AS resident_action
  FROM part),
v_rb_valid AS (
  SELECT *, CASE WHEN coalesce(upper(trim(enrolment_type)), '') = '' THEN 'ANY' ELSE upper(trim(enrolment_type)) END AS rb_type
  FROM v_runbook WHERE status = 'final' AND schema_version IN ('1.0', '1.1')
    AND regexp_full_match(reason_code, '[A-Za-z0-9_.:-]{{1,128}}') AND rejection_description IS NOT NULL
    AND synthesis IS NOT NULL AND action IS NOT NULL AND resident_action IS NOT NULL)"""


V_REJECTION = """
v_rejection AS (
  SELECT o_orderkey AS msg_offset,
    CASE WHEN o_orderkey % 41 = 0 THEN 'garbage-' || CAST(o_orderkey AS VARCHAR) ELSE
      '{"eventId":"' || CASE WHEN o_orderkey % 37 = 0 THEN 'EV ' || CAST(o_orderkey AS VARCHAR) || '/..' ELSE 'EV' || CAST(o_orderkey AS VARCHAR) END
      || '","category":"PACKET","sourceTopic":"packets.rejected","flowMetaData":{"stage":"BIO","subStage":"DEDUP"},"packetMetaData":{"refId":"'
      || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '","srn":"SRN' || CAST(o_custkey AS VARCHAR) || '","enrolmentType":"'
      || CASE o_orderstatus WHEN 'F' THEN 'NEW' WHEN 'O' THEN 'UPDATE' ELSE '' END || '"},'
      || CASE WHEN o_orderkey % 43 = 0 THEN '"other":1' ELSE
           '"packetExecutionSummary":{"packetStatus":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'SUCCESS' ELSE 'REJECTED' END
           || '","errorData":[' || CASE WHEN o_orderkey % 3 = 0 THEN '{"type":"VALIDATION","errorReasonCode":""},' ELSE '' END
           || '{"type":"BUSINESS","errorReasonCode":"RC_' || replace(upper(substr(o_orderpriority, 3, 100)), ' ', '_') || '"}]}' END
      || '}' END AS value
  FROM orders),
rj AS (
  SELECT *, coalesce(starts_with(trim(value), '{') AND json_valid(value), false) AS obj FROM v_rejection),
rj2 AS (
  SELECT *, CASE WHEN obj THEN json_extract_string(value, '$.eventId') END AS eid,
         CASE WHEN obj THEN json_extract(value, '$.packetExecutionSummary') END AS pes FROM rj),
rj3 AS (
  SELECT *, CASE WHEN NOT obj THEN 'payload is not a JSON object' WHEN eid IS NULL THEN 'eventId missing'
                 WHEN NOT regexp_full_match(eid, '[A-Za-z0-9_.:-]{1,128}') THEN 'eventId does not match the id pattern'
                 WHEN pes IS NULL OR json_type(pes) = 'NULL' THEN 'packetExecutionSummary missing' END AS poison_reason
  FROM rj2)"""


V_POD = """
vp0 AS (SELECT s.*, n.n_name, lower(replace(n.n_name, ' ', '-')) AS svc FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
v_pod AS (
  SELECT 'ns-' || CAST(s_nationkey % 3 AS VARCHAR) AS namespace, svc || '-' || CAST(s_suppkey AS VARCHAR) AS pod,
         CASE WHEN s_suppkey % 7 = 0 THEN 'Pending' WHEN s_suppkey % 17 = 0 THEN NULL ELSE 'Running' END AS phase,
         CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE strftime(make_timestamp((1704067200 + s_suppkey * 3600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS start_time,
         svc, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS tier,
         CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN ['istio-proxy'] WHEN s_suppkey % 5 = 1 THEN ['app', 'istio-proxy']
              ELSE ['app', 'worker'] END AS containers,
         CAST(s_suppkey % 4 AS INTEGER) AS app_restarts
  FROM vp0),
v_service AS (
  SELECT lower(replace(n_name, ' ', '-')) AS service, n_nationkey AS ord, 'ns-' || CAST(n_nationkey % 3 AS VARCHAR) AS namespace,
         CASE WHEN n_nationkey % 2 = 0 THEN 'name_contains' ELSE 'label' END AS mode, lower(replace(n_name, ' ', '-')) AS value
  FROM nation
  UNION ALL SELECT 'platform-' || CAST(k AS VARCHAR), 100 + k, 'ns-' || CAST(k AS VARCHAR), 'name_contains', '-'
  FROM (SELECT DISTINCT n_nationkey % 3 AS k FROM nation)),
pe AS (
  SELECT p.*, coalesce(phase, 'Running') AS ph,
         CAST(coalesce(start_time, '2000-01-01T00:00:00+00:00') AS TIMESTAMPTZ) AS st,
         CASE WHEN len(coalesce(containers, [])) > 0 THEN containers ELSE ['app'] END AS cs FROM v_pod p),
pc AS (
  SELECT *, CASE WHEN len(list_filter(cs, lambda c: c NOT IN ('istio-proxy', 'linkerd-proxy', 'vault-agent'))) = 0 THEN cs
                 ELSE list_filter(cs, lambda c: c NOT IN ('istio-proxy', 'linkerd-proxy', 'vault-agent')) END AS kept FROM pe WHERE ph <> 'Pending'),
pcont AS (SELECT namespace, pod, st, svc, tier, app_restarts, unnest(kept) AS container FROM pc),
pm AS (
  SELECT s.service, s.ord, c.* FROM pcont c JOIN v_service s ON s.namespace = c.namespace
   AND ((s.mode = 'name_contains' AND contains(c.pod, s.value)) OR (s.mode = 'label' AND c.svc = s.value AND c.tier = 'a'))),
pr AS (
  SELECT service, ord, namespace, pod, st, row_number() OVER (PARTITION BY service ORDER BY st DESC NULLS LAST, pod) AS rank,
         count(*) OVER (PARTITION BY service) AS n
  FROM (SELECT DISTINCT service, ord, namespace, pod, st FROM pm))"""
