"""Registered queries: dead-lettered records."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import deadletter as D
from logsift.plans import oracle_views as ov
from logsift.plans.dlt_fixture import TYPE_PATHS
from logsift.plans.registry import query
from logsift.plans.views import reason_codes, table, v_deadletter

APP_PACKAGES = ("com.example.app.",)
BOILERPLATE = ("com.example.app.common.ErrorFactory",)

HEADER_COLS = ["case_id", "original_topic", "original_partition", "original_offset", "original_timestamp_ms",
               "consumer_group", "exception_fqcn", "exception_cause_fqcn", "exception_message", "attempts",
               "retry_original_timestamp_ms", "backoff_timestamp_ms", "type_id", "last_attempt_ms",
               "anchor_is_fallback", "key_ref_id"]


def dlt_records(spark, sf_dir):
    return D.parse_deadletters(v_deadletter(spark, sf_dir)).withColumn("key_ref_id", D.key_as_ref_id(F.col("key")))


@query("dlt_headers", ov.with_views(ov.v_deadletter_sql(), ov.v_dlt_headers_sql()) +
       " SELECT " + ", ".join(HEADER_COLS) + " FROM v_dlt")
def dlt_headers(spark, sf_dir):
    """Typed DLT headers, epoch decode, anchor, case id and key shape."""
    return dlt_records(spark, sf_dir).select(*HEADER_COLS)


def _redacted(text: str) -> str:
    for rx, label in (("vid", "VID"), ("aad1", "AADHAAR"), ("aad2", "AADHAAR"), ("mob", "MOBILE"), ("email", "EMAIL")):
        text = f"regexp_replace({text}, '{ov._RX[rx]}', '[REDACTED:{label}]', 'g')"
    return text


@query("dlt_redacted_headers", f"""
WITH h AS (
  SELECT event_id, unnest([
    {{'name': 'kafka_original-offset', 'value': lpad(CAST(event_id AS VARCHAR), 12, '7')}},
    {{'name': '__TypeId__', 'value': CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'com.example.T9' || lpad(CAST(event_id AS VARCHAR), 9, '0') END}},
    {{'name': 'kafka_exception-message', 'value': event_type || ' failed for 9' || lpad(CAST(event_id AS VARCHAR), 9, '0')
                                               || ' / ' || lpad(CAST(event_id AS VARCHAR), 16, '4')}},
    {{'name': 'x-contact', 'value': CASE WHEN event_id % 4 > 0 THEN 'user' || CAST(user_id AS VARCHAR) || '@example.org, 2345 6789 '
                                    || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') END}}], recursive := true) FROM events)
SELECT event_id, name, CASE WHEN name IN ('kafka_original-offset', '__TypeId__') THEN value ELSE {_redacted('value')} END AS value
FROM h""")
def dlt_redacted_headers(spark, sf_dir):
    """Header maps with free-text values redacted and structural ones kept,
    one row per header."""
    e = F.col("event_id")
    digits = lambda n, fill: F.lpad(e.cast("string"), n, fill)
    headers = F.create_map(
        F.lit(D.H_ORIGINAL_OFFSET), digits(12, "7"),
        F.lit(D.H_TYPE_ID), F.when(e % 3 != 0, F.concat(F.lit("com.example.T9"), digits(9, "0"))),
        F.lit(D.H_EXCEPTION_MESSAGE), F.concat("event_type", F.lit(" failed for 9"), digits(9, "0"), F.lit(" / "), digits(16, "4")),
        F.lit("x-contact"), F.when(e % 4 > 0, F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org, 2345 6789 "),
                                                      F.lpad((e % 10000).cast("string"), 4, "0"))))
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.explode(D.redact_headers(headers)).alias("name", "value"))


FAILURE_COLS = ["case_id", "failure_class", "class_reason", "root_fqcn", "root_message", "business_code",
                "registry_description", "registry_category", "registry_category_source", "registry_stage",
                "fingerprint", "signature", "truncated"]


def dlt_failures_df(spark, sf_dir):
    recs = dlt_records(spark, sf_dir)
    return D.build_failures(recs, reason_codes(spark), packages=APP_PACKAGES,
                            boilerplate=BOILERPLATE)


@query("dlt_failures", ov.with_views(ov.v_deadletter_sql(), ov.v_dlt_headers_sql(), ov.v_failures_sql()) +
       " SELECT " + ", ".join(FAILURE_COLS) +
       ", array_to_string(frames, chr(10)) AS frames_text, chain_depth FROM v_failures")
def dlt_failures(spark, sf_dir):
    """Trace chain -> root, normalised frames, class A/B/C/U, code, catalog row,
    fingerprint and signature for every record."""
    return dlt_failures_df(spark, sf_dir).select(
        *FAILURE_COLS, F.array_join("frames", "\n").alias("frames_text"),
        F.size("chain").cast("bigint").alias("chain_depth"))


REF_COLS = ["case_id", "record_key", "ref_id", "ref_id_source", "payload_ref_id", "ref_id_mismatch"]
NOW = "2024-01-30 12:00:00"


def dlt_ids_df(spark, sf_dir):
    return D.resolve_ref_ids(dlt_records(spark, sf_dir), type_paths=TYPE_PATHS)


_IDS_VIEWS = ov.with_views(ov.v_deadletter_sql(), ov.v_dlt_headers_sql(), ov.v_ref_ids_sql())


@query("dlt_ref_ids", _IDS_VIEWS + " SELECT " + ", ".join(REF_COLS) + " FROM v_ref_ids")
def dlt_ref_ids(spark, sf_dir):
    """Correlation id per record: key, type path, bounded search; provenance
    and key/payload disagreement."""
    return dlt_ids_df(spark, sf_dir).select(*REF_COLS)


@query("dlt_windows", _IDS_VIEWS + f"""
, w0 AS (
  SELECT *, last_attempt_ms - 300000 AS ws, last_attempt_ms + 120000 AS we,
         greatest(0.0, (epoch_ms(TIMESTAMP '{NOW}') - (last_attempt_ms - 300000)) / 1000.0) AS age
  FROM v_ref_ids)
SELECT case_id, make_timestamp(ws * 1000) AS window_start, make_timestamp(we * 1000) AS window_end,
       CASE WHEN last_attempt_ms IS NOT NULL THEN round(age, 3) END AS window_age_seconds,
       CASE WHEN last_attempt_ms IS NOT NULL THEN age > 86400 END AS too_old, anchor_is_fallback,
       array_to_string(list_filter([CASE WHEN ref_id_mismatch THEN 'REFID_KEY_PAYLOAD_MISMATCH' END,
         CASE WHEN ref_id IS NULL THEN 'NO_CORRELATION_ID' WHEN last_attempt_ms IS NULL THEN 'NO_TIMESTAMP'
              WHEN age > 86400 THEN 'LOGS_TOO_OLD' END], lambda g: g IS NOT NULL), ',') AS gaps
FROM w0""")
def dlt_windows(spark, sf_dir):
    """Log window around the last attempt, age against an explicit ``now``,
    and the ordered evidence-gap list."""
    df = D.log_window(dlt_ids_df(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    gaps = D.evidence_gaps(F.col("ref_id_mismatch"), F.col("ref_id"), F.col("last_attempt_ms"), F.col("too_old"))
    return df.select("case_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                     F.round("window_age_seconds", 3).alias("window_age_seconds"), "too_old",
                     "anchor_is_fallback", F.array_join(gaps, ",").alias("gaps"))


def dlt_full_df(spark, sf_dir):
    """Failures with ids (one record table carrying every derived column)."""
    return D.resolve_ref_ids(dlt_failures_df(spark, sf_dir), type_paths=TYPE_PATHS)


_FAIL_VIEWS = ov.with_views(ov.v_deadletter_sql(), ov.v_dlt_headers_sql(), ov.v_failures_sql())


@query("dlt_class_distribution", _FAIL_VIEWS + """
, cls(failure_class) AS (VALUES ('A'), ('B'), ('C'), ('U'))
SELECT cls.failure_class, CAST(count(f.case_id) AS BIGINT) AS messages
FROM cls LEFT JOIN v_failures f USING (failure_class) GROUP BY cls.failure_class""")
def dlt_class_distribution(spark, sf_dir):
    """Messages per failure class (all four classes always present)."""
    from logsift.operators.corpus import class_distribution
    return class_distribution(dlt_failures_df(spark, sf_dir))


@query("dlt_corpus_summary", _FAIL_VIEWS + """
, per_fp AS (
  SELECT fingerprint, count(*) AS n, count(*) FILTER (WHERE truncated) AS n_trunc,
         count(*) FILTER (WHERE anchor_is_fallback) AS n_fallback, count(*) FILTER (WHERE failure_class = 'A') AS n_a
  FROM v_failures GROUP BY fingerprint)
SELECT CAST(sum(n) AS BIGINT) AS messages, CAST(sum(n_trunc) AS BIGINT) AS truncated_stacktraces,
       CAST(sum(n_fallback) AS BIGINT) AS missing_backoff_timestamp, count(*) AS distinct_fingerprints,
       round(sum(n) / greatest(count(*), 1), 1) AS messages_per_fingerprint,
       CAST(sum(n_a) AS BIGINT) AS class_a_messages, count(*) FILTER (WHERE n_a > 0) AS class_a_distinct_fingerprints
FROM per_fp""")
def dlt_corpus_summary(spark, sf_dir):
    """Corpus totals: truncated, fallback anchors, distinct fingerprints, class A."""
    from logsift.operators.corpus import corpus_summary
    return corpus_summary(dlt_failures_df(spark, sf_dir))


@query("dlt_top_fingerprints", _FAIL_VIEWS + """
SELECT substr(fingerprint, 1, 16) AS fingerprint, count(*) AS count,
       arg_min(failure_class, case_id) AS failure_class, arg_min(signature, case_id) AS signature
FROM v_failures GROUP BY v_failures.fingerprint ORDER BY count(*) DESC, v_failures.fingerprint LIMIT 10""")
def dlt_top_fingerprints(spark, sf_dir):
    """Top 10 fingerprints by occurrence (a top-k report)."""
    from logsift.operators.corpus import top_fingerprints
    return top_fingerprints(dlt_failures_df(spark, sf_dir))


@query("dlt_key_agreement", _IDS_VIEWS + """
SELECT count(*) FILTER (WHERE record_key IS NOT NULL) AS present,
       count(*) FILTER (WHERE key_ref_id IS NOT NULL) AS usable,
       count(*) FILTER (WHERE key_ref_id IS NOT NULL AND payload_ref_id IS NOT NULL AND NOT ref_id_mismatch) AS agrees_with_payload,
       count(*) FILTER (WHERE key_ref_id IS NOT NULL AND payload_ref_id IS NOT NULL AND ref_id_mismatch) AS disagrees_with_payload,
       count(*) FILTER (WHERE key_ref_id IS NOT NULL AND payload_ref_id IS NULL) AS key_only,
       count(*) FILTER (WHERE key_ref_id IS NULL AND payload_ref_id IS NOT NULL) AS payload_only,
       count(*) FILTER (WHERE key_ref_id IS NULL AND payload_ref_id IS NULL) AS neither
FROM v_ref_ids""")
def dlt_key_agreement(spark, sf_dir):
    """Record-key versus payload agreement counters."""
    from logsift.operators.corpus import key_agreement
    return key_agreement(dlt_ids_df(spark, sf_dir))


@query("dlt_id_sources", _IDS_VIEWS + " SELECT ref_id_source, count(*) AS messages FROM v_ref_ids GROUP BY 1")
def dlt_id_sources(spark, sf_dir):
    """Histogram of where the correlation id came from."""
    from logsift.operators.corpus import id_source_histogram
    return id_source_histogram(dlt_ids_df(spark, sf_dir))


_HEADER_NAMES = [("kafka_original-topic", "h_topic"), ("kafka_original-partition", "h_partition"),
                 ("kafka_original-offset", "h_offset"), ("kafka_original-timestamp", "h_orig_ts"),
                 ("kafka_dlt-original-consumer-group", "h_group"), ("kafka_exception-fqcn", "h_fqcn"),
                 ("kafka_exception-cause-fqcn", "h_cause"), ("kafka_exception-message", "h_msg"),
                 ("kafka_exception-stacktrace", "h_trace"), ("retry_topic-attempts", "h_attempts"),
                 ("retry_topic-original-timestamp", "h_retry_orig"), ("retry_topic-backoff-timestamp", "h_backoff"),
                 ("__TypeId__", "h_type")]


@query("dlt_header_frequency", ov.with_views(ov.v_deadletter_sql()) + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS header, count({c}) AS records FROM v_deadletter HAVING count({c}) > 0"
    for n, c in _HEADER_NAMES))
def dlt_header_frequency(spark, sf_dir):
    """How many records carry each header name."""
    from logsift.operators.corpus import header_frequency
    return header_frequency(v_deadletter(spark, sf_dir))


@query("dlt_missing_stacktrace", ov.with_views(ov.v_deadletter_sql()) +
       " SELECT count(*) AS captured, count(*) FILTER (WHERE h_trace IS NULL OR h_trace = '') AS missing_stacktrace"
       " FROM v_deadletter")
def dlt_missing_stacktrace(spark, sf_dir):
    from logsift.operators.corpus import missing_stacktraces
    return missing_stacktraces(v_deadletter(spark, sf_dir))


@query("dlt_arrival_lag", _FAIL_VIEWS + """
, lags AS (SELECT (epoch_us(dlt_timestamp) // 1000 - last_attempt_ms) / 1000.0 AS lag FROM v_dlt
           WHERE dlt_timestamp IS NOT NULL AND last_attempt_ms IS NOT NULL),
ranked AS (SELECT lag, row_number() OVER (ORDER BY lag) - 1 AS i, count(*) OVER () AS n FROM lags)
SELECT max(n) AS samples, round_even(min(lag), 1) AS min,
       round_even(max(CASE WHEN i = n // 2 THEN lag END), 1) AS median, round_even(max(lag), 1) AS max
FROM ranked""")
def dlt_arrival_lag(spark, sf_dir):
    """Arrival lag min / upper median / max (half-even, 1 dp)."""
    from logsift.operators.corpus import arrival_lag
    return arrival_lag(dlt_records(spark, sf_dir))


@query("dlt_refid_paths", ov.with_views(ov.v_deadletter_sql()) + r"""
, ok AS (SELECT * FROM v_deadletter WHERE json_valid(payload))
SELECT replace(replace(substr(t.fullkey, 3), '[0]', '[]'), '"', '') AS path, count(*) AS payloads
FROM ok, json_tree(CAST(payload AS JSON)) AS t
WHERE t.key IN ('refId', 'ref_id', 'referenceId', 'referenceID', 'rid')
  AND t.type IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'BOOLEAN') AND NOT regexp_matches(t.fullkey, '\[[1-9][0-9]*\]')
GROUP BY 1""")
def dlt_refid_paths(spark, sf_dir):
    """Every payload path holding an id-like key, by frequency (a walk in an
    Arrow-batched UDF; the oracle walks the same JSON trees)."""
    from logsift.operators.corpus import refid_path_frequency
    return refid_path_frequency(v_deadletter(spark, sf_dir))


ANALYSIS_NOW = "2024-02-01 00:00:00"
ANALYSIS_MAX_AGE = 40 * 86400


# what the analysis and its readers need of a case
CASE_COLS = ["case_id", "event_id", "dlt_timestamp", "ref_id", "ref_id_source", "window_start", "window_end",
             "gaps_list", "truncated", "root_fqcn", "frames", "failure_class", "class_reason", "business_code",
             "registry_description", "registry_category", "registry_category_source", "fingerprint", "signature"]
# read by the casebooks alone; the other queries do not carry them
CASEBOOK_COLS = ["payload", "chain"]


def dlt_cases_df(spark, sf_dir, now=ANALYSIS_NOW, max_age=ANALYSIS_MAX_AGE):
    """Failures with ids, window and gaps.  Ids are found before the records
    meet their parsed traces, so that a payload is not moved for its ids."""
    df = D.log_window(dlt_ids_df(spark, sf_dir), F.lit(now).cast("timestamp"), max_age_seconds=max_age)
    df = df.withColumn("gaps_list", D.evidence_gaps(F.col("ref_id_mismatch"), F.col("ref_id"),
                                                    F.col("last_attempt_ms"), F.col("too_old")))
    return D.build_failures(df, reason_codes(spark), packages=APP_PACKAGES, boilerplate=BOILERPLATE, materialize=True)


def dlt_case_inputs(spark, sf_dir, cases):
    """(cases, log lines, agent results) that an analysis starts from; raw
    headers and trace text are not read after parsing, so ``cases`` comes with
    the columns to carry alone."""
    from logsift.plans.views import v_agent, v_case_log
    from logsift.session import materialize
    # the test data's gapped traces: every seventh record
    cases = materialize(cases.withColumn("trace_gap", F.col("event_id") % 7 == 0))
    agent = v_agent(spark, sf_dir).join(cases.select("event_id", "case_id"), "event_id").drop("event_id")
    return cases, v_case_log(spark, sf_dir), agent


def dlt_analysis_df(spark, sf_dir, casebooks=True):
    from logsift.operators.analysis import analyse_cases
    cases = dlt_cases_df(spark, sf_dir).select(*CASE_COLS, *(CASEBOOK_COLS if casebooks else []))
    return analyse_cases(*dlt_case_inputs(spark, sf_dir, cases), materialize=True)


_CORR_VIEWS = ov.with_views(ov.v_deadletter_sql(), ov.v_dlt_headers_sql(), ov.v_failures_sql(), ov.v_ref_ids_sql(),
                            ov.v_case_log_sql(), ov.v_corroboration_sql(ANALYSIS_NOW, ANALYSIS_MAX_AGE))


@query("dlt_corroboration", _CORR_VIEWS + """
SELECT case_id, verdict, corroboration_reason, matched_declared, error_lines_seen, could_not_look,
       citations_text, unexplained_text, matched_on FROM v_corr""")
def dlt_corroboration(spark, sf_dir):
    """Declared root versus the error lines inside each case's log window."""
    return dlt_analysis_df(spark, sf_dir, casebooks=False).select(
        "case_id", "verdict", "corroboration_reason", "matched_declared", "error_lines_seen", "could_not_look",
        F.array_join("citations", "\n").alias("citations_text"), F.array_join("unexplained", ",").alias("unexplained_text"),
        "matched_on")


_DEC_VIEWS = _CORR_VIEWS + ", " + ov.v_decisions_sql()


@query("dlt_decisions", _DEC_VIEWS + """
SELECT case_id, occurrence, decision, decision_reason, provenance, canned_narrative, canned_recommendation,
       final_action, round(final_confidence, 6) AS final_confidence, array_to_string(final_ceilings, ',') AS ceilings,
       coalesce(final_action IN ('REDRIVE_AFTER_RECOVERY') AND final_confidence IS NOT NULL AND final_confidence >= 0.55
                AND coalesce(ref_id, '') <> '', false) AS should_replay,
       CASE WHEN final_action IS NULL OR final_action NOT IN ('REDRIVE_AFTER_RECOVERY')
              THEN 'action ''' || coalesce(final_action, 'None') || ''' is not in the replay-worthy set (''REDRIVE_AFTER_RECOVERY'')'
            WHEN final_confidence IS NULL THEN 'finding carries no confidence score -- a canned treatment produced it, and no model ran to be confident about anything'
            WHEN final_confidence < 0.55 THEN 'confidence ' || printf('%.2f', final_confidence) || ' is below DLT_REPLAY_CONFIDENCE_THRESHOLD (0.55)'
            WHEN coalesce(ref_id, '') = '' THEN 'no refId on this case; nothing to identify the packet to OIS with'
            ELSE 'action ' || final_action || ' at confidence ' || printf('%.2f', final_confidence) || ' clears the 0.55 threshold' END AS replay_reason,
       CASE WHEN final_action = 'NO_ACTION' THEN 'COMPLETED' ELSE 'NEEDS_MANUAL_REVIEW' END AS terminal_status
FROM v_decisions""")
def dlt_decisions(spark, sf_dir):
    """Occurrence order, reuse decision, treatment, ceilings and replay gate."""
    return dlt_analysis_df(spark, sf_dir, casebooks=False).select(
        "case_id", "occurrence", "decision", "decision_reason", "provenance", "canned_narrative",
        "canned_recommendation", "final_action", F.round("final_confidence", 6).alias("final_confidence"),
        F.array_join("ceilings_applied", ",").alias("ceilings"), "should_replay", "replay_reason", "terminal_status")


def dlt_groups_df(spark, sf_dir):
    from logsift.operators import groups as G
    cases = dlt_analysis_df(spark, sf_dir, casebooks=False).withColumn("seen_at", F.col("dlt_timestamp"))
    g = G.group_rollup(cases, seq="dlt_timestamp")
    return G.attach_recommendations(g, cases.withColumn("action", F.col("final_action"))
                                    .withColumn("confidence", F.col("final_confidence")), seq="dlt_timestamp")


_GROUP_SQL = _DEC_VIEWS + """,
g_hist AS (
  SELECT fingerprint, string_agg(verdict || '=' || CAST(n AS VARCHAR), ',' ORDER BY verdict) AS history_text
  FROM (SELECT fingerprint, verdict, count(*) AS n FROM v_decisions GROUP BY ALL) GROUP BY fingerprint),
g_mem AS (
  SELECT fingerprint, count(*) AS n_members, arg_max(case_id, rk_asc) AS newest_member, arg_min(case_id, rk_asc) AS oldest_retained
  FROM (SELECT fingerprint, case_id, row_number() OVER (PARTITION BY fingerprint ORDER BY dlt_timestamp DESC, case_id DESC) AS rk,
               row_number() OVER (PARTITION BY fingerprint ORDER BY dlt_timestamp, case_id) AS rk_asc FROM v_decisions)
  WHERE rk <= 200 GROUP BY fingerprint),
g_rec AS (
  SELECT fingerprint, arg_max(final_action, dlt_timestamp) AS recommendation_action,
         arg_max(final_confidence, dlt_timestamp) AS recommendation_confidence
  FROM v_decisions WHERE provenance = 'agent' GROUP BY fingerprint),
v_groups AS (
  SELECT fingerprint, count(DISTINCT case_id) AS occurrence_count, min(dlt_timestamp) AS first_seen, max(dlt_timestamp) AS last_seen,
         arg_max(signature, (dlt_timestamp, case_id)) FILTER (WHERE coalesce(signature, '') <> '') AS signature,
         arg_max(failure_class, (dlt_timestamp, case_id)) AS failure_class,
         arg_max(business_code, (dlt_timestamp, case_id)) FILTER (WHERE business_code IS NOT NULL) AS business_code
  FROM v_decisions GROUP BY fingerprint)"""


@query("dlt_groups", _GROUP_SQL + """
SELECT g.*, h.history_text, m.n_members, m.newest_member, m.oldest_retained,
       CASE WHEN r.recommendation_action IS NOT NULL THEN 'draft' ELSE 'none' END AS recommendation_state,
       r.recommendation_action, round(r.recommendation_confidence, 6) AS recommendation_confidence
FROM v_groups g LEFT JOIN g_hist h USING (fingerprint) LEFT JOIN g_mem m USING (fingerprint) LEFT JOIN g_rec r USING (fingerprint)""")
def dlt_groups(spark, sf_dir):
    """Failure-group roll-up: distinct occurrences, first/last seen, latest
    signature/class/code, verdict history, newest 200 members, recommendation."""
    g = dlt_groups_df(spark, sf_dir)
    hist = F.array_join(F.transform(F.array_sort(F.map_entries("corroboration_history")),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return g.select("fingerprint", "occurrence_count", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
                    F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "signature", "failure_class",
                    "business_code", hist.alias("history_text"), F.size("members").cast("bigint").alias("n_members"),
                    F.try_element_at("members", F.lit(-1)).alias("newest_member"),
                    F.try_element_at("members", F.lit(1)).alias("oldest_retained"), "recommendation_state",
                    "recommendation_action", F.round("recommendation_confidence", 6).alias("recommendation_confidence"))


@query("dlt_top_groups", _GROUP_SQL + """
SELECT substr(fingerprint, 1, 16) AS fingerprint, occurrence_count, failure_class, last_seen, signature
FROM v_groups ORDER BY occurrence_count DESC, v_groups.fingerprint LIMIT 5""")
def dlt_top_groups(spark, sf_dir):
    """Top groups by occurrence count (a top-k report)."""
    g = dlt_groups_df(spark, sf_dir)
    return (g.orderBy(F.col("occurrence_count").desc(), F.col("fingerprint")).limit(5)
            .select(F.substring("fingerprint", 1, 16).alias("fingerprint"), "occurrence_count", "failure_class",
                    F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "signature"))


@query("dlt_unreviewed", _GROUP_SQL + """
, ur AS (SELECT g.fingerprint, g.occurrence_count, g.signature FROM v_groups g JOIN g_rec r USING (fingerprint))
SELECT substr(fingerprint, 1, 16) AS fingerprint, occurrence_count AS served, signature FROM ur""")
def dlt_unreviewed(spark, sf_dir):
    """Draft recommendations awaiting review, most-served first."""
    g = dlt_groups_df(spark, sf_dir).where(F.col("recommendation_state") == "draft")
    return g.orderBy(F.col("occurrence_count").desc()).select(
        F.substring("fingerprint", 1, 16).alias("fingerprint"), F.col("occurrence_count").alias("served"), "signature")


@query("dlt_fleet_stats", _GROUP_SQL + """
, vt AS (SELECT verdict, count(*) AS n FROM v_decisions GROUP BY verdict)
SELECT (SELECT CAST(sum(occurrence_count) AS BIGINT) FROM v_groups) AS cases,
       (SELECT count(*) FROM v_groups) AS signatures,
       (SELECT CAST(coalesce(sum(occurrence_count) FILTER (WHERE failure_class = 'A'), 0) AS BIGINT) FROM v_groups) AS class_a,
       (SELECT CAST(coalesce(sum(occurrence_count) FILTER (WHERE failure_class = 'B'), 0) AS BIGINT) FROM v_groups) AS class_b,
       (SELECT CAST(coalesce(sum(occurrence_count) FILTER (WHERE failure_class = 'C'), 0) AS BIGINT) FROM v_groups) AS class_c,
       (SELECT CAST(coalesce(sum(occurrence_count) FILTER (WHERE failure_class = 'U'), 0) AS BIGINT) FROM v_groups) AS class_u,
       (SELECT CAST(coalesce(sum(n) FILTER (WHERE verdict IN ('CONTRADICTED', 'PARTIAL')), 0) AS BIGINT) FROM vt) AS discrepancies,
       (SELECT count(*) FILTER (WHERE failure_class = 'A') FROM v_groups) AS class_a_groups,
       (SELECT round(CASE WHEN sum(occurrence_count) FILTER (WHERE failure_class = 'A') > 0
                     THEN greatest(0.0, 1.0 - (count(*) FILTER (WHERE failure_class = 'A'))
                          / (sum(occurrence_count) FILTER (WHERE failure_class = 'A'))) ELSE 0.0 END, 4) FROM v_groups)
         AS llm_calls_avoided""")
def dlt_fleet_stats(spark, sf_dir):
    """Fleet statistics: cases, signatures, cases per class, discrepancies and
    the share of model calls avoided by reuse."""
    from logsift.operators.groups import llm_calls_avoided
    g = dlt_groups_df(spark, sf_dir)
    cls = F.col("failure_class")
    per = g.agg(F.sum("occurrence_count").cast("bigint").alias("cases"), F.count(F.lit(1)).alias("signatures"),
                *[F.coalesce(F.sum(F.when(cls == c, F.col("occurrence_count"))), F.lit(0)).cast("bigint")
                  .alias(f"class_{c.lower()}") for c in "ABCU"],
                F.count_if(cls == "A").alias("class_a_groups"))
    disc = g.select(F.explode("corroboration_history").alias("verdict", "n")).where(
        F.col("verdict").isin("CONTRADICTED", "PARTIAL")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("discrepancies"))
    out = per.crossJoin(disc)  # two one-row aggregates
    return out.select("cases", "signatures", "class_a", "class_b", "class_c", "class_u", "discrepancies",
                      "class_a_groups", F.round(llm_calls_avoided(F.col("class_a"), F.col("class_a_groups")), 4)
                      .alias("llm_calls_avoided"))


@query("dlt_casebooks")
def dlt_casebooks(spark, sf_dir):
    """Terminal DLT casebooks with the bounded evidence document (with the
    case's log lines inside its window) and the payload summary, flattened
    for checking."""
    from logsift.operators import casebooks as CB
    from logsift.operators.analysis import case_evidence, decide_cases
    from logsift.plans.dlt_fixture import TYPE_A
    from pyspark.sql import types as T
    cand = T.StructType([T.StructField("candidateRefId", T.StringType()), T.StructField("score", T.IntegerType())])
    ddl = ("response STRUCT<refId: STRING, results: STRUCT<referenceId: STRING, matches: ARRAY<STRUCT<engine: STRING, "
           "candidates: ARRAY<STRUCT<candidateRefId: STRING, score: INT>>>>>>")
    spec = {"schema_ddl": ddl, "matchers": "response.results.matches",
            "engine": "engine", "candidates": "candidates", "candidate_type": T.ArrayType(cand)}
    # what a casebook says of payload and chain is found where a record is
    # parsed; the payload and the frames of the links are not carried
    cases = CB.payload_summary(dlt_cases_df(spark, sf_dir), typed={TYPE_A: spec}).withColumn(
        "chain", F.transform("chain", lambda link: F.struct(link["fqcn"].alias("fqcn"), link["message"].alias("message"))))
    cases, log, agent = dlt_case_inputs(spark, sf_dir, cases.select(*CASE_COLS, "chain", "payload_keys", "candidate_total"))
    cases, lines = case_evidence(cases, log)
    a = decide_cases(cases, lines, agent, whole=False)
    # the lines inside each case's window, once for every row of the case
    s = a.join(CB.logs_text(lines.join(a.select("case_id"), "case_id")), "case_id", "left")
    books = CB.dlt_casebook(s)
    return books.join(s.select("case_id", "payload_keys", "candidate_total",
                               CB.evidence_document(s).alias("evidence")), "case_id").select(
        "case_id", "status", F.col("casebook.finding.action").alias("action"),
        F.col("casebook.reuse.decision").alias("decision"), F.array_join("payload_keys", ",").alias("payload_keys"),
        "candidate_total", F.length("evidence").alias("evidence_chars"))


@query("replay_nominations", _DEC_VIEWS + """
SELECT case_id, ref_id AS id, 'REFID' AS idType, 5 AS priority, 'dlt-analysis-auto' AS operatorName,
       'DLT_REDRIVE' AS category, false AS fromSedaStart
FROM v_decisions
WHERE final_action IN ('REDRIVE_AFTER_RECOVERY') AND final_confidence IS NOT NULL AND final_confidence >= 0.55
  AND coalesce(ref_id, '') <> ''""")
def replay_nominations(spark, sf_dir):
    """Replay-queue rows for the cases that cleared the replay gate."""
    from logsift.operators.policy import replay_nominations as nominate
    return nominate(dlt_analysis_df(spark, sf_dir, casebooks=False))


@query("dlt_group_detail", _GROUP_SQL + """
, hc AS (SELECT fingerprint, verdict, count(*) AS n FROM v_decisions GROUP BY ALL),
hs AS (SELECT fingerprint, string_agg(verdict || '=' || CAST(n AS VARCHAR), ',' ORDER BY -n, verdict) AS history_by_count,
              coalesce(max(CASE WHEN verdict = 'CONTRADICTED' THEN n END), 0) > 0 AS some_contradicted FROM hc GROUP BY fingerprint),
lm AS (SELECT fingerprint, string_agg(case_id, ',' ORDER BY dlt_timestamp, case_id) AS last_members
       FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY dlt_timestamp DESC, case_id DESC) AS rk FROM v_decisions)
       WHERE rk <= 10 GROUP BY fingerprint),
px AS (SELECT substr(fingerprint, 1, 8) AS prefix, count(*) AS n FROM v_groups GROUP BY 1)
SELECT g.fingerprint, substr(g.fingerprint, 1, 8) AS prefix, px.n > 1 AS ambiguous_prefix, hs.history_by_count,
       hs.some_contradicted, lm.last_members
FROM v_groups g JOIN px ON px.prefix = substr(g.fingerprint, 1, 8) JOIN hs USING (fingerprint) JOIN lm USING (fingerprint)""")
def dlt_group_detail(spark, sf_dir):
    """Group detail for every group: prefix and its ambiguity, verdict
    history most frequent first, contradiction flag, last 10 members."""
    from logsift.operators.groups import group_detail
    d = group_detail(dlt_groups_df(spark, sf_dir))
    return d.withColumn("last_members", F.array_join("last_members", ","))
