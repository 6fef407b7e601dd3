"""Raw log-line parsing into canonical records (all lines at once)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.levels import normalise_level, scan_level_token
from logsift.functions.text import (
    KUBELET_PREFIX_RE, LEADING_TS_RE, RFC3339_RE, blank_to_null, first_json_key, is_json_object,
    sanitise_pod_name, strip_ws,
)

# --- fixed values (must equal the behaviour being matched) -----------------
JSON_LEVEL_KEYS = ["level", "severity", "log_level", "loglevel", "lvl"]
JSON_MESSAGE_KEYS = ["message", "msg", "log", "text"]
JSON_APP_KEYS = ["application_name", "app", "service", "logger_name", "service_name"]
JSON_TIME_KEYS = ["@timestamp", "timestamp", "time", "ts"]
DEFAULT_APP = "unknown-service"
# Dump normaliser: service keys exclude the logger name; pod keys.
DUMP_APP_KEYS = ["application_name", "app", "service", "service_name"]
DUMP_POD_KEYS = ["HOSTNAME", "hostname", "kubernetes.pod_name", "pod_name", "host"]
CSV_JSON_RE = r'(?s)"(\{.*\})"\s*(?:,|$)'
# ---------------------------------------------------------------------------


def split_kubelet_timestamp(line: Column) -> tuple[Column, Column]:
    """(kubelet RFC3339 prefix or NULL, remainder)."""
    ts = F.nullif(F.regexp_extract(line, KUBELET_PREFIX_RE, 1), F.lit(""))
    rest = F.regexp_replace(line, KUBELET_PREFIX_RE, "")
    return ts, rest


def parse_log_lines(lines: DataFrame, line: str = "line", default_app: str | Column = DEFAULT_APP,
                    keep_blank: bool = False) -> DataFrame:
    """Parse raw pod-log lines (kubelet prefix + JSON object or plain text).

    Adds: timestamp (kubelet time, else the app's own, else ''), level
    (normalised; INFO when nothing was recognised), message, app_name,
    level_parsed, was_json, source.  Blank lines are dropped.
    """
    raw = F.regexp_replace(F.col(line), r"\n$", "")
    kts, rest = split_kubelet_timestamp(raw)
    df = lines.withColumns({"_kts": kts, "_rest": strip_ws(rest)})
    if not keep_blank:
        df = df.where(strip_ws(F.col(line)) != F.lit(""))
    rest = F.col("_rest")
    is_obj = is_json_object(rest)
    json_level = normalise_level(first_json_key(rest, JSON_LEVEL_KEYS))
    level = F.when(is_obj, json_level)
    level = F.coalesce(level, scan_level_token(rest))
    app_default = default_app if isinstance(default_app, Column) else F.lit(default_app)
    df = df.withColumns({
        "was_json": is_obj,
        "_lvl": level,
        "message": F.when(is_obj, F.coalesce(first_json_key(rest, JSON_MESSAGE_KEYS), rest)).otherwise(rest),
        "app_name": F.when(is_obj, F.coalesce(first_json_key(rest, JSON_APP_KEYS), app_default)).otherwise(app_default),
        "timestamp": F.coalesce(F.col("_kts"), F.when(is_obj, first_json_key(rest, JSON_TIME_KEYS)), F.lit("")),
    })
    return (df.withColumns({"level": F.coalesce(F.col("_lvl"), F.lit("INFO")),
                            "level_parsed": F.col("_lvl").isNotNull(),
                            "source": F.lit("kubernetes")})
            .drop("_kts", "_rest", "_lvl"))


def parse_quality(parsed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Parse-quality counters per key: total, level_parsed, json_lines and the
    two rates (0.0 when there are no lines).  Additive: re-aggregating the
    counters of parts gives the counters of the whole."""
    agg = parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("level_parsed").alias("level_parsed"),
        F.count_if("was_json").alias("json_lines"),
    )
    return with_quality_rates(agg)


def with_quality_rates(counts: DataFrame) -> DataFrame:
    total = F.col("total")
    return counts.withColumns({
        "level_failure_rate": F.when(total == 0, F.lit(0.0)).otherwise(1.0 - F.col("level_parsed") / total),
        "json_ratio": F.when(total == 0, F.lit(0.0)).otherwise(F.col("json_lines") / total),
    })


def normalise_timestamp(raw: Column) -> Column:
    """RFC3339 passes through untouched; other ISO forms -> UTC RFC3339
    (``+00:00`` offset, as an ISO formatter writes it); otherwise ''."""
    text = F.trim(raw.cast("string"))
    parsed = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    iso = F.when(F.date_format(parsed, "SSSSSS") == F.lit("000000"),
                 F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")) \
        .otherwise(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    return (F.when(F.coalesce(text, F.lit("")) == F.lit(""), F.lit(""))
            .when(text.rlike("^" + RFC3339_RE + "$"), text)
            .otherwise(F.coalesce(iso, F.lit(""))))


def origin_label(app: Column, pod: Column) -> Column:
    return F.when(F.coalesce(pod, F.lit("")) != F.lit(""), F.concat(F.coalesce(app, F.lit("")), F.lit("@"), pod)) \
        .otherwise(F.coalesce(app, F.lit("")))


def stamp_provenance(records: DataFrame, **values) -> DataFrame:
    """Set provenance columns (source, pod_name, container, container_instance)
    to literals or columns."""
    return records.withColumns({k: (v if isinstance(v, Column) else F.lit(v)) for k, v in values.items()})


def classify_dump_lines(lines: DataFrame, line: str = "line", forced_app: str | None = None) -> DataFrame:
    """Detect the format of each line of a mixed dump and extract its parts.

    format: json (bare object or Kibana-CSV quoted object), kubelet, plain-dated,
    plain; plus raw timestamp, pod, app and body.  Blank lines are dropped.
    """
    raw = F.regexp_replace(F.col(line), r"\r?\n$|\r$", "")
    df = lines.withColumn("_l", raw).where(strip_ws(F.col("_l")) != F.lit(""))
    stripped = strip_ws(F.col("_l"))
    bare_obj = is_json_object(stripped)
    csv_cand = F.regexp_replace(F.regexp_extract(stripped, CSV_JSON_RE, 1), '""', '"')
    csv_obj = (~stripped.startswith("{")) & is_json_object(csv_cand)
    payload = F.when(bare_obj, stripped).when(csv_obj, csv_cand)
    df = df.withColumn("_p", payload)
    p = F.col("_p")
    kub = F.nullif(F.regexp_extract(F.col("_l"), KUBELET_PREFIX_RE, 1), F.lit(""))
    lead = F.nullif(F.regexp_extract(F.col("_l"), LEADING_TS_RE, 1), F.lit(""))
    fmt = (F.when(p.isNotNull(), F.lit("json")).when(kub.isNotNull(), F.lit("kubelet"))
           .when(lead.isNotNull(), F.lit("plain-dated")).otherwise(F.lit("plain")))
    ts_raw = F.when(p.isNotNull(), normalise_timestamp(first_json_key(p, JSON_TIME_KEYS, nested=True))) \
        .when(kub.isNotNull(), kub).when(lead.isNotNull(), lead).otherwise(F.lit(""))
    body = (F.when(p.isNotNull(), p)
            .when(kub.isNotNull(), F.regexp_replace(F.col("_l"), KUBELET_PREFIX_RE, ""))
            .when(lead.isNotNull(), F.regexp_replace(F.col("_l"), LEADING_TS_RE, ""))
            .otherwise(F.col("_l")))
    app = F.lit(forced_app) if forced_app else F.when(p.isNotNull(), first_json_key(p, DUMP_APP_KEYS, nested=True))
    pod = F.when(p.isNotNull(), first_json_key(p, DUMP_POD_KEYS, nested=True))
    return (df.withColumns({"format": fmt, "ts_raw": F.nullif(ts_raw, F.lit("")),
                            "pod_raw": blank_to_null(pod), "app_raw": blank_to_null(app), "body": body})
            .drop("_l", "_p"))


def sanitise(c: Column) -> Column:
    return sanitise_pod_name(c)


def normalise_dump(lines: DataFrame, file: str = "file", chunk: str = "chunk", order: str = "line_no",
                   line: str = "line", forced_app: str | None = None,
                   default_app: str = DEFAULT_APP) -> DataFrame:
    """Mixed-format dump -> (timestamp, pod, app, body, format) per line.

    Undated lines inherit the previous timestamp; the undated preamble before
    a file's first timestamp is dropped *before* pod/app are carried, so it
    never updates them.  Until a real pod name appears, lines take the
    synthetic ``<app>-offline-0`` pod of the first kept line.
    """
    from logsift.operators.windows import chunked_ffill
    c = classify_dump_lines(lines, line, forced_app)
    c = chunked_ffill(c, ["ts_raw"], file, chunk, order, suffix="_f")
    kept = c.where(F.col("ts_raw_f").isNotNull())
    kept = kept.withColumns({"_pod_s": F.when(F.col("pod_raw").isNotNull(), sanitise_pod_name(F.col("pod_raw"))),
                             "_app_s": F.when(F.col("app_raw").isNotNull(), sanitise_pod_name(F.col("app_raw")))})
    kept = chunked_ffill(kept, ["_pod_s", "_app_s"], file, chunk, order, suffix="_f")
    app = F.coalesce(F.col("_app_s_f"), F.lit(default_app))
    kept = kept.withColumn("app", app)
    okey = F.struct(F.col(chunk), F.col(order))
    first_app = kept.groupBy(file).agg(F.min_by(F.col("_app_s_f"), okey).alias("_first_app"))
    synthetic = sanitise_pod_name(F.concat(F.coalesce(F.col("_first_app"), F.lit(default_app)), F.lit("-offline-0")))
    out = kept.join(first_app, file, "left").withColumn("pod", F.coalesce(F.col("_pod_s_f"), synthetic))
    return out.select(*[x for x in lines.columns if x != line], "format",
                      F.col("ts_raw_f").alias("timestamp"), "pod", "app", "body",
                      F.concat(F.col("ts_raw_f"), F.lit(" "), F.col("body")).alias("out_line"))
