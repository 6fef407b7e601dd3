"""Pod inventory, target selection and pod-log retrieval as table operators.

The pod inventory and service list are reference-sized (hundreds of pods,
tens of services), so selection uses small joins and windows over them.
Log lines are the large side: per-file line numbering is a chunked running
count, match context is an exact range expansion (each match emits its
window positions, then an equi-join on (file, position)), and the byte cap is
a chunked running sum -- no unbounded per-file window anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.operators.sift import FILTER_BITS, sift
from logsift.operators.windows import chunked_running_sum

# --- fixed values (must equal the behaviour being matched) -----------------
DEFAULT_PHASE = "Running"
DEFAULT_START = "2000-01-01T00:00:00+00:00"
DEFAULT_CONTAINERS = ["app"]
SIDECAR_DENYLIST = ["istio-proxy", "linkerd-proxy", "vault-agent"]
MAX_PODS_PER_SERVICE = 20
CONTEXT_BEFORE = 5
CONTEXT_AFTER = 20
MAX_BYTES_PER_POD = 10 * 1024 * 1024
ROTATION_SLACK_SECONDS = 60
PARSE_DEGRADED_RATE = 0.9
BANNER_HEADER = "--- EVIDENCE GAPS (the trace below is INCOMPLETE) ---"
BANNER_FOOTER = "--- END EVIDENCE GAPS ---"
POD_LOG_PATH_RE = r"([^/]+)/([^/]+)/(current|previous)\.log$"
# ---------------------------------------------------------------------------

META_SCHEMA = T.StructType([
    T.StructField("phase", T.StringType()), T.StructField("start_time", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("containers", T.ArrayType(T.StringType())),
    T.StructField("restart_counts", T.MapType(T.StringType(), T.IntegerType()))])


# ------------------------------------------------------------------ sources --

def read_pod_logs(spark: SparkSession, root: str, path_re: str = POD_LOG_PATH_RE) -> DataFrame:
    """``<root>/<ns>/<pod>/{current,previous}.log`` -> one row per non-blank
    line with namespace, pod, instance, file, chunk (file split) and order.

    A missing previous.log is simply absent.  Line order inside a file is
    (file split start, position within the split)."""
    df = (spark.read.text(f"{root}/*/*/*.log")
          .select("value", F.col("_metadata.file_path").alias("file"),
                  F.col("_metadata.file_block_start").alias("chunk"))
          .withColumn("pos", F.monotonically_increasing_id()))
    return (df.select(F.regexp_extract("file", path_re, 1).alias("namespace"),
                      F.regexp_extract("file", path_re, 2).alias("pod"),
                      F.regexp_extract("file", path_re, 3).alias("instance"),
                      "file", "chunk", "pos", F.col("value").alias("line"))
            .where(F.trim(F.col("line")) != ""))


def read_pod_meta(spark: SparkSession, root: str) -> DataFrame:
    """``meta.json`` per pod (multi-line JSON) with the documented defaults."""
    df = (spark.read.schema(META_SCHEMA).option("multiLine", True).json(f"{root}/*/*/meta.json")
          .withColumn("file", F.col("_metadata.file_path")))
    return pod_inventory(df.select(F.regexp_extract("file", r"([^/]+)/([^/]+)/meta\.json$", 1).alias("namespace"),
                                   F.regexp_extract("file", r"([^/]+)/([^/]+)/meta\.json$", 2).alias("pod"),
                                   "phase", "start_time", "labels", "containers", "restart_counts"))


def pod_inventory(meta: DataFrame) -> DataFrame:
    """Defaults applied, one row per (pod, container)."""
    df = meta.withColumns({
        "phase": F.coalesce(F.col("phase"), F.lit(DEFAULT_PHASE)),
        "start_time": F.try_to_timestamp(F.coalesce(F.col("start_time"), F.lit(DEFAULT_START))),
        "labels": F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>")),
        "containers": F.when(F.size(F.coalesce(F.col("containers"), F.array())) > 0, F.col("containers"))
        .otherwise(F.array(*[F.lit(c) for c in DEFAULT_CONTAINERS])),
    })
    return df


# ---------------------------------------------------------------- selection --

def eligible_containers(pods: DataFrame, sidecars: Sequence[str] = tuple(SIDECAR_DENYLIST)) -> DataFrame:
    """Pending pods dropped; sidecars dropped unless that removes every
    container; one row per remaining (pod, container) with its restarts."""
    deny = F.array(*[F.lit(s) for s in sidecars])
    kept = F.filter("containers", lambda c: ~F.array_contains(deny, c))
    cont = F.when(F.size(kept) == 0, F.col("containers")).otherwise(kept)
    p = pods.where(F.col("phase") != "Pending").withColumn("container", F.explode(cont))
    rc = F.try_element_at(F.coalesce(F.col("restart_counts"), F.create_map().cast("map<string,int>")), F.col("container"))
    return p.withColumn("restart_count", F.coalesce(rc, F.lit(0)))


def match_services(services: DataFrame, pods: DataFrame) -> DataFrame:
    """Services (service, ord, namespace, mode, value[, selector]) x pods.

    ``name_contains``: the pod name contains the value; ``label``: every
    selector entry equals the pod's label.  The service list is tiny and
    broadcast; the condition is evaluated per (service, pod) in the namespace.
    """
    s = F.broadcast(services)
    by_name = (F.col("mode") == "name_contains") & F.col("pod").contains(F.col("value"))
    by_label = (F.col("mode") == "label") & F.forall(
        F.map_entries(F.coalesce(F.col("selector"), F.create_map().cast("map<string,string>"))),
        lambda e: F.try_element_at(F.col("labels"), e["key"]) == e["value"])
    j = pods.join(s, (pods["namespace"] == s["namespace"]) & (by_name | by_label))
    return j.drop(s["namespace"])


def cap_per_service(matched: DataFrame, max_pods: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pods ranked per service (start time desc, no start last, then name):
    (targets with their rank, TRUNCATED gaps).  All of them unless a cap is
    given (``MAX_PODS_PER_SERVICE``): then the newest ``max_pods`` stay and the
    gap names the number that matched."""
    pods = matched.select("service", "ord", "namespace", "pod", "start_time").distinct()
    w = Window.partitionBy("service").orderBy(F.col("start_time").desc_nulls_last(), F.col("pod"))
    ranked = pods.withColumns({"rank": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("service"))})
    over = F.lit(False) if max_pods is None else F.col("_n") > max_pods
    gaps = (ranked.where((F.col("rank") == 1) & over)
            .select(F.lit("TRUNCATED").alias("gap_type"),
                    F.format_string("service %s matched %d pods; only the %d most recently started were read "
                                    "(K8S_MAX_PODS).", "service", "_n", F.lit(max_pods)).alias("detail"),
                    "service"))
    kept = (ranked if max_pods is None else ranked.where(F.col("rank") <= max_pods)).drop("_n")
    return matched.join(kept.select("service", "pod", "rank"), ["service", "pod"]), gaps


def merge_round_robin(capped: DataFrame, total_cap: int = 0) -> DataFrame:
    """Interleave services round-robin by rank, each pod kept once at its
    first (rank, service order) position, optional total pod cap."""
    first = capped.groupBy("namespace", "pod").agg(F.min(F.struct("rank", "ord")).alias("_first"))
    ordered = first.withColumn("merge_pos", F.row_number().over(
        Window.orderBy(F.col("_first.rank"), F.col("_first.ord"), F.col("pod"))))  # pods: reference-sized
    if total_cap > 0:
        ordered = ordered.where(F.col("merge_pos") <= total_cap)
    keep = ordered.select("namespace", "pod", "merge_pos", F.col("_first.ord").alias("_ord"))
    return capped.join(keep, ["namespace", "pod"]).where(F.col("ord") == F.col("_ord")).drop("_ord")


# ---------------------------------------------------------------- retrieval --

def number_lines(lines: DataFrame, file: str = "file", chunk: str = "chunk", pos: str = "pos") -> DataFrame:
    """Contiguous 1-based line numbers per file (chunked running count)."""
    return chunked_running_sum(lines.withColumn("_one", F.lit(1)), "_one", file, chunk, pos, out="line_no").drop("_one")


def byte_cap(lines: DataFrame, cap: int = MAX_BYTES_PER_POD, file: str = "file", chunk: str = "chunk",
             pos: str = "pos", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Keep each file's lines while the running byte count (line + newline)
    stays within ``cap``; returns (kept lines, TRUNCATED gaps per file)."""
    sized = lines.withColumn("_bytes", F.octet_length(F.col(line)) + 1)
    run = chunked_running_sum(sized, "_bytes", file, chunk, pos, out="_run")
    kept = run.where(F.col("_run") <= cap).drop("_bytes", "_run")
    gaps = (run.where(F.col("_run") > cap).groupBy(file).agg(F.min("_run").alias("_at"))
            .select(F.lit("TRUNCATED").alias("gap_type"),
                    F.format_string("log of %s exceeded %d bytes; the rest was not read.", F.col(file), F.lit(cap))
                    .alias("detail"), F.col(file)))
    return kept, gaps


#: Length of the grams that bring identifiers and lines together; shorter
#: identifiers are their own gram.
GRAM = 8


def _grams(text: Column, n: Column | int, block: int = 512) -> Column:
    """The distinct substrings of ``n`` characters.  A text is cut into
    overlapping blocks first: reaching a character takes time in proportion to
    its place, which in a very long line would square."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(text) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda s: F.substring(text, s, n + (block - 1)))
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.transform(
        F.sequence(F.lit(1), F.length(b) - n + 1), lambda i: F.substring(b, i, n)))))


def _line_grams(lines: DataFrame, lengths: DataFrame, text: Column, line: str, key: Sequence[str]) -> DataFrame:
    """(*key, line, _gram): the distinct grams of each line; ``lengths`` is the
    one row of gram lengths in use."""
    return lines.select(*key, line).crossJoin(F.broadcast(lengths)).select(*key, line, F.explode(F.array_distinct(
        F.flatten(F.transform("_lengths", lambda n: _grams(text, n))))).alias("_gram"))


def id_hits(lines: DataFrame, ids: DataFrame, line: str = "line", key: Sequence[str] = ("file", "line_no"),
            case_sensitive: bool = True, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Lines containing any of many identifiers, as plain substrings:
    (flow_id, identifier, *key, line), once per identifier of a flow and line.

    Of an identifier's grams of 8 characters (a shorter identifier is its own
    gram) the one held by the fewest lines is chosen, then by the fewest
    identifiers; an identifier with a gram that no line holds matches nothing
    and goes.  Lines are read twice, once to count the identifiers' grams
    (partial sums per gram) and once to meet the chosen ones.  Both times a
    line's grams pass a Bloom filter of bounded size where they are made, so
    what is shuffled grows with the candidates, not with the characters.
    Candidates carry their line and are verified with ``contains`` on the
    whole identifier.  An empty or null identifier or line matches nothing.
    """
    norm = (lambda c: c) if case_sensitive else F.lower
    text = norm(F.col(line))
    wanted = (ids.select("flow_id", "identifier", norm(F.col("identifier")).alias("_id"))
              .where(F.length("_id") > 0).distinct())
    names = wanted.select("_id").distinct()
    own = names.select("_id", F.explode(_grams(F.col("_id"), F.least(F.length("_id"), F.lit(GRAM)))).alias("_gram"))
    shared = own.groupBy("_gram").agg(F.count(F.lit(1)).alias("_ids"))
    # the few gram lengths in use, as one row beside every line
    lengths = names.agg(F.collect_set(F.least(F.length("_id"), F.lit(GRAM))).alias("_lengths"))
    seen = (sift(_line_grams(lines, lengths, text, line, key).drop(line, *key), shared, "_gram", filter_bits)
            .groupBy("_gram").agg(F.count(F.lit(1)).alias("_lines")))
    ranked = own.join(shared.join(seen, "_gram", "left"), "_gram").groupBy("_id").agg(
        F.min(F.struct(F.coalesce("_lines", F.lit(0)).alias("_lines"), "_ids", "_gram")).alias("_best"))
    chosen = ranked.where(F.col("_best._lines") > 0).select("_id", F.col("_best._gram").alias("_gram"))
    near = sift(_line_grams(lines, lengths, text, line, key), chosen, "_gram", filter_bits)
    found = near.join(chosen, "_gram").where(text.contains(F.col("_id")))
    return found.join(wanted, "_id").select("flow_id", "identifier", *key, line)


def match_ids(lines: DataFrame, ids: DataFrame, line: str = "line", key: Sequence[str] = ("file", "line_no"),
              case_sensitive: bool = True) -> DataFrame:
    """Lines containing any of a flow's identifiers (:func:`id_hits`):
    (flow_id, *key) pairs, each once."""
    return id_hits(lines, ids, line, key, case_sensitive).select("flow_id", *key).distinct()


def match_context(lines: DataFrame, matches: DataFrame, before: int = CONTEXT_BEFORE, after: int = CONTEXT_AFTER,
                  file: str = "file") -> DataFrame:
    """Lines within ``before`` rows ahead of and ``after`` rows past any match,
    per flow and file; overlapping windows merge; files are never crossed.
    Each match emits its window positions; an equi-join on (file, position)
    returns the lines."""
    pos = matches.select("flow_id", file, F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after))
                         .alias("line_no")).distinct()
    return lines.drop("flow_id").join(pos, [file, "line_no"])


def trace_order(records: DataFrame, flow: str = "flow_id") -> DataFrame:
    """Trace order: flow, parsed time, then the timestamp string, previous
    instance before current, file, line.  The rows are ranged over the
    partitions by that order and sorted in each, so a flow of any size is
    spread over as many partitions as its rows need."""
    ts = F.try_to_timestamp(F.col("timestamp"))
    inst = F.when(F.col("instance") == "previous", 0).otherwise(1)
    order = [flow, "_ts", "timestamp", "_inst", "file", "line_no"]
    return (records.withColumns({"_ts": ts, "_inst": inst}).repartitionByRange(*order)
            .sortWithinPartitions(*order).drop("_ts", "_inst"))


# --------------------------------------------------------------------- gaps --

def rotation_gaps(raw_oldest: DataFrame, requested_start: Column, pod_start: str = "earliest_start",
                  oldest: str = "oldest_line", slack: int = ROTATION_SLACK_SECONDS) -> DataFrame:
    """LOG_ROTATION: the oldest raw line (before id filtering) is later than
    the requested start + slack, and the pod is older than that line - slack."""
    o = F.try_to_timestamp(F.col(oldest))
    late = o > requested_start + F.expr(f"INTERVAL {slack} SECONDS")
    pod_young = F.col(pod_start).isNotNull() & (F.col(pod_start) >= o - F.expr(f"INTERVAL {slack} SECONDS"))
    return raw_oldest.where(o.isNotNull() & late & ~pod_young).select(
        "*", F.lit("LOG_ROTATION").alias("gap_type"),
        F.concat(F.lit("requested from "), F.date_format(requested_start, "yyyy-MM-dd'T'HH:mm:ssxxx"),
                 F.lit(", oldest available line is "), F.date_format(o, "yyyy-MM-dd'T'HH:mm:ssxxx"),
                 F.lit(". Logs before "), F.date_format(o, "yyyy-MM-dd'T'HH:mm:ssxxx"),
                 F.lit(" were rotated off the node and are unrecoverable.")).alias("detail"))


def pod_replaced_gaps(targets: DataFrame, requested_start: Column) -> DataFrame:
    """POD_REPLACED: one per pod that started after the window began."""
    t = targets.where(F.col("start_time") > requested_start).select("pod", "start_time").dropDuplicates(["pod"])
    return t.select(F.lit("POD_REPLACED").alias("gap_type"), F.concat(
        F.lit("pod "), F.col("pod"), F.lit(" started "), F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ssxxx"),
        F.lit(", after the requested window began at "), F.date_format(requested_start, "yyyy-MM-dd'T'HH:mm:ssxxx"),
        F.lit(". An earlier pod served part of this window; its logs are gone.")).alias("detail"), "pod")


def parse_degraded_gaps(quality: DataFrame, threshold: float = PARSE_DEGRADED_RATE) -> DataFrame:
    """LEVEL_PARSE_DEGRADED when the level failure rate reaches the threshold."""
    q = quality.where((F.col("total") > 0) & (F.col("level_failure_rate") >= threshold))
    return q.select("*", F.lit("LEVEL_PARSE_DEGRADED").alias("gap_type"), F.concat(
        F.format_string("%.0f%%", F.col("level_failure_rate") * 100), F.lit(" of "), F.col("total").cast("string"),
        F.lit(" lines had no recognisable log level. ERROR detection is unreliable for this fetch; the absence of "
              "ERROR lines below must not be read as an absence of errors.")).alias("detail"))


NO_PODS = "no searchable pods"


def coverage_gaps(listed: DataFrame, present: DataFrame, services: DataFrame, searchable: DataFrame) -> DataFrame:
    """POD_VANISHED for listed (pod, container) with no log lines;
    SERVICE_UNAVAILABLE for configured services with no searchable pods
    (``services`` may carry the ``reason``)."""
    reason = F.coalesce("reason", F.lit(NO_PODS)) if "reason" in services.columns else F.lit(NO_PODS)
    vanished = listed.join(present, ["namespace", "pod"], "left_anti").select(
        F.lit("POD_VANISHED").alias("gap_type"),
        F.concat(F.lit("pod "), F.col("pod"), F.lit(" disappeared between listing and reading; "
                                                    "its logs are unrecoverable.")).alias("detail"))
    unavailable = services.join(searchable, "service", "left_anti").select(
        F.lit("SERVICE_UNAVAILABLE").alias("gap_type"),
        F.concat(F.lit("service '"), F.col("service"), F.lit("' could not be searched: "), reason,
                 F.lit(". Any part of this packet's journey through it is missing from these logs.")).alias("detail"))
    return vanished.unionByName(unavailable)


def dedupe_gaps(gaps: DataFrame, key: Sequence[str] = ("flow_id",), seq: str = "seq") -> DataFrame:
    """One gap per (type, detail), the first kept, order kept."""
    return (gaps.groupBy(*key, "gap_type", "detail").agg(F.min(seq).alias(seq)))


def render_banner(gaps: DataFrame, key: Sequence[str] = ("flow_id",), seq: str = "seq") -> DataFrame:
    """Banner per key: header, one ``TYPE: detail`` line per gap in order,
    footer (keys without gaps get no banner row)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.concat("gap_type", F.lit(": "), "detail")
                                                             .alias("l")))), lambda x: x["l"])
    return gaps.groupBy(*key).agg(F.concat_ws("\n", F.lit(BANNER_HEADER), F.array_join(lines, "\n"),
                                              F.lit(BANNER_FOOTER)).alias("banner"))


def fetch_rollup(per_target: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Per id: records, bytes, pods queried/failed, oldest line, earliest pod
    start; ``ok`` is false only when every pod failed and nothing came back."""
    agg = per_target.groupBy(*key).agg(
        F.sum("records").cast("bigint").alias("records"), F.sum("bytes").cast("bigint").alias("bytes"),
        F.count(F.lit(1)).alias("pods_queried"), F.count_if(~F.col("read_ok")).alias("pods_failed"),
        F.min("oldest_ts").alias("oldest_line"), F.min("start_time").alias("earliest_start"))
    return agg.withColumn("ok", ~((F.col("pods_failed") == F.col("pods_queried")) & (F.col("records") == 0)))


def configured_services(spark: SparkSession, *lists: str | None, default: str = "") -> DataFrame:
    """The service list: the first non-empty comma list among ``lists``
    (parameters, in priority order), trimmed, de-duplicated with the first
    occurrence kept; ``default`` when every list is empty."""
    given = spark.createDataFrame(list(enumerate([*lists, default])), "priority int, raw string")
    names = given.select("priority", F.array_distinct(F.filter(
        F.transform(F.split(F.coalesce("raw", F.lit("")), ","), lambda n: F.trim(n)), lambda n: n != "")).alias("names"))
    chosen = names.where(F.size("names") > 0).agg(F.min_by("names", "priority").alias("names"))
    return chosen.select(F.posexplode("names").alias("ord", "service")).select("service", "ord")
