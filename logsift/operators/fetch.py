"""Index-style log fetch for many ids at once, the source fallback chain and
the query-variant recall diagnostic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.operators.pods import id_hits, match_ids

# --- fixed values (must equal the behaviour being matched) -----------------
MAX_DOCUMENTS = 50000
DEFAULT_TIME, DEFAULT_LEVEL, DEFAULT_APP = "UNKNOWN_TIME", "INFO", "unknown-service"
V_NOTHING = "ES HAS NOTHING for this id -- genuine ingestion loss or wrong index"
V_FILTER = "APP FILTER IS THE CULPRIT -- logs exist but are filtered out"
V_SYNTAX = "QUERY SYNTAX IS THE CULPRIT -- quoted query_string does not match"
V_FILTER_DROPS = "APP FILTER DROPS EVIDENCE from: {services}"
V_WIDER = "WIDER QUERY FINDS MORE -- both filter and syntax contribute"
V_FINE = "QUERY IS FINE -- production query returns everything ES has"
SERVICES_TOP = 50
# ---------------------------------------------------------------------------


def _phrase_free(message: Column, phrases: Sequence[str]) -> Column:
    if not phrases:
        return F.lit(True)
    arr = F.array(*[F.lit(p) for p in phrases])
    return ~F.exists(arr, lambda p: F.coalesce(message, F.lit("")).contains(p))


def index_fetch(ids: DataFrame, index: DataFrame, apps: Sequence[str] = (), since: Column | None = None,
                phrases: Sequence[str] = (), cap: int | None = None, order: Sequence[str] = ("ts", "line_id"),
                line_key: str = "line_id") -> DataFrame:
    """Records naming each id: app list (pushed to the scan), time lower
    bound, boilerplate-phrase exclusion.  All of them unless a ``cap`` is
    given: then the first ``cap`` per id by (time, doc id), with ``truncated``
    marking the ids that have more."""
    src = index
    if apps:
        src = src.where(F.col("app_name").isin(*apps))
    if since is not None:
        src = src.where(F.col("ts") >= since)
    if phrases:
        src = src.where(_phrase_free(F.col("message"), phrases))
    hits = match_ids(src, ids, line="message", key=(line_key,))
    rec = hits.join(src.drop("flow_id"), line_key)
    if cap is None:
        return _with_defaults(rec.withColumn("truncated", F.lit(False)))
    w = Window.partitionBy("flow_id").orderBy(*[F.col(c) for c in order])
    kept = rec.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= cap).drop("_rk")
    over = (hits.groupBy("flow_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
            .select("flow_id", F.lit(True).alias("truncated")))
    return _with_defaults(kept.join(over, "flow_id", "left")
                          .withColumn("truncated", F.coalesce(F.col("truncated"), F.lit(False))))


def _with_defaults(out: DataFrame) -> DataFrame:
    defaults = {"timestamp": DEFAULT_TIME, "level": DEFAULT_LEVEL, "app_name": DEFAULT_APP}
    return out.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v) for c, v in defaults.items()},
        "source": F.lit("elastic"),
    })


def source_chain(results: DataFrame) -> DataFrame:
    """``results``: one row per (flow_id, source, priority, ok, records).
    The first source by priority with ok and records wins; the others tried
    before it are named in a SOURCE_FALLBACK gap; when none wins, the gap is
    raised unless a single source ran cleanly and found nothing."""
    tried = F.concat(F.col("source"), F.lit(" ("), F.when(~F.col("ok"), F.lit("failed"))
                     .otherwise(F.lit("returned no records")), F.lit(")"))
    win = F.col("ok") & (F.col("records") > 0)
    r = results.withColumns({"_win": win, "_tried": tried})
    per = r.groupBy("flow_id").agg(
        F.min(F.when(F.col("_win"), F.col("priority"))).alias("_wp"),
        F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_list(F.struct("priority", "_tried", "source", "ok"))).alias("_all"))
    before = F.filter("_all", lambda x: x["priority"] < F.col("_wp"))
    winner = F.filter("_all", lambda x: x["priority"] == F.col("_wp"))
    last = F.try_element_at(F.col("_all"), F.lit(-1))
    names = lambda arr: F.array_join(F.transform(arr, lambda x: x["_tried"]), ", ")
    gap = (F.when(F.col("_wp").isNotNull() & (F.size(before) > 0),
                  F.concat(F.lit("tried "), names(before), F.lit(" first without success; the trace below came from "),
                           F.try_element_at(winner, F.lit(1))["source"], F.lit(".")))
           .when(F.col("_wp").isNull() & ((F.col("_n") > 1) | ~last["ok"]),
                 F.concat(F.lit("no source returned logs; tried "), names(F.col("_all")), F.lit("."))))
    return per.select("flow_id", F.when(F.col("_wp").isNotNull(), F.try_element_at(winner, F.lit(1))["source"])
                      .otherwise(last["source"]).alias("source"),
                      F.coalesce(F.col("_wp").isNotNull(), F.lit(False)).alias("has_records"),
                      gap.alias("fallback_gap"))


def recall_variants(ids: DataFrame, index: DataFrame, apps: Sequence[str], phrases: Sequence[str] = (),
                    line_key: str = "line_id") -> DataFrame:
    """Per id the hit counts of four query variants in one pass:
    A exact phrase + app filter + exclusions, B without the app filter,
    C loose (case-insensitive token) + app filter, D loose without filter;
    plus the diagnostic verdict."""
    # the case-blind hits hold the exact ones
    loose = (id_hits(index, ids, line="message", key=(line_key,), case_sensitive=False)
             .groupBy("flow_id", line_key).agg(F.max(F.col("message").contains(F.col("identifier"))).alias("_exact")))
    j = loose.join(index.select(line_key, "app_name", "message"), line_key)
    in_app = F.col("app_name").isin(*apps) if apps else F.lit(True)
    free = _phrase_free(F.col("message"), phrases)
    ex = F.coalesce(F.col("_exact"), F.lit(False))
    counts = j.groupBy("flow_id").agg(
        F.count_if(ex & in_app & free).alias("a"), F.count_if(ex & free).alias("b"),
        F.count_if(in_app).alias("c"), F.count(F.lit(1)).alias("d"),
        F.array_sort(F.collect_set(F.when(~in_app, F.col("app_name")))).alias("_other"))
    allids = ids.select("flow_id").distinct().join(counts, "flow_id", "left").na.fill(0, ["a", "b", "c", "d"])
    other = F.coalesce(F.col("_other"), F.array().cast("array<string>"))
    verdict = (F.when(F.col("d") == 0, F.lit(V_NOTHING))
               .when((F.col("a") == 0) & (F.col("b") > 0), F.lit(V_FILTER))
               .when((F.col("a") == 0) & (F.col("c") > 0), F.lit(V_SYNTAX))
               .when((F.col("b") > F.col("a")) & (F.size(other) > 0),
                     F.concat(F.lit("APP FILTER DROPS EVIDENCE from: "), F.array_join(other, ", ")))
               .when(F.col("d") > F.col("a"), F.lit(V_WIDER)).otherwise(F.lit(V_FINE)))
    return allids.select("flow_id", "a", "b", "c", "d", verdict.alias("verdict"))


def overall_gate(verdicts: DataFrame) -> DataFrame:
    """Majority gate over per-id verdicts."""
    v = F.col("verdict")
    agg = verdicts.agg(F.count_if(v.contains("APP FILTER")).alias("filter_issue"),
                       F.count_if(v.contains("QUERY SYNTAX")).alias("syntax_issue"),
                       F.count_if(v.contains("ES HAS NOTHING")).alias("nothing"),
                       F.count_if(v.contains("QUERY IS FINE")).alias("fine"), F.count(F.lit(1)).alias("total"))
    gate = (F.when(F.col("filter_issue") + F.col("syntax_issue") > F.col("total") / 2, F.lit("STOP"))
            .when(F.col("nothing") > F.col("total") / 2, F.lit("PROCEED")).otherwise(F.lit("MIXED")))
    return agg.withColumn("gate", gate)


def service_rollup(ids: DataFrame, index: DataFrame, top: int = SERVICES_TOP, line_key: str = "line_id") -> DataFrame:
    """Which services logged each id (loose match), top ``top`` by count."""
    hits = match_ids(index, ids, line="message", key=(line_key,), case_sensitive=False)
    c = hits.join(index.select(line_key, "app_name"), line_key).groupBy("flow_id", "app_name").agg(
        F.count(F.lit(1)).alias("docs"))
    w = Window.partitionBy("flow_id").orderBy(F.col("docs").desc(), F.col("app_name"))
    return c.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= top).drop("_rk")
