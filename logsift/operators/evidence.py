"""Evidence selection over log-line tables (all flows at once).

Input is a line table with at least ``flow_id``, an ordering (``ts`` +
``line_id``), ``level`` and ``message``.  Nothing here uses a window
partitioned by flow over unbounded rows: a single flow may hold a large share
of all lines, so per-flow facts are partial aggregates and the "N rows
before/after" bounds are per-flow top-N (``row_number() <= N``), which Spark
plans as a partial ``WindowGroupLimit`` below the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.levels import is_error
from logsift.functions.render import (
    DECISION_VOCABULARY_RE, ERROR_CONTEXT_AFTER, ERROR_CONTEXT_BEFORE, ERROR_MARKER,
    FULL_TRACE_BELOW, PLAIN_MARKER, short_line, trace_line,
)

ORDER = ("ts", "line_id")


def _key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def flow_profile(lines: DataFrame, flow: str = "flow_id", order: Sequence[str] = ORDER,
                 level: str = "level") -> DataFrame:
    """One row per flow: line count, first/last error key, first/last line key."""
    key = _key(order)
    err = is_error(F.col(level))
    return lines.groupBy(flow).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(err).alias("n_errors"),
        F.min(F.when(err, key)).alias("_first_err"),
        F.max(F.when(err, key)).alias("_last_err"),
        F.min(key).alias("_first_key"),
        F.max(key).alias("_last_key"),
    )


def _nth_neighbour_bound(lines: DataFrame, anchors: DataFrame, flow: str, order: Sequence[str],
                         anchor_col: str, n: int, before: bool, out: str) -> DataFrame:
    """Per flow, the key of the n-th row before (or after) the anchor key.

    Only the n nearest rows per flow survive the ranking, and Spark trims them
    per map partition before the shuffle, so a hot flow costs O(n) shuffle.
    """
    key = _key(order)
    if n <= 0:
        return anchors.select(flow, F.col(anchor_col).alias(out))
    side = lines.join(anchors.select(flow, anchor_col), flow)
    side = side.where(key < F.col(anchor_col)) if before else side.where(key > F.col(anchor_col))
    ordering = [F.col(c).desc() for c in order] if before else [F.col(c).asc() for c in order]
    ranked = side.withColumn("_rk", F.row_number().over(Window.partitionBy(flow).orderBy(*ordering)))
    agg = F.min(key) if before else F.max(key)
    near = ranked.where(F.col("_rk") <= n).groupBy(flow).agg(agg.alias("_nb"))
    return (anchors.select(flow, anchor_col).join(near, flow, "left")
            .select(flow, F.coalesce(F.col("_nb"), F.col(anchor_col)).alias(out)))


def error_context(lines: DataFrame, before: int = ERROR_CONTEXT_BEFORE, after: int = ERROR_CONTEXT_AFTER,
                  flow: str = "flow_id", order: Sequence[str] = ORDER, level: str = "level",
                  profile: DataFrame | None = None) -> DataFrame:
    """Lines from ``before`` rows ahead of a flow's first ERROR to ``after``
    rows past its last ERROR -- one continuous block.  Flows without an ERROR
    yield nothing.  Adds ``is_error``.
    """
    prof = profile if profile is not None else flow_profile(lines, flow, order, level)
    anchors = prof.where(F.col("_first_err").isNotNull()).select(flow, "_first_err", "_last_err")
    lo = _nth_neighbour_bound(lines, anchors, flow, order, "_first_err", before, True, "_lo")
    hi = _nth_neighbour_bound(lines, anchors, flow, order, "_last_err", after, False, "_hi")
    bounds = lo.join(hi, flow)
    key = _key(order)
    return (lines.join(bounds, flow)
            .where((key >= F.col("_lo")) & (key <= F.col("_hi")))
            .drop("_lo", "_hi")
            .withColumn("is_error", is_error(F.col(level))))


def flow_boundaries(lines: DataFrame, flow: str = "flow_id", order: Sequence[str] = ORDER) -> DataFrame:
    """First and last line of each flow (one row when the flow has one line).

    ``min_by``/``max_by`` style struct aggregates: partial, skew-safe.
    """
    cols = [c for c in lines.columns if c != flow]
    key = _key(order)
    packed = F.struct(key.alias("_k"), F.struct(*[F.col(c) for c in cols]).alias("_v"))
    agg = lines.groupBy(flow).agg(F.min_by(packed, key).alias("_first"), F.max_by(packed, key).alias("_last"))
    first = agg.select(flow, F.lit("flow_boundary_first").alias("boundary"), "_first._v.*")
    last = (agg.where(F.col("_first._k") != F.col("_last._k"))
            .select(flow, F.lit("flow_boundary_last").alias("boundary"), "_last._v.*"))
    return first.unionByName(last)


def decision_lines(lines: DataFrame, message: str = "message", pattern: str = DECISION_VOCABULARY_RE) -> DataFrame:
    """Lines whose message matches the decision vocabulary (kept in full)."""
    return lines.where(F.col(message).rlike(pattern))


def route_flows(profile: DataFrame, full_below: int = FULL_TRACE_BELOW) -> DataFrame:
    """Per-flow reduction route: ``full`` / ``error_context`` / ``reduced``."""
    return profile.withColumn(
        "route",
        F.when(F.col("n_lines") < full_below, F.lit("full"))
        .when(F.col("n_errors") > 0, F.lit("error_context"))
        .otherwise(F.lit("reduced")))


def reduce_evidence(lines: DataFrame, before: int = ERROR_CONTEXT_BEFORE, after: int = ERROR_CONTEXT_AFTER,
                    full_below: int = FULL_TRACE_BELOW, flow: str = "flow_id",
                    order: Sequence[str] = ORDER, materialize: bool = True) -> DataFrame:
    """The reduced evidence line table for every flow.

    Output: flow_id, route, section, ts, line_id, line.  ``full`` flows keep
    every line; ``error_context`` flows keep the error block with ``***``
    markers; ``reduced`` flows keep boundaries and decision-vocabulary lines
    (their template clusters come from the template operators).

    The prepared lines feed every branch (profile, bounds, three routes), so
    by default they are written once to the reliable checkpoint folder
    instead of being re-derived (and re-redacted) per branch.
    """
    if materialize:
        from logsift.session import materialize as _mat
        keep = [c for c in (flow, *order, "timestamp", "app_name", "pod_name", "level", "message") if c in lines.columns]
        lines = _mat(lines.select(*keep))
    prof = route_flows(flow_profile(lines, flow, order), full_below)
    routes = prof.select(flow, "route", "n_lines", "n_errors", "_first_err", "_last_err")
    rendered = trace_line(F.col("timestamp"), F.col("app_name"), F.col("pod_name"),
                          F.col("level"), F.col("message"))
    full = (lines.join(routes.where("route = 'full'").select(flow), flow, "left_semi")
            .select(flow, F.lit("full").alias("route"), F.lit("trace").alias("section"),
                    *order, rendered.alias("line")))
    err_prof = routes.where("route = 'error_context'")
    ctx = error_context(lines.join(err_prof.select(flow), flow, "left_semi"), before, after, flow, order,
                        profile=err_prof)
    ctx = ctx.select(flow, F.lit("error_context").alias("route"), F.lit("context").alias("section"), *order,
                     F.concat(F.when(F.col("is_error"), F.lit(ERROR_MARKER)).otherwise(F.lit(PLAIN_MARKER)),
                              rendered).alias("line"))
    red_lines = lines.join(routes.where("route = 'reduced'").select(flow), flow, "left_semi")
    short = short_line(F.col("timestamp"), F.col("level"), F.col("message"))
    bnd = flow_boundaries(red_lines.select(flow, *order, "timestamp", "level", "message"), flow, order)
    bnd = bnd.select(flow, F.lit("reduced").alias("route"),
                     F.regexp_replace("boundary", "^flow_", "").alias("section"), *order, short.alias("line"))
    dec = decision_lines(red_lines).select(flow, F.lit("reduced").alias("route"),
                                           F.lit("decision").alias("section"), *order, short.alias("line"))
    return full.unionByName(ctx).unionByName(bnd).unionByName(dec)
