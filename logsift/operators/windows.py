"""Order-dependent window helpers that stay bounded under skew.

A carry-forward or running total over one huge group (a dump file, a pod's
log) cannot use a window partitioned by that group alone: every row of the
group would sort in one task.  These helpers split the group into chunks
(e.g. the file split each line came from), solve each chunk with a bounded
window, and fix up chunk starts from a per-chunk summary whose size is
(#chunks), not (#rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def chunked_ffill(df: DataFrame, cols: Sequence[str], group: Sequence[str] | str, chunk: str,
                  order: Sequence[str] | str, suffix: str = "") -> DataFrame:
    """Replace NULLs in ``cols`` by the last non-null value earlier in the
    group (ordered by ``chunk`` then ``order``).  Output columns are named
    ``col + suffix`` (in place when suffix is empty).

    One shuffle on (group, chunk): the in-chunk carry and the chunk's tail
    value are windows over the same partitioning, and the per-chunk tails
    (one row per chunk) carry across chunks with a window over chunks only.
    """
    group, order, cols = _as_list(group), _as_list(order), list(cols)
    w_part = Window.partitionBy(*group, chunk)
    w_local = w_part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = w_part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    win = df.withColumns({
        **{f"_lf_{c}": F.last(F.col(c), ignorenulls=True).over(w_local) for c in cols},
        **{f"_tail_{c}": F.last(F.col(c), ignorenulls=True).over(w_all) for c in cols},
        "_rn_chunk": F.row_number().over(w_part.orderBy(*order)),
    })
    w_prev = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = (win.where(F.col("_rn_chunk") == 1)
             .select(*group, chunk, *[F.last(F.col(f"_tail_{c}"), ignorenulls=True).over(w_prev).alias(f"_in_{c}")
                                      for c in cols]))
    out = win.drop(*[f"_tail_{c}" for c in cols], "_rn_chunk").join(carry, [*group, chunk], "left")
    return (out.withColumns({c + suffix: F.coalesce(F.col(f"_lf_{c}"), F.col(f"_in_{c}")) for c in cols})
            .drop(*[f"_lf_{c}" for c in cols], *[f"_in_{c}" for c in cols]))


def chunked_running_sum(df: DataFrame, value: str, group: Sequence[str] | str, chunk: str,
                        order: Sequence[str] | str, out: str = "running", inclusive: bool = True) -> DataFrame:
    """Running total of ``value`` within the group, in (chunk, order) order.
    Same single-shuffle shape as :func:`chunked_ffill`."""
    group, order = _as_list(group), _as_list(order)
    w_part = Window.partitionBy(*group, chunk)
    w_local = w_part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    win = df.withColumns({"_rs_local": F.sum(F.col(value)).over(w_local),
                          "_rs_tot": F.sum(F.col(value)).over(w_part),
                          "_rn_chunk": F.row_number().over(w_part.orderBy(*order))})
    w_prev = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = (win.where(F.col("_rn_chunk") == 1)
             .select(*group, chunk, F.coalesce(F.sum("_rs_tot").over(w_prev), F.lit(0)).alias("_rs_in")))
    res = win.drop("_rs_tot", "_rn_chunk").join(carry, [*group, chunk], "left")
    total = F.col("_rs_in") + F.col("_rs_local")
    if not inclusive:
        total = total - F.col(value)
    return res.withColumn(out, total).drop("_rs_local", "_rs_in")


def kth_smallest(values: DataFrame, col: str, k: DataFrame, k_col: str = "k", buckets: int = 1024,
                 accuracy: int = 10000) -> DataFrame:
    """Exact k-th smallest value (0-based) of ``col``, as a one-row frame.

    Scalable selection without a global sort or an unpartitioned window over
    rows: values are first counted per distinct value (partial aggregation),
    the distinct values are cut into ~``buckets`` ranges by approximate
    quantiles, bucket totals (a few hundred rows) locate the bucket holding
    rank k, and only that bucket's distinct values are ranked exactly.
    ``k`` is a one-row frame holding the wanted rank.
    """
    from pyspark.sql import Window
    per_value = values.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    probs = [i / buckets for i in range(1, buckets)]
    splits = per_value.agg(F.percentile_approx(col, probs, accuracy).alias("_splits"))
    with_b = (per_value.crossJoin(F.broadcast(splits))
              .withColumn("_b", F.size(F.filter("_splits", lambda s: s < F.col(col)))).drop("_splits"))
    tot = with_b.groupBy("_b").agg(F.sum("_cnt").alias("_bt"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # <= `buckets` rows
    offs = tot.withColumn("_before", F.coalesce(F.sum("_bt").over(w), F.lit(0)))
    target = (offs.crossJoin(F.broadcast(k.select(F.col(k_col).alias("_k"))))
              .where((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_bt")))
              .select("_b", "_before", "_k"))
    inb = with_b.join(F.broadcast(target), "_b")
    wr = Window.partitionBy("_b").orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inb.withColumn("_upto", F.col("_before") + F.sum("_cnt").over(wr))
    return ranked.where((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_cnt") <= F.col("_k"))) \
        .select(F.col(col).alias("value"))


def greedy_segments(df: DataFrame, size: str, group: Sequence[str] | str, chunk: str, order: Sequence[str] | str,
                    limit: int, out: str = "segment") -> DataFrame:
    """Greedy byte-budget segmentation, exact and without a per-group scan.

    Rows are written in (chunk, order) order; a new segment starts before a
    row when the current segment already holds >= ``limit`` bytes.  With S
    the bytes before a row, the segment starting at row b ends before the
    first row j with S_j >= S_b + limit.  That "next start" is a rank of
    S_b + limit among the S values (a running count over starts and targets
    merged, chunked by byte bucket), and the segment starts are the orbit of
    row 0 under it, found by pointer doubling: log2(#segments) self-joins,
    each level written to the checkpoint folder.
    """
    from logsift.session import materialize
    group, order = _as_list(group), _as_list(order)
    if limit <= 0:                       # no budget: one segment per group
        return df.withColumn(out, F.lit(0).cast("bigint"))
    one = df.withColumn("_one", F.lit(1))
    base = chunked_running_sum(one, "_one", group, chunk, order, out="_idx", inclusive=False).drop("_one")
    base = chunked_running_sum(base, size, group, chunk, order, out="_S", inclusive=False)
    base = materialize(base)
    keys = [*group]
    starts = base.select(*keys, F.col("_S").alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_ref"))
    targets = base.select(*keys, (F.col("_S") + F.lit(limit)).alias("_v"), F.lit(0).alias("_kind"),
                          F.col("_idx").alias("_ref"))
    merged = starts.unionByName(targets).withColumn("_vb", F.floor(F.col("_v") / F.lit(max(1, limit))))
    ranked = chunked_running_sum(merged.withColumn("_o", F.struct("_v", "_kind")), "_kind", keys, "_vb", "_o",
                                 out="_starts_before", inclusive=False)
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    jump = (ranked.where(F.col("_kind") == 0).join(n, keys)
            .select(*keys, F.col("_ref").alias("_i"),
                    F.when(F.col("_starts_before") < F.col("_n"), F.col("_starts_before")).alias("_j")))
    jump = materialize(jump.where(F.col("_j").isNotNull()))
    visited = materialize(base.where(F.col("_idx") == 0).select(*keys, F.col("_idx").alias("_i")))
    while True:
        step = visited.join(jump, [*keys, "_i"]).select(*keys, F.col("_j").alias("_i"))
        visited = materialize(visited.unionByName(step).distinct())
        jump = jump.alias("a").join(jump.alias("b"), [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys],
                                                      F.col("a._j") == F.col("b._i")]) \
            .select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a._i").alias("_i"), F.col("b._j").alias("_j"))
        jump = materialize(jump)
        if jump.limit(1).count() == 0:     # every jump now runs past the end
            break
    starts_flag = visited.select(*keys, F.col("_i").alias("_idx"), F.lit(1).alias("_start"))
    flagged = base.join(starts_flag, [*keys, "_idx"], "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    # rows that tie in ``order`` keep the places they were given
    seg = chunked_running_sum(flagged, "_start", group, chunk, [*order, "_idx"], out=out)
    return seg.withColumn(out, F.col(out) - 1).drop("_idx", "_S", "_start")
