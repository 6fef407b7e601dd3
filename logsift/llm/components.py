"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.staging import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step over distinct edges (u, v), u > v.  Neighbours are
    rows of a window, never a collected list, so a hub may be any size."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m"))
        low = low.withColumn("_m", F.least("_m", "u"))
        return (both.join(low, "u").where(F.col("v") > F.col("u"))
                .select(F.col("v").alias("u"), F.col("_m").alias("v"))
                .unionAll(low.where(F.col("_m") < F.col("u")).select("u", F.col("_m").alias("v")))
                .where("u > v").distinct())
    low = edges.groupBy("u").agg(F.min("v").alias("_m"))
    return (edges.join(low, "u")
            .select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u > v")
            .unionAll(low.select("u", F.col("_m").alias("v"))).distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its
    smallest node.  ``edges`` has two comparable columns.  Each round writes
    its table to the shared folder."""
    a, b = edges.columns
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .where("u > v").distinct(), "edges")
    for _ in range(max_rounds):
        step = materialise(_stars(_stars(now, True), False), "edges")
        # done when every node points at one root and no root points on
        loose = (step.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
                 or step.join(step.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count())
        now = step
        if not loose:
            break
    else:
        raise RuntimeError("components did not settle")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
