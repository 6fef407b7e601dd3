"""Near-duplicate vectors by spherical k-means cells.

Equal vectors are one row with a count.  The cells' centres are fitted by
spherical k-means on a bounded sample (``sample_rows``) and lie further apart
than the link angle t.  Every vector goes to its ``probes`` nearest cells; two
vectors are compared if they share one, which linked vectors nearly always do
(recall measured against brute force in the tests).  A cell is cut
into blocks of bounded size; a task compares two blocks by one matrix
product in double precision, and a pair counts in the least cell it shares.

A dense group is never expanded into pairs: vectors within t/2 of their
cell's centre (its core) all link with each other by the triangle
inequality, so they only add the core's size and point at its least member.
Core blocks meet the cell's other blocks, not each other.

The number of cells grows with the distinct vectors up to ``max_cells``
(centres are what each task is sent: at most 2 MB at 64 dimensions); beyond
that cells get more blocks, and each block stays as large.

Defined results: null, zero, odd-length vectors and those with null or
non-finite components link with nothing (component_id is their vec_id, kept);
repeated rows link with each other; a null vec_id counts as a vector, is not
kept, and gets a component_id only from rows with an id; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.components import components
from logsift.llm.staging import materialise
from logsift.llm.vectors import finite, matrix, table_dimension

THRESHOLD, PROBES = 0.9, 6


def spherical_kmeans(sample: np.ndarray, k: int, apart: float, rounds: int = 8) -> np.ndarray:
    """Unit centres, no two with a cosine of ``apart`` or more."""
    def thin(c):
        keep: list[int] = []
        for i in range(len(c)):
            if not keep or (c[keep] @ c[i]).max() < apart:
                keep.append(i)
        return c[keep]

    centres = thin(sample[:4 * k])[:k]
    for r in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
        if r >= rounds // 2:
            # fuller cells first, so that a dense group keeps its own centre
            centres = thin(centres[np.argsort(-np.bincount(nearest, minlength=len(centres)), kind="stable")])
    return centres


def fit_cells(distinct: DataFrame, dim: int, n: int, threshold: float, cell_rows: int, max_cells: int, sample_rows: int) -> np.ndarray:
    """Centres from about ``sample_rows`` distinct vectors picked by hash."""
    share = min(1 << 20, max(1, (sample_rows << 20) // max(n, 1)))
    picked = distinct.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < share).select("cid", "vector").orderBy(F.xxhash64("cid"))
    sample = matrix(picked.toArrow().column(1).combine_chunks(), dim)
    if not len(sample):
        return np.zeros((0, dim))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    return spherical_kmeans(sample, max(1, min(n // cell_rows, max_cells, len(sample) // 4)), threshold)


def assign(distinct: DataFrame, centres: np.ndarray, dim: int, threshold: float, probes: int) -> DataFrame:
    """One row per vector and probed cell: cell, cid, copies, core (the cell
    whose core holds it, else -1), cells (all its cells), vector."""
    p = min(probes, len(centres))
    inner = math.cos(math.acos(threshold) / 2) + 1e-9

    def run(batches):
        for b in batches:
            u = matrix(b.column(2), dim)
            cos = (u / np.linalg.norm(u, axis=1, keepdims=True)) @ centres.T
            near = np.argpartition(-cos, p - 1, axis=1)[:, :p].astype(np.int32)
            home = cos.argmax(axis=1)
            core = np.where(cos[np.arange(len(u)), home] >= inner, home, -1).astype(np.int32)
            # the home cell is always one of the probes, also among ties
            lost = ~(near == home[:, None]).any(axis=1)
            near[lost, 0] = home[lost]
            at = np.repeat(np.arange(len(u)), p)
            cells = pa.ListArray.from_arrays(np.arange(0, len(u) * p + 1, p, dtype=np.int32), near.reshape(-1))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.reshape(-1)), b.column(0).take(take), b.column(1).take(take), pa.array(core[at]),
                 cells.take(take), b.column(2).take(take)], ["cell", "cid", "copies", "core", "cells", "vector"])

    return (distinct.select("cid", "copies", "vector")
            .mapInArrow(run, "cell int, cid long, copies long, core int, cells array<int>, vector array<double>"))


def block_pairs(entries: DataFrame, block_rows: int) -> DataFrame:
    """Entries dealt to the block pairs of their cell that they belong to:
    columns a, b (b < 0: a core block) and mine (the row's own block)."""
    here = F.col("core") == F.col("cell")
    sizes = entries.groupBy("cell").agg(F.count_if(~here).alias("loose"), F.count_if(here).alias("dense"))
    blocks = sizes.select("cell", F.ceil(F.col("loose") / block_rows).cast("int").alias("nl"),
                          F.ceil(F.col("dense") / block_rows).cast("int").alias("nd"))
    # one row per cell, at most max_cells of them
    dealt = entries.join(F.broadcast(blocks), "cell").withColumn(
        "mine", F.when(here, -1 - F.pmod(F.xxhash64("cid"), "nd")).otherwise(F.pmod(F.xxhash64("cid"), "nl")).cast("int"))
    loose = F.when(F.col("nl") > 0, F.sequence(F.lit(0), F.col("nl") - 1)).otherwise(F.array().cast("array<int>"))
    dense = F.when(F.col("nd") > 0, F.sequence(F.lit(-1), -F.col("nd"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    to = F.when(here, F.transform(loose, lambda i: F.struct(i.alias("a"), F.col("mine").alias("b")))).otherwise(
        F.concat(F.transform(loose, lambda i: F.struct(F.least(i, "mine").alias("a"), F.greatest(i, "mine").alias("b"))),
                 F.transform(dense, lambda i: F.struct(F.col("mine").alias("a"), i.alias("b")))))
    return dealt.select("cell", "cid", "copies", "core", "cells", "vector", "mine", F.explode(to).alias("to")).select(
        "cell", F.col("to.a").alias("a"), F.col("to.b").alias("b"), "mine", "cid", "copies", "core", "cells", "vector")


def linked_rows(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of at least ``threshold``; each once where x
    and y are the same rows."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    cos = (x / nx[:, None]) @ (y / ny[:, None]).T
    i, j = np.nonzero(cos >= threshold - 1e-12)
    if same:
        i, j = i[i < j], j[i < j]
    edge = np.flatnonzero(cos[i, j] < threshold + 1e-12)
    sure = np.ones(len(i), bool)
    sure[edge] = np.einsum("ij,ij->i", x[i[edge]], y[j[edge]]) / (nx[i[edge]] * ny[j[edge]]) >= threshold
    return i[sure], j[sure]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(dim: int, threshold: float, strip: int = 512):
    def run(table: pa.Table) -> pa.Table:
        cell, a, b = (table.column(c)[0].as_py() for c in ("cell", "a", "b"))
        mine = table.column("mine").to_numpy()
        cid, copies, core = (table.column(c).to_numpy() for c in ("cid", "copies", "core"))
        order = np.argsort(cid, kind="stable")                       # the least index is the least cid
        cid, copies, core, mine = cid[order], copies[order], core[order], mine[order]
        v = matrix(table.column("vector").combine_chunks(), dim)[order]
        cells = np.array(table.column("cells").combine_chunks().flatten()).reshape(len(v), -1)[order]
        left, right = np.flatnonzero(mine == a), np.flatnonzero(mine == b)
        links, edges = np.zeros(len(v), np.int64), []
        for s in range(0, len(left), strip):
            rows = left[s:s + strip]
            i, j = linked_rows(v[rows], v[right], threshold, False)
            i, j = rows[i], right[j]
            if a == b:
                i, j = i[i < j], j[i < j]
            apart = (core[i] != core[j]) | (core[i] < 0)
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            shared = cells[i][:, :, None] == cells[j][:, None, :]
            least = np.where(shared, cells[i][:, :, None], np.iinfo(np.int32).max).min(axis=(1, 2))
            own = least == cell
            np.add.at(links, i[own], copies[j[own]])
            np.add.at(links, j[own], copies[i[own]])
            root = _roots(len(v), i, j)
            linked = np.flatnonzero(root != np.arange(len(v)))
            edges.append(np.stack([linked, root[linked]]))
        i, j = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        root = _roots(len(v), i, j)
        some = np.flatnonzero((links > 0) | (root != np.arange(len(v))))
        return pa.table({"cid": cid[some], "links": links[some], "root": cid[root[some]]})
    return run


def links(distinct: DataFrame, centres: np.ndarray, dim: int, threshold: float = THRESHOLD, probes: int = PROBES,
          block_rows: int = 1024) -> DataFrame:
    """(cid, links, root) parts of the link counts, with an edge from cid to
    a vector of its component."""
    entries = materialise(assign(distinct, centres, dim, threshold, probes), "cell-entries")
    met = (block_pairs(entries, block_rows).groupBy("cell", "a", "b")
           .applyInArrow(_compare(dim, threshold), "cid long, links long, root long"))
    dense = entries.where("core = cell")
    cores = dense.groupBy("cell").agg(F.sum("copies").alias("all"), F.min("cid").alias("root"))
    inside = dense.join(F.broadcast(cores), "cell").select("cid", (F.col("all") - F.col("copies")).alias("links"), "root")
    return met.unionAll(inside)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, cell_rows: int = 512,
                    block_rows: int = 1024, max_cells: int = 4096, sample_rows: int = 16384,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    dim, n = table_dimension(rows.where(usable), "vector")
    usable = usable & (F.size("vector") == dim)
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    distinct = materialise(rows.where("vector IS NOT NULL").groupBy("vector")
                           .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
                           .withColumn("cid", F.monotonically_increasing_id()), "distinct-vectors")
    centres = fit_cells(distinct, dim, n, threshold, cell_rows, max_cells, sample_rows)
    parts = materialise(links(distinct, centres, dim, threshold, probes, block_rows), "vector-links")
    counts = parts.groupBy("cid").agg(F.sum("links").alias("links"))
    named = components(parts.where("cid <> root").select("cid", "root").distinct())
    whole = (distinct.drop("vector").join(counts, "cid", "left")
             .join(named.withColumnsRenamed({"node": "cid", "component": "root"}), "cid", "left")
             .withColumn("root", F.coalesce("root", "cid")))
    whole = materialise(whole, "vector-components")
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = (whole.join(least, "root")
             .select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    by_vector = distinct.select("cid", "vector").join(facts, "cid").drop("cid")
    out = (rows.where("vector IS NOT NULL").join(by_vector, "vector").select("vec_id", "n_links", "component_id")
           .unionAll(rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                         F.col("vec_id").alias("component_id"))))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def keep_representatives(vectors: DataFrame, **options) -> DataFrame:
    """The input rows whose vec_id is their component's least (all rows of
    that id), extra columns included."""
    id_col = options.get("id_col", "vec_id")
    found = near_duplicates(vectors, **options).where("kept").select(F.col("vec_id").alias(id_col)).distinct()
    return vectors.join(found, id_col, "left_semi")
