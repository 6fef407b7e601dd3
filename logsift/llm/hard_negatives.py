"""Hard negatives by best-first search of an STR-packed R-tree.

Vectors hold integers.  The tree is packed by sorting: the table is range
partitioned on its widest coordinate (row hash and id break ties, so one
repeated value spreads), sorted on the second widest within a partition and
cut into shelves; a shelf is tiled on the next coordinates into pages, the
leaves, each stored with its minimum bounding box.  A search task reads the
pages of a shelf, puts nodes of ``FAN`` pages and a root above them, and
searches it for a block of anchors.

A box bounds the inner product of every row in it: coordinate by coordinate
between the products with its two ends.  Each anchor's queue pops the node
of greatest upper bound; nodes strictly below the kth score found so far (a
tie may still win by its id) or outside every score window are pruned.  Each
anchor first searches its own shelf; the kth scores found there start the
search of all other shelves, so a task sees most boxes pruned.

Anchors are met in blocks of bounded size: a block is what a task is sent.

Defined results: rows with a null id or label, a null vector, null or
non-finite components or another length than most take no part; a row is
"other" than an anchor when its id differs; repeated rows count one by one
and repeated anchors repeat their results; ties go to the smaller id; scores
that could pass 64 bits raise an error; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.staging import materialise, scratch_path, shuffle_width
from logsift.llm.vectors import finite, table_dimension

FAN = 8
PAGES = "part long, shelf long, ids binary, labels binary, vectors binary, anchors binary"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def coordinate_spread(rows: DataFrame, dim: int) -> tuple[list[int], int]:
    """Coordinates from the widest (by variance) down, and the greatest
    magnitude.  Every task sends one row a coordinate."""
    def run(batches):
        n, s, ss, top = 0, np.zeros(dim), np.zeros(dim), np.zeros(dim)
        for b in batches:
            if b.num_rows:
                v = b.column(0).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                n, s, ss, top = n + len(v), s + v.sum(axis=0), ss + (v * v).sum(axis=0), np.maximum(top, np.abs(v).max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, float(n))), pa.array(s), pa.array(ss), pa.array(top)],
                                         ["d", "n", "s", "ss", "top"])

    found = (rows.select("vector").mapInArrow(run, "d long, n double, s double, ss double, top double")
             .groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.max("top").alias("top")).collect())
    spread = {r["d"]: r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in found if r["n"]}
    return sorted(spread, key=lambda d: (-spread[d], d)), int(max(r["top"] for r in found))


def tile(v: np.ndarray, at: np.ndarray, dims: list[int], page_rows: int) -> list[np.ndarray]:
    """Sort-tile-recursive pages of the rows ``at``."""
    pages = -(-len(at) // page_rows)
    if pages <= 1:
        return [at]
    at = at[np.argsort(v[at, dims[0]], kind="stable")]
    slabs = max(2, math.ceil(pages ** (1 / len(dims)))) if len(dims) > 1 else pages
    size = -(-pages // slabs) * page_rows
    return [p for s in range(0, len(at), size) for p in tile(v, at[s:s + size], dims[1:] or dims, page_rows)]


def pack_tree(rows: DataFrame, dim: int, dims: list[int], page_rows: int, shelf_pages: int) -> DataFrame:
    """The leaf pages, in shelf order, of rows (id, label, anchor, vector)."""
    inner = (dims[2:5] or dims)

    def run(batches):
        from pyspark import TaskContext
        part, shelf = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def emit():
            nonlocal held, size, shelf
            t = pa.Table.from_batches(held)
            v = t.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            ids, labels, anchors = (t.column(c).to_numpy() for c in ("id", "label", "anchor"))
            pages = tile(v, np.arange(len(v)), inner, page_rows)
            cols = [[part] * len(pages), [(part << 32) + shelf] * len(pages),
                    *[[x[p].astype(k).tobytes() for p in pages] for x, k in ((ids, "<i8"), (labels, "<i8"), (v, "<i8"), (anchors, "u1"))]]
            held, size, shelf = [], 0, shelf + 1
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], PAGE_NAMES)

        for b in batches:
            at = 0
            while at < b.num_rows:
                n = min(b.num_rows - at, page_rows * shelf_pages - size)
                held.append(b.slice(at, n))
                at, size = at + n, size + n
                if size == page_rows * shelf_pages:
                    yield emit()
        if size:
            yield emit()

    axis = lambda d: F.col("vector")[d]
    return (rows.select("id", "label", "anchor", "vector")
            .repartitionByRange(shuffle_width(rows.sparkSession), axis(dims[0]), F.xxhash64("id", "vector"), "id")
            .sortWithinPartitions(axis(dims[min(1, dim - 1)])).mapInArrow(run, PAGES))


PAGE_NAMES = [c.split()[0] for c in PAGES.split(", ")]


class Shelf:
    """A subtree: pages, nodes of FAN pages, the root."""

    def __init__(self, rows: list[dict], dim: int, kind: type):
        self.ids = [np.frombuffer(r["ids"], "<i8") for r in rows]
        self.labels = [np.frombuffer(r["labels"], "<i8") for r in rows]
        self.vectors = [np.frombuffer(r["vectors"], "<i8").reshape(-1, dim).astype(kind) for r in rows]
        lo = np.stack([v.min(axis=0) for v in self.vectors])
        hi = np.stack([v.max(axis=0) for v in self.vectors])
        starts = np.arange(0, len(rows), FAN)
        # node numbers: pages, then inner nodes, then the root
        self.lo = np.concatenate([lo, np.minimum.reduceat(lo, starts), lo.min(axis=0)[None]])
        self.hi = np.concatenate([hi, np.maximum.reduceat(hi, starts), hi.max(axis=0)[None]])
        n, m = len(rows), len(starts)
        self.pages, self.root = n, n + m
        self.children = {n + i: range(i * FAN, min((i + 1) * FAN, n)) for i in range(m)} | {n + m: range(n, n + m)}

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) inner product of every anchor with every node."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T


class Anchors:
    """A block of anchors: vectors, ids, labels, own shelves, and per anchor
    its score windows (low, high) and starting kth scores."""

    def __init__(self, numbers, ids, labels, shelves, vectors, same: bool, windows: list, kth: list):
        self.numbers, self.ids, self.labels, self.shelves, self.vectors = numbers, ids, labels, shelves, vectors
        self.same, self.windows, self.kth = same, windows, kth


def search_shelf(shelf: Shelf, block: Anchors, which: np.ndarray, found: dict, k: int) -> None:
    """Best-first search of one shelf for the anchors ``which``; ``found``
    holds each (anchor, window)'s best (-score, id) list over all shelves."""
    least, most = shelf.bounds(block.vectors[which])
    for row, a in enumerate(which.tolist()):
        lows, highs = least[row], most[row]
        goals = []
        for w, (lo, hi) in enumerate(block.windows[a]):
            best = found.setdefault((a, w), [])
            goals.append([w, lo, hi, max(lo, block.kth[a][w], -best[-1][0] if len(best) == k else lo), best])
        q, own, label = block.vectors[a], block.ids[a], block.labels[a]
        queue = [(-highs[shelf.root], shelf.root)]
        while queue:
            up, node = heapq.heappop(queue)
            if all(-up < g[3] for g in goals):
                break                                                # all others are below as well
            if not any(-up >= g[3] and lows[node] <= g[2] for g in goals):
                continue
            if node >= shelf.pages:
                for c in shelf.children[node]:
                    heapq.heappush(queue, (-highs[c], c))
                continue
            score = shelf.vectors[node] @ q
            ids = shelf.ids[node]
            right = (shelf.labels[node] == label) & (ids != own) if block.same else shelf.labels[node] != label
            for g in goals:
                hit = np.flatnonzero(right & (score >= g[3]) & (score <= g[2]))
                if len(hit):
                    hit = hit[np.lexsort((ids[hit], -score[hit]))[:k]]
                    g[4] += zip((-score[hit]).tolist(), ids[hit].tolist())
                    g[4].sort()
                    del g[4][k:]
                    if len(g[4]) == k:
                        g[3] = max(g[3], -g[4][-1][0])


def search(pages: DataFrame, block: Anchors, dim: int, kind: type, k: int, own: bool) -> DataFrame:
    """(number, w, id, score): each task's best rows per anchor and window,
    in the anchor's own shelf or in all others."""
    def run(batches):
        found: dict = {}

        def flush(rows):
            mine = block.shelves == rows[0]["shelf"]
            which = np.flatnonzero(mine if own else ~mine)
            if len(which):
                search_shelf(Shelf(rows, dim, kind), block, which, found, k)

        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and r["shelf"] != held[0]["shelf"]:
                    flush(held)
                    held = []
                held.append(r)
        if held:
            flush(held)
        rows = [(int(block.numbers[a]), w, i, int(-s)) for (a, w), best in found.items() for s, i in best]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64()])],
                                         ["number", "w", "id", "score"])

    return pages.select("shelf", "ids", "labels", "vectors").mapInArrow(run, "number long, w int, id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The first k per anchor and window, ranked from 1."""
    order = Window.partitionBy("number", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_all(pages: DataFrame, block: Anchors, dim: int, kind: type, k: int) -> list[tuple]:
    """Own shelves first, then all others from the kth scores found.  The
    result is k rows per anchor and window of the (bounded) block."""
    own = materialise(best_of(search(pages, block, dim, kind, k, True), k).drop("rank"), "own-shelf")
    place = {n: a for a, n in enumerate(block.numbers.tolist())}
    for r in own.groupBy("number", "w").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).collect():
        kth = block.kth[place[r["number"]]]
        kth[r["w"]] = max(kth[r["w"]], r["kth"])
    every = best_of(own.unionAll(search(pages, block, dim, kind, k, False)), k)
    return [(place[r["number"]], r["w"], r["rank"], r["id"], r["score"]) for r in every.collect()]


def mine_hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                        id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                        page_rows: int = 256, shelf_pages: int = 64, block_anchors: int = 4096) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each row where ``anchor`` holds and each of its
    first ``positives`` rows of the same label by inner product, the first
    ``negatives`` rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score.  ``vector_col`` holds
    integers (any numeric type; fractions are cut off)."""
    spark = vectors.sparkSession
    floats = F.col(vector_col).cast("array<double>")
    rows = (vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(floats) & (F.size(vector_col) > 0))
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.coalesce(anchor, F.lit(False)).alias("anchor"), floats.alias("vector")))
    dim, n = table_dimension(rows, "vector")
    out = scratch_path(spark, "hard-negatives")
    spark.createDataFrame([], OUT).write.parquet(out)
    if not n:
        return spark.read.schema(OUT).parquet(out)
    rows = rows.where(F.size("vector") == dim)
    dims, top = coordinate_spread(rows, dim)
    if dim * top * top >= 1 << 62:
        raise ValueError("inner products of these vectors may pass 64 bits")
    kind = np.float64 if dim * top * top < 1 << 52 else np.int64         # exact either way
    rows = rows.withColumn("vector", F.col("vector").cast("array<long>"))
    pages = materialise(pack_tree(rows, dim, dims, page_rows, shelf_pages), "rtree-pages", compression="zstd")

    def picked(batches):
        for b in batches:
            for r in b.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["anchors"], "u1"))
                if len(at):
                    v = np.frombuffer(r["vectors"], "<i8").reshape(-1, dim)[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(r["ids"], "<i8")[at]), pa.array(np.frombuffer(r["labels"], "<i8")[at]),
                         pa.array(np.full(len(at), r["shelf"])), pa.array([x.tobytes() for x in v])], ["id", "label", "shelf", "vector"])

    anchors = materialise(pages.select("shelf", "ids", "labels", "vectors", "anchors").where(F.col("anchors").contains(b"\1"))
                          .mapInArrow(picked, "id long, label long, shelf long, vector binary")
                          .withColumn("number", F.monotonically_increasing_id()), "anchors")
    blocks = -(-anchors.count() // block_anchors)
    for i in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == i).toArrow()
        if not part.num_rows:
            continue
        number, ids, labels, shelves = (part.column(c).to_numpy() for c in ("number", "id", "label", "shelf"))
        v = np.frombuffer(b"".join(part.column("vector").to_pylist()), "<i8").reshape(-1, dim).astype(kind)
        limit = dim * top * top + 1
        block = Anchors(number, ids, labels, shelves, v, True, [[(-limit, limit)] for _ in ids], [[-limit] for _ in ids])
        found = sorted(_search_all(pages, block, dim, kind, positives))
        windows: list[list] = [[] for _ in ids]
        for a, _, rank, pid, ps in found:
            windows[a].append((pid, ps))
        spans = [[(-(-low * ps // 100), high * ps // 100) for _, ps in w] for w in windows]
        block = Anchors(number, ids, labels, shelves, v, False, spans, [[-limit] * len(w) for w in spans])
        hits = sorted(_search_all(pages, block, dim, kind, negatives))
        mined = [(int(ids[a]), windows[a][w][0], rank, nid, windows[a][w][1], ns) for a, w, rank, nid, ns in hits]
        cols = list(zip(*mined)) if mined else [[]] * 6
        table = pa.table([pa.array(c, pa.int32() if name == "rank" else pa.int64()) for c, name in zip(cols, OUT_NAMES)], OUT_NAMES)
        if mined:
            spark.createDataFrame(table).write.mode("append").parquet(out)
    return spark.read.schema(OUT).parquet(out)


OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
