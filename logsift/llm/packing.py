"""Best-fit packing by bin completion.

Every document becomes its token ids plus an end id and is cut only when
longer than a sequence (the first piece takes the remainder, so all others
are full).  What matters for packing is how many pieces there are of each
length, a table of at most ``capacity`` rows whatever the corpus size.  On
that table the driver fills bins around the largest remaining length: it
enumerates undominated fillings, applies the best one as often as the counts
allow (the best-fit solution is the first incumbent), and backtracks to the
others while the waste bound leaves room for a better result.  The plan is
a list of intervals (piece rank within its length -> sequence, offset) with
at most a few entries per length; ranking and placing all pieces is done in
Spark.

Defined results: null text is empty (the end id alone); rows with equal
doc_id are packed separately; a null doc_id stays null; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.staging import materialise, shuffle_width
from logsift.llm.tokens import default_vocab, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = n % capacity or capacity
    out, at = [(0, min(n, first))], min(n, first)
    while at < n:
        out.append((at, capacity))
        at += capacity
    return out


def pieces(docs: DataFrame, vocab: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches):
        enc = encoder(vocab)
        for b in batches:
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    rows.append((d, k, s, n, zlib.crc32(raw[4 * s:4 * (s + n)])))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the plan

def fillings(left: np.ndarray, room: int, width: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the lengths still ``left``
    (counts by length), fullest first and, among equals, fewest pieces.

    A filling is dropped when another of no more pieces fills more.  While
    the largest length fits three times it is taken outright (every filling
    without it is dominated piecewise); the last pieces are searched.
    """
    left = left.copy()
    head: list[int] = []
    sizes = np.flatnonzero(left[:room + 1])
    while len(sizes) and sizes[-1] * 3 <= room:
        head.append(int(sizes[-1]))
        left[sizes[-1]] -= 1
        room -= int(sizes[-1])
        sizes = np.flatnonzero(left[:room + 1])
    found: dict[int, tuple[int, ...]] = {0: ()}

    def keep(parts):
        """Add what still fits (a filling with room for a piece is dominated)."""
        total = sum(parts)
        while total < room and len(sizes) and sizes[0] <= room - total:
            fit = sizes[:np.searchsorted(sizes, room - total, "right")][::-1]
            x = next((int(x) for x in fit if parts.count(x) < left[x]), 0)
            if not x:
                break
            parts, total = parts + (x,), total + x
        if total not in found or len(parts) < len(found[total]):
            found[total] = parts

    def pair(a: np.ndarray, space: int, fixed: tuple) -> None:
        """Best second length beside each first one."""
        b = sizes[np.maximum(np.searchsorted(sizes, np.minimum(space - a, a), "right") - 1, 0)]
        good = (a + b <= space) & (b <= a) & ((a != b) | (left[a] > 1))
        for i in np.argsort(-(a + b) * good, kind="stable")[:width]:
            parts = fixed + (int(a[i]), int(b[i]))
            if good[i] and all(parts.count(x) <= left[x] for x in parts):
                keep(parts)

    if len(sizes):
        keep((int(sizes[-1]),))
        pair(sizes[::-1], room, ())
        if room not in found:
            for x in sizes[::-1][:4 * width]:
                rest = sizes[sizes <= min(x, room - x)][::-1]
                if len(rest):
                    pair(rest, room - int(x), (int(x),))
    ranked = sorted(found.items(), key=lambda kv: (-kv[0], len(kv[1])))
    out, fewest = [], 1 << 30
    for total, parts in ranked:
        if len(parts) < fewest:
            fewest = len(parts)
            out.append(tuple(sorted(head + list(parts), reverse=True)))
    return out[:width]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello-Toth L2: pieces over capacity - k stand alone, and the rest
    cannot use more than their room."""
    lengths = np.arange(capacity + 1)
    best = -(-int((counts * lengths).sum()) // capacity)
    for k in range(0, capacity // 2 + 1, max(1, capacity // 256)):
        big = int(counts[capacity - k + 1:].sum())
        mid_n = int(counts[capacity // 2 + 1:capacity - k + 1].sum())
        mid = int((counts * lengths)[capacity // 2 + 1:capacity - k + 1].sum())
        small = int((counts * lengths)[k:capacity // 2 + 1].sum())
        best = max(best, big + mid_n + max(0, -(-(small - (mid_n * capacity - mid)) // capacity)))
    return best


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 6000, width: int = 6):
    """(filling, copies) list using as few bins as found within ``nodes``
    search steps, and the lower bound."""
    counts = np.array(counts, dtype=np.int64)
    least, total = lower_bound(counts, capacity), int((counts * np.arange(capacity + 1)).sum())
    best: list | None = None
    best_bins = 1 << 62

    def options(left):
        big = int(np.flatnonzero(left)[-1])
        left = left.copy()
        left[big] -= 1
        return [(big,) + f for f in fillings(left, capacity - big, width)]

    def apply(left, parts):
        need = np.bincount(parts, minlength=capacity + 1)
        used = np.flatnonzero(need)
        n = int((left[used] // need[used]).min())
        return n, left - n * need

    # depth first: the first way down is best fit around the largest length
    path: list = []
    frames = [(counts, options(counts), 0, 0)] if counts.any() else []    # left, options to try, bins, waste
    steps = 0
    while frames and best_bins > least:
        left, todo, bins, waste = frames[-1]
        if not todo or (best is not None and steps > nodes):
            frames.pop()
            if path:
                path.pop()
            continue
        parts = todo.pop(0)
        n, after = apply(left, parts)
        more = waste + n * (capacity - sum(parts))
        if best is not None and more > (best_bins - 1) * capacity - total:
            continue                       # no room left for a better result below this filling
        steps += 1
        if after.any():
            path.append((parts, n))
            frames.append((after, options(after), bins + n, more))
        elif bins + n < best_bins:
            best, best_bins = path + [(parts, n)], bins + n
    return best or [], least


def intervals(plan) -> dict[str, np.ndarray]:
    """Rank intervals of each length: (length, from rank) -> first sequence,
    pieces of that length per sequence, first offset."""
    cum: dict[int, int] = {}
    rows, seq = [], 0
    for parts, n in plan:
        at = 0
        for size in sorted(set(parts), reverse=True):
            m = parts.count(size)
            lo = cum.get(size, 0)
            rows.append((size, lo, seq, m, at))
            cum[size] = lo + m * n
            at += m * size
        seq += n
    rows.sort()
    a = np.array(rows or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) | a[:, 1], "lo": a[:, 1], "seq": a[:, 2], "m": a[:, 3], "at": a[:, 4]}


# ---------------------------------------------------------------- the operator

def pack(docs: DataFrame, vocab: str | None = None, capacity: int = 2048, end_id: int = 0,
         nodes: int = 6000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.  Runs the tokenisation and the length count."""
    spark = docs.sparkSession
    cutted = materialise(pieces(docs, vocab or default_vocab(), capacity, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    # at most `capacity` rows: the number of pieces of each length
    for r in cutted.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    plan, _ = bin_completion(counts, capacity, nodes)
    table = intervals(plan)

    # rank of each piece within its length; a frequent length is split over salts
    salts = max(8, shuffle_width(spark), int(counts.sum() // 200_000))
    salted = cutted.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(
                  Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before")))
    ranked = (salted.withColumn("_rank", F.row_number().over(
                  Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
              .join(before, ["length", "_salt"])
              .withColumn("_rank", F.col("_rank") + F.col("_before"))
              .select("doc_id", "piece", "start", "length", "ids_crc32", "_rank"))

    def place(batches):
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(table["key"], (size << 44) | rank, "right") - 1
            nth = rank - table["lo"][k]
            seq = table["seq"][k] + nth // table["m"][k]
            at = table["at"][k] + (nth % table["m"][k]) * size
            yield pa.RecordBatch.from_arrays(
                b.columns[:5] + [pa.array(seq), pa.array(at)], b.schema.names[:5] + ["sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
