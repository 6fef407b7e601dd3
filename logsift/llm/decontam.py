"""Benchmark decontamination by pigeonhole edit matching.

Item and document texts are compared lower-cased with blanks collapsed.  An
item of n characters may differ by ``k = floor(rate * n)`` edits.  Cut into
k + 1 pieces, at least one piece of any occurrence within k edits is
unchanged, so exact hits of the pieces (one automaton over all pieces, one
pass over each whole text) give every place worth looking at.  Hits on the
same diagonal are merged, and the text around each is verified with Myers'
bit-parallel edit distance.

The query set is the benchmark.  It is taken in blocks of at most
``block_chars`` characters; each block is one pass over the documents, so
what a task holds is bounded whatever the benchmark's size.

Defined results: null and blank texts match nothing; items shorter than
``min_chars`` after normalising are compared without edits; repeated items
each report; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = "doc_id long, item_id long, distance int, item_chars int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float, min_chars: int) -> int:
    return int(rate * n) if n >= min_chars else 0


def cut(text: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places."""
    n = len(text)
    edges = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:])]


def peq(pattern: str) -> dict[str, int]:
    table: dict[str, int] = {}
    for i, c in enumerate(pattern):
        table[c] = table.get(c, 0) | 1 << i
    return table


def myers(table: dict[str, int], m: int, text: str, limit: int) -> int:
    """Least edit distance of the whole pattern to any substring of
    ``text``; limit + 1 when none is within the limit."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, limit + 1
    for c in text:
        eq = table.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
    return best


class Items:
    """One block of the query set: its piece automaton and pattern tables."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        import ahocorasick
        pieces: dict[str, list] = {}
        self.items = []
        for item_id, text in items:
            if not text:
                continue
            k = budget(len(text), rate, min_chars)
            at = len(self.items)
            self.items.append((item_id, text, k, peq(text)))
            for off, piece in cut(text, k):
                pieces.setdefault(piece, []).append((at, off))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def match(self, text: str) -> dict[int, int]:
        """Item place -> least distance, for items within their budget."""
        if self.empty or not text:
            return {}
        starts: dict[int, set] = {}
        for end, (n, where) in self.automaton.iter(text):
            for at, off in where:
                starts.setdefault(at, set()).add(end - n + 1 - off)      # where the item would begin
        found = {}
        for at, places in starts.items():
            _, pattern, k, table = self.items[at]
            best = k + 1
            spans: list[list[int]] = []
            for p in sorted(places):
                if spans and p - spans[-1][1] <= k:
                    spans[-1][1] = p
                else:
                    spans.append([p, p])
            for a, b in spans:
                part = text[max(0, a - k):b + len(pattern) + k]
                if k == 0 or pattern in part:
                    best = 0 if pattern in part else best
                else:
                    best = min(best, myers(table, len(pattern), part, k))
                if best == 0:
                    break
            if best <= k:
                found[at] = best
        return found


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, block by block (one block is on the driver at a
    time)."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        text = normal(r["text"])
        block.append((r["item_id"], text))
        held += len(text)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, min_chars: int = 40,
                 block_chars: int = 4_000_000) -> DataFrame:
    """One row per (document, item) within the item's edit budget."""
    spark = docs.sparkSession

    def searcher(items):
        shared = spark.sparkContext.broadcast(items)       # at most block_chars characters

        def run(batches):
            block = Items(shared.value, rate, min_chars)
            for b in batches:
                rows = [(d, block.items[at][0], dist, len(block.items[at][1]))
                        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        for at, dist in sorted(block.match(normal(t)).items())]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])],
                    ["doc_id", "item_id", "distance", "item_chars"])
        return run

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = [texts.mapInArrow(searcher(items), HITS) for items in blocks(benchmark, block_chars)]
    if not parts:
        return spark.createDataFrame([], HITS)
    return reduce(DataFrame.unionAll, parts)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, min_chars: int = 40,
               block_chars: int = 4_000_000) -> DataFrame:
    """The documents without any benchmark item, with their own columns; a
    filter beside the text, block after block, without a shuffle."""
    spark = docs.sparkSession
    out = docs
    for items in blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared, at=docs.columns.index("text")):
            block = Items(shared.value, rate, min_chars)
            for b in batches:
                clean = [not block.match(normal(t)) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))
        out = out.mapInArrow(run, out.schema)
    return out
