"""Repeated word windows by level-wise doubling.

Windows of a quarter of the length that repeat nowhere drop out; only where
two repeating windows stand side by side is the window of twice the length
tried, and so on up to the full length (the last step overlaps, as 35 is not
a power of two times the first).  Most texts are out after the first level.

Defined results: words are runs without the six ASCII blanks, unchanged;
null, empty and blank texts have no words and keep the empty string; every
occurrence of a repeated window counts, also within one document and in
repeated rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.repeats import Block, Rounds, pack_blocks, window_keys


def lengths(window: int, levels: int = 3) -> list[int]:
    """Doubling lengths that end at ``window``."""
    out = [window]
    while len(out) < levels and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


class WordWindows:
    def __init__(self, window: int):
        self.sizes = lengths(window)
        # only the last level decides; the others need no more than a filter's key
        self.levels = [(8 if n == window else 4, False) for n in self.sizes]

    def start(self, block: Block) -> dict:
        gap = np.flatnonzero(block.data == 32)
        filled = np.flatnonzero(np.diff(block.bounds) > 0)
        begin = np.sort(np.concatenate([gap + 1, block.bounds[filled]]))
        end = np.sort(np.concatenate([gap, block.bounds[filled + 1]]))
        doc = np.searchsorted(block.bounds, begin, "right") - 1
        state = {"block": block, "begin": begin, "end": end, "doc": doc}
        n = self.sizes[0]
        state["at"] = np.flatnonzero(doc[:-n + 1 or None] == doc[n - 1:]) if len(doc) >= n else np.zeros(0, np.int64)
        return state

    def keys(self, level: int, state: dict) -> np.ndarray:
        at = state["at"]
        return window_keys(state["block"].data, state["begin"][at], state["end"][at + self.sizes[level] - 1])

    def mark(self, level: int, state: dict, flags: np.ndarray) -> None:
        at = state["at"][flags]
        if level + 1 < len(self.sizes):
            n = self.sizes[level + 1]
            hit = np.zeros(len(state["doc"]) + n, bool)
            hit[at] = True
            at = at[hit[at + n - self.sizes[level]]]
            at = at[at + n <= len(state["doc"])]
            at = at[state["doc"][at] == state["doc"][at + n - 1]]
        state["at"] = at

    def rows(self, state: dict):
        block, at = state["block"], state["at"]
        n_words = len(state["doc"])
        change = np.zeros(n_words + 1, np.int64)
        change[at] += 1
        change[at + self.sizes[-1]] -= 1
        kept = np.cumsum(change)[:-1] == 0
        first = np.searchsorted(state["doc"], np.arange(len(block.doc_ids) + 1))
        for i in range(len(block.doc_ids)):
            a, b = first[i], first[i + 1]
            text = block.raw[block.bounds[i]:block.bounds[i + 1]]
            keep = kept[a:b]
            if not keep.all():
                text = b" ".join(w for w, k in zip(text.split(b" "), keep.tolist()) if k)
            yield (None if block.nulls[i] else int(block.doc_ids[i]), int(b - a), int(b - a - keep.sum()),
                   hashlib.sha256(text).hexdigest(), text)


def _single_spaced(text: bytes) -> bytes:
    return b" ".join(text.split())


def drop_repeated_windows(docs: DataFrame, window: int = 35, block_bytes: int = 1 << 20, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on request, the kept
    words as text."""
    spark = docs.sparkSession
    table = pack_blocks(docs, _single_spaced, block_bytes, ordered=False)
    words = spark.table(table).agg(F.sum(F.length("data"))).first()[0] or 0
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    method = WordWindows(window)
    if not texts:
        full = method.rows
        method.rows = lambda state: (r[:4] for r in full(state))
        names, kinds = names[:4], kinds[:4]
    out = Rounds(spark, table, method, words // 2).run(
        ", ".join(f"{n} {t}" for n, t in zip(names, ["long", "long", "long", "string", "binary"])), names, kinds)
    return out.withColumn("kept", F.col("kept").cast("string")) if texts else out
