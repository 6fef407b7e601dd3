"""Repeated byte strings by difference-cover blockwise suffix sorting.

Question per suffix: do its first ``length`` bytes also start earlier?  So
suffixes are sorted to that depth, one key bucket at a time, never all at
once:

1. Long ties first.  Texts are cut where their content says so; a segment
   that stands earlier in the corpus settles all suffixes inside it at the
   price of one key (whole copies cost one key per segment).
2. Difference cover.  Positions whose residue modulo 73 is in a perfect
   difference set (9 residues; every pair of positions has one common shift
   below 73 to sampled positions) get the key of their next 28 bytes; two
   equal strings of 100 bytes agree at such a shift.  A cover position whose
   key stands alone cannot be in a tie.
3. Buckets.  The suffixes that still hold a tied cover position are sorted
   by the key of their whole 100 bytes, one bucket at a time; all but the
   first of a tie start earlier elsewhere.

Order is (doc_id, start); rows of equal doc_id follow each other in text
order.  Ranks are kept as 64-bit keys instead of lexicographic ranks: only
equality decides here, and keys need neither the text nor a global sort.

Defined results: null text is empty (0 bytes, the hash of nothing); texts
under ``length`` bytes keep everything; a null doc_id sorts first; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.repeats import Block, Rounds, pack_blocks, window_keys

#: Perfect difference set modulo 73.
PERIOD, COVER = 73, np.array([0, 1, 3, 7, 15, 31, 36, 54, 63])
#: A cut about every 64 bytes, where a hash of the next 8 bytes is small.
CUT_BYTES, CUT_SHARE = 8, 64


def _any_in(mask: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Is the mask set anywhere in [i - back, i + ahead]?"""
    n = len(mask)
    sums = np.zeros(back + n + ahead + 1, np.int32)
    np.cumsum(mask, out=sums[back + 1:back + n + 1])
    sums[back + n + 1:] = sums[back + n]
    return sums[back + ahead + 1:back + ahead + 1 + n] > sums[:n]


class ByteWindows:
    def __init__(self, length: int = 100):
        if length < PERIOD + 15:
            raise ValueError(f"strings under {PERIOD + 15} bytes need a shorter cover")
        self.length, self.seed = length, length - PERIOD + 1
        self.levels = [(8, True), (4, False), (8, True)]

    def start(self, block: Block) -> dict:
        n = len(block.data)
        room = np.repeat(block.bounds[1:], np.diff(block.bounds)) - np.arange(n)     # bytes to the document's end
        state = {"block": block, "room": room, "dup": np.zeros(n, bool), "open": room >= self.length}
        self._cut(state)
        return state

    def _cut(self, state: dict) -> None:
        """Segments: from a cut to ``length`` bytes past the end of the next
        one."""
        block, room = state["block"], state["room"]
        words = np.ndarray((max(len(block.data) - CUT_BYTES + 1, 0),), "<u8", block.raw, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        words ^= words >> np.uint64(32)
        words *= np.uint64(0xD6E8FEB86659FD93)
        at = np.flatnonzero(words < np.uint64((1 << 64) // CUT_SHARE))
        full = np.flatnonzero(np.diff(block.bounds) >= self.length)
        cuts = np.unique(np.concatenate([at, block.bounds[full]]))
        cuts = cuts[room[cuts] >= self.length] if len(cuts) else cuts
        ends = cuts + room[cuts] if len(cuts) else cuts
        after = np.append(cuts[1:], len(block.data)) + self.length + CUT_BYTES if len(cuts) else cuts
        state["seg"], state["seg_end"] = cuts, np.minimum(after, ends)

    def _cover(self, state: dict) -> np.ndarray:
        """Cover positions that an open suffix reaches within the period."""
        block = state["block"]
        residue = np.zeros(PERIOD, bool)
        residue[COVER] = True
        turn = np.resize(residue, max(int(np.diff(block.bounds).max(initial=0)), PERIOD))
        want = np.zeros(len(block.data), bool)
        for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist()):
            want[a:b] = turn[:b - a]
        want &= state["room"] >= self.seed
        # `open` ends with a document's last full string, so a reach of
        # PERIOD - 1 bytes back stays inside the document or finds nothing
        return np.flatnonzero(want & _any_in(state["open"], PERIOD - 1, 0))

    def keys(self, level: int, state: dict) -> np.ndarray:
        data = state["block"].data
        if level == 0:
            return window_keys(data, state["seg"], state["seg_end"])
        if level == 1:
            state["at"] = self._cover(state)
            return window_keys(data, state["at"], state["at"] + self.seed)
        state["at"] = np.flatnonzero(state["open"])
        return window_keys(data, state["at"], state["at"] + self.length)

    def mark(self, level: int, state: dict, flags: np.ndarray) -> None:
        if level == 0:
            change = np.zeros(len(state["dup"]) + 1, np.int32)
            change[state["seg"][flags]] += 1                       # segments start apart, but may end together
            change -= np.bincount(state["seg_end"][flags] - self.length + 1, minlength=len(change)).astype(np.int32)
            state["dup"] = np.cumsum(change)[:-1] > 0
            state["open"] &= ~state["dup"]
        elif level == 1:
            tied = np.zeros(len(state["dup"]), bool)
            tied[state["at"][flags]] = True
            state["open"] &= _any_in(tied, 0, PERIOD - 1)
        else:
            state["dup"][state["at"][flags]] = True

    def rows(self, state: dict):
        block, n = state["block"], len(state["dup"])
        dup = np.flatnonzero(state["dup"])
        change = np.zeros(n + 1, np.int32)
        change[dup] += 1
        change[dup + self.length] -= 1
        gone = np.cumsum(change)[:-1] > 0
        for i in range(len(block.doc_ids)):
            a, b = int(block.bounds[i]), int(block.bounds[i + 1])
            own = gone[a:b]
            removed = int(np.count_nonzero(own))
            kept = block.raw[a:b] if not removed else block.data[a:b][~own].tobytes()
            spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if removed else 0
            yield (None if block.nulls[i] else int(block.doc_ids[i]), b - a, removed, spans,
                   hashlib.sha256(kept).hexdigest(), kept)


def drop_repeated_strings(docs: DataFrame, length: int = 100, block_bytes: int = 1 << 20, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the
    remaining bytes."""
    spark = docs.sparkSession
    table = pack_blocks(docs, bytes, block_bytes, ordered=True)
    packed = spark.table(table).agg(F.sum(F.length("data"))).first()[0] or 0
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = ["long", "long", "long", "long", "string", "binary"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    method = ByteWindows(length)
    if not texts:
        full = method.rows
        method.rows = lambda state: (r[:5] for r in full(state))
        names, types, kinds = names[:5], types[:5], kinds[:5]
    return Rounds(spark, table, method, packed // 2).run(
        ", ".join(f"{n} {t}" for n, t in zip(names, types)), names, kinds)
