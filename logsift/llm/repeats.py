"""Finding repeated windows of a corpus in rounds of keys and replies.

Documents are packed into compressed blocks, written once as a bucketed
table.  In each round every block sends the 64-bit keys of its remaining
candidate windows to key buckets (each key once per block, so a window that
a third of all documents share costs one entry per block), a bucket sorts
its keys, one bucket at a time, and answers with one bit per key; the bits
go back to the block by a join that does not move the texts.  What a round
has established is worked out again from the bits, so no positions are ever
shipped.

A window's key is a polynomial hash of its bytes modulo 2^64 over random
byte values, taken for all windows at once from prefix sums, then mixed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.staging import PACKED, materialise, release, scratch_path, shuffle_width

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
SLICE = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def window_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Key of data[start:end) for every pair; starts ascend.  Works slice by
    slice, so a long text needs no more memory than a short one."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + SLICE, "left"))
        s, e = starts[i:j] - a, ends[i:j] - a
        n = int(e.max())
        up, down = _powers(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data[a:a + n]] * up[:n], out=sums[1:])
        h = (sums[e] - sums[s]) * down[s]
        out[i:j] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        i = j
    return out


# ---------------------------------------------------------------- blocks

class Block:
    """Documents' bytes one after another."""

    def __init__(self, row: dict):
        import zstandard
        self.id = row["block"]
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.nulls = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=int(self.bounds[-1]) or 1)
        self.data = np.frombuffer(self.raw, np.uint8)


BLOCKS = "block long, doc_ids binary, nulls binary, bounds binary, data binary"


def pack_blocks(docs: DataFrame, prepare, block_bytes: int, ordered: bool) -> str:
    """Write the block table and return its name.  ``prepare`` maps a text's
    bytes to what is compared.  With ``ordered``, blocks follow each other in
    (doc_id, text) order."""
    spark = docs.sparkSession

    def run(batches):
        import zstandard
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=1)
        ids, parts, held = [], [], 0

        def emit():
            nonlocal ids, parts, held, block
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<i8")
            row = [[block], [np.array([d or 0 for d in ids], "<i8").tobytes()],
                   [np.array([d is None for d in ids], np.uint8).tobytes()],
                   [bounds.tobytes()], [squeeze.compress(b"".join(parts))]]
            ids, parts, held, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, [pa.int64()] + [pa.binary()] * 4)],
                ["block", "doc_ids", "nulls", "bounds", "data"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(d)
                parts.append(prepare(t or b""))
                held += len(parts[-1])
                if held >= block_bytes:
                    yield emit()
        if ids:
            yield emit()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    if ordered:
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    name = f"blocks_{uuid.uuid4().hex}"
    (rows.mapInArrow(run, BLOCKS).write.bucketBy(shuffle_width(spark), "block")
     .options(path=scratch_path(spark, "blocks"), **PACKED).saveAsTable(name))
    release(spark)
    return name


# ---------------------------------------------------------------- rounds

class Level:
    """Keys of one round within a block, each distinct key once, ascending."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.ones(self.n, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        heads = np.flatnonzero(new)
        self.keys = ranked[heads]
        self.group = np.empty(self.n, np.int64)          # place -> its distinct key
        self.group[order] = np.cumsum(new) - 1
        self.first = np.minimum.reduceat(order, heads) if self.n else heads
        self.count = np.diff(np.append(heads, self.n))

    def edges(self, bits: int) -> np.ndarray:
        cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.concatenate([[0], np.searchsorted(self.keys, cuts), [len(self.keys)]])

    def flags(self, replies: list, bits: int, later: bool) -> np.ndarray:
        """Per place: does the window repeat (``later``: start earlier)?"""
        said = np.zeros(len(self.keys), bool)
        edges = self.edges(bits)
        for bucket, packed in replies:
            a, b = edges[bucket], edges[bucket + 1]
            said[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
        if later:
            return said[self.group] | (np.arange(self.n) != self.first[self.group])
        return (said | (self.count > 1))[self.group]


class Rounds:
    """Runs a method's rounds over a block table.

    The method object has ``levels`` (a list of (key bytes, later) pairs),
    ``start(block)``, ``keys(level, state)`` and ``mark(level, state, flags)``.
    """

    def __init__(self, spark, table: str, method, entries: int, bucket_keys: int = 1 << 20):
        self.spark, self.table, self.method = spark, table, method
        self.bits = min(16, max(3, (max(1, entries) // bucket_keys).bit_length()))
        self.replies: list[DataFrame] = []

    def _blocks(self) -> DataFrame:
        blocks = self.spark.table(self.table)
        if not self.replies:
            return blocks.withColumn("replies", F.array().cast("array<struct<level:int,bucket:int,bits:binary>>"))
        every = self.replies[0]
        for r in self.replies[1:]:
            every = every.unionAll(r)
        packed = every.groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "bits")).alias("replies"))
        return blocks.join(packed.hint("shuffle_hash"), "block", "left")

    def _walk(self, upto: int):
        method, bits = self.method, self.bits

        def walk(row) -> tuple:
            state = method.start(Block(row))
            for level in range(upto):
                own = [(r["bucket"], r["bits"]) for r in row["replies"] or [] if r["level"] == level]
                got = Level(method.keys(level, state))
                method.mark(level, state, got.flags(own, bits, method.levels[level][1]))
            return state
        return walk

    def send(self) -> None:
        """One round: keys out, replies written."""
        level, method, bits = len(self.replies), self.method, self.bits
        walk, (size, later) = self._walk(level), method.levels[level]
        kind = {4: "<u4", 8: "<u8"}[size]

        def out(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    got = Level(method.keys(level, walk(row)))
                    edges = got.edges(bits)
                    at = [i for i in range(1 << bits) if edges[i + 1] > edges[i]]
                    keys = got.keys if size == 8 else got.keys >> np.uint64(32 - bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at, pa.int32()), pa.array([row["block"]] * len(at), pa.int64()),
                         pa.array([keys[edges[i]:edges[i + 1]].astype(kind).tobytes() for i in at], pa.binary())],
                        ["bucket", "block", "keys"])

        def answer(table: pa.Table) -> pa.Table:
            """Sort one bucket; a key's bit is set in every block but the
            first (``later``), or in all blocks when there are several."""
            blocks = table["block"].to_numpy()
            parts = [np.frombuffer(k, kind) for k in table["keys"].to_pylist()]
            turn = np.argsort(blocks, kind="stable")
            sizes = np.array([len(parts[i]) for i in turn])
            keys = np.concatenate([parts[i] for i in turn])
            order = np.argsort(keys, kind="stable")          # within a key: by block
            ranked = keys[order]
            same = ranked[1:] == ranked[:-1]
            flag = np.zeros(len(keys), bool)
            flag[1:] = same
            if not later:
                flag[:-1] |= same
            said = np.empty(len(keys), bool)
            said[order] = flag
            bits_of = [np.packbits(p).tobytes() for p in np.split(said, np.cumsum(sizes)[:-1])]
            return pa.table({
                "block": pa.array(blocks[turn], pa.int64()), "level": pa.array([level] * len(turn), pa.int32()),
                "bucket": pa.array([table["bucket"][0].as_py()] * len(turn), pa.int32()),
                "bits": pa.array(bits_of, pa.binary())})

        sent = self._blocks().mapInArrow(out, "bucket int, block long, keys binary")
        said = sent.groupBy("bucket").applyInArrow(answer, "block long, level int, bucket int, bits binary")
        self.replies.append(materialise(said, f"replies-{level}"))
        release(self.spark)

    def finish(self, schema: str, names: list[str], kinds: list) -> DataFrame:
        """All rounds done: one row per document from ``method.rows(state)``;
        the block table goes."""
        walk, method = self._walk(len(self.replies)), self.method

        def out(batches):
            for b in batches:
                for row in b.to_pylist():
                    cols = list(zip(*method.rows(walk(row)))) or [[]] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        done = materialise(self._blocks().mapInArrow(out, schema), "repeats")
        self.spark.sql(f"DROP TABLE {self.table}")
        release(self.spark)
        return done

    def run(self, schema: str, names: list[str], kinds: list) -> DataFrame:
        for _ in self.method.levels:
            self.send()
        return self.finish(schema, names, kinds)
