"""Token ids as fixed-width bit-packed blocks.

File format, one block per row of a Parquet table (so any store Spark
reaches can hold it): a block covers consecutive documents in doc_id order
and holds ``bits`` (the least width for the vocabulary), the offsets of its
documents, and the ids packed little-endian, 64 ids in ``bits`` 64-bit
words.  Lane j of every group of 64 has the same word and shift, so packing
and unpacking are 64 vectorised numpy steps whatever the number of ids, and
id i of a block is found directly at bit ``i * bits`` (``read_slice``).

Defined results: null text is empty (end id alone); rows of equal doc_id
follow each other in text order; null doc_id comes first; an empty table
gives no blocks; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.llm.staging import scratch_path
from logsift.llm.tokens import default_vocab, encoder, vocab_size

BLOCKS = "part long, block long, bits int, n_ids long, doc_ids binary, doc_null binary, offsets binary, packed binary"


def width(n_vocab: int) -> int:
    return max(1, int(n_vocab - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    groups = -(-len(ids) // 64)
    v = np.zeros(groups * 64, np.uint64)
    v[:len(ids)] = ids
    v = v.reshape(groups, 64)
    out = np.zeros((groups, bits + 1), np.uint64)
    for j in range(64):
        word, off = divmod(j * bits, 64)
        out[:, word] |= v[:, j] << np.uint64(off)
        if off + bits > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - off)
    return out[:, :bits].astype("<u8").tobytes()


def unpack_bits(packed: bytes, bits: int, n: int) -> np.ndarray:
    words = np.frombuffer(packed, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, off = divmod(j * bits, 64)
        v = words[:, word] >> np.uint64(off)
        if off + bits > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - off))
        out[:, j] = v & mask
    return out.reshape(-1)[:n]


def read_slice(packed: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a block, reading only the groups they lie in."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    g0, g1 = start // 64, -(-stop // 64)
    return unpack_bits(packed[g0 * bits * 8:g1 * bits * 8], bits, (g1 - g0) * 64)[start - g0 * 64:stop - g0 * 64]


def write_token_blocks(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 0,
                       block_ids: int = 1 << 20) -> None:
    """Tokenise ``docs`` and write the block table to ``path``.  One range
    shuffle of the texts by doc_id puts documents in order; each task then
    encodes and packs its range block by block."""
    vocab = vocab or default_vocab()
    bits = width(vocab_size(vocab))

    def run(batches):
        from pyspark import TaskContext
        part, block = TaskContext.get().partitionId(), 0
        enc = encoder(vocab)
        ids, docs_in, held = [], [], 0

        def emit():
            nonlocal ids, docs_in, held, block
            flat = np.concatenate(ids)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i8")
            row = [[part], [block], [bits], [len(flat)],
                   [np.array([d or 0 for d in docs_in], "<i8").tobytes()],
                   [np.array([d is None for d in docs_in], np.uint8).tobytes()],
                   [offsets.tobytes()], [pack_bits(flat, bits)]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 4
            names = ["part", "block", "bits", "n_ids", "doc_ids", "doc_null", "offsets", "packed"]
            ids, docs_in, held, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names)

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                ids.append(np.append(x, np.uint32(end_id)))
                docs_in.append(d)
                held += len(x) + 1
                if held >= block_ids:
                    yield emit()
        if ids:
            yield emit()

    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, BLOCKS).write.parquet(path))


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, read back from the blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # ids before each block: a running sum within the range partition, plus
    # the totals of the partitions before it (one row per write task)
    sizes = blocks.select("part", "block", "n_ids")
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_t"))
    parts = parts.select("part", F.coalesce(F.sum("_t").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    begin = (sizes.withColumn("_b", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)))
             .join(parts, "part").select("part", "block", (F.col("_b") + F.col("_p")).alias("_begin")))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = unpack_bits(r["packed"], r["bits"], r["n_ids"]).astype("<u4")
                off = np.frombuffer(r["offsets"], "<i8")
                nulls = np.frombuffer(r["doc_null"], np.uint8).astype(bool)
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(crc), pa.int64()), pa.array([r["block"]] * len(crc), pa.int64()),
                     pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=nulls), pa.array(off[:-1]),
                     pa.array(np.diff(off)), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "_at", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(run, "part long, block long, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return (rows.join(begin, ["part", "block"])
            .select("doc_id", (F.col("_begin") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32"))


def token_round_trip(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-blocks")
    write_token_blocks(docs, path, vocab)
    return read_token_blocks(docs.sparkSession, path)
