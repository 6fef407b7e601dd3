"""Alignment of two tokenisations of the same texts.

Every text is tokenised whole by both vocabularies: a byte-level BPE over
space + text (A) and a piece BPE with byte fallback over the text (B, which
puts the space itself).  Byte ends of the tokens come from the vocabularies'
own bytes and are verified against the text.  Anchors are byte offsets where
tokens of both end and the next token of both starts with a blank; they split
the two id sequences into windows of about a word.  A window's alignment (its
groups between shared ends, and its id pairs) is worked out once per block of
documents for a tuple of A and B ids and then reused.

An id pair's count is the number of documents that hold it linked.  Each task
writes blocks of documents with the block's distinct pairs; counts are added
up over all blocks, joined back per block and pair, never per link.

Defined results: a null or empty text, or one whose tokens do not spell
space + text on either side, has no tokens: zeros and an empty
``groups_sha256``; rows of equal doc_id are documents of their own (each
counts); a null doc_id stays null; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.staging import materialise
from logsift.llm.tokens import _BLANK_RUN, _MARK, PieceEncoder, default_vocab

PIECE_FILE = "piece_bpe_32k.model"
BLOCKS = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, pairs array<long>, held array<long>, ends binary, idx binary, times binary")
ROWS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def default_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path(PIECE_FILE)


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: visible Latin-1 bytes
    stand for themselves, the others for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One vocabulary: its tokens' bytes, lengths and blank marks."""

    def __init__(self, table: list[bytes]):
        self.table = np.array(table, object)
        self.lens = np.fromiter(map(len, table), np.int64, len(table))
        self.marked = np.fromiter((t[:1] == b" " for t in table), bool, len(table))

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        return int(self.lens[ids].sum()) == len(text) and b"".join(self.table[ids]) == text


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices first[i], first[i] + 1, ... (size[i] of them) in a row."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def mixed(ids: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of every token and its place in its window."""
    x = ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpacedPieces(PieceEncoder):
    """The same piecewise encoding for a sentencepiece BPE over blank + text:
    merges stay inside vocabulary entries, and no entry has a blank after
    another character or a newline, so pieces encode alone as they do in the
    text.  A vocabulary with such entries is given whole texts only."""

    def __init__(self, path: str, max_pieces: int = 1_000_000, group_bytes: int = 1 << 22):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = any("▁" in t.lstrip("▁") or "\n" in t for t in self.names)
        self.whole = "" if crossing else "|".join([_BLANK_RUN, _MARK, "▁"])
        self.max_pieces, self.group_bytes = max_pieces, group_bytes
        self._reset()

    def _encode(self, texts: list[str]) -> list:
        # the library puts the blank itself: off where the text has it, and
        # its token dropped where a piece starts without one
        got = self.sp.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        blank = self.sp.piece_to_id("▁")
        return [ids or [blank] if t[:1] == " " else ids[1:] for t, ids in zip(texts, got)]


class Tokens:
    """Both id sequences of a group of documents in a row, and the shared
    ends: ``i``, ``j`` count the A and B tokens up to each, ``cuts`` are the
    places among them of the anchors, which end the windows."""

    def __init__(self, pair: "Pair", a: list[np.ndarray], b: list[np.ndarray]):
        self.n_a = np.fromiter(map(len, a), np.int64, len(a))
        self.n_b = np.fromiter(map(len, b), np.int64, len(b))
        self.a, self.b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        ends_a, ends_b = np.cumsum(pair.a.lens[self.a]), np.cumsum(pair.b.lens[self.b])
        total = int(ends_a[-1]) + 1 if len(ends_a) else 1
        in_a, in_b = np.zeros(total, bool), np.zeros(total, bool)
        in_a[ends_a], in_b[ends_b] = True, True
        self.i, self.j = np.flatnonzero(in_b[ends_a]) + 1, np.flatnonzero(in_a[ends_b]) + 1
        # the next document starts with a blank too: its start is an anchor
        next_a, next_b = np.append(pair.a.marked[self.a], True), np.append(pair.b.marked[self.b], True)
        self.cuts = np.flatnonzero(next_a[self.i] & next_b[self.j])
        self.end_a, self.end_b = self.i[self.cuts], self.j[self.cuts]
        self.size_a, self.size_b = np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)

    def distinct_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(one window of each kind, every window's kind): grouped by a hash
        of the id tuples, then compared id by id."""
        n = len(self.cuts)
        place_a, place_b = spans(np.zeros(n, np.int64), self.size_a), spans(np.zeros(n, np.int64), self.size_b)
        start_a, start_b = self.end_a - self.size_a, self.end_b - self.size_b
        key = (np.add.reduceat(mixed(self.a, place_a, 1), start_a) ^ (np.add.reduceat(mixed(self.b, place_b, 1 << 63), start_b) * np.uint64(0x9E3779B97F4A7C15)))
        _, first, kind = np.unique(key, return_index=True, return_inverse=True)
        like = first[kind]
        same = (self.size_a == self.size_a[like]) & (self.size_b == self.size_b[like])
        safe = np.where(same, like, np.arange(n))
        for ids, start, size in ((self.a, start_a, self.size_a), (self.b, start_b, self.size_b)):
            unlike = ids != ids[spans(start[safe], size)]
            same &= ~np.logical_or.reduceat(unlike, start)
        other = np.flatnonzero(~same)                                # unlike windows of one hash
        kind[other] = len(first) + np.arange(len(other))
        return np.concatenate([first, other]), kind


def joined(items: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """The items up to each of ``ends`` (after the end before), joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), items), mark)


class Memo:
    """The alignments of a block's windows, one per id tuple pair: its groups
    as text, its distinct id pairs and how often it links each."""

    def __init__(self, t: Tokens):
        sample, self.kind = t.distinct_windows()
        # the sampled windows' groups, in a row
        first_cut = np.append(-1, t.cuts[:-1])[sample] + 1
        n_groups = t.cuts[sample] + 1 - first_cut
        group = spans(first_cut, n_groups)
        size_a, size_b = np.diff(t.i, prepend=0)[group], np.diff(t.j, prepend=0)[group]
        start_a, start_b = t.i[group] - size_a, t.j[group] - size_b
        window_ends = np.cumsum(n_groups)
        decimal = lambda ids: pc.cast(pa.array(ids), pa.string())
        left = joined(decimal(t.a[spans(start_a, size_a)]), np.cumsum(size_a), ",")
        right = joined(decimal(t.b[spans(start_b, size_b)]), np.cumsum(size_b), ",")
        self.spelt = joined(pc.binary_join_element_wise(left, right, "|"), window_ends, ";")
        links = size_a * size_b
        nth = spans(np.zeros(len(links), np.int64), links)
        wide = np.repeat(size_b, links)
        codes = (t.a[np.repeat(start_a, links) + nth // wide] << 32) | t.b[np.repeat(start_b, links) + nth % wide]
        self.pairs, place = np.unique(codes, return_inverse=True)
        window = np.repeat(np.repeat(np.arange(len(sample)), n_groups), links)
        both, self.times = np.unique(window << 40 | place, return_counts=True)
        self.place = both & (1 << 40) - 1
        self.ends = np.append(0, np.cumsum(np.bincount(both >> 40, minlength=len(sample))))


class Pair:
    """Both tokenisers of a worker."""

    def __init__(self, vocab: str, pieces: str, max_pieces: int = 250_000):
        self.enc = PieceEncoder(vocab, plain=True, max_pieces=max_pieces)
        alphabet = byte_level_alphabet()
        tokens = self.enc.tok.get_vocab()
        table = [b""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            table[i] = bytes(map(alphabet.__getitem__, t)) if all(c in alphabet for c in t) else t.encode()
        self.a = Side(table)
        self.dec = SpacedPieces(pieces, max_pieces)
        self.b = Side([bytes([int(t[3:5], 16)]) if self.dec.sp.is_byte(i) else t.replace("▁", " ").encode()
                       for i, t in enumerate(self.dec.names)])

    def tokenise(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; both empty where it has no tokens."""
        none = np.zeros(0, np.uint32)
        spaced = pc.binary_join_element_wise("", pc.fill_null(texts, ""), " ")
        for t, a, b in zip(spaced.cast(pa.binary()).to_pylist(), self.enc.encode(spaced), self.dec.encode(spaced)):
            yield (a, b) if len(t) > 1 and self.a.spells(a, t) and self.b.spells(b, t) else (none, none)

    def block(self, texts: pa.Array) -> tuple:
        """Of a group of documents: n_a, n_b, n_groups, n_links and
        groups_sha256 each; their distinct pairs, how many of the documents
        hold each; per document the end of its part of the lists of places
        among the pairs and of times linked."""
        t = Tokens(self, *map(list, zip(*self.tokenise(texts))))
        n = len(t.n_a)
        if not len(t.a):
            zero, none = np.zeros(n, np.int64), np.zeros(0, np.int64)
            return zero, zero, zero, zero, [""] * n, none, none, zero, none, none
        # shared ends and windows up to each document's end
        last = np.cumsum(t.n_a)
        upto_end = lambda ends: np.searchsorted(ends, last, "right")
        groups = upto_end(t.i)
        links = np.append(0, np.cumsum(np.diff(t.i, prepend=0) * np.diff(t.j, prepend=0)))[groups]
        windows = upto_end(t.end_a)
        memo = Memo(t)
        digests = [hashlib.sha256(x).hexdigest() if x else "" for x in
                   joined(memo.spelt.take(pa.array(memo.kind)), windows, ";").cast(pa.binary()).to_pylist()]
        # (document, window kind), then (document, pair)
        doc = np.repeat(np.arange(n), np.diff(windows, prepend=0))
        both, seen = np.unique(doc << 40 | memo.kind, return_counts=True)
        d, w = both >> 40, both & (1 << 40) - 1
        size = memo.ends[w + 1] - memo.ends[w]
        at = spans(memo.ends[w], size)
        both, into = np.unique(np.repeat(d, size) << 40 | memo.place[at], return_inverse=True)
        times = np.bincount(into, memo.times[at] * np.repeat(seen, size), len(both)).astype(np.int64)
        d, place, pairs = both >> 40, both & (1 << 40) - 1, memo.pairs
        return (t.n_a, t.n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0), digests, pairs,
                np.bincount(place, minlength=len(pairs)), np.cumsum(np.bincount(d, minlength=n)), place, times)


_PAIRS: dict = {}


def worker_pair(vocab: str, pieces: str) -> Pair:
    if (vocab, pieces) not in _PAIRS:
        _PAIRS[vocab, pieces] = Pair(vocab, pieces)
    return _PAIRS[vocab, pieces]


def aligned_blocks(docs: DataFrame, vocab: str, pieces: str, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per block of documents: their figures, the block's distinct
    pairs with the number of its documents that hold each, and every
    document's pairs as places in that list."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        pair = worker_pair(vocab, pieces)
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), *[longs] * 5, pa.list_(pa.string()), longs, longs, *[pa.binary()] * 3]
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(size + 64) // block_bytes
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for k0, k1 in zip(cuts[:-1], cuts[1:]):
                if k0 == k1:
                    continue
                part = batch.slice(k0, k1 - k0)
                *facts, digests, known, held, ends, place, times = pair.block(part.column(1))
                row = [[number], [part.column(0).to_pylist()], *([f] for f in facts), [digests], [known], [held],
                       [ends.astype("<i8").tobytes()], [place.astype("<u4").tobytes()], [times.astype("<i8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], BLOCK_NAMES)
                number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def pair_counts(entries: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (no other pair of its A
    id has a higher n) from rows (pair, held)."""
    n = entries.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("a", F.shiftright("pair", 32))
    top = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _finish(batches):
    for batch in batches:
        for k in range(batch.num_rows):                  # block by block: each may be megabytes
            r = {c: batch.column(c)[k] for c in batch.schema.names}
            facts = [r[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            ends = np.frombuffer(r["ends"].as_buffer(), "<i8")
            idx = np.frombuffer(r["idx"].as_buffer(), "<u4")
            times = np.frombuffer(r["times"].as_buffer(), "<i8")
            n_best = count_sum = ends * 0
            if len(idx):
                n = r["n"].values.to_numpy(zero_copy_only=False)
                best = r["best"].values.to_numpy(zero_copy_only=False)
                first = np.append(0, ends)
                upto = lambda v: np.diff(np.append(0, np.cumsum(v))[first])
                n_best, count_sum = upto(np.where(best[idx], times, 0)), upto(n[idx] * times)
            facts += [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), r["groups_sha256"].values]
            yield pa.RecordBatch.from_arrays(facts, [c.split()[0] for c in ROWS.split(", ")])


def align_tokenizers(docs: DataFrame, vocab: str | None = None, pieces: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    blocks = materialise(aligned_blocks(docs, vocab or default_vocab(), pieces or default_pieces()), "aligned-blocks")
    entries = (blocks.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("x"))
               .select("block", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held")))
    counts = materialise(pair_counts(entries.select("pair", "held")), "pair-counts")
    looked = (entries.select("block", "pair").join(counts, "pair")
              .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("x"))
              .select("block", F.col("x.n").alias("n"), F.col("x.best").alias("best")))
    return (blocks.drop("pairs", "held").join(looked, "block", "left")
            .mapInArrow(_finish, ROWS))


def pair_table(docs: DataFrame, vocab: str | None = None, pieces: str | None = None) -> DataFrame:
    """The corpus-wide id pairs: a_id, b_id, n_docs, best."""
    blocks = materialise(aligned_blocks(docs, vocab or default_vocab(), pieces or default_pieces()), "aligned-blocks")
    entries = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(
        F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    return pair_counts(entries).select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"),
                                       F.col("n").alias("n_docs"), "best")
