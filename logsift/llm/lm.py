"""Language-model scoring by logistic context mixing over bits.

A text's words are symbols of a prefix code over the common words of the
training documents; any other word is an escape, its bytes in a second
prefix code, and a blank.  Each symbol is a few binary decisions, and
several predictors, tables of bit counts under a hashed context, give the
log odds of each: for a word the last very common word (which tells the
language), the word before and the two words before; for a byte two bytes
with that common word, and the last three and five bytes.
The odds are mixed by weights picked by a gate - word or byte, and how much
the predictors have seen - that learn online on training documents kept out
of the tables, and an adaptive probability map by place and mixed odds
refines the result.  The sum of the decisions' log probabilities is the log
probability of the text.

What is scored is the text as the baseline sees it: A-Z lower-cased, words
joined by single spaces.  Tables, weights and map are sums over all training
documents: each task adds up its documents, and the sums are merged in Spark
in two steps.  Tables grow with the training bytes up to ``most_bits``,
which bounds the model that is broadcast (two bytes a slot).  The word-count baseline is exact: counts of the
``top_words`` commonest words are broadcast and every other occurrence is
joined to its count.

Defined results: null text is empty (the end mark alone); repeated rows are
scored row by row; a null doc_id is held out; without training documents
every decision has odds one; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.staging import PACKED, materialise, release

ESCAPE, END, FIRST = 256, 257, 258      # symbols: bytes, escape, end mark, then the coded words
PAD = 5                                 # end marks before each text: contexts never cross texts
ORDERS = 3                              # predictors
COMMON = 64                             # words that tell the language
CODED = 13                              # a coded word is one token of 2^13 or more: at most 8,192 words
GATES, STEPS, MAP_CELLS = 128, 32, 32
ODDS = 24 * STEPS                       # steps of the mixed odds
DEEP = 32                               # decisions of a word told apart by the map
PLACES = 257 + DEEP                     # map rows: byte after each byte or escape, word by depth
SYMBOL = 14                             # bits of a symbol: FIRST + 2^CODED at most
CHUNK = 1 << 16


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))


# ---------------------------------------------------------------- spelling

def prefix_code(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical Huffman code: length of each symbol and its path, a one bit
    followed by the code, so that the decision node at depth d is the path
    less its last (length - d) bits.  Weights below a millionth of the sum
    are raised to it, which keeps paths within 32 bits."""
    weights = np.maximum(weights, max(1, int(weights.sum()) >> 20)).tolist()
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    n, up = len(heap), [0] * (2 * len(heap) - 1)
    for node in range(n, 2 * n - 1):
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        up[a] = up[b] = node
        heapq.heappush(heap, (wa + wb, node))
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[up[node]] + 1
    length = np.array(depth[:n])
    path, code, last = np.zeros(n, np.uint32), 0, 0
    for i in np.argsort(length, kind="stable").tolist():
        code <<= int(length[i]) - last
        last = int(length[i])
        path[i] = (1 << last) | code
        code += 1
    return length, path


SHORT = 15                              # bytes of a word that is looked up as two numbers
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Places:
    """Place of a word in a list of distinct words, for all words of a
    buffer at once.  A word of up to SHORT bytes is two numbers that hold
    its bytes and length, found in a bucket of their hash; longer ones are
    few and are asked for one by one."""

    def __init__(self, words: list[bytes]):
        self.long = {w: i for i, w in enumerate(words) if len(w) > SHORT}
        own = [i for i, w in enumerate(words) if len(w) <= SHORT]
        width = np.array([len(words[i]) for i in own], np.int64)
        pair = self._pairs(b"".join([words[i] for i in own]), np.cumsum(width) - width, width)
        self.bits = max(len(own) * 2, 2).bit_length()
        bucket = self._buckets(pair)
        order = np.argsort(bucket, kind="stable")
        self.pair, self.place = pair[order], np.array(own, np.int32)[order]
        self.start = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    @staticmethod
    def _pairs(buffer: bytes, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The two numbers of each word (of a longer one: of its beginning)."""
        buffer += bytes(16)
        eight = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))        # the eight bytes from each place
        pair = np.empty((len(start), 2), np.uint64)
        np.bitwise_and(eight[start], _KEEP.take(np.minimum(width, 8)), out=pair[:, 0])
        rest = eight[start + 8]
        rest &= _KEEP.take(np.clip(width - 8, 0, SHORT - 8))
        rest |= np.minimum(width, SHORT + 1).astype(np.uint64) << np.uint64(56)
        pair[:, 1] = rest
        return pair

    def _buckets(self, pair: np.ndarray) -> np.ndarray:
        h = pair[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        h ^= (pair[:, 1] + (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h >>= np.uint64(64 - self.bits)
        return h.view(np.int64)

    def find(self, buffer: bytes, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for those that are not in the list."""
        got = np.full(len(start), -1, np.int64)
        if len(self.place):
            pair = self._pairs(buffer, start, width)
            bucket = self._buckets(pair)
            at, stop = self.start.take(bucket), self.start.take(bucket + 1)
            open_ = np.flatnonzero((at < stop) & (width <= SHORT))
            at, stop, pair = at.take(open_), stop.take(open_), pair.take(open_, axis=0)
            while len(open_):
                same = self.pair.take(at, axis=0) == pair
                hit = same[:, 0] & same[:, 1]
                got[open_[hit]] = self.place.take(at[hit])
                at += 1
                left = np.flatnonzero(~hit & (at < stop))
                open_, at, stop, pair = open_.take(left), at.take(left), stop.take(left), pair.take(left, axis=0)
        if self.long:
            for i in np.flatnonzero(width > SHORT).tolist():
                got[i] = self.long.get(buffer[start[i]:start[i] + width[i]], -1)
        return got


class Speller:
    """The vocabulary's symbols and their prefix codes.  ``words``: word to
    count, of which those that are one in 2^CODED of the ``total`` training
    tokens or more (four at least) get a symbol of their own."""

    def __init__(self, words: dict[bytes, int], total: int):
        ranked = sorted(words.items(), key=lambda x: (-x[1], x[0]))
        self.ids = {w: i for i, (w, _) in enumerate(ranked)}
        counts = np.array([n for _, n in ranked], np.int64)
        self.coded = int(np.searchsorted(-counts, -max(4, total >> CODED), "right"))
        ends = words.get(b"", 0)
        self.places = Places([w for w, _ in ranked])
        self.codes = Places([w for w, _ in ranked[:self.coded]])
        own = counts[:self.coded].copy()
        if self.ids.get(b"", self.coded) < self.coded:
            own[self.ids[b""]] = 0                     # the end mark has its own symbol
        bytes_ = prefix_code(byte_weights(words))
        word = prefix_code(np.concatenate([[max(total - int(own.sum()) - ends, 0) + 1, ends + 1], own]))
        self.length = np.concatenate([bytes_[0], word[0]]).astype(np.uint8)
        self.path = np.concatenate([bytes_[1], word[1]])

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "ids"}      # tasks look words up by ``places``

    def symbols(self, texts: list[bytes], ranks: bool = True) -> tuple:
        """Symbols with PAD end marks before each text, the mask of those
        that are spelled, words a text, and all words (the buffer they stand
        in, their starts and widths) with their ranks (-1: unknown, or,
        without ``ranks``, not coded)."""
        # every word and end mark (an empty word) with one blank behind it
        joined = b"".join([t + b"  " if t else b" " for t in texts])
        text = np.frombuffer(joined, np.uint8)
        blanks = np.flatnonzero(text == 32)
        long = np.diff(blanks, prepend=-1)
        sizes = np.fromiter((t.count(b" ") + 2 if t else 1 for t in texts), np.int64, len(texts))
        words = joined, blanks - long + 1, long - 1
        ids = (self.places if ranks else self.codes).find(*words)
        last = np.cumsum(sizes) - 1
        spelled = (ids < 0) | (ids >= self.coded)
        spelled[last] = False
        width = np.where(spelled, long + 1, 1)
        width[last - sizes + 1] += PAD
        at = np.cumsum(width) - width
        real = np.ones(int(width.sum()), bool)
        pads = (at[last - sizes + 1][:, None] + np.arange(PAD)).ravel()
        real[pads] = False
        at[last - sizes + 1] += PAD
        out = np.empty(len(real), np.uint32)
        out[pads] = END
        out[at] = np.where(spelled, ESCAPE, ids + FIRST)
        out[at[last]] = END
        byte = real.copy()
        byte[at] = False
        out[byte] = text[np.repeat(spelled, long)]
        return out, real, sizes, words, ids


def contexts(data: np.ndarray) -> list[np.ndarray]:
    """Hashed contexts of the predictors for the symbols from the PADth on."""
    u = np.uint32
    back = [data[PAD - k:-k] for k in range(1, PAD + 1)]
    told = np.where((data >= END) & (data < FIRST + COMMON), np.arange(len(data), dtype=np.int32), 0)
    lang = data.take(np.maximum.accumulate(told)[PAD - 1:-1], mode="clip") * u(0x7FEB352D)
    one = back[0] * u(0x2C1B3C6D)
    two = one + back[1] * u(0x297A2D39)
    three = two + back[2] * u(0x85EBCA6B)
    five = three + back[3] * u(0xC2B2AE35) + back[4] * u(0x27D4EB2F)
    byte = data[PAD:] < 256
    out = []
    for word, spelled in ((lang, lang + two), (one, three), (two, five)):
        c = np.where(byte, spelled + u(0x68E31DA4), word)
        c *= u(0x165667B1)
        c ^= c >> u(15)
        out.append(c)
    return out


def decisions(length: np.ndarray, path: np.ndarray, ctx: list[np.ndarray], bits: tuple):
    """Per depth of symbols in order of falling length: number of symbols
    still open, slots of the predictors, bits."""
    masks = [np.uint32((1 << b) - 1) for b in bits]
    opened = len(length) - np.cumsum(np.bincount(length, minlength=1))     # symbols beyond depth d
    shift = length.astype(np.uint32)
    for n in opened.tolist():
        if not n:
            return
        left = shift[:n]
        left -= np.uint32(1)
        node = path[:n] >> left
        bit = (node & np.uint32(1)).astype(bool)
        node >>= np.uint32(1)
        node *= np.uint32(0x9E3779B1)
        slots = []
        for c, mask in zip(ctx, masks):
            s = c[:n] ^ node
            s *= np.uint32(0x85EBCA6B)
            s ^= s >> np.uint32(13)
            s &= mask
            slots.append(s)
        yield n, slots, bit


class Spelled:
    """A group of texts laid out for vectorised decisions."""

    def __init__(self, texts: list[bytes], speller: Speller, ranks: bool = True):
        self.data, real, self.sizes, self.words, self.ids = speller.symbols(texts, ranks)
        at = np.flatnonzero(real)
        marks = np.flatnonzero(real & (self.data == END)) - PAD * np.arange(1, len(texts) + 1)
        self.ends = np.repeat(np.arange(len(texts)), np.diff(marks, prepend=-1))     # text of each place
        length = speller.length.take(self.data.take(at))
        # longest spelled first: the places still open at a depth are a prefix
        self.order = np.argsort(255 - length, kind="stable")
        self.at = at.take(self.order)
        own = self.data.take(self.at)
        self.length, self.path = length.take(self.order), speller.path.take(own)
        self.byte = own < 256
        before = self.data.take(self.at - 1)
        self.row = np.where(self.byte, np.minimum(before, 256), 257).astype(np.intp)
        self.gate = self.byte.astype(np.int16) << 2         # shifted twice more by the predictors

    def decisions(self, bits: tuple):
        """Per depth: number of places still open, slots of the predictors,
        bits."""
        own = self.at - PAD
        return decisions(self.length, self.path, [c.take(own) for c in contexts(self.data)], bits)

    def rows(self, d: int, n: int) -> np.ndarray:
        """Map rows of the open places at depth d."""
        return np.where(self.byte[:n], self.row[:n], 257 + min(d, DEEP - 1))


def spelling(text: bytes | None) -> bytes:
    """The text that is scored: A-Z lower-cased, words single-spaced."""
    return b" ".join((text or b"").lower().split())


def grouped(texts, size: int):
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


# ---------------------------------------------------------------- learning

def merge(parts: DataFrame, kind: str, finish=None) -> dict[str, np.ndarray]:
    """Sums of the vectors that tasks emitted as (name, chunk, salt, data),
    first per salt, then over salts; ``finish`` is applied to each summed
    chunk.  The result has the size of the model."""
    wide = {"<i4": "<i8"}.get(kind, kind)

    def adder(read, last):
        def add(batches):
            import zstandard
            sums: dict = {}
            for b in batches:
                for name, chunk, data in zip(*[b.column(i).to_pylist() for i in (0, 1, 3)]):
                    v = np.frombuffer(zstandard.decompress(data), read)
                    if (name, chunk) in sums:
                        sums[name, chunk] += v
                    else:
                        sums[name, chunk] = v.astype(wide)
            for (name, chunk), v in sums.items():
                yield _row(name, chunk, 0, finish(v) if last and finish else v)
        return add

    schema = "name string, chunk int, salt int, data binary"
    once = parts.repartition("name", "chunk", "salt").mapInArrow(adder(kind, False), schema)
    whole = materialise(once.repartition("name", "chunk").mapInArrow(adder(wide, True), schema), "lm-sums", **PACKED)
    import zstandard
    got: dict[str, list] = {}
    for r in sorted(whole.collect(), key=lambda r: (r["name"], r["chunk"])):       # the model itself
        got.setdefault(r["name"], []).append(np.frombuffer(zstandard.decompress(r["data"]), "<i2" if finish else wide))
    return {k: np.concatenate(v) for k, v in got.items()}


def _row(name: str, chunk: int, salt: int, v: np.ndarray) -> pa.RecordBatch:
    import zstandard
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()),
         pa.array([zstandard.compress(v.tobytes(), 1)], pa.binary())], ["name", "chunk", "salt", "data"])


def _salt() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId() // 64


def byte_weights(words: dict[bytes, int]) -> np.ndarray:
    """How often each byte stands in the commonest words, their blanks
    included (only the lengths of the code depend on it)."""
    total = np.zeros(256, np.int64)
    for w, n in words.items():
        total += n * np.bincount(np.frombuffer(w + b" ", np.uint8), minlength=256)
    return total


class BitCounts:
    """Counts of zeros and ones in every slot.  A symbol's decisions follow
    from the symbol and its context, so symbols are held as (context, symbol)
    and each distinct pair of some ``held`` symbols is spelled out once, with
    its count."""

    def __init__(self, speller: Speller, bits: tuple, held: int = 1 << 20):
        self.speller, self.bits, self.held, self.n = speller, bits, held, 0
        self.total = [np.zeros(2 << b, np.int32) for b in bits]
        self.pairs: list[list] = [[] for _ in bits]

    def add(self, texts: list[bytes]) -> None:
        data, real, *_ = self.speller.symbols(texts, ranks=False)
        own, real = data[PAD:].astype(np.uint64), real[PAD:]
        for pairs, c in zip(self.pairs, contexts(data)):
            pairs.append((c.astype(np.uint64) << np.uint64(SYMBOL) | own)[real])
        self.n += int(real.sum())
        if self.n >= self.held:
            self.spell()

    def spell(self) -> None:
        for k, b in enumerate(self.bits):
            if self.n:
                pairs = np.concatenate(self.pairs[k])
                self.pairs[k] = []
                pairs.sort()
                heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                times = np.diff(np.append(heads, len(pairs))).astype(np.int32)
                pairs = pairs[heads]
                own = (pairs & np.uint64((1 << SYMBOL) - 1)).astype(np.intp)
                length = self.speller.length[own]
                order = np.argsort(255 - length, kind="stable")
                c, times = (pairs >> np.uint64(SYMBOL)).astype(np.uint32)[order], times[order]
                for n, (s,), bit in decisions(length[order], self.speller.path[own[order]], [c], (b,)):
                    s <<= np.uint32(1)
                    s |= bit
                    np.add.at(self.total[k], s.astype(np.intp), times[:n])
        self.n = 0


def bit_tables(texts: DataFrame, speller: Speller, bits: tuple, group_bytes: int) -> list[np.ndarray]:
    """Odds tables from the counts of zeros and ones in every slot."""
    shared = texts.sparkSession.sparkContext.broadcast(speller)

    def run(batches):
        own = shared.value
        seen = BitCounts(own, bits)
        for b in batches:
            for group in grouped((spelling(t) for t in b.column(0).to_pylist()), group_bytes):
                seen.add(group)
        seen.spell()
        if any(counts.any() for counts in seen.total):
            salt = _salt()
            for k, counts in enumerate(seen.total):
                for c in range(0, len(counts), CHUNK):
                    part = counts[c:c + CHUNK]
                    if part.any():
                        yield _row(f"order{k}", c // CHUNK, salt, part.astype("<i4"))

    got = merge(texts.mapInArrow(run, "name string, chunk int, salt int, data binary"), "<i4", odds_table)
    return [got.get(f"order{k}", np.zeros(1 << b, np.int16)) for k, b in enumerate(bits)]


def odds_table(counts: np.ndarray) -> np.ndarray:
    """Log odds in thousandths, with how much was seen (0 to 3) in the low
    two bits."""
    n0, n1 = counts[0::2].astype(float), counts[1::2].astype(float)
    st = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -8, 8)
    seen = np.searchsorted([1, 4, 32], n0 + n1, "right")
    return ((st * 1000).round().astype(np.int16) << 2 | seen).astype("<i2")


def mixed(model: dict, sp: Spelled, n: int, slots: list) -> tuple[np.ndarray, np.ndarray, list]:
    """Gate, mixed log odds and the predictors' odds of the ``n`` open
    decisions."""
    x, gate = [], None
    for table, s in zip(model["tables"], slots):
        v = table.take(s, mode="clip")
        x.append(np.multiply(v, np.float32(0.00025), dtype=np.float32))    # the low bits weigh nothing
        v &= 3
        if gate is None:
            gate = sp.gate[:n] + v
        else:
            gate <<= 2
            gate |= v
    gate = gate.astype(np.intp)
    w = model["weights"]
    z = w[ORDERS].take(gate, mode="clip")
    for k in range(ORDERS):
        own = w[k].take(gate, mode="clip")
        own *= x[k]
        z += own
    return gate, np.clip(z, -11.999, 11.999, out=z), x


def cell(z: np.ndarray) -> np.ndarray:
    return np.clip((z + 8) * np.float32(MAP_CELLS / 16), 0, MAP_CELLS - 1).astype(np.intp)


class Tuner:
    """Weights by online gradient steps, and counts of the refining map."""

    def __init__(self, model: dict, rate: float = 0.4):
        self.model, self.rate = dict(model), rate
        self.model["weights"] = model["weights"].copy()
        self.ones, self.alls, self.total = np.zeros(PLACES * MAP_CELLS), np.zeros(PLACES * MAP_CELLS), 0

    def learn(self, texts: list[bytes]) -> None:
        w = self.model["weights"]
        sp = Spelled(texts, self.model["speller"], ranks=False)
        for d, (n_open, slots, bit) in enumerate(sp.decisions(self.model["bits"])):
            gate, z, x = mixed(self.model, sp, n_open, slots)
            err = bit - 1 / (1 + np.exp(-z))
            n = np.maximum(np.bincount(gate, minlength=GATES), 32)
            for k in range(ORDERS):
                w[k] += (self.rate * np.bincount(gate, err * x[k], GATES) / n).astype(np.float32)
            w[ORDERS] += (self.rate * np.bincount(gate, err, GATES) / n).astype(np.float32)
            at = sp.rows(d, n_open) * MAP_CELLS + cell(z)
            self.alls += np.bincount(at, minlength=len(self.alls))
            self.ones += np.bincount(at, bit, len(self.ones))
            self.total += n_open

    def sums(self) -> np.ndarray:
        return np.concatenate([(self.model["weights"] * self.total).ravel(), [self.total], self.ones, self.alls])


def apply_tuning(model: dict, got: np.ndarray) -> None:
    """Weights averaged by the decisions that tuned them, and the map."""
    n = model["weights"].size
    model["weights"] = (got[:n] / got[n]).reshape(model["weights"].shape).astype(np.float32)
    ones, alls = got[n + 1:].reshape(2, PLACES, MAP_CELLS)
    model["map"] = ((ones + 8 * model["map"]) / (alls + 8)).astype(np.float32)


def tune(texts: DataFrame, model: dict, group_bytes: int) -> None:
    """Tune in every task and average what the tasks learned."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tuner = Tuner(shared.value)
        for b in batches:
            for group in grouped((spelling(t) for t in b.column(0).to_pylist()), group_bytes):
                tuner.learn(group)
        if tuner.total:
            yield _row("tuned", 0, _salt(), tuner.sums().astype("<f8"))

    got = merge(texts.mapInArrow(run, "name string, chunk int, salt int, data binary"), "<f8").get("tuned")
    if got is not None:
        apply_tuning(model, got)


def sizes(train_bytes: int, most_bits: int) -> tuple[int, ...]:
    """Bits of the tables: a slot of the longest contexts for every two bytes
    of text, half as many for the others."""
    most = max(18, min(most_bits, int(train_bytes).bit_length() - 1))
    return most - 1, most - 1, most


def untuned(speller: Speller, bits: tuple, tables: list[np.ndarray]) -> dict:
    centre = (np.arange(MAP_CELLS) + 0.5) * (16 / MAP_CELLS) - 8
    return {"speller": speller, "bits": bits, "tables": tables,
            "weights": np.vstack([np.full((ORDERS, GATES), 0.3), np.zeros((1, GATES))]).astype(np.float32),
            "map": np.tile(1 / (1 + np.exp(-centre)), (PLACES, 1)).astype(np.float32)}


def train(docs: DataFrame, speller: Speller, train_bytes: int, most_bits: int = 23, group_bytes: int = 1 << 18) -> dict:
    learn = docs.where(~held_out()).select(F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id").alias("h"))
    aside = learn.where("pmod(h, 8) = 0").select("text")
    rest = learn.where("pmod(h, 8) <> 0").select("text")
    bits = sizes(train_bytes, most_bits)
    model = untuned(speller, bits, bit_tables(rest, speller, bits, group_bytes))
    tune(aside, model, group_bytes // 8)
    model["spent"] = spent_table(model["map"])
    release(docs.sparkSession)
    return model


def spent_table(refine: np.ndarray) -> np.ndarray:
    """Log10 probability of a one and of a zero by map row and mixed odds
    in steps of 1/STEPS: the mean of the odds' own and the refined one."""
    z = (np.arange(24 * STEPS) + 0.5) / STEPS - 12
    one = 0.5 / (1 + np.exp(-z)) + 0.5 * refine[:, cell(z)]
    one = np.clip(one, 1e-6, 1 - 1e-6)
    return np.log10(np.stack([1 - one, one])).astype(np.float32).ravel()


def log10_probabilities(sp: Spelled, model: dict) -> np.ndarray:
    """Log10 probability of each text of a group (with its end mark)."""
    spent, table = np.zeros(len(sp.at), np.float64), model["spent"]
    place, deeper = (sp.row * ODDS).astype(np.int32), np.where(sp.byte, 0, ODDS).astype(np.int32)
    for d, (n, slots, bit) in enumerate(sp.decisions(model["bits"])):
        _, z, _ = mixed(model, sp, n, slots)
        z *= np.float32(STEPS)
        z += np.float32(12 * STEPS)
        at = z.astype(np.int32)                        # above zero: rounds down
        at += place[:n]
        at += bit * np.int32(PLACES * ODDS)
        spent[:n] += table.take(at, mode="clip")
        if d < DEEP - 1:
            place[:n] += deeper[:n]
    return np.bincount(sp.ends[sp.order], spent, len(sp.sizes))


# ---------------------------------------------------------------- words

def word_counts(docs: DataFrame, held_words: int = 300_000) -> DataFrame:
    """(token, n) over the training documents; the end of a document is the
    empty token."""
    def run(batches):
        counts: Counter = Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update((t or b"").lower().split())
                counts[b""] += 1
                if len(counts) >= held_words:
                    yield emit()
        if counts:
            yield emit()

    return (docs.where(~held_out()).select(F.col("text").cast("binary")).mapInArrow(run, "token binary, n long")
            .groupBy("token").agg(F.sum("n").alias("n")))


def common(counts: DataFrame, top_words: int) -> tuple[int, dict[bytes, int]]:
    """The least count such that at most ``top_words`` words reach it, and
    those words."""
    by_n = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(top_words).collect()
    total, least = 0, 1 << 62
    for r in by_n:
        total += r["k"]
        if total > top_words:
            break
        least = r["n"]
    # at most `top_words` rows
    return least, {bytes(r["token"]): r["n"] for r in counts.where(F.col("n") >= least).collect()}


def unknown_words(sp: Spelled, text: np.ndarray) -> pa.ListArray:
    """(token, k) of the words of each text that have no rank; ``text`` is
    the text of each word."""
    buffer, start, width = sp.words
    at = np.flatnonzero(sp.ids < 0)
    found = Counter(zip(text[at].tolist(), [buffer[i:i + n] for i, n in zip(start[at].tolist(), width[at].tolist())]))
    per_text = np.bincount(np.fromiter((t for t, _ in found), np.int64, len(found)), minlength=len(sp.sizes))
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()),
        pa.StructArray.from_arrays([pa.array([w for _, w in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", "k"]))


def lm_scores(docs: DataFrame, most_bits: int = 23, top_words: int = 300_000, group_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte."""
    spark = docs.sparkSession
    counts = materialise(word_counts(docs), "lm-words")
    release(spark)
    n, v, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"),
                            F.coalesce(F.sum(F.col("n") * (F.length("token") + 1)), F.lit(0))).first()
    least, known = common(counts, top_words)
    speller = Speller(known, n)
    model = train(docs, speller, size, most_bits, group_bytes)
    logs = np.array([math.log10(known[w] + 1) for w in speller.ids] + [0.0])        # by rank; last: unknown
    shared = spark.sparkContext.broadcast((model, logs))
    floor = math.log10(n + v + 1)

    def run(batches):
        from pyspark import TaskContext
        own, logs = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            for group in grouped((spelling(t) for t in b.column(1).to_pylist()), group_bytes):
                sp = Spelled(group, own["speller"])
                score = log10_probabilities(sp, own)
                m = len(group)
                text = np.repeat(np.arange(m), sp.sizes)
                n_top = np.bincount(text, sp.ids >= 0, m).astype(np.int64)
                base = np.bincount(text, logs.take(sp.ids, mode="wrap"), m)
                rare = unknown_words(sp, text)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, m), pa.array(range(row, row + m), pa.int64()), pa.array([len(t) for t in group], pa.int64()),
                     pa.array(sp.sizes), pa.array(n_top), pa.array(base), pa.array(score), rare],
                    ["doc_id", "row", "n_bytes", "n_tokens", "n_top", "base", "score", "rare"])
                at, row = at + m, row + m

    rows = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, row long, n_bytes long, n_tokens long, n_top long, base double, score double, "
             "rare array<struct<token:binary,k:long>>"), "lm-rows")
    release(spark)
    each = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    joined = each.join(counts.where(F.col("n") < least), "token", "left")
    rest = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("n_rest"),
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("b_rest"))
    return rows.drop("rare").join(rest, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens",
        (F.col("n_top") + F.coalesce("n_rest", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b_rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
