import itertools
import random
import zlib

import numpy as np
from corpus import frame, rows

from logsift.llm import binary_output, packing
from logsift.llm.tokens import PieceEncoder, default_vocab


def library_ids(texts, plain=False):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(default_vocab())
    if plain:
        tok.encode_special_tokens = True
    return [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_pieces_give_the_librarys_ids():
    odd = ["", None, " ", "  ", "a  b", "a   b\n\n c", "foo\nbar", "\nfoo", " foo", "foo ", "foo\n", " \n ", "it's don't 's",
           "a\tb \tc", "x<|endoftext|> y", "é à b 　c", "foo 's", "日本 語", "a\x1cb \x1c c", "\u0085 x", "<|endoftext|>", "\x01a b", "b \x01a", "x\u3000 y", "a\u00a0b \u2028c"]
    every = odd + [r[1] for r in rows()]
    for plain in (False, True):
        enc = PieceEncoder(default_vocab(), plain, max_pieces=50, group_bytes=200)       # resets between groups
        assert [list(x) + [0] for x in enc.encode(every)] == library_ids(every, plain)
    assert 50256 in library_ids(["x<|endoftext|> y"])[0] and 50256 not in library_ids(["x<|endoftext|> y"], True)[0]
    assert list(PieceEncoder(default_vocab()).encode([])) == []


def test_bits_round_trip():
    rng = np.random.default_rng(0)
    for bits, n in itertools.product((1, 7, 16, 17, 31), (0, 1, 63, 64, 65, 1000)):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        packed = binary_output.pack_bits(ids, bits)
        assert (binary_output.unpack_bits(packed, bits, n) == ids).all()
        assert (binary_output.read_slice(packed, bits, n // 3, n) == ids[n // 3:]).all()
    assert binary_output.width(50257) == 16


def test_token_blocks_read_back(spark):
    got = [tuple(r) for r in binary_output.token_round_trip(frame(spark)).collect()]
    data = sorted(((r[0], r[1]) for r in rows()), key=lambda r: r[0])
    at, want = 0, []
    for (d, _), ids in zip(data, library_ids([t for _, t in data])):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got) == sorted(want)
    assert binary_output.token_round_trip(frame(spark, [])).count() == 0


def fewest_bins(sizes, cap):
    """Exhaustive search."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= cap:
                place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1:])
        place(i + 1, bins + [sizes[i]])
    place(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest_bins():
    rng = random.Random(4)
    for _ in range(40):
        sizes = sorted((rng.randint(5, 60) for _ in range(rng.randint(1, 9))), reverse=True)
        plan, least = packing.bin_completion(np.bincount(sizes, minlength=101), 100)
        assert least <= sum(n for _, n in plan) == fewest_bins(sizes, 100)
        used = np.zeros(101, int)
        for parts, n in plan:
            assert sum(parts) <= 100
            np.add.at(used, list(parts), n)
        assert (used == np.bincount(sizes, minlength=101)).all()


def test_cut_puts_the_remainder_first():
    assert packing.cut(5, 8) == [(0, 5)]
    assert packing.cut(16, 8) == [(0, 8), (8, 8)]
    assert packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


def test_pack_places_every_piece_once(spark):
    got = packing.pack(frame(spark), capacity=256).collect()
    ids = {}
    for r, x in zip(rows(), library_ids([r[1] for r in rows()])):
        ids[r[0]] = x
    copies = {}
    for r in rows():
        copies[r[0]] = copies.get(r[0], 0) + 1
    per_seq, per_doc = {}, {}
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] <= 256
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        per_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + r["length"]
    for parts in per_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert per_doc == {d: len(x) * copies[d] for d, x in ids.items()}
    total = sum(per_doc.values())
    assert len(per_seq) <= -(-total // 256) + 2
    assert packing.pack(frame(spark, [])).count() == 0
