import hashlib
from collections import Counter

import pyarrow as pa
import sentencepiece
from corpus import frame, rows
from tokenizers import Tokenizer

from logsift.llm import alignment
from logsift.llm.tokens import default_vocab

ODD = ["a▁b", "x<|endoftext|> y <s> z", "日本 語 テスト", "🙂🙃 emoji 🏳️‍🌈", "a  b   c", "\nfoo\n\nbar\t", " lead", "tail ", "\x00a", "ﬁ ①", "é é",
       "unbelievabletokenization " * 30, "z" * 2000, "0123456789 3.14 a_b-c"]


def brute(docs):
    """Both libraries, byte by byte, whole documents at once."""
    tok = Tokenizer.from_file(default_vocab())
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    chars = alignment.byte_level_alphabet()
    every, held = [], Counter()
    for d, t in docs:
        a = tok.encode(" " + t, add_special_tokens=False) if t else None
        ids = a.ids if t else []
        b = sp.encode(t) if t else []
        ab = [bytes(chars[c] for c in x) for x in a.tokens] if t else []
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        spoken = (" " + t).encode() if t else b""
        if not t or b"".join(ab) != spoken or b"".join(bb) != spoken:
            every.append((d, 0, 0, [], []))
            continue
        shared = {sum(map(len, ab[:0]))}
        ends_a, ends_b, at = [], [], 0
        for x in ab:
            at += len(x)
            ends_a.append(at)
        at = 0
        for x in bb:
            at += len(x)
            ends_b.append(at)
        shared = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for s in shared:
            i1, j1 = ends_a.index(s, i) + 1, ends_b.index(s, j) + 1
            groups.append((ids[i:i1], b[j:j1]))
            i, j = i1, j1
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        held.update(set(links))
        every.append((d, len(ab), len(bb), groups, links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for d, na, nb, groups, links in every:
        spelt = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((d, na, nb, len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links),
                    hashlib.sha256(spelt.encode()).hexdigest() if na else ""))
    return sorted(out, key=str)


def test_alignment_equals_brute_force(spark):
    odd = [(1000 + i, t, "en", "s", 0, "x", i, "y") for i, t in enumerate(ODD)] + [(None, "no id here", None, None, 0, "x", 1, "y")] * 2
    data = rows() + odd
    got = sorted((tuple(r) for r in alignment.align_tokenizers(frame(spark, data)).collect()), key=str)
    want = brute([(r[0], r[1]) for r in data])
    assert got == want
    none = {r[0] for r in got if r[1] == 0}
    assert 1000 in none and 1001 not in none                 # U+2581 itself is read as a blank
    assert alignment.align_tokenizers(frame(spark, [])).count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch):
    data = rows()[:30] + [(2000 + i, t, "en", "s", 0, "x", i, "y") for i, t in enumerate(ODD)]
    docs = frame(spark, data)
    whole = sorted((tuple(r) for r in alignment.align_tokenizers(docs).collect()), key=str)
    one = alignment.Pair(default_vocab(), alignment.default_pieces(), max_pieces=20)
    facts = {}
    for d, text, *_ in data:    
        n_a, n_b, n_groups, n_links, digests, *_ = one.block(pa.array([text], pa.string()))
        facts[d] = (n_a[0], n_b[0], n_groups[0], n_links[0], digests[0])
    assert facts == {r[0]: (*r[1:5], r[7]) for r in whole}
    blocks = alignment.aligned_blocks

    def small(docs, vocab, pieces, block_bytes=200):
        return blocks(docs, vocab, pieces, block_bytes)
    monkeypatch.setattr(alignment, "aligned_blocks", small)
    assert sorted((tuple(r) for r in alignment.align_tokenizers(docs.repartition(3)).collect()), key=str) == whole


def test_pair_table(spark):
    docs = frame(spark, [(i, "the cat the cat", "en", "s", 0, "x", 1, "y") for i in range(3)] + [(9, "the", "en", "s", 0, "x", 1, "y")])
    rows_ = alignment.pair_table(docs).collect()
    assert sorted(r["n_docs"] for r in rows_) == [3, 4] and all(r["best"] for r in rows_)


def test_windows_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(alignment, "mixed", lambda ids, place, salt: (ids * 0).astype("uint64"))
    one = alignment.Pair(default_vocab(), alignment.default_pieces())
    text = "the cat sat on the unbelievably tall matmatmat the cat"
    got = one.block(pa.array([text, None, text]))
    want = [r for r in brute([(1, text), (2, None), (3, text)])]
    assert [(a, b, g, n, s) for a, b, g, n, s in zip(*got[:5])] == [(*r[1:5], r[7]) for r in want]
