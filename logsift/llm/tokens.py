"""Byte-level BPE ids of whole texts through the ``tokenizers`` library.

The pre-tokeniser of a byte-level BPE never joins a token across the start of
a single space or newline that follows a non-blank, so a text whose blanks
all stand alone is the concatenation of its pieces (a word with the blank
before it).  Texts are split and dictionary-encoded in Arrow; each distinct
piece is encoded once per worker by the library and its ids are gathered by
index.  A text with two blanks in a row, with the mark put before a text's
first piece, or with the string of an added token is encoded whole.  Both
ways give the library's ids for the text.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCAB_FILE = "byte_bpe_50k.json"
_MARK = "\x01"
# every character that the library or Python takes for a blank
_BLANK_RUN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"
_ENCODERS: dict = {}


def default_vocab() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCAB_FILE)


def vocab_size(path: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).get_vocab_size()


def encoder(path: str, plain: bool = False) -> "PieceEncoder":
    """The worker's encoder of a vocabulary file (kept between tasks)."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = PieceEncoder(path, plain)
    return _ENCODERS[path, plain]


class PieceEncoder:
    """``plain``: an added token's string in a text is ordinary text; else it
    becomes that token, as the library does by default."""

    def __init__(self, path: str, plain: bool = False, max_pieces: int = 1_000_000, group_bytes: int = 1 << 22):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = [] if plain else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.tok.encode_special_tokens = plain
        self.whole = "|".join([_BLANK_RUN, _MARK, *map(re.escape, added)])
        self.max_pieces, self.group_bytes = max_pieces, group_bytes
        self._reset()

    def _reset(self) -> None:
        self.index: dict = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lens = np.zeros(1 << 16, np.int64)

    def _encode(self, texts: list[str]) -> list:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, new: list) -> None:
        encoded = self._encode([k[1:] if k[:1] == _MARK else k if k[:1] == "\n" else " " + k for k in new])
        n = np.fromiter(map(len, encoded), np.int64, len(encoded))
        k0, total = len(self.index), int(n.sum())
        while k0 + len(new) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + total] = [i for e in encoded for i in e]
        self.lens[k0:k0 + len(new)] = n
        self.starts[k0:k0 + len(new)] = self.used + np.cumsum(n) - n
        self.used += total
        self.index.update(zip(new, range(k0, k0 + len(new))))

    def _places(self, pieces: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))

    def _group(self, texts: pa.Array) -> list:
        marked = pc.binary_join_element_wise(_MARK, pc.replace_substring(texts, "\n", " \n"), "")
        pieces = pc.split_pattern(marked, " ")
        bounds = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        place = self._places(distinct)
        if (place < 0).any():
            if len(self.index) + int((place < 0).sum()) > self.max_pieces and self.index:
                self._reset()
                place[:] = -1
            self._add(distinct[place < 0].tolist())
            place = self._places(distinct)
        at = place[coded.indices.to_numpy()]
        n = self.lens[at]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.starts[at] - (ends - n), n) + np.arange(ends[-1])]
        counts = np.add.reduceat(n, bounds[:-1] - bounds[0])
        return np.split(flat, np.cumsum(counts)[:-1])

    def encode(self, texts):
        """Yield the ids (uint32 array) of each text of a list or Arrow array;
        null counts as empty."""
        arr = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        group = np.cumsum(pc.binary_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)) // self.group_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(arr)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            part = arr.slice(i, j - i)
            whole = pc.match_substring_regex(part, self.whole)
            easy = part.filter(pc.invert(whole))
            fast = iter(self._group(easy) if len(easy) else ())
            for t, w in zip(part, whole.to_pylist()):
                yield np.array(self._encode([t.as_py()])[0], np.uint32) if w else next(fast)
