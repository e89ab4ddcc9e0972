"""Token ids of whole texts for vocabularies that drop white space and end words by a mark.

In such a vocabulary no token crosses white space, so the ids of a text are those of its
space-separated pieces one after the other.  Pieces repeat, and a worker keeps the ids of the
pieces it has met; only new ones are encoded.  Ids equal the tokenizer's for the whole text.
Many texts at once (``documents``) are split and their pieces made distinct by Arrow, so that each
distinct piece is looked up once; new pieces that the tokenizer has to encode go to it together.
"""

from __future__ import annotations

import os
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

VOCABULARY = "word_bpe_49k.json"
END = 1  # appended to every document
ID_TYPE = np.dtype("<u2")  # ids of vocabularies below 65,536 entries
AT_ONCE = 1 << 22  # bytes of text whose pieces are made distinct together
TOGETHER = 4096  # new pieces that are encoded together
KEPT = 600_000  # pieces a worker keeps before it starts anew; a bound on memory only
WORDS_KEPT = 150_000  # the same of words, which only new pieces look up

GAP = np.iinfo(ID_TYPE).max  # between the ids of pieces encoded together; no id

# fixed values: the word pattern of the vocabulary, for lowered plain pieces, with lines apart
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\n]+|\n")
# plain: printable ASCII and the letters of Latin-1, which are composed and lowered one by one
_NOT_PLAIN = re.compile(r"[^\n\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]")
# the byte-level spelling of those letters in lower case: a sign for each byte of their UTF-8
_SPELLED = {
    c: "".join(chr(b + 162 if b < 0xA1 else 323 if b == 0xAD else b) for b in chr(c).encode()) for c in range(0xDF, 0x100)
}
# white space at which Python splits and the tokenizer may not
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_ARROW = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Pieces(dict):
    """Piece -> its ids as bytes."""

    def __init__(self, encode, most: int | None = None):
        super().__init__()
        self.encode, self.most = encode, most or KEPT

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


def _packed(ids: list[int]) -> bytes:
    packed = array("H", ids)  # an error for an id beyond ID_TYPE
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class WordEncoder:
    """``encode(text)``: the ids of a text, as an array of ID_TYPE."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > GAP:
            raise ValueError("the vocabulary has more ids than ID_TYPE can hold")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.model = self.tokenizer.model
        self.words = _Pieces(self._word, WORDS_KEPT)
        self.pieces = _Pieces(self._piece)

    def _word(self, word: str) -> bytes:
        if word == "\n":
            return _packed([GAP])
        if not word.isascii():
            word = word.translate(_SPELLED)
        return _packed([t.id for t in self.model.tokenize(word)])

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if _NOT_PLAIN.search(piece) or self.special.search(piece):
            return self._whole(piece)
        return b"".join(map(self.words.__getitem__, _PLAIN_WORDS.findall(piece.lower())))

    def raw(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), ID_TYPE)

    def document(self, text: str | None, end: int = END) -> np.ndarray:
        """The ids of a document (null: none), then ``end``."""
        return np.frombuffer(self.raw(text) + struct.pack("<H", end), ID_TYPE)

    def _meet(self, pieces: list[str]) -> None:
        """Encode those of some pieces that are new, together."""
        kept = self.pieces
        for at in range(0, len(pieces), TOGETHER):
            plain, odd = [x for x in pieces[at : at + TOGETHER] if x not in kept], []
            if len(kept) + len(plain) > KEPT:
                kept.clear()
            joined = "\n".join(plain)
            if _NOT_PLAIN.search(joined):
                odd = [x for x in plain if _NOT_PLAIN.search(x)]
                plain = [x for x in plain if not _NOT_PLAIN.search(x)]
                joined = "\n".join(plain)
            if plain and not self.special.search(joined):
                raw = b"".join(map(self.words.__getitem__, _PLAIN_WORDS.findall(joined.lower())))
                gaps = np.flatnonzero(np.frombuffer(raw, ID_TYPE) == GAP) * ID_TYPE.itemsize
                starts = [0, *(gaps + ID_TYPE.itemsize).tolist()]
                kept.update((x, raw[i:j]) for x, i, j in zip(plain, starts, [*gaps.tolist(), len(raw)]))
            for x, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else ()):
                kept[x] = _packed(found.ids)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without odd white space, one after the other, and how many each has."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        self._meet(pieces)
        each = list(map(self.pieces.__getitem__, pieces))
        known = np.frombuffer(b"".join(each), ID_TYPE)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // ID_TYPE.itemsize
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        # narrow places where they suffice: their arrays are as long as the ids
        place = np.int32 if len(known) + n.sum() < 1 << 31 else np.int64
        shift = ((np.cumsum(sizes) - sizes)[at] - (ends - n)).astype(place)
        ids = known.take(np.repeat(shift, n) + np.arange(len(shift) and ends[-1], dtype=place))
        ends = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(split).to_numpy())]
        return ids, np.diff(ends, prepend=0)

    def documents(self, texts: pa.Array, end: int = END) -> Iterator[np.ndarray]:
        """``document`` of every text; memory holds the ids of AT_ONCE bytes of text, or of one longer text."""
        texts = pc.fill_null(texts, "")
        last = np.array([end], ID_TYPE)
        part = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // AT_ONCE
        cuts = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(texts)]])
        for at, to in zip(cuts, cuts[1:]):
            some = texts.slice(at, to - at)
            odd = pc.match_substring_regex(some, _ODD_ARROW).to_numpy(zero_copy_only=False)
            ids, sizes = self._plain(some.filter(pa.array(~odd)))
            rest = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            for i, is_odd in enumerate(odd.tolist()):
                yield self.document(some[i].as_py(), end) if is_odd else np.concatenate([next(rest), last])


@cache
def word_encoder(path: str | None = None) -> WordEncoder:
    """One encoder a worker process; ``path`` is a file that all workers have."""
    return WordEncoder(path or public_tokenizers.path(VOCABULARY))
