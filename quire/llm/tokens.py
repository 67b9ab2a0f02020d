"""Whole-text encoding with a public tokenizer file.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the
ids of the parts are the ids of the whole. The cuts of many texts are found
together, each distinct part among them is looked up once, and a worker
remembers the ids of parts up to a bound.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

#: Bytes of remembered parts beyond which only the latest stay.
MEMO_BYTES = 64 << 20
#: Text bytes that are cut and looked up together.
ENCODE_BYTES = 16 << 20
#: A run of letters that NFC leaves alone, or of marks that start no contraction,
#: with the blank before it: for both tokenizer files exactly one pre-token.
_SIMPLE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+)")

#: Bits of a byte's class: the end of such a letter, such a mark, ASCII white
#: space, the end and the start of a character that is certainly no white space.
_LETTER, _MARK, _SPACE, _SOLID, _START = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SOLID | _START
_CLASS[0xC3:0xE0] = _START  # U+00C0 to U+07FF: two bytes
_CLASS[[*range(9, 14), 32]] = _SPACE
for _c in range(0x21, 0x7F):
    _CLASS[_c] |= _LETTER if chr(_c).isalpha() else 0 if chr(_c).isdigit() or chr(_c) == "'" else _MARK


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for U+0100 onwards in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


def _cuts(data: np.ndarray, spaced: bool) -> np.ndarray:
    """Marks of the places of UTF-8 bytes before which a part may start: white
    space after a solid character (any, where white space is dropped), a mark
    after a letter, and what follows a line end that is alone."""
    cut = np.zeros(len(data) + 1, bool)
    kind = _CLASS[data]
    second = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] < 0xE0)) + 1
    kind[second] |= _SOLID
    second = second[(data[second - 1] == 0xC3) & (data[second] != 0x97) & (data[second] != 0xB7)]
    kind[second] |= _LETTER
    space = np.flatnonzero(kind[1:] & _SPACE) + 1
    cut[space[(kind[space - 1] & _SOLID > 0) if spaced else (kind[space - 1] & _SPACE == 0)]] = True
    mark = np.flatnonzero(kind[1:] & _MARK) + 1
    cut[mark[kind[mark - 1] & _LETTER > 0]] = True
    line = np.flatnonzero(data[1:-1] == 10) + 1
    cut[line[(kind[line - 1] & _SOLID > 0) & (kind[line + 1] & _START > 0)] + 1] = True
    return cut


class Parts:
    """Parts of texts with their ids: those of part ``k`` are
    ``ids[ends[k]:ends[k + 1]]``. When all take more than MEMO_BYTES, those of
    the last call stay."""

    def __init__(self, tokenizer, lower: bool):
        self.tokenizer, self.lower = tokenizer, lower
        self.pieces = tokenizer.model.tokenize
        self.letters = byte_letters()
        self.keys, self.ids, self.ends = pa.array([], pa.binary()), np.empty(0, "<u4"), np.zeros(1, np.int64)
        self.last = np.empty(0, np.int64)

    def places(self, parts: pa.BinaryArray) -> np.ndarray:
        """Place of each of ``parts`` (distinct) among those remembered; new ones join them."""
        if self.keys.nbytes + self.ids.nbytes + self.ends.nbytes > MEMO_BYTES:
            first, size = self.ends[self.last], np.diff(self.ends)[self.last]
            self.ids, self.keys = gathered(self.ids, first, size), self.keys.take(pa.array(self.last))
            self.ends = np.concatenate([[0], np.cumsum(size)])
        place = pc.index_in(parts, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = parts.take(pa.array(new))
            flat, ends = array("I"), []
            for part in fresh.to_pylist():
                flat.extend(self.spelt(part.decode()))
                ends.append(len(flat))
            place[new] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, fresh])
            self.ends = np.concatenate([self.ends, len(self.ids) + np.array(ends)])
            self.ids = np.concatenate([self.ids, np.frombuffer(flat, "<u4")])
        self.last = place
        return place

    def spelt(self, part: str) -> list[int]:
        """Ids of one part. A pre-token goes to the model at once, in the byte
        alphabet, of which ASCII letters and marks stand for themselves."""
        if not (part.isascii() and part.lstrip(" ").isalpha() and part[1:].isalpha() or _SIMPLE.fullmatch(part)):
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        if self.lower:
            part = part.lstrip(" ").lower()
        if part.isascii():
            part = part.replace(" ", self.letters[32])
        else:
            part = "".join([self.letters[b] for b in part.encode()])
        return [t.id for t in self.pieces(part)]


def gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``values[first:first + size]`` in a row."""
    after = np.cumsum(size)
    kind = np.int32 if len(values) <= 1 << 30 and (not len(after) or after[-1] <= 1 << 30) else np.int64
    places = np.repeat((first - (after - size)).astype(kind), size)
    places += np.arange(len(places), dtype=kind)
    return values[places]


class Encoder:
    """``kind`` "words": lower case, white space dropped by the tokenizer;
    "spaced": a blank belongs to the word after it."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, self.spaced = Tokenizer.from_file(path), kind == "spaced"
        self.added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.parts = Parts(tokenizer, not self.spaced)

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def _lowered(self, whole: bytes) -> bytes:
        """ASCII letters in lower case, but those that NFC may join with what
        follows; nothing where that could make an added token."""
        low = whole.lower()
        if any(token in low for token in self.added):
            return whole
        old, new = np.frombuffer(whole, np.uint8), np.frombuffer(bytearray(low), np.uint8)
        kept = np.flatnonzero((old[1:] >= 0x80) & (old[1:] != 0xC3))
        new[kept] = old[kept]
        return new.tobytes()

    def encode_all(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and where each text's ids end."""
        whole = b"".join(texts)
        if not self.spaced:
            whole = self._lowered(whole)
        after = np.cumsum([len(t) for t in texts])
        cut = _cuts(np.frombuffer(whole, np.uint8), self.spaced)
        for token in self.added:  # is one id, wherever it stands
            at = whole.find(token)
            while at >= 0:
                cut[at + 1:at + len(token)] = False
                at = whole.find(token, at + 1)
        cut[0] = cut[after] = True
        at = np.flatnonzero(cut).astype(np.int32)
        del cut
        found = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(whole)]).dictionary_encode()
        which = self.parts.places(found.dictionary)[found.indices.to_numpy()]
        upto = np.searchsorted(at, after)
        first, size = self.parts.ends[which], np.diff(self.parts.ends)[which]
        ids = gathered(self.parts.ids, first, size)
        ends = np.concatenate([[0], np.cumsum(size)])[upto]
        if end_id is not None:
            ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(texts) + 1)
        return ids, ends


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for ``path``."""
    return worker_cache((path, kind), lambda: Encoder(path, kind))
