"""A word-level BPE vocabulary of the tokenizers library over texts of any length.

Two ways to its ids, both exactly the library's:

* `spliced`: a huge text is encoded by the library in overlapping chunks with offsets, and two
  neighbours are spliced at a common boundary that is proven to be stable.
* `entries`: short texts are cut into units that no token crosses, and the library encodes each
  distinct unit once for a worker. The vocabulary's pre-tokeniser drops white space, so no token
  crosses it, and an ASCII letter next to ASCII punctuation (but the apostrophe of a contraction)
  is also always a boundary. Lower-casing A-Z first changes nothing, as the vocabulary lower-cases.
  Texts with `<|`, which may hold special strings, are not cut so.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from .bytesops import LOWER, SPACE, UnitTable, doc_starts

#: 0 white space, 1 ASCII letter, 2 ASCII punctuation that no contraction starts with, 3 the rest.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[97:123] = KIND[65:91] = 1
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2
_WHITE = " \t\n\r\x0b\x0c"


class WordBpe:
    _loaded: dict[str, WordBpe] = {}

    def __init__(self, vocab: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocab)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size()
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.table = UnitTable(self._encode, dtype=self.dtype)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: White space is dropped and parts what stands around it, but within these special strings.
        self.apart = self.whole("a b") == self.whole("a") + self.whole("b")
        self.spaced = [t for t in self.special if any(c.isspace() for c in t)]

    @classmethod
    def load(cls, vocab: str) -> WordBpe:
        """One for each worker process."""
        if vocab not in cls._loaded:
            cls._loaded[vocab] = cls(vocab)
        return cls._loaded[vocab]

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, each encoded whole."""
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, text: str, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and places (in the text) of the tokens of text[start : start + size]."""
        done = self.library.encode(text[start : start + size], add_special_tokens=False)
        return np.array(done.ids, np.int64), np.array([a for a, _ in done.offsets], np.int64) + start

    def _boundary(self, text: str, left: tuple, right: tuple, since: int) -> int | None:
        """A place where both chunks have a token that follows white space, and from which on both agree.

        Left of it the left chunk is right, as its end is far; right of it the right one. The
        last such place but the one nearest the left chunk's end, whose word may be cut there.
        """
        (ids, at), (others, there) = left, right
        common = np.intersect1d(at, there)
        common = [p for p in common.tolist() if p > since and text[p - 1] in _WHITE and not self._inside(text, p)]
        for p, last in zip(reversed(common[:-1]), reversed(common[1:]), strict=True):
            one = ids[(at >= p) & (at < last)]
            if np.array_equal(one, others[(there >= p) & (there < last)]):
                return p
        return None

    def _inside(self, text: str, place: int) -> bool:
        """Whether a special string that holds white space stands around the place."""
        return any(t in text[max(0, place - len(t) + 1) : place + len(t) - 1] for t in self.spaced)

    def spliced(self, text: str, chunk: int, overlap: int) -> Iterator[np.ndarray]:
        """The ids of a text, encoded in chunks of `chunk` characters that overlap by `overlap`.

        Where no stable boundary lies in an overlap, both chunks are encoded again with twice the
        overlap, at last to the text's end.
        """
        if not self.apart:
            yield np.array(self.whole(text), np.int64)
            return
        start, since, wide = 0, 0, overlap
        left = self._chunk(text, 0, chunk + wide)
        while start + chunk + wide < len(text):
            right = self._chunk(text, start + chunk, chunk + overlap)
            place = self._boundary(text, left, right, since)
            if place is None:
                wide *= 2
                left = self._chunk(text, start, chunk + wide)
                if wide > overlap + chunk:  # the neighbour must reach as far as the overlap
                    right = self._chunk(text, start + chunk, chunk + wide)
                    place = self._boundary(text, left, right, since)
                    if place is not None and start + chunk + wide < len(text):
                        yield left[0][(left[1] >= since) & (left[1] < place)]
                        start, since, left = start + chunk, place, right
                continue
            yield left[0][(left[1] >= since) & (left[1] < place)]
            start, since, left, wide = start + chunk, place, right, overlap
        yield left[0][left[1] >= since]

    def _encode(self, units: list[bytes]) -> tuple[list[list[int]], bool]:
        out: list[list[int]] = [[]] * len(units)
        texts = [u.decode() for u in units]
        # Latin letters alone, or ASCII punctuation alone, are one word to the library, so that
        # many can share a call: each ends with the one token that ends a word. (U+0130 lower-cases
        # to a letter and a mark.)
        single = [k for k, t in enumerate(texts) if (t.isalpha() and max(t) < "ɐ" and "İ" not in t) or (t.isascii() and (KIND[ord(t[0])] == 2) and all(KIND[ord(c)] == 2 for c in t))]
        blocks = [single[i : i + 512] for i in range(0, len(single), 512)]
        for block, done in zip(blocks, self.library.encode_batch_fast([" ".join(texts[k] for k in b) for b in blocks], add_special_tokens=False), strict=True):
            ids = done.ids
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            assert len(cuts) == len(block)
            a = 0
            for k, b in zip(block, cuts, strict=True):
                out[k], a = ids[a:b], b
        rest = sorted(set(range(len(units))).difference(single))
        for k, done in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = done.ids
        return out, True

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units; no unit crosses a row."""
        kind = KIND[data]
        inside = kind > 0
        first = doc_starts(len(data), offsets)
        cut = first[1:-1] | ~inside[:-1] | (kind[:-1] + kind[1:] == 3) & (kind[:-1] != 3) & (kind[1:] != 3)
        head = inside.copy()
        head[1:] &= cut
        tail = inside.copy()
        tail[:-1] &= cut | ~inside[1:]
        return np.flatnonzero(head), np.flatnonzero(tail) + 1

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.table.entries(LOWER[data], starts, ends)
