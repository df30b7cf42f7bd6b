"""Token ids of whole texts through a bounded cache of pre-tokenised pieces.

Both byte-pair vocabularies cut a text into pieces before any merge, and merges
never cross a piece; so the ids of a text are the ids of its pieces in turn. A
piece met before costs one dictionary look-up.
"""

from __future__ import annotations

import json
import unicodedata
from functools import partial

import numpy as np
import regex

from sigflow.llm.text import spread

#: Pieces remembered by one worker; when it is full, others are encoded wherever they occur, and it starts anew if those become many.
CACHE = 400_000


class Pieces:
    """Piece -> ids, kept as one flat array. ``encode(pieces)`` gives (flat ids, lengths) of unknown ones."""

    def __init__(self, encode, limit: int = CACHE):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, pieces: list, keep: bool) -> dict:
        """Put unknown pieces behind the known ones; unless they are kept, the next ones take their place."""
        ids, lens = self.encode(pieces)
        n, k = len(self.index), len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + k > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[n : n + k] = lens
        self.start[n : n + k] = self.used + np.cumsum(lens) - lens
        if not keep:
            return dict(zip(pieces, range(n, n + k)))
        self.used += len(ids)
        self.index.update(zip(pieces, range(n, n + k)))
        return self.index

    def ids(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and the number of each piece's ids."""
        got = list(map(self.index.get, pieces))
        if None in got:
            missed = [k for k, i in enumerate(got) if i is None]
            if len(self.index) > self.limit and 4 * len(missed) > len(got):  # other text than before
                self.clear()
                return self.ids(pieces)
            found = self._add(list(dict.fromkeys([pieces[k] for k in missed])), len(self.index) <= self.limit)
            for k in missed:
                got[k] = found[pieces[k]]
        at = np.array(got, np.int64)
        lens = self.length[at]
        return self.flat[spread(self.start[at], lens)], lens


_PIECE = regex.compile(r"\p{L}+|\p{N}|'s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+")


def _lower(text: str) -> str:
    if "Σ" in text:  # lower-cased letter by letter, so never a final sigma
        return "σ".join(p.lower() for p in text.split("Σ"))
    return text.lower()


class WordBpe:
    """Ids of ``word_bpe_49k.json``: unknown words are merged in batches, the cache has the others.

    White space is dropped and no piece crosses it, so words between ASCII blanks
    are the cached unit. A mark such as ``<|endoftext|>`` is cached under its id.
    """

    def __init__(self, path: str):
        from sigflow.llm.bpe import Merges

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.mark = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.mark)))
        self.cache = Pieces(partial(self._encode, self.merges))  # not of self: the last user's end frees it all

    @staticmethod
    def _encode(merges, words: list[bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        found = [[] if isinstance(w, int) else _PIECE.findall(w.decode()) for w in words]
        pieces = [p for x in found for p in x]
        number = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        flat, lens = merges.encode([p.encode() for p in number])
        at = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        flat, lens = flat[spread((np.cumsum(lens) - lens)[at], lens[at])], lens[at]
        count = np.array([len(x) for x in found], np.int64)
        sums = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(count)
        size = sums[ends] - sums[ends - count]
        marks = [k for k, w in enumerate(words) if isinstance(w, int)]
        if not marks:
            return flat, size
        size[marks] = 1
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        plain = np.ones(len(out), bool)
        plain[start[marks]] = False
        out[plain] = flat
        out[start[marks]] = [words[k] for k in marks]
        return out, size

    def words(self, text: str) -> list[bytes | int]:
        if "<|" in text and (found := self.cut.findall(text)):
            first, *rest = self.cut.split(text)
            out = self._plain(first)
            for m, p in zip(found, rest):
                out.append(self.mark[m])
                out += self._plain(p)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[bytes | int]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return _lower(text).encode().split()

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of each text's ids."""
        words: list[bytes | int] = []
        cut = [0]
        for t in texts:
            words += self.words(t)
            cut.append(len(words))
        ids, lens = self.cache.ids(words)
        sums = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(sums[cut])
