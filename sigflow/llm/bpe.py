"""Byte-pair encoding by batched NumPy merge rounds, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.text import chunks, spread
from sigflow.llm.wordids import Pieces
from sigflow.session import ship

_SHIFT = np.int64(20)
#: Bytes of a word that is merged with the others, at most.
LONG = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merges:
    """Merge rules as sorted pair keys (left id << 20 | right id), with each key's rank and product."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << _SHIFT | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], np.arange(len(key))[order], made[order]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.rules: dict[int, tuple[int, int]] = {}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and the number of each word's ids. Words beyond LONG bytes are merged alone, through a heap."""
        size = np.array([len(w) for w in words], np.int64)
        alone = np.flatnonzero(size > LONG)
        if not len(alone):
            return self._rounds(words, size)
        ids, lens = self._rounds([b"" if n > LONG else w for w, n in zip(words, size.tolist())], np.where(size > LONG, 0, size))
        parts, at = [], 0
        ends = np.cumsum(lens)
        for k in alone.tolist():
            found = self._one(words[k])
            parts += [ids[at : ends[k]], found]
            at, lens[k] = int(ends[k]), len(found)
        return np.concatenate([*parts, ids[at:]]), lens

    def _one(self, word: bytes) -> np.ndarray:
        """Ids of one word: the lowest-ranked, leftmost pair first, in time near-linear in its length."""
        if not self.rules:
            self.rules = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        raw, n = np.frombuffer(word, np.uint8), len(word)
        sym = [*self.first[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rule[0], i, a, b, rule[1]) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (rule := self.rules.get(a << 20 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (rule := self.rules.get(sym[x] << 20 | sym[y])):
                    heapq.heappush(heap, (rule[0], x, sym[x], sym[y], rule[1]))
        return np.array([x for x in sym if x >= 0], np.uint32)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (the number of rules if there is none) and product of each pair."""
        key = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], len(self.key)), self.made[at]

    def _rounds(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All symbols lie in one flat array, each with the rank of the pair that it starts.

        A round finds each word's lowest rank and merges that pair wherever it stands in
        the word, from the left; the pairs that a merge makes are looked up by binary
        search. Words without a mergeable pair leave the array.
        """
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(size)
        sym[ends[size > 0] - 1] = self.last[raw[ends[size > 0] - 1]]
        word = np.repeat(np.arange(len(words)), size)
        none = len(self.key)
        rank, made = np.full(len(sym), none), np.zeros(len(sym), np.int64)
        at = np.flatnonzero(word[:-1] == word[1:])
        rank[at], made[at] = self._look_up(sym[at], sym[at + 1])
        done_sym, done_word = [], []
        while len(sym):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(sym))))
            live = best < none
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
            pick = np.flatnonzero(live & (rank == best))
            run = np.diff(pick, prepend=-2) > 1  # x x x: the first two merge
            place = np.arange(len(pick))
            pick = pick[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            sym[pick] = made[pick]
            live[pick + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[pick] = True
            fresh[np.maximum(pick - 1, 0)] = True
            sym, word, rank, made = sym[live], word[live], rank[live], made[live]
            at = np.flatnonzero(fresh[live])
            rank[at] = none
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at], made[at] = self._look_up(sym[at], sym[at + 1])
        sym, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word))
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(words))


_PIECE = regex.compile(r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class ByteBpe:
    """Encoder and decoder of a byte-level vocabulary file (``byte_bpe_50k.json``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.merges = Merges(vocab, spec["model"]["merges"])
        self.marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(sorted(map(regex.escape, self.marks), key=len, reverse=True)))
        value = {c: b for b, c in enumerate(byte_letters())}
        n = max([*vocab.values(), *self.marks.values()]) + 1
        raw: list[bytes] = [b""] * n
        for t, i in vocab.items():
            raw[i] = bytes(value[c] for c in t)
        for t, i in self.marks.items():
            raw[i] = t.encode()
        self.size = np.array([len(x) for x in raw], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.cache = Pieces(self._encode)

    def _encode(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        plain = [k for k, p in enumerate(pieces) if isinstance(p, str)]
        ids, lens = self.merges.encode([pieces[k].encode() for k in plain])
        if len(plain) == len(pieces):
            return ids, lens
        all_lens = np.ones(len(pieces), np.int64)
        all_lens[plain] = lens
        start = np.cumsum(all_lens) - all_lens
        out = np.zeros(int(all_lens.sum()), np.uint32)
        out[spread(start[plain], lens)] = ids
        for k in set(range(len(pieces))) - set(plain):
            out[start[k]] = pieces[k]
        return out, all_lens

    def pieces(self, text: str) -> list:
        if not (self.marks and any(m in text for m in self.marks)):
            return _PIECE.findall(text)
        found = self.cut.findall(text)
        first, *rest = self.cut.split(text)
        out: list = _PIECE.findall(first)
        for m, p in zip(found, rest):
            out.append(self.marks[m])
            out += _PIECE.findall(p)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of each text's ids."""
        pieces: list = []
        cut = [0]
        for t in texts:
            pieces += self.pieces(t)
            cut.append(len(pieces))
        ids, lens = self.cache.ids(pieces)
        sums = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(sums[cut])

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.size[ids]
        raw = self.bytes[spread(self.place[ids], size)].tobytes()
        sums = np.concatenate([[0], np.cumsum(size)])
        ends = sums[np.cumsum(lens)].tolist() if len(lens) else []
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends)]


_CODERS: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path)
    return _CODERS[path]


def _round_trip(path: str, keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = coder(path)
    for c in chunks(batches, 2 << 20):
        ids, lens = bpe.encode([c.text(k) for k in range(len(c))])
        texts = bpe.decode(ids, lens)
        ids = ids.astype("<u4")
        ends = np.cumsum(lens)
        runs = [ids[b - n : b] for b, n in zip(ends.tolist(), lens.tolist())]
        cols = [pa.array(c.ids), pa.array(lens.astype(np.int64)), pa.array([hashlib.sha256(r).hexdigest() for r in runs]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep:
            cols += [pa.array([r.astype(np.int64) for r in runs], pa.list_(pa.int64())), pa.array(texts)]
            names += ["ids", "decoded"]
        yield pa.record_batch(cols, names=names)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encode every text and decode it again; digests of both, and with ``keep`` the ids and the text.

    One narrow pass, no shuffle. Null and empty texts have no tokens. Rows with a
    null id are left out; repeated rows give one result each; an empty table gives
    an empty result. Other columns are not looked at. A special token's string in
    a text is that token, as in the tokenizers library.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_round_trip, tokenizer_path, keep), schema)
