"""Token counts under a byte-pair vocabulary with scores, by rank-synchronous array merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.text import chunks
from sigflow.session import ship

_SHIFT = np.int64(20)
#: Characters of a pre-token that is merged with the others, at most; longer ones go through a heap alone.
LONG = 256
#: Counts of pre-tokens remembered by one worker; when they are more, it starts anew.
CACHE = 400_000
BLANK = "▁"


def _byte_length(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


class PieceCounter:
    """Numbers of tokens that a sentencepiece BPE model with byte fallback makes of texts.

    The vocabulary's pieces are symbols, and so is every character in them. Two
    neighbours merge if their concatenation is a piece; its score gives the rank.
    Characters without a piece end as their bytes. No piece has a blank behind
    another character or crosses a character that only stands alone, so a text falls
    into pre-tokens that no merge connects, and each is counted once.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  a ") != f"{BLANK}ﬁ{BLANK * 2}a{BLANK}":
            raise ValueError("texts of this model are normalised; only those taken as they are can be counted")
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(map(model.is_unused, ids)):
            raise ValueError("models with unused pieces are not supported")
        pieces = [model.id_to_piece(i) for i in ids]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece of this model goes on after a blank")
        _, level = np.unique([-model.get_score(i) for i in ids], return_inverse=True)
        number = {p: k for k, p in enumerate(pieces)}
        weight = [1] * len(pieces)
        joined = {c for p in pieces if len(p) > 1 for c in p}
        for c in sorted(joined - set(number)):
            number[c] = len(weight)
            weight.append(len(c.encode()))
        code = np.arange(0x110000)
        self.symbol = (len(weight) - 1 + _byte_length(code)).astype(np.int32)  # four symbols that merge with nothing
        self.weight = np.array([*weight, 1, 2, 3, 4], np.int64)
        for c, k in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = k
        rules = {}
        for k, p in enumerate(pieces):
            for cut in range(1, len(p)):
                a, b = number.get(p[:cut]), number.get(p[cut:])
                if a is not None and b is not None:
                    rules[a << 20 | b] = (int(level[k]), k)
        self.rules = rules
        self.key = np.array(sorted(rules), np.int64)
        self.rank, self.made = (np.array([rules[k][j] for k in self.key.tolist()], np.int64) for j in (0, 1))
        self.none = int(level.max(initial=0)) + 1
        inside = "".join(map(re.escape, sorted(joined - {BLANK})))
        self.cut = re.compile(f"{BLANK}*[{inside}]+|{BLANK}+|[^{inside}{BLANK}]" if inside else f"{BLANK}+|[^{BLANK}]")
        self.seen: dict[str, int] = {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``none`` if they do not merge) and product of each pair, by binary search."""
        if not len(self.key):
            return np.full(len(left), self.none), np.zeros(len(left), np.int64)
        key = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], self.none), self.made[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        alone = np.flatnonzero(size > LONG)
        short = [w if len(w) <= LONG else "" for w in words] if len(alone) else words
        out, redo = self._rounds(short, np.where(size > LONG, 0, size))
        for k in [*alone.tolist(), *redo.tolist()]:
            out[k] = self._one(words[k])
        return out

    def _rounds(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word, and the numbers of words whose merges would depend on their order.

        All symbols lie in one ragged array, each with the rank of the pair that it
        starts. A round applies each word's lowest rank at every place where it
        stands, but for places that touch one before them: those wait. One merge
        at a time, leftmost first, gives the same unless a merge makes a pair of its
        own rank or below while the word has other places of that rank. Such words
        (in the models at hand long runs of blanks, and a few others) are named and
        merged one pair at a time.
        """
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), size)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        before = np.full(len(words), -1)
        redo = np.zeros(len(words), bool)
        rank, made = np.full(len(sym), self.none), np.zeros(len(sym), np.int64)
        at = np.flatnonzero(word[:-1] == word[1:])
        rank[at], made[at] = self._look_up(sym[at], sym[at + 1])
        while len(sym):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(heads, len(sym)))
            lowest = np.minimum.reduceat(rank, heads)
            best = np.repeat(lowest, size)
            live = best < self.none
            if not live.all():
                ended.append((word[~live], sym[~live]))
            hits = live & (rank == best)
            of = word[heads]
            several = np.repeat((np.add.reduceat(hits, heads, dtype=np.int64) > 1) | (before[of] == lowest), size)
            before[of] = lowest
            at = np.flatnonzero(hits)
            pick = at[(np.diff(at, prepend=-9) > 2) | (np.diff(word[at], prepend=-1) > 0)]
            sym[pick] = made[pick]
            live[pick + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[pick] = True
            fresh[np.maximum(pick - 1, 0)] = True
            sym, word, rank, made, best, several = sym[live], word[live], rank[live], made[live], best[live], several[live]
            at = np.flatnonzero(fresh[live])
            rank[at] = self.none
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at], made[at] = self._look_up(sym[at], sym[at + 1])
            turned = at[(rank[at] <= best[at]) & several[at]]
            if len(turned):
                redo[word[turned]] = True
                stay = ~redo[word]
                sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
        of, last = map(np.concatenate, zip(*ended)) if ended else (np.zeros(0, np.int64),) * 2
        return np.bincount(of, self.weight[last], len(words)).astype(np.int64), np.flatnonzero(redo)

    def _one(self, word: str) -> int:
        """Tokens of one pre-token: best score first, then leftmost, in time near-linear in its length."""
        sym = self.symbol[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rule[0], i, a, b, rule[1]) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (rule := self.rules.get(a << 20 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], right[i] = made, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (rule := self.rules.get(sym[x] << 20 | sym[y])):
                    heapq.heappush(heap, (rule[0], x, sym[x], sym[y], rule[1]))
        return int(self.weight[[x for x in sym if x >= 0]].sum())

    def tokens(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        words: list[str] = []
        cut = [0]
        for t in texts:
            if t:
                words += self.cut.findall(BLANK + t.replace(" ", BLANK))
            cut.append(len(words))
        got = list(map(self.seen.get, words))
        if None in got:
            new = list(dict.fromkeys([w for w, n in zip(words, got) if n is None]))
            found = dict(zip(new, self.counts(new).tolist()))
            got = [found[w] if n is None else n for w, n in zip(words, got)]
            if len(self.seen) + len(found) > CACHE:
                self.seen.clear()
            self.seen.update(found if len(found) <= CACHE else {})
        sums = np.concatenate([[0], np.cumsum(np.array(got, np.int64))])
        return np.diff(sums[cut])


_COUNTERS: dict[str, PieceCounter] = {}


def _count(path: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    for c in chunks(batches):
        n = _COUNTERS[path].tokens([c.text(k) for k in range(len(c))])
        yield pa.record_batch([pa.array(c.ids), pa.array(np.diff(c.off)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens are more than ``limit``.

    One narrow pass, no shuffle. Null and empty texts have no bytes and no tokens.
    Strings such as ``</s>`` in a text are ordinary text. Rows with a null id are left
    out; repeated rows give one result each; a text may be of any length; an empty
    table gives an empty result. Other columns are not looked at.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_count, model_path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
