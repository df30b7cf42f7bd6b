"""Periodic runs of words: maximal stretches that repeat themselves with a short period, and texts with each run cut to one period."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.llm.text import Chunk, chunks, gram_hash, mix, span_hash, spread, tokens
from sigflow.session import ship

#: Pairs of places compared at once; bounds the memory of a search, however long a text is.
PAIRS = 1 << 18
#: Words put together at once when texts are written.
_WORDS = 1 << 17
_PRIMES = (2147483647, 2147483629)
_BASES = (1102983407, 1830427661)


class Stretches:
    """Equality of stretches of words by polynomials over two primes (62 bits), in constant time each."""

    def __init__(self, h: np.ndarray):
        self.power, self.sums = [], []
        for p, b in zip(_PRIMES, _BASES):
            power = np.ones(len(h) + 1, np.int64)
            done, step = 1, b
            while done < len(power):  # power[k] = b**k mod p, by doubling
                n = min(done, len(power) - done)
                power[done : done + n] = power[:n] * step % p
                done, step = done + n, step * step % p
            self.power.append(power)
            value = (h % np.uint64(p)).astype(np.int64)
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[:-1] % p) % p]))

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Are the n words from i on those from j on? Needs i <= j."""
        ok = np.ones(len(i), bool)
        for p, power, sums in zip(_PRIMES, self.power, self.sums):
            ok &= (sums[i + n] - sums[i]) % p * power[j - i] % p == (sums[j + n] - sums[j]) % p
        return ok

    def ahead(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from i on and from j on are the same, up to limit."""
        return self._longest(limit, lambda n: self.equal(i, j, n))

    def behind(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words before i and before j are the same, up to limit."""
        return self._longest(limit, lambda n: self.equal(i - n, j - n, n))

    @staticmethod
    def _longest(limit: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros(len(limit), np.int64), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = same(middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


def least_overlap(min_length: int, min_power: int) -> int:
    """Words that a run shares with itself, moved by its period, at least."""
    return min(max(min_length, min_power * q) - q for q in range(1, min_length + 1))


def segments(h: np.ndarray, first: np.ndarray, k: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of words, each inside one document, that k-grams found twice in their document cover.

    Hashes that agree by chance only make more of these.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(max(len(h) - k + 1, 0))
    at = at[at + k <= first[1:][doc[at]]]
    key = mix(gram_hash(h, k)[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = at[twice]
    depth = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + k, minlength=len(h) + 1)
    inside = np.cumsum(depth)[: len(h)] > 0
    edge = inside.copy()
    edge[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    low = np.flatnonzero(edge)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
    high = np.flatnonzero(last) + 1
    long = high - low >= shortest
    return low[long], high[long]


def _distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its least period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def find_runs(h: np.ndarray, low: np.ndarray, high: np.ndarray, min_length: int = 24, min_power: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, least period) of all maximal runs inside segments low..high of words h, sorted by start and end.

    Main and Lorentz: a run lies in one half of its segment or across the middle m.
    One across it with period q shows where the words from m on and from m+q on (or
    from m-q and m) are compared ahead and behind; halves are searched alike. All
    segments and all periods of a level are compared together, in slices of PAIRS.
    As the comparison goes on to the segment's ends, what is found is maximal. A
    multiple of a run's period finds the same stretch, so the least period is kept.
    """
    known = [(np.zeros(0, np.int64),) * 3]
    if not len(low):
        return known[0]
    # only the segments' words are kept, end to end
    size = high - low
    place = np.cumsum(size) - size
    words = Stretches(h[spread(low, size)])
    shift = low - place
    half = (least_overlap(min_length, min_power) + 1) // 2
    gram = gram_hash(h[spread(low, size)], half)
    a, b, seg = place.copy(), place + size, np.arange(len(low))
    seg_low, seg_high = place, place + size
    while len(a):
        middle, most = (a + b) // 2, (b - a) // min_power
        for m, s, q in _slices(middle, seg, most):
            for back in (False, True):
                i = m - q if back else m
                j = i + q
                ok = (i >= seg_low[s]) & (j <= seg_high[s])
                i, j, t, p = i[ok], j[ok], s[ok], q[ok]
                # a run shares half its least overlap on one side at least
                x, y = np.minimum(i, len(gram) - 1), np.minimum(j, len(gram) - 1)
                ok = (j + half <= seg_high[t]) & (gram[x] == gram[y])
                x, y = np.maximum(i - half, 0), np.maximum(j - half, 0)
                ok |= (i - half >= seg_low[t]) & (gram[np.minimum(x, len(gram) - 1)] == gram[np.minimum(y, len(gram) - 1)])
                i, j, t, p = i[ok], j[ok], t[ok], p[ok]
                if not len(i):
                    continue
                start = i - words.behind(i, j, i - seg_low[t])
                end = j + words.ahead(i, j, seg_high[t] - j)
                ok = end - start >= np.maximum(min_length, min_power * p)
                known.append(_distinct(start[ok] + shift[t[ok]], end[ok] + shift[t[ok]], p[ok]))
        a, b, seg = np.concatenate([a, middle]), np.concatenate([middle, b]), np.concatenate([seg, seg])
        ok = b - a >= min_length
        a, b, seg = a[ok], b[ok], seg[ok]
        known = [_distinct(*map(np.concatenate, zip(*known)))]
    return known[0]


def _slices(middle: np.ndarray, seg: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(middle, segment, period) of all periods 1..most, at most PAIRS at a time."""
    ends = np.cumsum(most)
    total = int(ends[-1])
    for lo in range(0, total, PAIRS):
        flat = np.arange(lo, min(lo + PAIRS, total))
        node = np.searchsorted(ends, flat, "right")
        yield middle[node], seg[node], flat - (ends[node] - most[node]) + 1


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by a space."""
    parts = []
    for k in range(0, len(starts), _WORDS):
        s, n = starts[k : k + _WORDS], ends[k : k + _WORDS] - starts[k : k + _WORDS] + 1
        raw = data[np.minimum(spread(s, n), len(data) - 1)]
        raw[np.cumsum(n) - 1] = 0x20
        parts.append(raw.tobytes())
    return b"".join(parts)[:-1]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _runs_of(c: Chunk, min_length: int, min_power: int) -> pa.RecordBatch:
    starts, ends, first = tokens(c)
    h = span_hash(c.data, starts, ends)
    low, high = segments(h, first, least_overlap(min_length, min_power), min_length)
    begin, end, period = find_runs(h, low, high, min_length, min_power)
    depth = np.bincount(begin + period, minlength=len(h) + 1) - np.bincount(end, minlength=len(h) + 1)
    kept = np.flatnonzero(np.cumsum(depth)[: len(h)] == 0)
    cut = np.searchsorted(kept, first)
    of = np.searchsorted(first, begin, "right") - 1
    order = np.lexsort((period, begin))
    begin, end, period, of = begin[order], end[order], period[order], of[order]
    edge = np.searchsorted(of, np.arange(len(c) + 1))
    runs, texts = [], []
    for k in range(len(c)):
        r = slice(int(edge[k]), int(edge[k + 1]))
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in zip((begin[r] - first[k]).tolist(), (end[r] - begin[r]).tolist(), period[r].tolist())])
        w = kept[cut[k] : cut[k + 1]]
        texts.append(_joined(c.data, starts[w], ends[w]).decode("utf-8", "replace"))
    return pa.record_batch([pa.array(c.ids), pa.array(np.diff(first).astype(np.int64)), pa.array(runs, _RUN), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def _find(min_length: int, min_power: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        yield _runs_of(c, min_length, min_power)


def periodic_runs(docs: DataFrame, *, min_length: int = 24, min_power: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the periodic runs of every whole text, and the text without what they repeat.

    A run is a stretch of words with least period q, at least ``min_length`` and
    ``min_power`` times q words long, that no neighbouring word extends. ``runs`` is sorted
    by start, then period. ``collapsed`` has the words that no run contains after its
    first q words, joined by one space. One narrow pass, no shuffle; memory grows
    with the longest single text only.

    Null, empty and short texts have no runs; null texts collapse to an empty one.
    Rows with a null id are left out; repeated rows give one result each; an empty
    table gives an empty result. Other columns are not looked at. ``min_power`` is 2
    at least. 64-bit hashes stand for words.
    """
    if min_power < 2 or min_length < 2:
        raise ValueError("min_power and min_length must be 2 or more")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_find, min_length, min_power), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length for its period, compared exactly; the first of equals, null if there is none."""
    none = "cast(null as struct<start: bigint, length: bigint, period: bigint>)"
    return F.aggregate(runs, F.expr(none), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the texts, chosen by id, repeat some words up to their end.

    With h = crc32(doc_id) and g = h div 10, texts with h % 10 = 0 keep a = g % n of their
    n words and go on with the next 1 + (n - a) div (3 + g % 8) words over and over.
    """
    words = F.expr(rf"filter(split(cast({text_col} as string), '[ \\t-\\r]+'), w -> w <> '')")
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    # each operand is bound once a row by an array of one element
    planted = F.transform(
        F.array(F.struct(words.alias("w"), F.floor(h / 10).cast("long").alias("g"))),
        lambda x: F.transform(
            F.array(F.struct(x["w"].alias("w"), (x["g"] % F.greatest(F.size(x["w"]), F.lit(1))).alias("a"), x["g"].alias("g"))),
            lambda y: F.transform(
                F.array(F.struct(y["w"].alias("w"), y["a"].alias("a"), (1 + F.floor((F.size(y["w"]) - y["a"]) / (3 + y["g"] % 8))).alias("p"))),
                lambda z: F.array_join(F.transform(z["w"], lambda word, i: F.when(i < z["a"], word).otherwise(F.get(z["w"], (z["a"] + (i - z["a"]) % z["p"]).cast("int")))), " "),
            )[0],
        )[0],
    )[0]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(h % 10 == 0, planted).otherwise(F.col(text_col).cast("string")).alias("text"))
