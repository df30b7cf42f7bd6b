"""Repeated passages: windows of consecutive words that start at two places of the corpus or more.

Every window of ``length`` words holds a content-selected anchor: the smallest hashed
8-gram among its own. So two equal windows share an anchor at the same offset, and
only anchors whose hash occurs twice or more need a closer look. Around such an
anchor a *context* reaches as far as any window over it. Contexts are counted
(equal ones once), and a resolver says which windows of each context are repeated:
a suffix automaton of the anchor's contexts, or sparse suffix arrays.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.graph import KeyFilter
from sigflow.llm.text import _POW, Chunk, chunks, gram_hash, keyed_texts, mix, packed_stream, poly, rewrite, row_chunks, span_hash, tokens, unpacked
from sigflow.session import buckets as groups
from sigflow.session import checkpoint, discard, ship

GRAM = 8
#: An automaton takes at most so many distinct contexts (some 50 MB of states); the windows of larger groups are counted by hash, exactly.
AUTOMATON = 2048


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i:i+w] for every i, by doubling; near the end over what is left."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        out[: len(out) - step] = op(out[: len(out) - step], out[step:].copy())
        have += step
    return out


@dataclass
class Anchors:
    pos: np.ndarray  # word of the chunk at which the 8-gram starts
    doc: np.ndarray  # document of the chunk
    key: np.ndarray  # uint64 hash of the 8-gram
    word: np.ndarray  # uint64 hashes of all words
    first: np.ndarray  # first word of each document


def anchors(c: Chunk, length: int) -> Anchors:
    starts, ends, first = tokens(c)
    h = span_hash(c.data, starts, ends)
    g = gram_hash(h, GRAM)
    w = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return Anchors(none, none, none.astype(np.uint64), h, first)
    doc = np.repeat(np.arange(len(c)), np.diff(first))[: len(g)]
    whole = np.arange(len(g)) + length <= first[1:][doc]  # a window starts here
    low = np.where(whole, _slide(g, w, np.minimum), 0)
    best = _slide(low[::-1], w, np.maximum)[::-1]
    pos = np.flatnonzero((best == g) & (best > 0))
    return Anchors(pos, doc[pos], g[pos], h, first)


def _bounds(a: Anchors, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each anchor's context to the left, and from the anchor on."""
    return np.minimum(a.pos - a.first[a.doc], length - GRAM), np.minimum(a.first[a.doc + 1] - a.pos, length)


def _digest(a: Anchors, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(poly(a.word, a.pos - left, a.pos + right) + (left * 4096 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _contexts(a: Anchors, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """(anchors, 2 * length - 8) words as 64-bit hashes, odd ones; 0 outside the document."""
    at = np.arange(-(length - GRAM), length)[None, :]
    inside = (at >= -left[:, None]) & (at < right[:, None])
    idx = np.clip(a.pos[:, None] + at, 0, max(len(a.word) - 1, 0))
    return np.where(inside, a.word[idx] | np.uint64(1), np.uint64(0))


def _pick(a: Anchors, ok: np.ndarray) -> Anchors:
    return Anchors(a.pos[ok], a.doc[ok], a.key[ok], a.word, a.first)


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (key % np.uint64(n)).astype(np.int64)


def _send_keys(length: int, n: int, batches):
    def parts():
        for c in chunks(batches):
            key, count = np.unique(anchors(c, length).key, return_counts=True)
            yield _bucket(key, n), key, (count > 1).astype(np.uint8)

    return packed_stream(parts(), n)


def _repeated(t: pa.Table) -> pa.Table:
    key, more = unpacked(t, "p0", np.uint64), unpacked(t, "p1", np.uint8)
    value, at, count = np.unique(key, return_index=True, return_counts=True)
    again = np.zeros(len(value), bool)
    again[np.searchsorted(value, key[more > 0])] = True
    return pa.table({"h": pa.array(value[(count > 1) | again].view(np.int64))})


def _distinct(a: Anchors, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one anchor for each (key, context digest), and how often each occurs, up to two."""
    order = np.lexsort((d, a.key))
    k, ds = a.key[order], d[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (ds[1:] != ds[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(k)))
    return order[new], np.minimum(count, 2).astype(np.uint8)


def _send_digests(length: int, n: int, keep, batches):
    def parts():
        for c in chunks(batches):
            a = anchors(c, length)
            a = _pick(a, keep.value.has(a.key))
            d = _digest(a, *_bounds(a, length))
            at, count = _distinct(a, d)
            yield _bucket(a.key[at], n), a.key[at], d[at], count

    return packed_stream(parts(), n)


def _counted(t: pa.Table) -> pa.Table:
    """(h, c, twice, mixed): each distinct context, whether it occurs twice, whether its anchor has several."""
    k, d, n = unpacked(t, "p0", np.uint64), unpacked(t, "p1", np.uint64), unpacked(t, "p2", np.uint8)
    order = np.lexsort((d, k))
    k, d, n = k[order], d[order], n[order].astype(np.int64)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    total = np.add.reduceat(n, np.flatnonzero(new)) if len(k) else n
    k, d = k[new], d[new]
    _, back, many = np.unique(k, return_inverse=True, return_counts=True)
    mixed = many[back] > 1
    ok = mixed | (total > 1)
    return pa.table({"h": k[ok].view(np.int64), "c": d[ok].view(np.int64), "twice": total[ok] > 1, "mixed": mixed[ok]})


def _send_contexts(length: int, n: int, keep, batches):
    def parts():
        for c in chunks(batches):
            a = anchors(c, length)
            a = _pick(a, keep.value.has(a.key))
            left, right = _bounds(a, length)
            d = _digest(a, left, right)
            at, count = _distinct(a, d)
            for lo in range(0, len(at), 1 << 14):
                k = at[lo : lo + (1 << 14)]
                some = _pick(a, k)
                ctx = _contexts(some, left[k], right[k], length)
                yield _bucket(some.key, n), some.key, d[k], count[lo : lo + (1 << 14)], left[k].astype(np.uint8), right[k].astype(np.uint8), ctx.view(np.dtype((np.void, ctx.shape[1] * 8)))[:, 0]

    return packed_stream(parts(), n, 1 << 15)


def _resolve(length: int, resolver, t: pa.Table) -> pa.Table:
    """(h, c, mask): bit i of mask says that the window starting i words after the context's leftmost reach is repeated."""
    k, d, n = unpacked(t, "p0", np.uint64), unpacked(t, "p1", np.uint64), unpacked(t, "p2", np.uint8)
    left, right = unpacked(t, "p3", np.uint8), unpacked(t, "p4", np.uint8)
    ctx = unpacked(t, "p5", np.uint64).reshape(len(k), 2 * length - GRAM)
    order = np.lexsort((d, k))
    new = np.ones(len(k), bool)
    new[1:] = (k[order][1:] != k[order][:-1]) | (d[order][1:] != d[order][:-1])
    count = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new)) if len(k) else n.astype(np.int64)
    at = order[new]
    k, d, left, right, ctx = k[at], d[at], left[at].astype(np.int64), right[at].astype(np.int64), ctx[at]
    mask = resolver(k, ctx, count, left, right, length) if len(k) else np.zeros(0, np.uint64)
    ok = mask > 0
    return pa.table({"h": k[ok].view(np.int64), "c": d[ok].view(np.int64), "mask": mask[ok].view(np.int64)})


def _valid(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """(contexts, offsets): the window that starts ``offset`` words after the leftmost reach lies in its document."""
    off = np.arange(length - GRAM + 1)[None, :]
    reach = length - GRAM
    return (off >= reach - left[:, None]) & (off + length <= reach + right[:, None])


def _bits(rep: np.ndarray) -> np.ndarray:
    return (rep.astype(np.uint64) << np.arange(rep.shape[1], dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)


def by_suffix_array(k, ctx, count, left, right, length) -> np.ndarray:
    """Sparse suffix arrays of all contexts at hand, by one sort to the right of the anchors and one to the left.

    Neighbours' common lengths cut each order into classes that agree over r words;
    a window that reaches a words left and length - a words right is repeated if
    another context shares both of its classes.
    """
    m, reach = len(k), length - GRAM
    key = k.astype(">u8").view(np.uint8).reshape(m, 8)

    def classes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = np.concatenate([key, np.ascontiguousarray(words.astype(">u8")).view(np.uint8).reshape(m, -1)], 1)
        order = np.argsort(np.ascontiguousarray(raw).view(np.dtype(("S", raw.shape[1])))[:, 0], kind="stable")
        w, kk = words[order], k[order]
        same = w[1:] == w[:-1]
        lcp = np.where(kk[1:] == kk[:-1], np.where(same.all(1), w.shape[1], same.argmin(1)), -1)
        return order, lcp

    ro, rl = classes(ctx[:, reach:])
    lo, ll = classes(ctx[:, :reach][:, ::-1])
    ok = _valid(left, right, length)
    rep = np.zeros_like(ok)
    rc, lc = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for off in range(reach + 1):
        a = reach - off
        rc[ro] = np.concatenate([[0], np.cumsum(rl < length - a)])
        lc[lo] = np.concatenate([[0], np.cumsum(ll < a)])
        use = np.flatnonzero(ok[:, off])
        _, back = np.unique(rc[use] * m + lc[use], return_inverse=True)
        rep[use, off] = np.bincount(back, count[use])[back] > 1 if len(use) else False
    return _bits(rep)


def by_window_hash(ctx, count, left, right, length) -> np.ndarray:
    """Windows of the contexts of one anchor, counted by hash offset by offset."""
    ok = _valid(left, right, length)
    rep = np.zeros_like(ok)
    wide = mix(ctx.ravel()).reshape(ctx.shape)
    power = _POW[:length]
    for off in range(ok.shape[1]):
        use = np.flatnonzero(ok[:, off])
        if len(use):
            h = (wide[use, off : off + length] * power).sum(1, dtype=np.uint64)
            _, back = np.unique(h, return_inverse=True)
            rep[use, off] = np.bincount(back, count[use])[back] > 1
    return _bits(rep)


class SuffixAutomaton:
    """Suffix automaton of several sequences; ``seen`` counts, up to two, where each state's strings end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.seen = [-1], [0], [0]

    def add(self, word: list[int], weight: int) -> None:
        last = 0
        nxt, link, length, seen = self.next, self.link, self.len, self.seen
        for x in word:
            q = nxt[last].get(x)
            if q is not None and length[q] == length[last] + 1:
                last = q
            elif q is not None:
                last = self._clone(last, x, q)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                seen.append(0)
                p = last
                while p >= 0 and x not in nxt[p]:
                    nxt[p][x] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][x]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
                last = cur
            seen[last] += weight

    def _clone(self, p: int, x: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.seen.append(0)
        link[q] = new
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = new
            p = link[p]
        return new

    def close(self) -> None:
        """Sum counts up the suffix links, longest first."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.seen[self.link[s]] += self.seen[s]

    def repeated_ends(self, word: list[int]) -> list[int]:
        """Matching statistics against what occurs twice: for each position, the length of the longest suffix ending there that does."""
        out, s, n = [], 0, 0
        for x in word:
            while s and x not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if x in self.next[s]:
                s, n = self.next[s][x], n + 1
            while s and self.seen[s] < 2:
                s = self.link[s]
                n = self.len[s]
            out.append(n)
        return out


def by_automaton(k, ctx, count, left, right, length) -> np.ndarray:
    """For each anchor an automaton of its contexts, then each context streamed through it.

    A symbol is a word with its place relative to the anchor: what two anchors of one
    document both reach is one place of the corpus and must not count twice.
    """
    out = np.zeros(len(k), np.uint64)
    reach = length - GRAM
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    place = np.arange(ctx.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a > AUTOMATON:
            out[a:b] = by_window_hash(ctx[a:b], count[a:b], left[a:b], right[a:b], length)
            continue
        coded = mix((ctx[a:b] + place).ravel()).reshape(b - a, -1).view(np.int64)
        words = [row[reach - lo : reach + hi].tolist() for row, lo, hi in zip(coded, left[a:b].tolist(), right[a:b].tolist())]
        sam = SuffixAutomaton()
        for w, n in zip(words, count[a:b].tolist()):
            sam.add(w, n)
        sam.close()
        for i, w in enumerate(words, a):
            shift, bits = reach - int(left[i]), 0
            for e, n in enumerate(sam.repeated_ends(w)):
                if n >= length:
                    bits |= 1 << (shift + e + 1 - length)
            out[i] = bits
    return out


def _occurrences(length: int, keep, batches):
    for c in chunks(batches):
        a = anchors(c, length)
        a = _pick(a, keep.value.has(a.key))
        d = _digest(a, *_bounds(a, length))
        yield pa.record_batch([pa.array(a.key.view(np.int64)), pa.array(d.view(np.int64)), pa.array(c.ids[a.doc]), pa.array((a.pos - a.first[a.doc]).astype(np.int32))], names=["h", "c", "row", "pos"])


def gone_words(c: Chunk, pos: pa.Array, mask: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, first word of each row, and which words lie in a marked window."""
    reach = length - GRAM
    starts, ends, first = tokens(c)
    edge = np.zeros(len(starts) + 1, np.int64)
    for k in range(len(c)):
        if not pos[k].is_valid:
            continue
        p = pos[k].values.to_numpy().astype(np.int64)
        m = mask[k].values.to_numpy().view(np.uint64)
        on = (m[:, None] >> np.arange(reach + 1, dtype=np.uint64)[None, :]) & np.uint64(1) > 0
        at = np.unique((p[:, None] - reach + np.arange(reach + 1)[None, :])[on])
        at = at[(at >= 0) & (at < first[k + 1] - first[k])] + first[k]  # a place of another text under the same key marks nothing beyond this one
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + length, first[k + 1]), -1)
    return starts, ends, first, np.cumsum(edge)[:-1] > 0


def _remove(length: int, batches):
    for b in batches:
        for c in row_chunks(b, 1):
            at, rows = int(c.ids[0]), len(c)
            starts, ends, first, gone = gone_words(c, b.column(2).slice(at, rows), b.column(3).slice(at, rows), length)
            raw = c.data.tobytes()
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            kept, spans = [], []
            for k in range(rows):
                lo, hi = int(first[k]), int(first[k + 1])
                stay = np.flatnonzero(~gone[lo:hi]) + lo
                kept.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())])).hexdigest())
                flips = np.flatnonzero(np.diff(gone[lo:hi].astype(np.int8), prepend=0, append=0))
                spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(flips[::2], flips[1::2])])
            yield pa.record_batch([b.column(0).slice(at, rows), pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(kept)], names=["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])


def _kept_text(length: int, c: Chunk, pos: pa.Array, mask: pa.Array) -> list[bytes | None]:
    """Texts without the marked words: what stands between them as it was, joined by a space."""
    starts, ends, first, gone = gone_words(c, pos, mask, length)
    raw = c.data.tobytes()
    out: list[bytes | None] = []
    for k in range(len(c)):
        lo, hi = int(first[k]), int(first[k + 1])
        if c.null[k]:
            out.append(None)
        elif not gone[lo:hi].any():
            out.append(raw[c.off[k] : c.off[k + 1]])
        else:
            flips = np.flatnonzero(np.diff((~gone[lo:hi]).astype(np.int8), prepend=0, append=0)) + lo
            out.append(b" ".join([raw[starts[s] : ends[e - 1]] for s, e in zip(flips[::2].tolist(), flips[1::2].tolist())]))
    return out


def repeat_marks(docs: DataFrame, *, length: int, resolver=by_automaton, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(row, pos, mask) arrays: anchors of each text with repeated windows, and which windows over each; rows are named by ``row_key``."""
    if not GRAM < length <= GRAM + 63:
        raise ValueError("length must be 9 to 71")
    spark = ship(docs.sparkSession)
    buckets = buckets or groups(spark)
    texts = keyed_texts(docs, id_col, text_col).select("row", "text")
    share = spark.sparkContext.broadcast

    def dealt(f, n_cols: int) -> DataFrame:
        return texts.mapInArrow(f, "bucket int, " + ", ".join(f"p{i} binary" for i in range(n_cols))).groupBy("bucket")

    again = checkpoint(dealt(partial(_send_keys, length, buckets), 2).applyInArrow(_repeated, "h long"))
    seen = share(KeyFilter(again, "h"))
    counted = checkpoint(dealt(partial(_send_digests, length, buckets, seen), 3).applyInArrow(_counted, "h long, c long, twice boolean, mixed boolean"))
    mixed = share(KeyFilter(counted.where("mixed"), "h"))
    solved = dealt(partial(_send_contexts, length, buckets, mixed), 6).applyInArrow(lambda t: _resolve(length, resolver, t), "h long, c long, mask long")
    every = F.lit(-1).cast("long")  # all windows of a context that occurs twice; those outside the document are not there to remove
    marks = counted.where("twice and not mixed").select("h", "c", every.alias("mask")).union(solved.join(counted.where("mixed").select("h", "c"), ["h", "c"], "left_semi"))
    at = texts.mapInArrow(partial(_occurrences, length, seen), "h long, c long, row long, pos int").join(marks, ["h", "c"])
    out = checkpoint(at.groupBy("row").agg(F.collect_list(F.struct("pos", "mask")).alias("hits")).select("row", F.col("hits.pos").alias("pos"), F.col("hits.mask").alias("mask")))
    discard(again)
    discard(counted)
    return out


def remove_repeats(docs: DataFrame, *, length: int, resolver=by_automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the words that lie in a repeated window of ``length`` words.

    Returns (doc_id, n_words, n_removed, spans, kept_sha256), spans being the maximal
    removed runs as word positions. Both places of a repeat go, also within
    one document; windows are judged on the input.

    Null, empty and short texts have no window and stay whole. Rows with a null id
    are left out. Two texts under one id are two documents; a repeated row repeats
    all its windows. A text may be of any length. An empty table gives an empty
    result. Other columns are not looked at. ``length`` may be 9 to 71.
    """
    marks = repeat_marks(docs, length=length, resolver=resolver, id_col=id_col, text_col=text_col)
    rows = keyed_texts(docs, id_col, text_col).join(marks.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "pos", "mask")
    return rows.mapInArrow(partial(_remove, length), "doc_id long, n_words long, n_removed long, spans array<struct<start: long, length: long>>, kept_sha256 string")


def without_repeats(docs: DataFrame, *, length: int, resolver=by_automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every column, the texts rid of repeated passages.

    Null texts stay null; rows with a null id stay as they are and their windows
    count nowhere. A repeated row repeats all its windows, so nothing but its short
    rest is left. An empty table stays empty.
    """
    marks = repeat_marks(docs, length=length, resolver=resolver, id_col=id_col, text_col=text_col)
    return rewrite(docs, marks, lambda c, p, m: _kept_text(length, c, p, m), text_col, id_col)
