"""Word-level language identification with a linear-chain conditional random field."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.text import Chunk, chunks, lower_ascii, mix, row_chunks, span_hash, spread, tokens
from sigflow.session import ship

#: Size of the hashed weight table; words of a block, whose messages are passed on to the next; training documents at most, and segments and words taken from each.
BITS, BLOCK, MAX_DOCS, SEGMENTS, SEGMENT = 16, 64, 3000, 3, 32
_CHUNK = 512 << 10
#: A word enters the lexicon when the training segments hold it so often.
LEXICON_MIN = 3
_FOLD = "crc32(cast(doc_id as string)) % 3 = 1"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h.astype(np.uint64) + np.uint64(kind << 56)) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs: affixes of 1-4 characters, character 2- and 3-grams, length, and the word itself if the lexicon has it."""
    h = span_hash(data, starts, ends)
    size = ends - starts
    data = data[spread(starts, size)]  # the words, end to end, as characters
    heads = (data & 0xC0) != 0x80
    cut = np.concatenate([[0], np.cumsum(size)])
    at = np.concatenate([[0], np.cumsum(heads)])[cut]
    point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts, ends = np.minimum(at[:-1], len(point)), np.minimum(at[1:], len(point))
    n = ends - starts
    word, feat = [], []
    every = np.arange(len(starts))

    def code(at: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out = out * np.uint64(0x110000 + 7) + point[at + j]
        return out

    for k in range(1, 5):
        ok = every[n >= k]
        for kind, at in ((k, starts[ok]), (4 + k, ends[ok] - k)):
            word.append(ok)
            feat.append(_slot(code(at, k), kind))
    for k in (2, 3):
        size = np.maximum(n - k + 1, 0)
        word.append(np.repeat(every, size))
        feat.append(_slot(code(spread(starts, size), k), 8 + k))
    word.append(every)
    feat.append(_slot(np.minimum(n, 15), 12))
    known = np.isin(h, lexicon)
    word.append(every[known])
    feat.append(_slot(h[known], 13))
    return np.concatenate(word), np.concatenate(feat)


def block_layout(first: np.ndarray, limit: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length, and number within its document of each block: documents laid out in blocks of ``limit`` words."""
    n = np.diff(first)
    per = -(-n // limit)
    k = spread(np.zeros(len(n), np.int64), per)
    start = np.repeat(first[:-1], per) + k * limit
    return start, np.minimum(limit, np.repeat(first[1:], per) - start), k


def forward_backward(emission: np.ndarray, length: np.ndarray, trans: np.ndarray, begin: np.ndarray, into: np.ndarray | None = None, out_of: np.ndarray | None = None, opening: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior label marginals (chains, time, labels), expected transitions (labels, labels) and log partition of each chain.

    ``emission`` is (chains, time, labels); entries at and after a chain's length are
    ignored. A chain that is not ``opening`` goes on from the message ``into`` of the
    words before it, and each ends with the message ``out_of`` of those after it.
    """
    c, t, k = emission.shape
    top = emission.max(2, keepdims=True)
    e = np.exp(emission - top)
    on = np.arange(t)[None, :] < length[:, None]
    e[~on] = 1.0
    tr = np.exp(trans)
    alpha, beta = np.empty((t, c, k)), np.empty((t, c, k))
    log_z = np.where(on, top[:, :, 0], 0).sum(1)
    a = np.exp(begin) * e[:, 0] if into is None else np.where(opening[:, None], np.exp(begin), into @ tr) * e[:, 0]
    for i in range(t):
        if i:
            a = np.where(on[:, i, None], (a @ tr) * e[:, i], a)
        s = a.sum(1, keepdims=True)
        log_z += np.log(s[:, 0])
        a = a / s
        alpha[i] = a
    b = np.ones((c, k)) if out_of is None else out_of
    pair = np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        beta[i] = b
        if i:
            x = e[:, i] * b
            prev = np.where(on[:, i, None], x @ tr.T, b)
            joint_norm = np.where(on[:, i], 1 / np.maximum((alpha[i - 1] * prev).sum(1), 1e-300), 0.0)
            pair += tr * ((alpha[i - 1] * joint_norm[:, None]).T @ x)
            b = prev / prev.sum(1, keepdims=True)
    gamma = (alpha * beta).transpose(1, 0, 2)
    gamma /= gamma.sum(2, keepdims=True)
    return gamma * on[:, :, None], pair, log_z


def document_marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: np.ndarray, limit: int = BLOCK) -> np.ndarray:
    """Posterior label marginals of all words (words, labels), each document being one chain however long.

    Blocks are worked on side by side. What a block does to any message is a small
    matrix; these carry the messages from block to block, forward and backward, and
    every block is then finished with its own.
    """
    start, n, number = block_layout(first, limit)
    k = len(begin)
    emission = scores[np.minimum(start[:, None] + np.arange(limit)[None, :], len(scores) - 1)]
    into, out_of = np.ones((len(start), k)), np.ones((len(start), k))
    opening = number == 0
    last = np.append(opening[1:], True)
    if not opening.all():
        e, tr = np.exp(emission - emission.max(2, keepdims=True)), np.exp(trans)
        many = np.flatnonzero(~(opening & last))  # blocks of documents with several
        step = np.where(opening[many, None, None], np.exp(begin), tr) * e[many, 0][:, None, :]
        for i in range(1, limit):
            on = n[many] > i
            step[on] = (step[on] @ tr) * e[many[on], i][:, None, :]
            step /= step.sum((1, 2), keepdims=True)
        place = np.full(len(start), -1)
        place[many] = np.arange(len(many))
        for j in range(1, int(number.max()) + 1):
            at = np.flatnonzero(number == j)
            m = np.einsum("ci,cij->cj", into[at - 1], step[place[at - 1]])
            into[at] = m / m.sum(1, keepdims=True)
        for j in range(int(number.max()), 0, -1):
            at = np.flatnonzero(number == j)
            m = np.einsum("cij,cj->ci", step[place[at]], out_of[at])
            out_of[at - 1] = m / m.sum(1, keepdims=True)
    gamma, _, _ = forward_backward(emission, n, trans, begin, into, out_of, opening)
    return gamma[np.arange(limit)[None, :] < n[:, None]]


class Crf:
    def __init__(self, langs: list[str], weight: np.ndarray, trans: np.ndarray, begin: np.ndarray, lexicon: np.ndarray):
        self.langs, self.weight, self.trans, self.begin, self.lexicon = langs, weight, trans, begin, lexicon

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Emission scores (words, labels); equal words are scored once."""
        _, pick, back = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        w, f = word_features(data, starts[pick], ends[pick], self.lexicon)
        return np.stack([np.bincount(w, col[f], len(pick)) for col in self.weight.T], 1)[back]

    def label(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all words (words, labels), byte starts and ends of the words, and the documents' first words."""
        data = lower_ascii(c.data)
        starts, ends, first = tokens(c, data)
        if not len(starts):
            return np.zeros((0, len(self.langs))), starts, ends, first
        return document_marginals(self.word_scores(data, starts, ends), first, self.trans, self.begin), starts, ends, first

    def predict(self, c: Chunk) -> tuple[list[str], np.ndarray]:
        """Language of each document: the label with the most posterior mass over words that hold a letter."""
        if not self.langs:
            return ["und"] * len(c), np.zeros(len(c))
        gamma, starts, ends, first = self.label(c)
        letters = np.concatenate([[0], np.cumsum(_LETTER[c.data])])
        has = (letters[ends] > letters[starts]).astype(float)
        doc = np.repeat(np.arange(len(c)), np.diff(first))
        n = np.bincount(doc, has, len(c))
        mass = np.stack([np.bincount(doc, g * has, len(c)) for g in gamma.T], 1)
        best = mass.argmax(1)
        score = np.where(n > 0, mass[np.arange(len(c)), best] / np.maximum(n, 1), 0.0).clip(0, 1)
        ascii_ = np.concatenate([[0], np.cumsum(_LETTER[c.data] & (c.data < 128))])
        sure = ascii_[c.off[1:]] > ascii_[c.off[:-1]]
        named = [self.langs[b] if ok or any(map(str.isalpha, c.text(k))) else "und" for k, (b, ok) in enumerate(zip(best.tolist(), sure.tolist()))]
        return named, np.where(np.array(named) == "und", 0.0, score)


def train(segments: list[str], labels: list[str], *, epochs: int = 6, l2: float = 1e-4, seed: int = 7) -> Crf:
    """Fit by Adagrad on the log likelihood of label chains.

    Each chain joins two segments, half of them of different languages, so that the
    transitions are learned from switches as well as from stays.
    """
    langs = sorted(set(labels))
    k = len(langs)
    zero = np.zeros(0, np.uint64)
    if k == 0:
        return Crf([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)), np.zeros(0), zero)
    raw = [s.encode() for s in segments]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = lower_ascii(np.frombuffer(b"".join(raw), np.uint8))
    starts, ends, first = tokens(Chunk(np.arange(len(raw)), np.zeros(len(raw), bool), off, data))
    h = span_hash(data, starts, ends)
    value, seen = np.unique(h, return_counts=True)
    lexicon = value[seen >= LEXICON_MIN]
    w, f = word_features(data, starts, ends, lexicon)
    order = np.argsort(w, kind="stable")
    w, f = w[order], f[order]
    cut = np.searchsorted(w, np.arange(len(starts) + 1))
    y_doc = np.searchsorted(langs, labels)
    rng = np.random.default_rng(seed)
    weight, trans, begin = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)
    past = [np.full_like(x, 1e-2) for x in (weight, trans, begin)]
    usable = np.flatnonzero(np.diff(first) > 0)
    for _ in range(epochs):
        mixed = rng.permutation(usable)
        half = len(mixed) // 2
        same = np.concatenate([rng.permutation(half)[: 2 * (half // 2)], np.arange(half, len(mixed))]) if half else np.arange(len(mixed))
        turn = mixed[same]
        by_lang = turn[np.argsort(y_doc[turn[: len(turn) // 2]], kind="stable")] if len(turn) > 3 else turn
        turn = np.concatenate([by_lang, turn[len(turn) // 2 :]]) if len(turn) > 3 else turn
        pairs = turn[: len(turn) // 2 * 2].reshape(-1, 2) if len(turn) > 1 else turn.reshape(-1, 1)
        pairs = pairs[rng.permutation(len(pairs))]
        for at in range(0, len(pairs), 200):
            batch = pairs[at : at + 200]
            size = np.diff(first)[batch]
            word = spread(first[batch].ravel(), size.ravel())
            n = size.sum(1)
            t = int(n.max())
            y = np.repeat(y_doc[batch].ravel(), size.ravel())
            here = np.arange(t)[None, :] < n[:, None]
            fl = cut[word + 1] - cut[word]
            feats, of = f[spread(cut[word], fl)], np.repeat(np.arange(len(word)), fl)
            emission = np.zeros((len(batch), t, k))
            emission[here] = np.stack([np.bincount(of, col[feats], len(word)) for col in weight.T], 1)
            gamma, pair, _ = forward_backward(emission, n, trans, begin)
            gold = np.zeros((len(word), k))
            gold[np.arange(len(word)), y] = 1
            diff = gamma[here] - gold
            line = np.zeros((len(batch), t), np.int64)
            line[here] = y
            follow = here[:, 1:]
            gold_pair = np.bincount(line[:, :-1][follow] * k + line[:, 1:][follow], minlength=k * k).reshape(k, k)
            grads = (
                np.stack([np.bincount(feats, d[of], 1 << BITS) for d in diff.T], 1) / len(batch) + l2 * weight,
                (pair - gold_pair) / len(batch) + l2 * trans,
                (gamma[:, 0].sum(0) - np.bincount(line[:, 0], minlength=k)) / len(batch) + l2 * begin,
            )
            for x, g, p in zip((weight, trans, begin), grads, past):
                p += g * g
                x -= 0.3 * g / np.sqrt(p)
    return Crf(langs, weight.astype(np.float32), trans, begin, lexicon)


def _segments(segments: int, words: int, batches):
    """Evenly spaced runs of words of each sampled document."""
    for b in batches:
        langs = b.column(0)
        for c in row_chunks(b, 1):
            out: list[tuple[str, str]] = []
            starts, ends, first = tokens(c)
            raw = c.data.tobytes()
            for k, row in enumerate(c.ids.tolist()):
                a, z = int(first[k]), int(first[k + 1])
                for s in sorted({a + (z - a - words) * j // max(segments - 1, 1) if z - a > words else a for j in range(segments)}):
                    e = min(s + words, z)
                    if e > s:
                        out.append((langs[row].as_py(), raw[starts[s] : ends[e - 1]].decode("utf-8", "replace")))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["lang", "text"])


def fit_langid(docs: DataFrame, *, max_docs: int = MAX_DOCS, segments: int = SEGMENTS, words: int = SEGMENT, fold: str | None = _FOLD) -> Crf:
    """Fit on a bounded sample: ``segments`` runs of ``words`` words, spread evenly over the text, of at most ``max_docs`` documents.

    The documents are those with a language, outside the held-out ``fold`` (a SQL
    condition on doc_id), with the smallest hash of the id. Rows with a null id, text or
    lang teach nothing; two languages of one id are two documents. With no such row, or
    an empty table, the model knows no language. Other columns are not looked at.
    """
    ship(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where("doc_id is not null and lang is not null").distinct()
    if fold:
        ids = ids.where(f"not ({fold})")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")
    got = sorted((r.lang, r.text) for r in rows.mapInArrow(partial(_segments, segments, words), "lang string, text string").collect())
    return train([t for _, t in got], [y for y, _ in got])


def _predict(model, batches):
    for c in chunks(batches, _CHUNK):
        lang, score = model.value.predict(c)
        yield pa.record_batch([pa.array(c.ids), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])


def predict_language(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, lang_pred, score) of every document: one narrow pass over whole texts with the model (about 2 MB) broadcast.

    ``score`` is the mean posterior of the predicted language over the words that
    hold a letter. Texts that are null or hold no letter get ``und`` and 0, as all do
    when nothing could be learned. Of languages with equal mass the first by name is
    predicted. A text is one chain however long it is. Rows with a null id are left
    out; repeated rows give one result each; an empty table gives an empty result.
    Only doc_id and text are looked at.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_predict, shared), "doc_id long, lang_pred string, score double")


def _words(model, batches):
    for c in chunks(batches, _CHUNK):
        gamma, starts, ends, first = model.value.label(c)
        doc = np.repeat(np.arange(len(c)), np.diff(first))
        best = gamma.argmax(1) if gamma.size else np.zeros(len(starts), int)
        yield pa.record_batch([pa.array(c.ids[doc]), pa.array(np.arange(len(starts)) - first[doc]), pa.array([model.value.langs[i] for i in best] if gamma.size else ["und"] * len(starts), pa.string()), pa.array(gamma.max(1) if gamma.size else np.zeros(len(starts)))], names=["doc_id", "word", "lang", "posterior"])


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, word, lang, posterior) of every word: the chain's labels themselves, for code-switched text.

    Null and empty texts have no word; rows with a null id are left out; repeated rows
    give their words again; an empty table gives an empty result. A text is one chain
    however long it is; of equal posteriors the first language by name is taken.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_words, shared), "doc_id long, word long, lang string, posterior double")
