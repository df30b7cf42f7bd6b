"""Character n-gram linear classifier on naive-Bayes-scaled features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.graph import KeyFilter
from sigflow.llm.text import _BLANK, Chunk, chunks, lower_ascii, packed, release, row_chunks, unpacked
from sigflow.session import buckets, checkpoint, discard, ship

#: Hashed feature space, n-gram orders, features kept for the linear model, documents that must hold a kept feature.
BITS, ORDERS, KEPT, LEAST = 20, (3, 4, 5, 6), 16384, 5
#: Labelled rows of the linear fit, at most: those with the smallest hash of the id. Counts see all labelled rows.
MAX_ROWS = 12_000
#: Occurrences in 1,000 characters at which a feature has half its full value; weight of label 1 in the fit; L2 penalty.
HALF, POSITIVE, L2 = 4.0, 4.0, 1.0
THRESHOLD = 0.7
#: Bytes of text whose n-grams are held at once; some 250 bytes of arrays for each.
_CHUNK = 128 << 10
#: Slices of the feature space that a task's counts leave in.
_SLICES = 16
_FOLD = "crc32(cast(doc_id as string)) % 3 = 1"


def characters(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and each text's first (documents + 1). Letters A-Z count as a-z and every blank as a space."""
    data = np.where(_BLANK[c.data], 32, lower_ascii(c.data)).astype(np.uint8)
    off = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[c.off]
    point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return point, np.minimum(off, len(point))


def grams(point: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the hashed n-gram that starts at each character; -1 where it would leave its document."""
    n = len(point)
    room = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    h = np.zeros(n, np.uint32)
    for j in range(max(ORDERS)):
        h = h[: max(n - j, 0)]
        h = (h ^ point[j:]) * np.uint32((0x01000193 + 2 * j * 0x3D4D51) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        if (k := j + 1) in ORDERS:
            out = np.full(n, -1, np.int32)
            out[: len(h)] = ((h ^ np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int32)
            out[room < k] = -1
            yield out


def occurrences(c: Chunk, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, times) of all pairs that occur, and each text's characters; with ``slot`` only features that have one, renamed to it."""
    point, off = characters(c)
    doc = np.repeat(np.arange(len(c), dtype=np.int64), np.diff(off)) << 32
    keys = []
    for h in grams(point, off):
        if slot is not None:
            h = slot[h]  # -1 finds the last slot, which is always free
        ok = h >= 0
        keys.append(doc[ok] | h[ok])
    key = np.sort(np.concatenate(keys))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at] >> 32, key[at] & 0xFFFFFFFF, np.diff(np.append(at, len(key))), np.diff(off)


def values(doc: np.ndarray, times: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A feature's value in a text, between 0 and 1: its occurrences in 1,000 characters, dampened."""
    often = times * 1000.0 / np.maximum(size[doc], 1)
    return often / (often + HALF)


def _counts(n: int, batches):
    """(feature, documents and occurrences in class 0, the same in class 1) of the features that a task meets, packed by bucket, a range of features; feature -1 counts all."""
    total = np.zeros((4, 1 << BITS), np.int64)
    rows = np.zeros(4, np.int64)
    for b in batches:
        y = b.column(0).to_numpy()
        for c in row_chunks(b, 1, _CHUNK):
            label = y[c.ids]
            d, f, times, _ = occurrences(c)
            for k in (0, 1):
                ok = label[d] == k
                np.add.at(total[2 * k], f[ok], 1)
                np.add.at(total[2 * k + 1], f[ok], times[ok])
                rows[2 * k] += int((label == k).sum())
                rows[2 * k + 1] += int(times[ok].sum())
    if rows.any():
        yield packed(np.zeros(1, np.int64), n, np.array([-1], np.int32), *rows[:, None])
        for lo in range(0, 1 << BITS, (1 << BITS) // _SLICES):  # never a copy of all counts
            at = lo + np.flatnonzero(total[:, lo : lo + (1 << BITS) // _SLICES].any(0))
            if len(at):
                yield packed(at * n >> BITS, n, at.astype(np.int32), *(total[k][at] for k in range(4)))
    del total
    release()


def _sum(t: pa.Table) -> pa.Table:
    f, back = np.unique(unpacked(t, "p0", np.int32), return_inverse=True)
    sums = [np.bincount(back, unpacked(t, f"p{k + 1}", np.int64)).astype(np.int64) for k in range(4)]
    return pa.table([pa.array(f, pa.int32()), *map(pa.array, sums)], names=["f", "d0", "n0", "d1", "n1"])


def _rows(slot, batches):
    """Label, kept features and their values of each row, and (doc_id, hash of the text) to order the rows by."""
    for b in batches:
        for c in row_chunks(b, 1, _CHUNK):
            d, f, times, size = occurrences(c, slot)
            cut = np.searchsorted(d, np.arange(len(c) + 1)).tolist()
            x = values(d, times, size).astype(np.float16)
            f = f.astype(np.uint16)
            yield pa.record_batch([b.column(0).take(pa.array(c.ids)), pa.array([f[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([x[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()), *(b.column(k).take(pa.array(c.ids)) for k in (2, 3))], names=["y", "f", "x", "doc_id", "hash"])


def logistic(y: np.ndarray, row: np.ndarray, col: np.ndarray, x: np.ndarray, size: int, l2: float = L2, positive: float = POSITIVE, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression on sparse (row, column, value) features, by Adam on all rows; rows of label 1 count ``positive`` times.

    Sums run over slices of a million values, so that nothing as large as the features is made.
    """
    n = len(y)
    slices = [slice(lo, lo + (1 << 20)) for lo in range(0, len(x), 1 << 20)]
    w, b = np.zeros(size), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = sum((np.bincount(row[s], x[s] * w[col[s]], n) for s in slices), np.full(n, b))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = (p - y) * np.where(y > 0, positive, 1.0)
        gw = sum((np.bincount(col[s], x[s] * g[row[s]], size) for s in slices), l2 * w) / n
        gb = g.mean()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * min(1, 2 * (1 - t / (steps + 1)))
        w -= rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


class ToxicityModel:
    """Slot of each kept feature, weight of each slot (linear weight times log-count ratio), bias."""

    def __init__(self, slot: np.ndarray, weight: np.ndarray, bias: float):
        self.slot, self.weight, self.bias = slot, weight, bias

    def score(self, c: Chunk) -> np.ndarray:
        d, f, times, size = occurrences(c, self.slot)
        z = np.bincount(d, self.weight[f] * values(d, times, size), len(c)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_count_ratios(docs: np.ndarray, times: np.ndarray, rows: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each feature, and what it is worth keeping (0: not at all).

    ``docs`` and ``times`` are (2, features) documents and occurrences by class, ``rows``
    and ``total`` the same over all. Documents of the rarer class weigh as much as those
    of the other.
    """
    ratio = np.log((times[1] + 1) / (total[1] + 1)) - np.log((times[0] + 1) / (total[0] + 1))
    return ratio, np.abs(ratio) * np.sqrt(docs[1] + docs[0] * rows[1] / max(rows[0], 1)) * (docs.sum(0) >= LEAST)


def _labelled(keep, batches):
    for b in batches:
        yield b.filter(pa.array(keep.value.has_bits(b.column(2).to_numpy()))).select([0, 1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, fold: str | None = _FOLD) -> ToxicityModel:
    """Fit on the labelled rows outside the held-out ``fold`` (a SQL condition on doc_id).

    A bounded bitmap of the labelled ids goes to every task, so that only labelled
    texts are shuffled to their labels; they are written once. One pass counts, per
    class, the documents and occurrences of each hashed n-gram in all of them; the
    counts give the log-count ratios and the kept features. A second pass brings the
    kept features of at most ``max_rows`` rows to the driver for the linear fit.

    Labels other than 0 and 1, null ids and documents without a label teach nothing;
    of two labels of one id the larger counts, and it holds for every text of that id.
    Null and empty texts have no features. With one class only, no n-gram in enough
    documents, or an empty table, the score is the class rate. Other columns of either table are not looked at.
    """
    spark = ship(docs.sparkSession)
    y = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    if fold:
        y = y.where(f"not ({fold})")
    y = checkpoint(y)
    keep = spark.sparkContext.broadcast(KeyFilter(y, "doc_id", hashed=False))
    rows = _labelled_rows(docs, y, keep)
    try:
        return _fit(rows, max_rows)
    finally:
        discard(rows)
        discard(y)


def _labelled_rows(docs: DataFrame, y: DataFrame, keep) -> DataFrame:
    """(y, text, doc_id) of the documents with a label, written once."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    near = texts.withColumn("bit", F.shiftrightunsigned(F.xxhash64("doc_id"), 38)).mapInArrow(partial(_labelled, keep), "doc_id long, text string")
    return checkpoint(near.join(y, "doc_id").select("y", "text", "doc_id"))


def _kept_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and occurrences by class, the kept features' numbers, and their log-count ratios."""
    n = buckets(rows.sparkSession)
    counted = rows.select("y", "text").mapInArrow(partial(_counts, n), "bucket int, p0 binary, p1 binary, p2 binary, p3 binary, p4 binary").groupBy("bucket").applyInArrow(lambda t: _sum(t), "f int, d0 long, n0 long, d1 long, n1 long").toArrow()
    f, *columns = (counted.column(k).to_numpy() for k in range(5))
    whole = np.array([c[f < 0].sum() for c in columns])
    none = np.zeros(0, np.int64)
    if not (whole[0] and whole[2]):
        return whole, none, none.astype(float)
    ok = (f >= 0) & (f < (1 << BITS) - 1)  # the last slot stays free
    f, (d0, n0, d1, n1) = f[ok], (c[ok] for c in columns)
    order = np.argsort(f)
    f = f[order].astype(np.int64)
    ratio, worth = log_count_ratios(np.stack([d0, d1])[:, order], np.stack([n0, n1])[:, order], whole[[0, 2]], whole[[1, 3]])
    kept = np.argsort(-worth, kind="stable")[:KEPT]
    kept = kept[worth[kept] > 0]
    return whole, f[kept], ratio[kept]


def _fit(rows: DataFrame, max_rows: int) -> ToxicityModel:
    whole, kept, ratio = _kept_features(rows)
    slot = np.full(1 << BITS, -1, np.int32)
    if not len(kept):
        return ToxicityModel(slot, np.zeros(KEPT), float(np.log((whole[2] + 1) / (whole[0] + 1))))
    slot[kept] = np.arange(len(kept))
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    got = rows.join(F.broadcast(chosen), "doc_id").select("y", "text", "doc_id", F.xxhash64("text").alias("hash")).mapInArrow(partial(_rows, slot), "y int, f binary, x binary, doc_id long, hash long").toArrow()
    order = np.lexsort((got.column("hash").to_numpy(), got.column("doc_id").to_numpy()))  # sums of doubles depend on it, and tasks end in any order
    truth = got.column("y").to_numpy().astype(float)[order]
    feats, parts = ([np.frombuffer(x.as_buffer(), kind) for x in got.column(name)] for name, kind in (("f", np.uint16), ("x", np.float16)))
    feats, parts = [feats[k] for k in order], [parts[k] for k in order]
    row = np.repeat(np.arange(len(feats), dtype=np.int32), [len(f) for f in feats])
    col = np.concatenate(feats)
    x = np.concatenate(parts).astype(np.float32)
    del got, feats, parts
    x *= ratio.astype(np.float32)[col]
    w, b = logistic(truth, row, col, x, len(kept))
    return ToxicityModel(slot, np.append(w * ratio, 0.0), b)


def _score(model, threshold, batches):
    model = model.value
    for c in chunks(batches, _CHUNK):
        s = model.score(c)
        yield pa.record_batch([pa.array(c.ids), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document: one narrow pass over whole texts with the model (about 4 MB) broadcast.

    A null or empty text has no features and gets the score of the bias. Rows with
    a null id are left out; repeated rows and two texts of one id give one result
    each; a text may be of any length; an empty table gives an empty result. Only
    doc_id and text are looked at.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_score, shared, threshold), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with every column, whose text scores below the threshold; one narrow pass.

    Null and empty texts have the score of the bias. Rows with a null id are judged by
    their text as others are; repeated rows stay or go together. An empty table stays empty.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for c in row_chunks(b, at, _CHUNK):
                yield b.slice(int(c.ids[0]), len(c)).filter(pa.array(shared.value.score(c) < threshold))

    return docs.mapInArrow(run, docs.schema)
