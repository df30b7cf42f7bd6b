"""Vectorised text kernels: Arrow string buffers in, NumPy arrays out.

A *chunk* is a run of documents whose texts lie one after another in one byte
array. Words are ``[^\\x20\\x09-\\x0D]+`` everywhere, on the UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once; bounds the memory of every kernel.
CHUNK_BYTES = 2 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    k, b = 1, base
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(b)
        k, b = k + m, b * b & _MASK
    return out


#: Polynomials are summed in sections of this many items, so their tables stay small however long a text is.
_SECTION = 1 << 16
_POW = _powers(_BASE, _SECTION)
_UNPOW = _powers(_UNBASE, _SECTION)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


@dataclass
class Chunk:
    ids: np.ndarray  # int64 per document
    null: np.ndarray  # bool per document: the text is null
    off: np.ndarray  # int64, documents + 1
    data: np.ndarray  # uint8

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, k: int) -> str:
        return self.data[self.off[k] : self.off[k + 1]].tobytes().decode("utf-8", "replace")


def _strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    null = col.is_null().to_numpy(zero_copy_only=False) if col.null_count else np.zeros(len(col), bool)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return null, off, data


def release() -> None:
    """Give freed memory back to the system, Arrow's and the C library's: a worker that waits for its next task keeps none of the last one's arrays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of (id, text) record batches. Rows with a null id are left out."""
    for b in batches:
        if not b.num_rows:
            continue
        if b.column(0).null_count:
            b = b.filter(b.column(0).is_valid())
            if not b.num_rows:
                continue
        ids = b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        null, off, data = _strings(b.column(1))
        k, n = 0, len(ids)
        while k < n:
            j = max(k + 1, int(np.searchsorted(off, off[k] + size, "right")) - 1)
            j = min(j, n)
            yield Chunk(ids[k:j], null[k:j], off[k : j + 1] - off[k], data[off[k] : off[j]])
            k = j
    release()


def tokens(c: Chunk, data: np.ndarray | None = None, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per document the number of its first word (documents + 1)."""
    data = c.data if data is None else data
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(c.off), np.int64)
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = c.off[1:-1]
    edge = edge[edge < n]
    first[edge] = word[edge]  # a document ends a word
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, c.off)


def poly(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start + i] * base**i for each span, by running sums inside sections; the few spans that cross sections are put together."""
    sums = np.empty(len(values), np.uint64)
    for lo in range(0, len(values), _SECTION):
        part = values[lo : lo + _SECTION]
        np.cumsum(part * _POW[: len(part)], out=sums[lo : lo + _SECTION])
    place = starts & (_SECTION - 1)

    def between(s, e, place):
        return (sums[e - 1] - np.where(place > 0, sums[np.maximum(s, 1) - 1], np.uint64(0))) * _UNPOW[place]

    out = between(starts, ends, place) if len(values) else np.zeros(len(starts), np.uint64)
    for k in np.flatnonzero((starts // _SECTION != (ends - 1) // _SECTION) | (ends <= starts)).tolist():
        total, at, e = 0, int(starts[k]), int(ends[k])
        while at < e:
            z = min(e, (at // _SECTION + 1) * _SECTION)
            total += int(between(np.array([at]), np.array([z]), np.array([at % _SECTION]))[0]) * pow(_BASE, at - int(starts[k]), 1 << 64)
            at = z
        out[k] = total & _MASK
    return out


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte values, then mixed."""
    return mix(poly(_BYTE[data], starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for every i (len(h) - k + 1 of them), put together from runs of doubling length."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, width = np.zeros(m, np.uint64), 0, h, 1
    while True:
        if k & width:
            out += part[done : done + m] * _POW[done]
            done += width
        if done == k:
            return mix(out)
        part = part[:-width] + part[width:] * _POW[width]
        width *= 2


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def of_document(first: np.ndarray, n: int) -> np.ndarray:
    """For n items, of which document d holds first[d]..first[d+1]-1: the document of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lens[0] of them, then the same for the next: indices of many runs."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def binary_offsets(cut: np.ndarray, payload: np.ndarray) -> pa.Array:
    """A binary column whose k-th value is the bytes of payload[cut[k]:cut[k+1]]."""
    raw = np.ascontiguousarray(payload)
    off = (np.asarray(cut, np.int64) * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw.tobytes())])


def packed(bucket: np.ndarray, n: int, *columns: np.ndarray) -> pa.RecordBatch | None:
    """Rows (bucket, one binary per column): the values of each bucket laid end to end."""
    if not len(bucket):
        return None
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")  # 16 bits: a radix sort
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    keep = np.flatnonzero(np.diff(cut))
    edges = np.append(cut[keep], len(bucket))
    return pa.record_batch([pa.array(keep.astype(np.int32)), *(binary_offsets(edges, c[order]) for c in columns)], names=["bucket", *(f"p{i}" for i in range(len(columns)))])


def packed_stream(parts, n: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``packed`` rows of (bucket, columns ...) parts, held back until they have ``limit`` values: rows stay large where buckets are many."""
    held, size = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size >= limit:
            yield packed(*_joined(held, n))
            held, size = [], 0
    if held:
        yield packed(*_joined(held, n))


def _joined(held: list[tuple], n: int) -> tuple:
    bucket, *columns = (np.concatenate(c) for c in zip(*held))
    return bucket, n, *columns


def unpacked(table: pa.Table, name: str, dtype) -> np.ndarray:
    """All values of a packed column."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in table.column(name) if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def row_chunks(batch: pa.RecordBatch, text: int, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of one batch whose ids are the row numbers; text is the number of the text column."""
    return chunks([pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(text)], names=["row", "text"])], size)


def row_key(id_col: str, text_col: str):
    """Names a row by its id and text, so that two texts under one id stay apart; rows equal in both are one."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text, doc_id) of the rows that have an id."""
    return docs.where(F.col(id_col).isNotNull()).select(row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))


def rewrite(docs: DataFrame, marks: DataFrame, new_text, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with texts changed by ``new_text(chunk, mark columns of its rows)``, a list of bytes or None for each row.

    ``marks`` has row (``row_key``) and further columns, one line a row at most; all other
    columns of ``docs`` pass through, whatever their names. Rows without a mark, those
    with a null id among them, get null marks.
    """
    others = [c for c in docs.columns if c != text_col]
    names = [c for c in marks.columns if c != "row"]
    row = F.struct(*(docs[c] for c in others)) if others else F.struct(F.lit(1).alias("none"))
    key = F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string")))
    marks = marks.select(F.col("row").alias("__key"), *(F.col(c).alias(f"__{c}") for c in names))
    bare = docs.select(row.alias("__row"), docs[text_col].cast("string").alias("__text"), key.alias("__of"))
    joined = bare.join(marks.hint("shuffle_hash"), bare["__of"] == marks["__key"], "left").select("__row", "__text", *(f"__{c}" for c in names))

    def run(batches):
        for b in batches:
            for c in row_chunks(b, 1):
                at, n = int(c.ids[0]), len(c)
                texts = new_text(c, *(b.column(2 + k).slice(at, n) for k in range(len(names))))
                yield pa.record_batch([b.column(0).slice(at, n), pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts], pa.string())], names=["__row", "__text"])

    out = joined.mapInArrow(run, T.StructType([joined.schema["__row"], T.StructField("__text", T.StringType())]))
    return out.select(*(F.col("__text").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns))
