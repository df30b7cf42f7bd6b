"""Near-duplicate documents by MinHash, odd sketches and exact confirmation."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.graph import KeyFilter
from sigflow.llm.minhash import band_keys, class_gap, deal_sketches, key_lists, linked_components, odd_similarity, odd_sketch, signatures
from sigflow.llm.text import Chunk, binary_offsets, chunks, gram_hash, lower_ascii, mix, span_hash, tokens
from sigflow.session import buckets, checkpoint, discard, ship

#: 256 samples in 512 bits; bands of 3 from the first 60: a pair at 0.8 is missed by all 20 bands once in a million.
SAMPLES, SKETCH_BITS, BANDS, ROWS = 256, 512, 20, 3
#: Estimates have a deviation of 0.035 at 0.8: FLOOR, for a likely pair, is two of them below; LOW, below which no pair is looked at, nearly six.
FLOOR, LOW = 0.72, 0.6


def shingle_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each document, end to end, and where each document's begin (documents + 1)."""
    data = lower_ascii(c.data)
    starts, ends, first = tokens(c, data)
    h = span_hash(data, starts, ends)
    n = np.diff(first)
    grams = gram_hash(h, k)
    doc = np.repeat(np.arange(len(c)), n)[: len(grams)]
    inside = np.arange(len(grams)) + k <= first[1:][doc] if len(grams) else np.zeros(0, bool)
    values, owner = [grams[inside]], [doc[inside]]
    for m in range(1, k):
        few = np.flatnonzero(n == m)
        if len(few):  # the whole sequence is the only shingle
            at = first[few]
            v = np.full(len(few), m, np.uint64)
            for j in range(m):
                v = mix(v * np.uint64(31) + h[at + j])
            values.append(v)
            owner.append(few)
    value, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(c) + 1))


def _measure(k: int, batches):
    for c in chunks(batches):
        value, first = shingle_sets(c, k)
        n = np.diff(first)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(value), dtype=np.uint64)])
        other = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
        sig = signatures((value >> np.uint64(32)).astype(np.uint32), first[:-1], n, SAMPLES)
        keys, sketch = band_keys(sig, BANDS, ROWS), odd_sketch(sig, SKETCH_BITS)
        at = np.arange(len(c) + 1)
        yield pa.record_batch(
            [pa.array(c.ids), pa.array(n.astype(np.int64)), pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)), pa.array((other[first[1:]] - other[first[:-1]]).view(np.int64)), binary_offsets(at * BANDS, keys.ravel()), binary_offsets(at * (SKETCH_BITS // 8), sketch.ravel())],
            names=["doc_id", "n_shingles", "d1", "d2", "keys", "sketch"],
        )


def _sets(k: int, keep, batches):
    """Full sets of the documents that pass the filter (batch columns: id, text, filter bit)."""
    for b in batches:
        b = b.filter(pa.array(keep.value.has_bits(b.column(2).to_numpy())))
        for c in chunks([b.select([0, 1])]):
            value, first = shingle_sets(c, k)
            yield pa.record_batch([pa.array(c.ids), binary_offsets(first, value)], names=["id", "values"])


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    One pass over the texts leaves some 250 bytes a document: set size, a 128-bit
    digest of the set, band keys and odd sketch. Documents of equal sets form one
    class, counted by a combining aggregation; only class representatives enter the
    bands. Likely pairs are confirmed on the full sets, which a second pass makes for
    those documents alone.

    Null and empty texts have the empty set and stay alone. Rows with a null id are
    left out. Repeated rows of one id get one result each and the same component.
    An empty table gives an empty result. Other columns are not looked at.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpoint(texts.mapInArrow(partial(_measure, shingle), "doc_id long, n_shingles long, d1 long, d2 long, keys binary, sketch binary"))
    classes = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = checkpoint(classes)

    def sets_of(ids: DataFrame) -> DataFrame:
        keep = spark.sparkContext.broadcast(KeyFilter(ids, "id", hashed=False))
        marked = texts.where("doc_id is not null").select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id"), 38).alias("bit"))
        return marked.mapInArrow(partial(_sets, shingle, keep), "id long, values binary")

    n = buckets(spark)
    lists = key_lists(classes, class_gap(percent, 100), n)
    comp = linked_components(lists, lambda ids: classes.select("id", "sketch").mapInArrow(partial(deal_sketches, n), "bucket int, p1 binary, p3 binary"), sets_of, partial(odd_similarity, SAMPLES), FLOOR, LOW, num=percent, buckets=n)
    named = checkpoint(classes.select("d1", "d2", "id").join(comp, "id", "left").select("d1", "d2", F.coalesce("comp", "id").alias("component_id")))
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    alone = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    found = checkpoint(out.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id")))
    for done in (rows, classes, comp, named):
        discard(done)
    return found
