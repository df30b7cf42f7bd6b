"""MinHash signatures, odd sketches, and exact links found through bands.

Items have a long id, band keys and a sketch. Items that share a band key form a
list. Lists are sieved by sketches inside tasks: members that no chain of similar
pairs connects are parted, and a most similar spanning tree of each part names
likely pairs, never all pairs. Likely pairs are confirmed on the full sets. A second
round compares, on the full sets and inside tasks, the members of a sieved list that
still lie in different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigflow.llm.graph import components
from sigflow.llm.text import distinct, mix, packed, packed_stream, unpacked
from sigflow.session import checkpoint, discard

#: Bytes hashed at once by one sample, and the height of a column at most.
_BLOCK, _HIGH = 1 << 18, 48
#: Bands whose lists give likely pairs; all bands count in the second round.
EARLY = 4
#: Lists up to SMALL are sieved together, pair by pair; larger ones grow a tree each. Lists beyond LARGE are cut to blocks, every two of which are a list.
SMALL, LARGE = 64, 4096
#: Items of a block in the exact second round; up to FEW pairs an item are compared one by one, more by a matrix.
BLOCK, FEW = 256, 4
#: Bits by which pairs of sets are told apart before they are compared.
MARKS = 512
#: Other lists by which an item of a large list meets again those that it has not met, before the rest meets by its rarest values.
FINER = 6
#: The table that orders values by how many sets hold them has 2**CELL_BITS cells of a byte, 8 MB, however many values there are; in slices of 2**SLICE_BITS.
CELL_BITS, SLICE_BITS = 23, 15


def coefficients(k: int, dtype=np.uint32) -> np.ndarray:
    """Distinct odd multipliers; each permutes the odd values of the type. Those of the second half are the negatives of the first, so they order the values the other way round."""
    bits = 8 * np.dtype(dtype).itemsize
    a = (np.random.default_rng(97).choice(1 << (bits - 2), k - k // 2, replace=False).astype(np.uint64) * np.uint64(2) + np.uint64(1)).astype(dtype)
    return np.concatenate([a, np.negative(a[: k // 2])])


def signatures(v: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """(items, k) MinHash values of the sets v[start:start+size], v being hashed values of 16 or 32 bits; an empty set has all ones.

    Sets of like size are laid out together, each as some columns of up to _HIGH values (its
    last value repeats), so that the minima run down many columns at a time. One product
    gives two samples: its least value, and its greatest, which is the least under the
    negative multiplier. In a pair of sets the two agree no more often together than
    independent ones would; they lie half the samples apart, so no band has both.
    """
    v = v | v.dtype.type(1)
    half = k - k // 2
    a = coefficients(k, v.dtype)[:half]
    out = np.full((k, len(sizes)), np.iinfo(v.dtype).max, v.dtype)
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    at = int(np.searchsorted(n, 1))
    while at < len(n):
        z = min(int(np.searchsorted(n, n[at] + n[at] // 4 + 4, "right")), at + max(1, _BLOCK // v.itemsize // int(n[at])))
        columns = -(-int(n[z - 1]) // _HIGH)
        high = -(-int(n[z - 1]) // columns)
        place = np.arange(high)[:, None, None] + np.arange(columns)[None, :, None] * high
        part = v[starts[order[at:z]] + np.minimum(place, n[at:z] - 1)].reshape(high, -1)
        buf, low = np.empty_like(part), np.empty((k, part.shape[1]), v.dtype)
        for j in range(half):
            np.multiply(part, a[j], out=buf)
            np.minimum.reduce(buf, axis=0, out=low[j])
            if half + j < k:
                np.maximum.reduce(buf, axis=0, out=low[half + j])
        np.negative(low[half:], out=low[half:])
        out[:, order[at:z]] = low.reshape(k, columns, z - at).min(1)
        at = z
    return out.T


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(items, bands) 64-bit keys of the first bands * rows values."""
    key = np.zeros((len(sig), bands), np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :]
    for r in range(rows):
        key = mix((key + sig[:, r : bands * rows : rows].astype(np.uint64)).ravel()).reshape(key.shape)
    return key


def odd_sketch(sig: np.ndarray, bits: int) -> np.ndarray:
    """(items, bits / 8) bytes: the parity of how many MinHash samples fall on each bit."""
    n, k = sig.shape
    place = (mix((sig.astype(np.uint64) << np.uint64(10) | np.arange(k, dtype=np.uint64)).ravel()) % np.uint64(bits)).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(n), k) * bits + place, minlength=n * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(n, bits), axis=1)


def odd_similarity(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity along the last axis, from the set bits of the XOR of two odd sketches of k samples."""
    n = x.shape[-1] * 8
    ones = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1], np.int32)
    x, y = np.ascontiguousarray(x).view(np.uint64), np.ascontiguousarray(y).view(np.uint64)
    for w in range(x.shape[-1]):
        ones += np.bitwise_count(x[..., w] ^ y[..., w])
    different = -n / 2 * np.log(np.maximum(1 - 2 * ones / n, 1e-9))
    return 1 - different / (2 * k)


def byte_matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal MinHash bytes along the last axis (a multiple of 8, up to 248), corrected for equal bytes of different values."""
    eights = (x == y).view(np.uint64).sum(-1, dtype=np.uint64)  # a count in each byte
    same = (eights * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.float32)
    return (same / x.shape[-1] - 1 / 256) / (1 - 1 / 256)


def bit_pairs(sig: np.ndarray) -> np.ndarray:
    """(items, samples / 4) bytes of (items, samples) MinHash values: the first bit of each sample's hash, then the second of each."""
    k = sig.shape[1]
    h = (sig.astype(np.uint32) + np.arange(1, k + 1, dtype=np.uint32) * np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return np.concatenate([np.packbits(h >> np.uint32(31), axis=1), np.packbits(h >> np.uint32(30) & np.uint32(1), axis=1)], axis=1)


def pair_matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal ``bit_pairs`` (a multiple of 64 samples) along the last axis, corrected for equal bits of different values."""
    half = x.shape[-1] // 16
    apart = np.ascontiguousarray(x).view(np.uint64) ^ np.ascontiguousarray(y).view(np.uint64)
    different = np.bitwise_count(apart[..., :half] | apart[..., half:]).sum(-1, dtype=np.uint16)
    return 1 - different.astype(np.float32) / (x.shape[-1] * 4) / 0.75


def _find(up: list[int] | dict[int, int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def size_class(n: np.ndarray) -> np.ndarray:
    """Size of a set in steps of an eighth of its logarithm: seven bits."""
    return np.minimum(8 * np.log(np.maximum(n, 1)), 127).astype(np.uint8)


def class_gap(num: int, den: int) -> int:
    """Sets further apart than so many size classes have a similarity below num / den, whatever they hold."""
    return int(8 * np.log(den / num)) + 1 if num else 127


def dealt_keys(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Parts for ``packed_stream`` of (items, bands) keys: bucket, 32 bits of the key, id, and size class with a bit for early bands."""
    bands = keys.shape[1]
    flat = keys.ravel()
    size = np.repeat(size_class(sizes), bands) | np.tile((np.arange(bands) < EARLY).astype(np.uint8) << 7, len(ids))
    return ((flat >> np.uint64(32)) % np.uint64(n)).astype(np.int64), flat.astype(np.uint32), np.repeat(ids, bands), size


def named_parts(part: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For members grouped by ``part`` (sorted numbers from 0), the name of each one's part: a hash of its ids."""
    if not len(ids):
        return np.zeros(0, np.int64)
    weight, at = mix(ids.view(np.uint64)), np.flatnonzero(np.diff(part, prepend=-1))
    name = np.bitwise_xor.reduceat(weight, at) ^ mix(np.add.reduceat(weight, at))
    return name[part].view(np.int64)


def bucket_lists(gap: int, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, early, id) of every key of a bucket that two or more items share.

    A list is cut where the next larger set is more than ``gap`` size classes away: no
    link crosses the cut, if the sizes are those of sets.
    """
    line = np.sort(key)
    again = distinct(line[1:][line[1:] == line[:-1]])
    if not len(again):
        return ids[:0], np.zeros(0, bool), ids[:0]
    cells = np.zeros(1 << CELL_BITS, bool)  # leaves few keys to look for
    cells[again & np.uint32(len(cells) - 1)] = True
    ok = np.flatnonzero(cells[key & np.uint32(len(cells) - 1)])
    ok = ok[again[np.minimum(np.searchsorted(again, key[ok]), len(again) - 1)] == key[ok]]
    key, ids, early, size = key[ok], ids[ok], size[ok] > 127, (size[ok] & 127).astype(np.int16)
    order = np.lexsort((ids, size, key))
    key, ids, early, size = key[order], ids[order], early[order], size[order]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (size[1:] - size[:-1] > gap)
    new = head.copy()
    new[1:] |= ids[1:] != ids[:-1]
    head, ids, early = head[new], ids[new], early[new]
    part = np.cumsum(head) - 1
    ok = np.bincount(part)[part] > 1
    ids, early, part = ids[ok], early[ok], part[ok]
    part = np.cumsum(np.diff(part, prepend=-1) > 0) - 1
    return named_parts(part, ids), early, ids


_PACKED = "p0 binary, p1 binary, p2 binary, p3 binary"
#: Members with sketches that one task holds back.
_HELD = 1 << 18


def _members(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, id, early) of packed members."""
    return unpacked(t, "p0", np.int64), unpacked(t, "p1", np.int64), unpacked(t, "p2", np.bool_)


def hash_bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def void_rows(x: np.ndarray) -> np.ndarray:
    """Each row of bytes as one value."""
    return np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1])))[:, 0]


def _deal_members(n: int, batches) -> Iterator[pa.RecordBatch]:
    """Packed members, dealt by their lists."""

    def parts():
        for b in batches:
            for k in range(b.num_rows):
                which, ids, early = _members(b.slice(k, 1))
                yield hash_bucket(which, n), which, ids, early

    yield from packed_stream(parts(), n)


def _unique(t: pa.Table) -> pa.Table:
    which, ids, early = _members(t)
    order = np.lexsort((~early, ids, which))
    which, ids, early = which[order], ids[order], early[order]
    new = np.ones(len(ids), bool)
    new[1:] = (which[1:] != which[:-1]) | (ids[1:] != ids[:-1])
    which, ids, early = which[new], ids[new], early[new]
    size = np.diff(np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]]))) if len(which) else np.zeros(0, np.int64)
    return pa.table({"list": pa.array(which), "early": pa.array(early), "id": pa.array(ids), "n": pa.array(np.repeat(size, size), pa.int64())})


def unique_lists(members: DataFrame, buckets: int) -> DataFrame:
    """(list, early, id, n), each member of a list once and the list's size, from packed rows (p0 lists, p1 ids, p2 early); a list that several keys gave is one, early if any was."""
    dealt = members.select("p0", "p1", "p2").mapInArrow(partial(_deal_members, buckets), "bucket int, p0 binary, p1 binary, p2 binary")
    return dealt.groupBy("bucket").applyInArrow(_unique, "list long, early boolean, id long, n long")


def _deal_ids(n: int, batches) -> Iterator[pa.RecordBatch]:
    """Members (list, early, id), dealt by their ids."""
    rows = ((b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()) for b in batches if b.num_rows)
    yield from packed_stream(((hash_bucket(ids, n), which, ids, early) for which, early, ids in rows), n)


def deal_sketches(n: int, batches) -> Iterator[pa.RecordBatch]:
    """Packed sketches (bucket, p1 ids, p3 sketches) from rows (id, sketch), dealt by their ids."""

    def parts():
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                yield hash_bucket(ids, n), ids, void_rows(np.frombuffer(b"".join(x.as_buffer() for x in b.column(1)), np.uint8).reshape(len(ids), -1))

    for b in packed_stream(parts(), n, _HELD):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2)], names=["bucket", "p1", "p3"])


def _attach(t: pa.Table) -> pa.Table:
    """The packed members of a bucket with their sketches, from members (p0 lists) and sketches (p0 null) of the same ids."""
    known, asked = t.filter(t.column("p0").is_null()), t.filter(t.column("p0").is_valid())
    which, ids, early = _members(asked)
    have = unpacked(known, "p1", np.int64)
    if not (len(ids) and len(have)):
        return t.slice(0, 0).drop_columns("bucket")
    sketch, order = unpacked(known, "p3", np.uint8).reshape(len(have), -1), np.argsort(have)
    at = order[np.minimum(np.searchsorted(have, ids, sorter=order), len(have) - 1)]
    ok = have[at] == ids
    return pa.table({f"p{k}": pa.array([x[ok].tobytes()], pa.binary()) for k, x in enumerate((which, ids, early, sketch[at]))})


def _deal_sketched(n: int, batches) -> Iterator[pa.RecordBatch]:
    def parts():
        for b in batches:
            for k in range(b.num_rows):
                which, ids, early = _members(row := b.slice(k, 1))
                if len(ids):
                    yield hash_bucket(which, n), which, ids, early, void_rows(unpacked(row, "p3", np.uint8).reshape(len(ids), -1))

    yield from packed_stream(parts(), n, _HELD)


def with_sketches(lists: DataFrame, sketches: DataFrame, buckets: int) -> DataFrame:
    """Packed members (bucket, p0 lists, p1 ids, p2 early, p3 sketches), dealt by list, of rows (list, early, id) and packed sketches dealt by id."""
    dealt = lists.select("list", "early", "id").mapInArrow(partial(_deal_ids, buckets), "bucket int, p0 binary, p1 binary, p2 binary")
    null = F.lit(None).cast("binary")
    both = dealt.withColumn("p3", null).union(sketches.select("bucket", null.alias("p0"), "p1", null.alias("p2"), "p3"))
    return both.groupBy("bucket").applyInArrow(_attach, _PACKED).mapInArrow(partial(_deal_sketched, buckets), f"bucket int, {_PACKED}")


def _tree(sketch: np.ndarray, similar, low: float) -> tuple[np.ndarray, np.ndarray]:
    """(parent, similarity) of each item in a most similar spanning forest of the pairs at or above ``low``; a root is its own parent. Grown item by item, in linear space."""
    n = len(sketch)
    best, parent = np.full(n, -np.inf, np.float32), np.arange(n)
    left = np.arange(n)
    while len(left):
        k = int(best[left].argmax())
        at = left[k]
        if best[at] < low:
            best[at], parent[at] = -np.inf, at
        left = np.delete(left, k)
        est = similar(sketch[at], sketch[left]).astype(np.float32)
        closer = est > best[left]
        best[left[closer]], parent[left[closer]] = est[closer], at
    return parent, best


_SIEVED = pa.schema([("link", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def _sieve(similar, floor: float, low: float, t: pa.Table) -> pa.Table:
    """``sieved`` for rows (list, early, id, sketch)."""
    ids = t.column("id").to_numpy()
    sketch = np.frombuffer(b"".join(x.as_buffer() for x in t.column("sketch").combine_chunks()), np.uint8).reshape(len(ids), -1)
    return sieved(similar, floor, low, t.column("list").to_numpy(), ids, t.column("early").to_numpy(), sketch)


def _sieve_packed(similar, floor: float, low: float, t: pa.Table) -> pa.Table:
    """``sieved`` for the packed rows of ``with_sketches``."""
    which, ids, early = _members(t)
    return sieved(similar, floor, low, which, ids, early, unpacked(t, "p3", np.uint8).reshape(len(ids), -1) if len(ids) else np.zeros((0, 8), np.uint8))


def sieved(similar, floor: float, low: float, which: np.ndarray, ids: np.ndarray, early: np.ndarray, sketch: np.ndarray) -> pa.Table:
    """Likely pairs (link, a, b) of early lists, and the parts of all lists (not link, part, id) that pairs at or above ``low`` connect.

    ``low`` is so far below the threshold that a link stays in one part with all but certainty.
    """
    order = np.lexsort((ids, which))
    which, ids, early, sketch = which[order], ids[order], early[order], sketch[order]
    cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]])) if len(ids) else np.zeros(1, np.int64)
    n = np.diff(cut)
    left, right, value = [], [], []
    for k in np.flatnonzero(n > SMALL).tolist():
        a, b = int(cut[k]), int(cut[k + 1])
        parent, est = _tree(sketch[a:b], similar, low)
        at = np.flatnonzero(parent != np.arange(b - a))
        left.append(a + np.minimum(at, parent[at]))
        right.append(a + np.maximum(at, parent[at]))
        value.append(est[at])
    end = np.where(np.repeat(n > SMALL, n), 0, np.repeat(cut[1:], n))
    here, d = np.arange(len(ids)), 1
    while len(here := here[end[here] > here + d]):
        for lo in range(0, len(here), 1 << 16):
            i = here[lo : lo + (1 << 16)]
            est = similar(sketch[i], sketch[i + d])
            ok = est >= low
            left.append(i[ok])
            right.append(i[ok] + d)
            value.append(est[ok])
        d += 1
    links, names, members = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if left:
        i, j, est = np.concatenate(left), np.concatenate(right), np.concatenate(value)
        two = np.repeat(n == 2, n)[i]  # a list of two has one pair, which nothing else can connect
        up = np.arange(len(ids))
        up[j[two]] = i[two]
        root, up, taken = up, up.tolist(), np.flatnonzero(two).tolist()
        order = np.lexsort((j, i, -est))
        order = order[~two[order]]
        for k, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
            ra, rb = _find(up, a), _find(up, b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                taken.append(k)
        taken = np.array(taken, np.int64)
        taken = taken[(est[taken] >= floor) & early[i[taken]]]
        links = np.stack([ids[i[taken]], ids[j[taken]]], 1)
        met = np.zeros(len(ids), bool)
        met[i] = met[j] = True
        at = np.flatnonzero(met)
        more = at[np.repeat(n > 2, n)[at]]
        root[more] = [_find(up, k) for k in more.tolist()]
        root = root[at]
        order = np.argsort(root, kind="stable")
        part = np.cumsum(np.diff(root[order], prepend=-1) > 0) - 1
        members = ids[at[order]]
        names = named_parts(part, members)
    return pa.table([pa.array(np.arange(len(links) + len(names)) < len(links)), pa.array(np.concatenate([links[:, 0], names])), pa.array(np.concatenate([links[:, 1], members]))], schema=_SIEVED)


def exact_links(values: list[np.ndarray], comp: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between different components among full sets: a spanning forest over the components.

    Intersections of all pairs come from products of slices of the incidence matrix,
    over the values that two sets share at least.
    """
    n = np.array([len(v) for v in values])
    owner = np.repeat(np.arange(len(values)), n)
    _, col, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    ok = shared[col]
    owner, col = owner[ok], rank[col[ok]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both = np.zeros((len(values), len(values)), np.float32)
    width = min(4096, int(shared.sum()))
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        x = np.zeros((len(values), width), np.float32)
        x[owner[a:b], col[a:b] - lo] = 1
        both += x @ x.T
    either = n[:, None] + n[None, :] - both
    i, j = np.nonzero(np.triu((den * both >= num * either) & (comp[:, None] != comp[None, :]), 1))
    _, c = np.unique(comp, return_inverse=True)
    up, out = list(range(int(c.max()) + 1)), []
    for p, q in zip(i.tolist(), j.tolist()):
        rp, rq = _find(up, int(c[p])), _find(up, int(c[q]))
        if rp != rq:
            up[max(rp, rq)] = min(rp, rq)
            out.append((p, q))
    return out


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _share(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets (sorted values) have den * |both| >= num * |either|."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(large) or den * len(small) < num * len(large):
        return False
    v = np.concatenate([x, y])
    v.sort()
    both = int(np.count_nonzero(v[1:] == v[:-1]))
    return den * both >= num * (len(x) + len(y) - both)


def _few_links(values: list[np.ndarray], comp: list[int], pairs: list[tuple[int, int]], num: int, den: int) -> list[tuple[int, int]]:
    """``exact_links`` pair by pair, for few pairs."""
    up, out = {c: c for c in comp}, []
    for i, j in pairs:
        p, q = _find(up, comp[i]), _find(up, comp[j])
        if p != q and _share(values[i], values[j], num, den):
            up[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def possible_links(values: list[np.ndarray], task: np.ndarray, comp: np.ndarray, num: int, den: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) within a task and between components, without those that cannot be a link; ``of`` gives the set of each row, if rows share sets.

    Sets hash to MARKS bits. Each bit that two of them do not share stands for a value at
    least that they do not share, and a link has (den + num) * |not shared| <= (den - num) * (|x| + |y|).
    """
    n = np.array([len(v) for v in values], np.int64)
    bits = np.zeros(len(values) * MARKS, bool)
    bits[np.repeat(np.arange(len(values)) * MARKS, n) + (np.concatenate(values) >> np.uint64(20)).astype(np.int64) % MARKS] = True
    mark = np.packbits(bits.reshape(-1, MARKS), axis=1).view(np.uint64)
    if of is not None:
        n, mark = n[of], mark[of]
    end = np.searchsorted(task, task, "right")
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    here, d = np.arange(len(task)), 1
    while len(here := here[end[here] > here + d]):
        i = here[comp[here] != comp[here + d]]
        apart = np.bitwise_count(mark[i] ^ mark[i + d]).sum(1, dtype=np.int64)
        i = i[(den + num) * apart <= (den - num) * (n[i] + n[i + d])]
        left.append(i)
        right.append(i + d)
        d += 1
    return np.concatenate(left), np.concatenate(right)


def _compare(num: int, den: int, expand, t: pa.Table) -> pa.Table:
    """Links between components within the tasks of a bucket. Tasks of one home lie side by side, as they share items: of some 512 rows each set is made once, and each pair compared once."""
    task, home, ids, comp = (t.column(k).to_numpy() for k in ("task", "home", "id", "comp"))
    raw = t.column("values").combine_chunks()
    order = np.lexsort((ids, task, home))
    task, ids, comp = task[order], ids[order], comp[order]
    cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]])) if len(ids) else np.zeros(1, np.int64)
    left, right = [ids[:0]], [ids[:0]]
    at = 0
    while at < len(cut) - 1:
        z = max(at + 1, int(np.searchsorted(cut, cut[at] + 2 * BLOCK, "right")) - 1)
        a, b = int(cut[at]), int(cut[z])
        item, first, of = np.unique(ids[a:b], return_index=True, return_inverse=True)
        values, part = expand(raw.take(pa.array(order[a:b][first]))), comp[a:b][first]
        run = np.repeat(np.arange(z - at), np.diff(cut[at : z + 1]))
        i, j = possible_links(values, run, comp[a:b], num, den, of)
        i, j, run = of[i], of[j], run[i]
        _, once = np.unique(i * len(item) + j, return_index=True)
        i, j, run = i[once], j[once], run[once]
        many = np.bincount(run, minlength=z - at) > FEW * np.diff(cut[at : z + 1])
        found = []
        for k in np.flatnonzero(many).tolist():
            x = of[cut[at + k] - a : cut[at + k + 1] - a]
            found += [(int(x[p]), int(x[q])) for p, q in exact_links([values[k] for k in x.tolist()], part[x], num, den)]
        few = ~many[run]
        found += _few_links(values, part.tolist(), list(zip(i[few].tolist(), j[few].tolist())), num, den)
        if found:
            x, y = np.array(found).T
            left.append(item[x])
            right.append(item[y])
        at = z
    return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)}, schema=_PAIRS)


def remaining_links(parts: DataFrame, comp: DataFrame, sets: DataFrame, *, num: int, den: int, expand, buckets: int) -> DataFrame:
    """Second round: exact links between members of a part that are not yet of one component.

    The members outside a part's largest component are cut into blocks of BLOCK
    items, and so is the largest component; every outside block meets every block once,
    in a task of its own. So a large part costs tasks and copies of its outsiders,
    but no pair is a row. A part of no more than two blocks is one task;
    those with one smallest item are at home in one bucket, as they have more items in common.
    """
    member = parts.join(comp, "id", "left").select("list", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = member.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    member = checkpoint(member.join(mixed, "list"))
    if member.isEmpty():
        return member.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    size = member.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).groupBy("list").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max("n").alias("nm"), F.sum("n").alias("n"), F.min("least").alias("least"))
    size = size.select("list", "main", "least", (F.col("n") <= 2 * BLOCK).alias("whole"), F.ceil(F.col("nm") / BLOCK).cast("int").alias("bm"), F.ceil((F.col("n") - F.col("nm")) / BLOCK).cast("int").alias("bo"))
    dealt = member.join(size, "list").selectExpr(
        "id", "comp", "list", "least",
        """explode(if(whole, array(struct(0 as i, 2 as kind, 0 as j)), if(comp = main,
             transform(sequence(0, bo - 1), i -> struct(i as i, 1 as kind, cast(pmod(xxhash64(id), bm) as int) as j)),
             concat(transform(sequence(0, bo - 1), j -> struct(least(j, cast(pmod(xxhash64(id), bo) as int)) as i, 0 as kind, greatest(j, cast(pmod(xxhash64(id), bo) as int)) as j)),
                    transform(sequence(0, bm - 1), j -> struct(cast(pmod(xxhash64(id), bo) as int) as i, 1 as kind, j as j)))))) as t""",
    )
    task = F.xxhash64("list", "t.i", "t.kind", "t.j")
    dealt = dealt.select("id", "comp", task.alias("task"), F.when(F.col("t.kind") == 2, F.xxhash64("least")).otherwise(task).alias("home"))
    return dealt.join(sets, "id").select(F.pmod("home", F.lit(buckets)).cast("int").alias("bucket"), "home", "task", "id", "comp", "values").groupBy("bucket").applyInArrow(lambda t: _compare(num, den, expand, t), "a long, b long")


def plain_sets(values: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Sets that travel as sorted 64-bit values."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in values]


def _confirm(num: int, den: int, expand, batches):
    """Pairs whose full sets (sorted 64-bit values) have den * |both| >= num * |either|."""
    for b in batches:
        sets = [expand(b.column(k)) for k in (2, 3)]
        ok = [_share(x, y, num, den) for x, y in zip(*sets)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _deal(n: int, batches) -> Iterator[pa.RecordBatch]:
    def parts():
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                keys = np.frombuffer(b"".join(x.as_buffer() for x in b.column(1)), np.uint64).reshape(len(ids), -1)
                yield dealt_keys(keys, ids, b.column(2).to_numpy(), n)

    yield from packed_stream(parts(), n)


def _lists(gap: int, t: pa.Table) -> pa.Table:
    name, early, ids = bucket_lists(gap, unpacked(t, "p0", np.uint32), unpacked(t, "p1", np.int64), unpacked(t, "p2", np.uint8))
    return pa.table({"list": pa.array(name), "early": pa.array(early), "id": pa.array(ids)})


def key_lists(items: DataFrame, gap: int, buckets: int) -> DataFrame:
    """(list, early, id) of the keys that items (id, keys, n) share."""
    dealt = items.select("id", "keys", "n").mapInArrow(partial(_deal, buckets), "bucket int, p0 binary, p1 binary, p2 binary")
    return dealt.groupBy("bucket").applyInArrow(lambda t: _lists(gap, t), "list long, early boolean, id long")


def beyond(lists: DataFrame) -> DataFrame:
    """(list, n) of the lists that have more than LARGE members."""
    if "n" in lists.columns:
        return checkpoint(lists.where(F.col("n") > LARGE).select("list", "n").distinct())
    return checkpoint(lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE))


def cut_large(lists: DataFrame) -> DataFrame:
    """Lists beyond LARGE as blocks, every two of which are a list of their own; so no task holds a whole large list, and every pair still meets."""
    size = beyond(lists)
    if size.isEmpty():
        return lists
    blocks = f"ceil(2 * n / {LARGE})"
    cut = lists.join(size, "list", "left").selectExpr("list", "early", "id", f"if(n is null, null, cast({blocks} as int)) as b", f"if(n is null, 0, cast(pmod(xxhash64(id), {blocks}) as int)) as i")
    cut = cut.selectExpr("list", "early", "id", "b", "i", "explode(if(b is null, array(0), sequence(0, b - 1))) as j")
    out = checkpoint(cut.selectExpr("if(b is null, list, xxhash64(list, least(i, j), greatest(i, j))) as list", "early", "id"))
    discard(lists)
    return out


def cut_once(lists: DataFrame, large: DataFrame) -> DataFrame:
    """Lists beyond LARGE as blocks of half that size, each member in one; every list deals its members in its own way."""
    blocks = f"cast(ceil(2 * n / {LARGE}) as int)"
    cut = lists.join(large, "list", "left")
    return checkpoint(cut.selectExpr(f"if(n is null, list, xxhash64(list, pmod(xxhash64(id, list), {blocks}))) as list", "early", "id"))


def finer_lists(lists: DataFrame, large: DataFrame, comp: DataFrame) -> DataFrame:
    """Lists beyond LARGE that still hold two components, parted by a second list that their members share: a cheap step before ``rare_lists``.

    For each of its large lists an item takes the FINER of its other lists that come
    first in an order that all members of the list agree on; those with a second list in
    common are a list. Of two similar items that share a large list, one in twelve
    has no such second list in common, and they share several lists. What is of one
    component by now is left out. So n members cost FINER rows each, not a block each.
    """
    member = lists.join(large.select("list"), "list").join(comp, "id", "left").select("list", "early", "id", F.coalesce("comp", "id").alias("comp"))
    several = member.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    met = member.join(several, "list").join(lists.select("id", F.col("list").alias("other")), "id").where("other <> list")
    rank = F.row_number().over(Window.partitionBy("id", "list").orderBy(F.xxhash64("list", "other"), "other"))  # an item is in a list a band at most
    fine = met.withColumn("rank", rank).where(F.col("rank") <= FINER)
    fine = checkpoint(fine.select(F.xxhash64(F.least("list", "other"), F.greatest("list", "other")).alias("list"), "id", "comp").distinct())
    mixed = fine.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    out = checkpoint(fine.join(mixed, "list").select("list", F.lit(True).alias("early"), "id"))
    discard(fine)
    return out


def _holders(n: int, expand, batches) -> Iterator[pa.RecordBatch]:
    """Values of sets (comp, values), each with its number of holders and their smallest and largest component; some 512 sets are combined before they travel."""

    def parts():
        for b in batches:
            for lo in range(0, b.num_rows, 2 * BLOCK):
                sets = expand(b.column(1).slice(lo, 2 * BLOCK))
                comp = np.repeat(b.column(0).to_numpy()[lo : lo + 2 * BLOCK], [len(x) for x in sets])
                value, *held = _combined(np.concatenate(sets), np.ones(len(comp), np.int64), comp, comp)
                yield (mix(value) % np.uint64(n)).astype(np.int64), value, *held

    yield from packed_stream(parts(), n)


def _combined(value: np.ndarray, count: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(value):
        return value, count, lo, hi
    order = np.argsort(value, kind="stable")
    value = value[order]
    at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    return value[at], np.add.reduceat(count[order], at), np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)


_CELLS = "bucket int, p0 binary, p1 binary"


def _frequencies(t: pa.Table) -> pa.Table:
    """Packed rows of each slice (cell, eighths of the logarithm of the holders, at least 1) for the values that several components hold."""
    value, count, lo, hi = _combined(*(unpacked(t, f"p{i}", x) for i, x in enumerate((np.uint64, np.int64, np.int64, np.int64))))
    ok = lo != hi
    cell, step = _cell(value[ok]), np.minimum(8 * np.log(count[ok]), 255).astype(np.uint8)
    rows = packed(cell >> SLICE_BITS, 1 << (CELL_BITS - SLICE_BITS), (cell & ((1 << SLICE_BITS) - 1)).astype(np.uint16), step)
    return pa.table({"bucket": pa.array([], pa.int32()), "p0": pa.array([], pa.binary()), "p1": pa.array([], pa.binary())}) if rows is None else pa.Table.from_batches([rows])


def _slice(t: pa.Table) -> pa.Table:
    cells = np.zeros(1 << SLICE_BITS, np.uint8)
    np.maximum.at(cells, unpacked(t, "p0", np.uint16), unpacked(t, "p1", np.uint8))
    return pa.table({"slice": t.column("bucket").slice(0, 1), "cells": pa.array([cells.tobytes()], pa.binary())})


def _cell(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def rarest(sets: list[np.ndarray], table: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, number of its set): the values by which sets of different components with a similarity of num / den or more must meet.

    All values have one order: those in cells without a value of several components,
    then by step, then by value. Two sets with a link share so many values that the first of them is
    within the first n - ceil(n * num / den) + 1 of either; and as both hold it, its cell is not empty.
    """
    n = np.array([len(x) for x in sets], np.int64)
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    step = table[_cell(value)]
    order = np.lexsort((value, step, owner))
    value, step = value[order], step[order]
    place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
    ok = (place < (n + (-n * num) // den + 1)[owner]) & (step > 0)
    return value[ok], owner[ok]


def _rare(n: int, num: int, den: int, expand, table, batches) -> Iterator[pa.RecordBatch]:
    def parts():
        for b in batches:
            for lo in range(0, b.num_rows, 2 * BLOCK):
                sets = expand(b.column(1).slice(lo, 2 * BLOCK))
                value, owner = rarest(sets, table.value, num, den)
                yield dealt_keys(value[:, None], b.column(0).to_numpy()[lo : lo + 2 * BLOCK][owner], np.array([len(x) for x in sets], np.int64)[owner], n)

    yield from packed_stream(parts(), n)


def rare_lists(lists: DataFrame, large: DataFrame, comp: DataFrame, sets_of: Callable[[DataFrame], DataFrame], *, num: int, den: int, expand, buckets: int) -> DataFrame:
    """Lists of the items of large lists that still hold two components: those that share one of their rarest values.

    Exact, whatever the bands: each link between two components has a value in common
    among the rarest fifth (at 0.8) of either set, see ``rarest``. Values that one component
    alone holds come first, so what a text has for itself uses its fifth up, and texts that
    share boilerplate do not meet by it. The order is that of a table of bounded size; where it is full, lists are longer but never miss a link.
    """
    member = lists.join(large.select("list"), "list").join(comp, "id", "left").select("list", "id", F.coalesce("comp", "id").alias("comp"))
    several = member.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    asked = checkpoint(member.join(several, "list").select("id", "comp").distinct())
    if asked.isEmpty():
        discard(asked)
        return lists.limit(0)
    held = checkpoint(sets_of(asked.select("id")).join(asked, "id").select("id", "comp", "values"))
    count = held.select("comp", "values").mapInArrow(partial(_holders, buckets, expand), "bucket int, p0 binary, p1 binary, p2 binary, p3 binary")
    table = np.zeros((1 << (CELL_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in count.groupBy("bucket").applyInArrow(_frequencies, _CELLS).groupBy("bucket").applyInArrow(_slice, "slice int, cells binary").collect():
        table[r.slice] = np.frombuffer(r.cells, np.uint8)
    order = held.sparkSession.sparkContext.broadcast(table.ravel())
    dealt = held.select("id", "values").mapInArrow(partial(_rare, buckets, num, den, expand, order), "bucket int, p0 binary, p1 binary, p2 binary")
    gap = class_gap(num, den)
    rare = checkpoint(dealt.groupBy("bucket").applyInArrow(lambda t: _lists(gap, t), "list long, early boolean, id long").distinct().join(asked, "id"))
    mixed = rare.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    out = checkpoint(rare.join(mixed, "list").select("list", "early", "id"))
    for done in (asked, held, rare):
        discard(done)
    return out


def linked_components(lists: DataFrame, sketches_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], similar, floor: float, low: float, *, num: int = 80, den: int = 100, expand=plain_sets, buckets: int) -> DataFrame:
    """(id, comp) of the items that have a link.

    ``lists`` has (list, early, id) rows, or those of ``unique_lists``. ``sketches_of(ids)``
    gives packed sketches (bucket, p1 ids, p3 sketches), dealt by ``hash_bucket``, and
    ``sets_of(ids)`` (id, values), each asked id once and maybe others;
    ``expand`` makes the full sets (sorted 64-bit values) from these binaries.
    ``similar`` estimates similarities along the last axis of sketches; ``floor`` makes
    a likely pair, ``low`` keeps members of a list together.

    Lists beyond LARGE first meet in blocks, each member in one block a list. As lists
    deal their members differently, many near copies are one component after that.
    Where a large list still holds several, its members meet again in the finer lists
    that a second shared list makes, and where it holds several even then, by their
    rarest values, which loses no link; only of those lists, what is beyond LARGE meets
    block by block.
    """
    unique = checkpoint(lists if "n" in lists.columns else lists.groupBy("list", "id").agg(F.max("early").alias("early")))
    lists, large = unique.select("list", "early", "id"), beyond(unique)
    held: list[DataFrame] = []

    def met(lists: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Links within lists, added to the known ones, and the components of all."""
        asked = with_sketches(lists, sketches_of(lists.select("id").distinct()), buckets)
        rows = checkpoint(asked.groupBy("bucket").applyInArrow(lambda t: _sieve_packed(similar, floor, low, t), "link boolean, a long, b long"))
        likely = rows.where("link").select("a", "b").distinct()
        parts = checkpoint(rows.where("not link").select(F.col("a").alias("list"), F.col("b").alias("id")).distinct())
        sets = checkpoint(sets_of(parts.select("id").distinct()))
        both = likely.join(sets.select(F.col("id").alias("b"), F.col("values").alias("vb")), "b").join(sets.select(F.col("id").alias("a"), F.col("values").alias("va")), "a")
        links = checkpoint(both.select("a", "b", "va", "vb").mapInArrow(partial(_confirm, num, den, expand), "a long, b long"))
        held.append(links)
        every = links if known is None else known.union(links)
        comp = components(every)
        more = checkpoint(remaining_links(parts, comp, sets, num=num, den=den, expand=expand, buckets=buckets))
        held.append(more)
        if not more.isEmpty():
            every = every.union(more)
            first, comp = comp, components(every)
            discard(first)
        for done in (rows, parts, sets):
            discard(done)
        return every, comp

    if large.isEmpty():
        _, comp = met(lists, None)
    else:
        once = cut_once(lists, large)
        every, comp = met(once, None)
        discard(once)
        fine = finer_lists(lists, large, comp)
        if not fine.isEmpty():
            again = beyond(fine)
            once = cut_once(fine, again)
            first, (every, comp) = comp, met(once, every)
            for done in (once, again, first):
                discard(done)
        discard(fine)
        rare = rare_lists(lists, large, comp, sets_of, num=num, den=den, expand=expand, buckets=buckets)
        if not rare.isEmpty():
            rare = cut_large(rare)
            first, (_, comp) = comp, met(rare, every)
            discard(first)
        discard(rare)
    for done in (unique, large, *held):
        discard(done)
    return comp
