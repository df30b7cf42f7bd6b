"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search on it.

All tables travel as packed arrays: one row a bucket of nodes and sender, so that a
join of neighbours' neighbours is a shuffle of a few large rows and NumPy work on
each side. Equal vectors are one node.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigflow.llm.text import distinct, mix, packed, packed_stream, spread, unpacked
from sigflow.session import checkpoint, discard, ship

#: Neighbours of a node in the graph; random-projection orders for the start; rounds of NN-descent at most; nodes in a search's beam.
NEIGHBOURS, TREES, ROUNDS, BEAM = 20, 3, 8, 400
#: Rounds end when less than this share of all neighbours is new.
SETTLED = 0.02
#: Rows of one block that are compared with each other; nodes of a bucket.
BLOCK, NODES = 256, 800
#: Nodes that name one hub and are compared in its task; of more, blocks meet pair by pair in tasks of their own.
HUB = 2048
_CAND = "bucket int, p0 binary, p1 binary, p2 binary"


def _bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _row(bucket, *cols: np.ndarray) -> pa.Table:
    names = ["bucket", *(f"p{i}" for i in range(len(cols)))]
    return pa.table([pa.array([bucket], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols)], names=names)


def _empty(n: int) -> pa.Table:
    return pa.table([pa.array([], pa.int32()), *(pa.array([], pa.binary()) for _ in range(n))], names=["bucket", *(f"p{i}" for i in range(n))])


def _table(batch: pa.RecordBatch | None, n: int) -> pa.Table:
    return _empty(n) if batch is None else pa.Table.from_batches([batch])


def _void(x: np.ndarray) -> np.ndarray:
    """Rows of a matrix as single items, to be packed."""
    x = np.ascontiguousarray(x)
    return x.view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0]


def _top(v: np.ndarray, c: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each v its k nearest distinct candidates, nearest first, ties to the smaller id."""
    order = np.lexsort((d, c, v))
    v, c, d = v[order], c[order], d[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    v, c, d = v[new], c[new], d[new]
    order = np.lexsort((c, d, v))
    v, c, d = v[order], c[order], d[order]
    head = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    place = np.arange(len(v))
    ok = place - np.maximum.accumulate(np.where(head, place, 0)) < k
    return v[ok], c[ok], d[ok]


def _squares(x: np.ndarray) -> np.ndarray:
    n = (x * x).sum(1)
    d = np.maximum(n[:, None] + n[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    return d


def _packs(n: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                x = np.array(b.column(1).to_pylist(), float)
                yield packed(_bucket(ids, n), n, ids, _void(x))

    return run


def _merge_nodes(t: pa.Table) -> pa.Table:
    return _row(t.column("bucket")[0].as_py(), unpacked(t, "p0", np.int64), unpacked(t, "p1", np.float64))


def _projections(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, 40))


def _codes(mean: np.ndarray, seed: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                ids = unpacked(pa.Table.from_batches([b]), "p0", np.int64)
                x = unpacked(pa.Table.from_batches([b]), "p1", np.float64).reshape(len(ids), -1)
                code = ((x - mean) @ _projections(x.shape[1], seed) > 0) @ (1 << np.arange(39, -1, -1, dtype=np.int64))
                yield pa.record_batch([pa.array(code), pa.array(ids), pa.array([r.tobytes() for r in x.astype(np.float32)])], names=["code", "id", "x"])

    return run


def _block_lists(n: int, k: int):
    """Nearest neighbours of each node inside blocks of consecutive rows."""

    def lists(ids: np.ndarray, x: np.ndarray):
        d = _squares(x)
        m = min(k, len(ids) - 1)
        if m < 1:
            return None
        at = np.argpartition(d, m - 1, 1)[:, :m]
        v = np.repeat(ids, m)
        return packed(_bucket(v, n), n, v, ids[at].ravel(), np.take_along_axis(d, at, 1).ravel().astype(np.float32))

    def run(batches):
        ids, x = np.zeros(0, np.int64), None
        for b in batches:
            if b.num_rows:
                more = np.stack([np.frombuffer(r.as_buffer(), np.float32) for r in b.column(2)])
                ids = np.concatenate([ids, b.column(1).to_numpy()])
                x = more if x is None else np.concatenate([x, more])
                while len(ids) >= 2 * BLOCK:
                    if (out := lists(ids[:BLOCK], x[:BLOCK])) is not None:
                        yield out
                    ids, x = ids[BLOCK:], x[BLOCK:]
        if len(ids) and (out := lists(ids, x)) is not None:
            yield out

    return run


def _merge_lists(k: int):
    def run(t: pa.Table) -> pa.Table:
        return _row(t.column("bucket")[0].as_py(), *_top(unpacked(t, "p0", np.int64), unpacked(t, "p1", np.int64), unpacked(t, "p2", np.float32), k))

    return run


def _renew_lists(k: int):
    """The k best of old and new candidates, with how many entries are not among the old."""

    def run(t: pa.Table) -> pa.Table:
        v, c, d = _top(*(unpacked(t, f"p{i}", x) for i, x in enumerate((np.int64, np.int64, np.float32))), k)
        old = t.filter(pc.invert(t.column("new")))
        pair = lambda a, b: mix(a.view(np.uint64)) + b.view(np.uint64)
        changed = int((~np.isin(pair(v, c), pair(unpacked(old, "p0", np.int64), unpacked(old, "p1", np.int64)))).sum())
        out = _row(t.column("bucket")[0].as_py(), v, c, d)
        return out.append_column("changed", pa.array([changed])).append_column("size", pa.array([len(v)]))

    return run


def _both_ways(n: int):
    """Each (node, neighbour, distance) at the node, and again at the neighbour with distance -1."""

    def parts(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            v, c, d = unpacked(t, "p0", np.int64), unpacked(t, "p1", np.int64), unpacked(t, "p2", np.float32)
            u, w = np.concatenate([v, c]), np.concatenate([c, v])
            yield _bucket(u, n), u, w, np.concatenate([d, np.full(len(d), -1, np.float32)])

    return lambda batches: packed_stream(parts(batches), n)


def _announce(n: int, k: int):
    """Each node sends itself, with its vector and the distance of its last neighbour, to all its neighbours, to those that have it as one, and to itself."""

    def run(edges: pa.Table, nodes: pa.Table) -> pa.Table:
        ids = unpacked(nodes, "p0", np.int64)
        if not len(ids):
            return _empty(4)
        x = unpacked(nodes, "p1", np.float64).reshape(len(ids), -1).astype(np.float32)
        u, w, d = unpacked(edges, "p0", np.int64), unpacked(edges, "p1", np.int64), unpacked(edges, "p2", np.float32)
        order = np.argsort(ids)
        at = order[np.searchsorted(ids[order], u)] if len(u) else np.zeros(0, np.int64)
        own = d >= 0
        worst = np.zeros(len(ids), np.float32)
        np.maximum.at(worst, at[own], d[own])
        worst[np.bincount(at[own], minlength=len(ids)) < k] = np.inf
        to, who = np.concatenate([w, ids]), np.concatenate([at, np.arange(len(ids))])
        return _table(packed(_bucket(to, n), n, to, ids[who], worst[who], _void(x[who])), 4)

    return run


def _all_pairs(v: np.ndarray, worst: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every two of the nodes compared, BLOCK rows at a time: (node, other, squared distance) below the node's worst, k a node at most."""
    out = []
    n = (x * x).sum(1)
    for lo in range(0, len(v), BLOCK):
        at = np.arange(lo, min(lo + BLOCK, len(v)))
        d = np.maximum(n[at, None] + n[None, :] - 2 * x[at] @ x.T, 0)
        d[at - lo, at] = np.inf
        i, j = np.nonzero(d < worst[at][:, None])
        found = v[at[i]], v[j], d[i, j]
        out.append(found if len(v) <= BLOCK else _top(*found, k))
    return out


def _groups(key: np.ndarray, v: np.ndarray):
    """Positions of each key's nodes, by id; a node counts once."""
    order = np.lexsort((v, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (v[order][1:] != v[order][:-1])
    order = order[new]
    cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield order[a:b]


def _candidates(n: int, k: int, out: list[tuple]) -> pa.RecordBatch | None:
    v, c, d = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    v, c, d = _top(v, c, d.astype(np.float32), k)
    return packed(_bucket(v, n), n, v, c, d)


def _local_join(n: int, k: int, hub: int = HUB):
    """At every node, its neighbours and those that have it as one are compared with each other: neighbours of neighbours.

    Where more than ``hub`` nodes meet, they are dealt to blocks of about ``hub``
    and every two blocks go to a task (``dealt`` rows: task, node, worst, vector).
    """

    def run(t: pa.Table) -> pa.Table:
        to, v, worst = unpacked(t, "p0", np.int64), unpacked(t, "p1", np.int64), unpacked(t, "p2", np.float32)
        x = unpacked(t, "p3", np.float32).reshape(len(to), -1)
        out: list[tuple] = []
        sent: list[tuple[np.ndarray, np.ndarray]] = []
        for at in _groups(to, v):
            if len(at) <= hub:
                out += _all_pairs(v[at], worst[at], x[at], k)
                continue
            blocks = -(-len(at) // hub)
            mine = _bucket(v[at] ^ to[at], blocks)
            seed = mix(to[at[:1]].view(np.uint64))
            for j in range(blocks):
                pair = np.minimum(mine, j) * blocks + np.maximum(mine, j)
                sent.append((mix(seed + pair.astype(np.uint64)).view(np.int64), at))
        tables = []
        if (b := _candidates(n, k, out)) is not None:
            tables.append(_table(b, 3).append_column("p3", pa.nulls(b.num_rows, pa.binary())).append_column("dealt", pa.array([False] * b.num_rows)))
        if sent:
            task, at = (np.concatenate(z) for z in zip(*sent))
            b = packed(_bucket(task, n), n, task, v[at], worst[at], _void(x[at]))
            tables.append(_table(b, 4).append_column("dealt", pa.array([True] * b.num_rows)))
        return pa.concat_tables(tables) if tables else _empty(4).append_column("dealt", pa.array([], pa.bool_()))

    return run


def _block_join(n: int, k: int):
    """The nodes of each task compared with each other."""

    def run(t: pa.Table) -> pa.Table:
        task, v, worst = unpacked(t, "p0", np.int64), unpacked(t, "p1", np.int64), unpacked(t, "p2", np.float32)
        x = unpacked(t, "p3", np.float32).reshape(len(task), -1)
        return _table(_candidates(n, k, [z for at in _groups(task, v) for z in _all_pairs(v[at], worst[at], x[at], k)]), 3)

    return run


def _merge_edges(t: pa.Table) -> pa.Table:
    u, w = unpacked(t, "p0", np.int64), unpacked(t, "p1", np.int64)
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    return _row(t.column("bucket")[0].as_py(), u[new], w[new])


def _vectors(t: pa.Table, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, sorted, and the vector of each."""
    every = unpacked(t, ids, np.int64)
    x = unpacked(t, vectors, np.float64).reshape(len(every), -1) if len(every) else np.zeros((0, 1))
    q, at = np.unique(every, return_index=True)
    return q, x[at]


def _to_nodes(n: int, node: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_x: np.ndarray) -> pa.Table:
    """(node, query) pairs packed by the node's bucket; each row has the vectors of its queries once."""
    bucket = _bucket(node, n)
    order = np.argsort(bucket, kind="stable")
    bucket, node, q = bucket[order], node[order], q[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        some = distinct(q[a:b])
        rows.append((int(bucket[a]), node[a:b].tobytes(), q[a:b].tobytes(), some.tobytes(), q_x[np.searchsorted(q_ids, some)].tobytes()))
    columns = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "p0", "p1", "p2", "p3"])


def _ask(n: int):
    """The open (node, query) pairs of the beams, sent to the nodes."""

    def run(state: pa.Table, nodes: pa.Table) -> pa.Table:
        q, c, done = unpacked(state, "p0", np.int64), unpacked(state, "p1", np.int64), unpacked(state, "p3", np.uint8)
        q_ids, q_x = _vectors(nodes, "p0", "p1")
        return _to_nodes(n, c[done == 0], q[done == 0], q_ids, q_x)

    return run


def _follow(n: int):
    """(node, query) pairs to (neighbour, query) pairs."""

    def run(front: pa.Table, edges: pa.Table) -> pa.Table:
        c, q = unpacked(front, "p0", np.int64), unpacked(front, "p1", np.int64)
        u, w = unpacked(edges, "p0", np.int64), unpacked(edges, "p1", np.int64)
        lo, hi = np.searchsorted(u, c, "left"), np.searchsorted(u, c, "right")
        w, q = w[spread(lo, hi - lo)], np.repeat(q, hi - lo)
        order = np.lexsort((q, w))
        w, q = w[order], q[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (q[1:] != q[:-1])
        return _to_nodes(n, w[new], q[new], *_vectors(front, "p2", "p3"))

    return run


def _measure(n: int, k: int):
    """Exact distances of (node, query) pairs, sent back to the queries; of each query the k nearest met here."""

    def run(pairs: pa.Table, nodes: pa.Table) -> pa.Table:
        c, q = unpacked(pairs, "p0", np.int64), unpacked(pairs, "p1", np.int64)
        if not len(c) or not nodes.num_rows:
            return _empty(4)
        (ids, x), (q_ids, q_x) = _vectors(nodes, "p0", "p1"), _vectors(pairs, "p2", "p3")
        at, of = np.searchsorted(ids, c), np.searchsorted(q_ids, q)
        d = np.empty(len(c))
        for lo in range(0, len(c), 1 << 15):
            d[lo : lo + (1 << 15)] = np.sqrt(((x[at[lo : lo + (1 << 15)]] - q_x[of[lo : lo + (1 << 15)]]) ** 2).sum(1))
        q, c, d = _top(q, c, d, k)
        return _table(packed(_bucket(q, n), n, q, c, d, np.zeros(len(q), np.uint8)), 4)

    return run


def _advance(k: int):
    """New beams: what was there has been expanded, what came is open."""

    def run(t: pa.Table) -> pa.Table:
        q, c, d, done = unpacked(t, "p0", np.int64), unpacked(t, "p1", np.int64), unpacked(t, "p2", np.float64), unpacked(t, "p3", np.uint8)
        order = np.lexsort((-done.astype(np.int8), c, q))
        q, c, d, done = q[order], c[order], d[order], done[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, d, done = q[new], c[new], d[new], done[new]
        order = np.lexsort((c, d, q))
        q, c, d, done = q[order], c[order], d[order], done[order]
        head = np.concatenate([[True], q[1:] != q[:-1]])
        place = np.arange(len(q))
        ok = place - np.maximum.accumulate(np.where(head, place, 0)) < k
        out = _row(t.column("bucket")[0].as_py(), q[ok], c[ok], d[ok], done[ok])
        return out.append_column("open", pa.array([int((done[ok] == 0).sum())], pa.int64()))

    return run


def _start(n: int, batches):
    """Beams that hold the query's own node, open."""
    for b in batches:
        ids = b.column(0).to_numpy()
        if (out := packed(_bucket(ids, n), n, ids, ids, np.zeros(len(ids)), np.zeros(len(ids), np.uint8))) is not None:
            yield out


def _expanded(batches):
    for b in batches:
        t = pa.Table.from_batches([b])
        for i in range(t.num_rows):
            r = t.slice(i, 1)
            yield _row(r.column("bucket")[0].as_py(), *(unpacked(r, f"p{j}", x) for j, x in enumerate((np.int64, np.int64, np.float64))), np.ones(len(unpacked(r, "p0", np.int64)), np.uint8)).to_batches()[0]


def _flat(batches):
    for b in batches:
        t = pa.Table.from_batches([b])
        yield pa.record_batch([pa.array(unpacked(t, "p0", np.int64)), pa.array(unpacked(t, "p1", np.int64)), pa.array(unpacked(t, "p2", np.float64))], names=["q", "c", "d"])


def _cogroup(a: DataFrame, b: DataFrame, f, schema: str) -> DataFrame:
    return a.groupBy("bucket").cogroup(b.groupBy("bucket")).applyInArrow(f, schema)


def nn_descent(nodes: DataFrame, buckets: int, dim: int, *, k: int = NEIGHBOURS, trees: int = TREES, rounds: int = ROUNDS) -> DataFrame:
    """Packed (node, neighbour, squared distance) lists of the k nearest found for each node.

    Start: nodes sorted by the signs of random projections, compared inside blocks of
    consecutive rows, several times over. Each round then compares, at every node, its
    neighbours of both directions with each other and keeps the k best of old and new,
    until few lists change.
    """
    mean = np.zeros(dim)
    sums = nodes.mapInArrow(lambda bs: (pa.record_batch([pa.array([len(x)]), pa.array([x.sum(0).tolist()], pa.list_(pa.float64()))], names=["n", "s"]) for b in bs if b.num_rows for x in [unpacked(pa.Table.from_batches([b]), "p1", np.float64).reshape(-1, dim)]), "n long, s array<double>")
    total = sums.agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(dim))).first()
    if total["n"]:
        mean = np.array([total[f"s{i}"] for i in range(dim)]) / total["n"]
    graph = None
    for t in range(trees):
        rows = nodes.mapInArrow(_codes(mean, t), "code long, id long, x binary")
        lists = rows.repartitionByRange(max(1, buckets // 4), "code", "id").sortWithinPartitions("code", "id").mapInArrow(_block_lists(buckets, k), _CAND)
        graph = lists if graph is None else graph.union(lists)
    graph = checkpoint(graph.groupBy("bucket").applyInArrow(_merge_lists(k), _CAND))
    for _ in range(rounds):
        edges = graph.mapInArrow(_both_ways(buckets), _CAND)
        told = _cogroup(edges, nodes, _announce(buckets, k), _CAND + ", p3 binary")
        met = checkpoint(told.groupBy("bucket").applyInArrow(_local_join(buckets, k), _CAND + ", p3 binary, dealt boolean"))
        found = met.where("not dealt").select("bucket", "p0", "p1", "p2")
        dealt = met.where("dealt").drop("dealt")
        if not dealt.isEmpty():
            found = found.union(dealt.groupBy("bucket").applyInArrow(_block_join(buckets, k), _CAND))
        known, new = graph.withColumn("new", F.lit(False)), found.withColumn("new", F.lit(True))
        last = graph
        merged = checkpoint(known.union(new).groupBy("bucket").applyInArrow(_renew_lists(k), _CAND + ", changed long, size long"))
        discard(last)
        discard(met)
        graph = merged.select("bucket", "p0", "p1", "p2")
        graph._checkpoint_path = merged._checkpoint_path
        moved = merged.agg(F.sum("changed"), F.sum("size")).first()
        if not moved[0] or moved[0] < SETTLED * moved[1]:
            break
    return graph


def greedy_search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, buckets: int, *, beam: int = BEAM) -> DataFrame:
    """(q, c, d): the beam of every query node when no open node is left in it.

    ``queries`` has the ids of query nodes. All searches go on together: a beam lies in
    the bucket of its query, a search starts at the query's own node, and each round
    sends all open nodes of the beams, with the query's vector, to those nodes' edges,
    taken both ways, then to the nodes at their ends, and the distances back. Every step is
    a shuffle of packed rows; nothing but the number of open nodes comes to the driver.
    """
    both = graph.mapInArrow(_both_ways(buckets), _CAND).select("bucket", "p0", "p1")
    edges = checkpoint(both.groupBy("bucket").applyInArrow(_merge_edges, "bucket int, p0 binary, p1 binary"))
    beams = _CAND + ", p3 binary"
    first = queries.select("id").mapInArrow(partial(_start, buckets), beams)
    state = checkpoint(first.groupBy("bucket").applyInArrow(_advance(beam), beams + ", open long"))
    while state.agg(F.sum("open")).first()[0]:
        front = _cogroup(state, nodes, _ask(buckets), beams)
        pairs = _cogroup(front, edges, _follow(buckets), beams)
        met = _cogroup(pairs, nodes, _measure(buckets, beam), beams)
        last, state = state, checkpoint(state.mapInArrow(_expanded, beams).union(met).groupBy("bucket").applyInArrow(_advance(beam), beams + ", open long"))
        discard(last)
    return state.mapInArrow(_flat, "q long, c long, d double")


def nearest(vectors: DataFrame, *, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, trees: int = TREES, rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row whose id is divisible by ``every``.

    The score is the Euclidean distance in double precision on the original vectors;
    ties go to the smaller id; a query is no candidate of itself. Vectors that are null,
    zero or hold a null or non-finite component, and those of another length than
    the vector of the smallest id, take no part; nor do rows with a null id. Of
    repeated rows of one id one counts. Equal vectors are one node of the graph, with
    the k + 1 smallest ids as its members, found by a limited rank that each task
    applies before the shuffle. An empty table gives an empty result.
    """
    spark = ship(vectors.sparkSession)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = f"forall({vector_col}, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists({vector_col}, v -> v <> 0)"
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast("double") + 0.0).alias("x"))
    dim = rows.agg(F.min_by(F.size("x"), "id")).first()[0]
    if not dim:
        return empty
    rows = rows.where(F.size("x") == dim)
    same = Window.partitionBy("x")
    members = rows.withColumn("r", F.rank().over(same.orderBy("id"))).where(F.col("r") <= k + 1).withColumn("node", F.min("id").over(same))
    members = checkpoint(members.select("node", "id", "x").dropDuplicates(["node", "id"]))
    reps = members.where("id = node").select("id", "x")
    n = reps.count()
    buckets = max(8, n // NODES)
    nodes = checkpoint(reps.mapInArrow(_packs(buckets), "bucket int, p0 binary, p1 binary").groupBy("bucket").applyInArrow(_merge_nodes, "bucket int, p0 binary, p1 binary"))
    graph = nn_descent(nodes, buckets, dim, k=neighbours, trees=trees, rounds=rounds)
    asked = checkpoint(rows.where(F.col("id") % every == 0).distinct().join(reps.select(F.col("id").alias("node"), "x"), "x").select("id", "node"))
    queries = asked.select(F.col("node").alias("id")).distinct()
    found = greedy_search(nodes, graph, queries, buckets, beam=beam)
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).where(F.col("r") <= k + 1)
    each = near.join(members.select(F.col("node").alias("c"), F.col("id").alias("vec_id")), "c").select(F.col("q").alias("node"), "vec_id", "d")
    pairs = asked.join(each, "node").where("id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", F.col("d").alias("score"))
