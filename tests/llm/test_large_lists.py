"""Links in large lists that no second list has: each list counts as large from 20 members on, and all items share one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigflow.llm import lines, minhash, neardup
from tests.llm.test_llm import brute_components, frame, shingle_set

VOCAB = [f"w{k}" for k in range(400)]


@pytest.fixture
def one_list(monkeypatch):
    """Nothing but one list of all items for the operators of a module; the rows of the lists by rarest values go to the list that is given back."""
    rows, linked, rare = [], minhash.linked_components, minhash.rare_lists if hasattr(minhash, "rare_lists") else None

    def patch(module):
        monkeypatch.setattr(minhash, "LARGE", 20)
        if rare:
            monkeypatch.setattr(minhash, "rare_lists", lambda *a, **k: [x := rare(*a, **k), rows.append(x.count())][0])
        monkeypatch.setattr(module, "linked_components", lambda lists, *a, **k: linked(lists.select("id").distinct().select(F.lit(1).cast("long").alias("list"), F.lit(True).alias("early"), "id"), *a, **k))
        return rows

    return patch


def pairs_in_boilerplate(rng, n=60):
    """Pairs of near copies; all texts share a block that is half of each."""
    words = lambda k: " ".join(rng.choice(VOCAB, k))
    block, out = words(110), []
    for _ in range(n):
        own = words(60)
        out += [f"{block} {own}", f"{block} {own} {words(2)}"]
    return out


def test_documents_of_one_large_list_all_meet(spark, one_list):
    rows = one_list(neardup)
    texts = pairs_in_boilerplate(np.random.default_rng(3))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts), shingle=4).collect()}
    comp = brute_components([shingle_set(t, 4) for t in texts], 80)
    assert got == dict(enumerate(comp)) and len(set(comp)) == 60
    assert rows[0] < 60 * len(texts)  # a fifth of a set at most; boilerplate brings nobody together


def test_rarest_values_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for num in (50, 80, 95):
        base = rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 50), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(150)]
        sets += [np.sort(rng.permutation(x)[: max(1, len(x) - int(rng.integers(0, 6)))]) for x in sets]
        comp = np.arange(len(sets))
        comp[:20] = 0
        value, *held = minhash._combined(np.concatenate(sets), *(np.concatenate([np.full(len(x), y) for x, y in zip(sets, z)]) for z in (np.ones(len(sets), np.int64), comp, comp)))
        table = np.zeros(1 << minhash.CELL_BITS, np.uint8)
        several = held[1] != held[2]
        np.maximum.at(table, minhash._cell(value[several]), np.minimum(8 * np.log(held[0][several]), 255).astype(np.uint8))
        value, owner = minhash.rarest(sets, table, num, 100)
        few = [set(value[owner == k].tolist()) for k in range(len(sets))]
        links = [(i, j) for j in range(len(sets)) for i in range(j) if comp[i] != comp[j] and minhash._share(sets[i], sets[j], num, 100)]
        assert len(links) > 20 and all(few[i] & few[j] for i, j in links)


def test_lines_of_one_large_list_all_meet(spark, one_list):
    rng = np.random.default_rng(7)
    block = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 90))
    texts = []
    for _ in range(60):
        own = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60))
        texts += [block + own, block + own + "#!"]
    rows = one_list(lines)
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert got == {i: i % 2 for i in range(len(texts))} and rows[0] < 40 * len(texts)


def test_pipeline_stages_of_one_large_list(spark, one_list):
    """Each text is one line, so either stage leaves one of each pair: the second by an empty text, or none."""
    texts = pairs_in_boilerplate(np.random.default_rng(9))
    docs = frame(spark, texts)
    one_list(neardup)
    assert sorted(r.doc_id for r in corpus_pipeline.minhash_dedup(spark, docs, "").select("doc_id").collect()) == list(range(0, len(texts), 2))
    one_list(lines)
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").select("doc_id", "text").collect()}
    assert left == {i: "" if i % 2 else t for i, t in enumerate(texts)}


def test_pairs_told_apart_by_their_bits_are_no_links():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base[: 60 if k % 2 else 900], 50 if k % 2 else 800, replace=False), rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64)])) for k in range(120)]
    task, comp = np.repeat(np.arange(4), 30), np.arange(120) // 2
    got = set(zip(*(x.tolist() for x in minhash.possible_links(sets, task, comp, 80, 100))))
    pairs = {(i, j) for j in range(120) for i in range(j) if task[i] == task[j] and comp[i] != comp[j]}
    links = {(i, j) for i, j in pairs if minhash._share(sets[i], sets[j], 80, 100)}
    assert links and links <= got < pairs


def test_lines_of_one_set_link_whatever_their_lengths(spark):
    """A line that repeats its shingles is as long as it likes; sets are what counts, also where 16-bit samples give way to 32-bit ones."""
    rng = np.random.default_rng(17)
    letters = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    few, many = letters(45), letters(2450)
    pairs = [("-" * 10, "-" * 40), ("ab" * 20, "ab" * 300), ("abc " * 500, "abc " * 2000), (few * 2, few * 9), (many, many + letters(300)), (many[::-1], many[::-1][:2100])]
    texts = [x for p in pairs for x in p]
    assert brute_components([shingle_chars(t) for t in texts], 80) == [k - k % 2 for k in range(len(texts))]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert got == {k: k % 2 for k in range(len(texts))}


def shingle_chars(x):
    return {x[i : i + lines.SHINGLE] for i in range(len(x) - lines.SHINGLE + 1)}


def test_bit_pairs_estimate_similarity():
    rng, n, k = np.random.default_rng(19), 4000, lines.SAMPLES
    same = rng.random((n, k)) < 0.8
    x = rng.integers(0, 1 << 15, (n, k)).astype(np.uint16) * np.uint16(2) + np.uint16(1)
    y = np.where(same, x, rng.integers(0, 1 << 15, (n, k)).astype(np.uint16) * np.uint16(2) + np.uint16(1))
    est = minhash.pair_matches(minhash.bit_pairs(x), minhash.bit_pairs(y))
    assert minhash.bit_pairs(x).shape[1] == lines.SKETCH and abs(est.mean() - 0.8) < 0.005 and est.std() < 0.046 and est.min() >= lines.LOW


def test_tasks_of_one_home_link_like_each_alone():
    """Parts that share items and pairs are compared side by side: the same components as by brute force."""
    rng = np.random.default_rng(23)
    base = rng.integers(0, 1 << 63, (30, 50)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base[k % 30], 47, replace=False), rng.integers(0, 1 << 63, rng.integers(0, 4)).astype(np.uint64)])) for k in range(150)]
    task, home, ids = (np.concatenate(x) for x in zip(*[(np.full(m, 99 - t), np.full(m, t % 7), rng.choice(150, m, replace=False)) for t, m in enumerate(rng.integers(2, 40, 60))]))
    comp = ids // 2
    t = pa.table({"task": task, "home": home, "id": ids, "comp": comp, "values": pa.array([sets[k].tobytes() for k in ids], pa.binary())})
    got = minhash._compare(80, 100, minhash.plain_sets, t).to_pylist()
    assert all(minhash._share(sets[r["a"]], sets[r["b"]], 80, 100) for r in got)
    pairs = {(i, j) for k in range(60) for i in ids[task == 99 - k].tolist() for j in ids[task == 99 - k].tolist() if i < j and i // 2 != j // 2}
    links = [p for p in pairs if minhash._share(sets[p[0]], sets[p[1]], 80, 100)]

    def joined(edges):
        up = list(range(75))
        for i, j in edges:
            a, b = sorted((minhash._find(up, i // 2), minhash._find(up, j // 2)))
            up[b] = a
        return [minhash._find(up, k) for k in range(75)]

    assert len(set(joined(links))) < 60 and joined(links) == joined([(r["a"], r["b"]) for r in got])


def packed_members(spark, parts):
    rows = [tuple(bytearray(np.array(x, kind).tobytes()) for x, kind in zip(p, (np.int64, np.int64, np.bool_))) for p in parts]
    return spark.createDataFrame(rows, "p0 binary, p1 binary, p2 binary")


def test_members_of_lists_count_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    parts = [(rng.integers(-9, 9, 70), rng.integers(-30, 30, 70), rng.random(70) < 0.2) for _ in range(5)] + [([], [], [])]
    want = {}
    for which, ids, early in parts:
        for key, e in zip(zip(map(int, which), map(int, ids)), early):
            want[key] = want.get(key, False) or bool(e)
    size = {k: sum(x == k for x, _ in want) for k, _ in want}
    df = minhash.unique_lists(packed_members(spark, parts), 7)
    got = df.collect()
    assert len(got) == len(want) and {(r.list, r.id): r.early for r in got} == want
    assert all(r.n == size[r.list] for r in got)
    monkeypatch.setattr(minhash, "LARGE", sorted(size.values())[9])
    large = {(r.list, r.n) for r in minhash.beyond(df).collect()}
    assert large == {(k, n) for k, n in size.items() if n > minhash.LARGE} == {(r.list, r.n) for r in minhash.beyond(df.drop("n")).collect()}
    assert minhash.unique_lists(packed_members(spark, parts[-1:]), 7).count() == 0


def test_members_meet_their_sketches_without_a_join(spark):
    rng = np.random.default_rng(9)
    sketch = {int(i): rng.integers(0, 256, 16, dtype=np.uint8).tobytes()[:-1] + b"\0" for i in range(-20, 20)}
    rows = sorted({(int(a), bool(a % 3), int(b)) for a, b in rng.integers(-25, 25, (300, 2))})
    lists = spark.createDataFrame(rows, "list long, early boolean, id long")
    items = spark.createDataFrame([(i, bytearray(x)) for i, x in sketch.items()], "id long, sketch binary")
    dealt = minhash.with_sketches(lists, items.mapInArrow(lambda b: minhash.deal_sketches(7, b), "bucket int, p1 binary, p3 binary"), 7)
    assert "Join" not in dealt._jdf.queryExecution().toString()
    got, bucket = [], {}
    for r in dealt.collect():
        which, ids, early = (np.frombuffer(x, kind).tolist() for x, kind in zip((r.p0, r.p1, r.p2), (np.int64, np.int64, np.bool_)))
        got += [(a, e, i, bytes(r.p3[16 * k : 16 * k + 16])) for k, (a, i, e) in enumerate(zip(which, ids, early))]
        assert all(bucket.setdefault(a, r.bucket) == r.bucket for a in which)  # a list lies in one bucket
    assert sorted(got) == [(a, e, i, sketch[i]) for a, e, i in rows if i in sketch]
