"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from sigflow.llm import runs
from sigflow.llm.queries import QUERIES
from sigflow.llm.text import chunks
from sigflow.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=24, power=3):
    """Sorted (start, length, period): each period's maximal stretches, the least period of each stretch."""
    found, n = {}, len(w)
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        letters = "ab" if k % 3 == 0 else "abcdefgh"
        words = []
        for _ in range(rng.randint(0, 8)):
            words += [rng.choice(letters) for _ in range(rng.randint(1, 12))] * rng.randint(1, 9)
            if rng.random() < 0.2:
                words += words[: rng.randint(0, len(words))]
        out.append(words)
    morse = "a"
    for _ in range(11):
        morse += morse.translate(str.maketrans("ab", "ba"))
    return [*out, list(morse) + ["a", "b"] * 30, ["x"] * 1500]


@pytest.mark.parametrize("least,power", [(24, 3), (10, 2), (5, 4)])
@pytest.mark.parametrize("pairs", [1 << 18, 500])
def test_runs_are_all_there(monkeypatch, least, power, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    docs = texts(150)
    batch = pa.record_batch([pa.array(range(len(docs))), pa.array([" ".join(d) for d in docs])], names=["id", "text"])
    got = [r for c in chunks([batch], 5000) for r in runs._runs_of(c, least, power).column("runs").to_pylist()]
    assert [[(r["start"], r["length"], r["period"]) for r in g] for g in got] == [brute(d, least, power) for d in docs]


def test_overlap_and_segments():
    assert runs.least_overlap(24, 3) == 16 and runs.least_overlap(10, 2) == 5 and runs.least_overlap(5, 4) == 4
    h = np.array([*range(1, 41), *range(1, 41), *range(100, 130)], np.uint64)
    low, high = runs.segments(h, np.array([0, 80, 110]), 16, 24)
    assert list(zip(low.tolist(), high.tolist())) == [(0, 80)]
    low, high = runs.segments(h, np.array([0, 40, 110]), 16, 24)  # copies in two documents are none in one
    assert not len(low)


def test_stretches():
    h = np.array([5, 6, 7, 5, 6, 7, 5, 6, 9], np.uint64)
    s = runs.Stretches(h)
    i, j = np.array([0, 0, 1]), np.array([3, 6, 4])
    assert s.ahead(i, j, 9 - j).tolist() == [5, 2, 4] and s.behind(i, j, i).tolist() == [0, 0, 1]


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    lines = "".join("%d,%d,%d\n" % r for r in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_query_on_the_table(spark):
    at = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, at).collect()}
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in table(spark, at, "documents").collect()}


def test_query_on_edges(spark, tmp_path):
    docs = [None, "", " \n", "a", "é " * 40, "x y z " * 30, "a " * 100 + "b " * 100 + "a b " * 30, "w" * 5000, *(" ".join(d) for d in texts(60, 4))]
    rows = [(k, t, 1, "x") for k, t in enumerate(docs)]
    spark.createDataFrame(rows * 2 + [(None, "no id", 1, "x")], "doc_id long, text string, runs int, best string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    want = [expected(k, t) for k, t in enumerate(docs)]
    assert [tuple(r) for r in got] == [w for w in want for _ in range(2)]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert runs.periodic_runs(df).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, min_power=1)
