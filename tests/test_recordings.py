"""Recording files written here by hand, in both byte orders, plain and compressed, against the same runs as a table."""

import struct
import zlib

import numpy as np
import pytest

from sigflow.sources.recordings import Container, read_recording_files
from sigflow.sources.tables import RECORDING, read_recordings, recording_trials

KIND = {"f8": (9, 6), "i4": (5, 12), "u1": (2, 9), "i2": (3, 10)}


class Writer:
    def __init__(self, order="<", compress=False):
        self.o, self.compress = order, compress

    def element(self, kind, raw):
        if 0 < len(raw) <= 4:
            return struct.pack(f"{self.o}I", len(raw) << 16 | kind) + raw.ljust(4, b"\0")
        return struct.pack(f"{self.o}II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)

    def head(self, cls, shape, name):
        return self.element(6, struct.pack(f"{self.o}II", cls, 0)) + self.element(5, struct.pack(f"{self.o}{len(shape)}i", *shape)) + self.element(1, name.encode())

    def numeric(self, x, name=""):
        kind, cls = KIND[x.dtype.str[1:]]
        return self.element(14, self.head(cls, x.shape, name) + self.element(kind, x.astype(self.o + x.dtype.str[1:]).tobytes(order="F")))

    def text(self, s):
        return self.element(14, self.head(4, (1, len(s)), "") + self.element(17, s.encode("utf-16-le" if self.o == "<" else "utf-16-be")))

    def struct(self, fields):
        names = b"".join(n.encode().ljust(16, b"\0") for n in fields)
        return self.element(14, self.head(2, (1, 1), "") + self.element(5, struct.pack(f"{self.o}i", 16)) + self.element(1, names) + b"".join(fields.values()))

    def cell(self, items, name):
        return self.element(14, self.head(1, (1, len(items)), name) + b"".join(items))

    def file(self, *variables):
        out = b"made by a test".ljust(124) + struct.pack(f"{self.o}H", 0x0100) + (b"IM" if self.o == "<" else b"MI")
        for v in variables:
            if self.compress:
                z = zlib.compress(v)
                v = struct.pack(f"{self.o}II", 15, len(z)) + z
            out += v
        return out


def run(rng, trials, samples=60):
    x = rng.normal(size=(samples, 5))
    starts = np.sort(rng.integers(0, samples - 20, trials))
    return x, starts.astype(float), rng.integers(1, 5, trials).astype(np.uint8), (rng.random(trials) < 0.3).astype(np.uint8)


def encode(w, runs):
    cells = []
    for x, trial, y, art in runs:
        cells.append(w.struct({"X": w.numeric(x), "trial": w.numeric(trial.reshape(-1, 1)), "y": w.numeric(y.reshape(-1, 1)), "fs": w.numeric(np.array([[250.0]])), "classes": w.text("left"), "artifacts": w.numeric(art.reshape(-1, 1)), "age": w.numeric(np.zeros((0, 0)))}))
    return w.file(w.numeric(np.arange(6, dtype=np.int16).reshape(2, 3), "other"), w.cell(cells, "data"))


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(6)
    known = {}
    for subject, letter, order, compress in ((1, "T", "<", False), (1, "E", ">", False), (12, "T", "<", True), (3, "E", ">", True)):
        known[subject, letter] = [run(rng, n) for n in (0, 3, 8)]
        (tmp_path / f"A{subject:02d}{letter}.mat").write_bytes(encode(Writer(order, compress), known[subject, letter]))
    (tmp_path / "notes.txt").write_text("not a recording")
    return str(tmp_path), known


def test_files_and_table_give_the_same_trials(spark, folder, tmp_path_factory):
    path, known = folder
    rows = [(s, {"T": "train", "E": "test"}[k], x.tolist(), t.astype(int).tolist(), y.tolist(), a.tolist()) for (s, k), runs in known.items() for x, t, y, a in runs]
    stored = str(tmp_path_factory.mktemp("runs") / "t")
    spark.createDataFrame(rows, RECORDING).write.parquet(stored)
    files, table = read_recording_files(spark, path), read_recordings(spark, stored)
    assert files.schema == table.schema and files.count() == 12
    want = sorted(map(repr, recording_trials(table, 20, 4).collect()))
    assert sorted(map(repr, recording_trials(files, 20, 4).collect())) == want and len(want) > 40


def test_only_what_is_asked_for_is_read(spark, folder):
    path, known = folder
    got = read_recording_files(spark, path, 12, "train", ("split", "y")).collect()
    assert [(r.split, r.y) for r in got] == [("train", y.tolist()) for _, _, y, _ in known[12, "T"]]
    assert {r.subject for r in read_recording_files(spark, path, split="test", columns=("subject",)).collect()} == {1, 3}
    with open(f"{path}/A12T.mat", "rb") as f:
        cells = Container(f.read(), {"y"}).variables("data")["data"]
    assert [list(r[0]) for r in cells] == [["y"]] * 3


def test_every_number_type_and_nesting():
    for order in "<>":
        for kind in KIND:
            w = Writer(order)
            x = np.arange(6).reshape(2, 3).astype(kind)
            got = Container(w.file(w.numeric(x, "a"))).variables()["a"]
            assert got.shape == (2, 3) and (got == x).all()
        inner = w.cell([w.numeric(np.ones((1, 1))), w.cell([w.text("hi")], "")], "c")
        got = Container(w.file(inner)).variables()["c"]
        assert got[0][0, 0] == 1 and bytes(got[1][0].astype("u1").tobytes()) == b"hi"


@pytest.mark.parametrize("damage", [lambda b: b[:100], lambda b: b[:-40], lambda b: b[:124] + b"\2\0" + b[126:], lambda b: b"x" * 300, lambda b: b[:128]])
def test_a_damaged_file_is_named(spark, tmp_path, damage):
    good = encode(Writer(), [run(np.random.default_rng(1), 2)])
    (tmp_path / "A05T.mat").write_bytes(damage(good))
    with pytest.raises(Exception, match="A05T.mat"):
        read_recording_files(spark, str(tmp_path)).collect()
