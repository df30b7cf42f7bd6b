"""Recording files: the binary container of numeric arrays, structs and cells that each session of a subject is stored in."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from sigflow.session import ship
from sigflow.sources.tables import RECORDING

# Fixed values of the container format: element types and array classes.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
_MATRIX, _COMPRESSED = 14, 15
_CELL, _STRUCT, _OBJECT = 1, 2, 3
_NUMERIC = range(4, 16)
#: Fields of a run in its struct, by the columns that they become.
FIELDS = {"x": "X", "trial": "trial", "y": "y", "artifacts": "artifacts"}
_NAME = re.compile(r"A(\d+)([TE])\.mat$")
SPLITS = {"T": "train", "E": "test"}


class Container:
    """Reader of one file's bytes. Arrays are views where they lie uncompressed; fields that nobody asks for are stepped over."""

    def __init__(self, data: bytes, fields: set[str] | None = None):
        if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
            raise ValueError("no container of the fifth level")
        self.order = "<" if data[126:128] == b"IM" else ">"
        if struct.unpack(f"{self.order}H", data[124:126])[0] != 0x0100:
            raise ValueError("a container of another version")
        self.data, self.fields = memoryview(data), fields

    def variables(self, wanted: str | None = None) -> dict[str, object]:
        """Top-level arrays by name, or the one of the given name."""
        out, at = {}, 128
        while at < len(self.data):
            kind, body, at = self._element(self.data, at)
            if kind == _COMPRESSED:
                kind, body, _ = self._element(memoryview(zlib.decompress(body)), 0)
            if kind == _MATRIX:
                name, value = self._matrix(body, wanted)
                if wanted is None or name == wanted:
                    out[name] = value
        return out

    def _element(self, data: memoryview, at: int) -> tuple[int, memoryview, int]:
        """Type and bytes of the element at a place, and where the next begins."""
        if at + 8 > len(data):
            raise ValueError("the file is cut off")
        kind, size = struct.unpack_from(f"{self.order}II", data, at)
        if kind >> 16:  # small: type, size and up to four bytes in one word
            return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
        end = at + 8 + size
        if end > len(data):
            raise ValueError("the file is cut off")
        return kind, data[at + 8 : end], end if kind == _COMPRESSED else -(-end // 8) * 8

    def _numbers(self, kind: int, body: memoryview) -> np.ndarray:
        if kind not in _NUMBERS:
            raise ValueError(f"unknown element type {kind}")
        return np.frombuffer(body, self.order + _NUMBERS[kind])

    def _matrix(self, body: memoryview, wanted: str | None = None) -> tuple[str, object]:
        if not len(body):
            return "", np.zeros((0, 0))
        kind, part, at = self._element(body, 0)
        form = int(self._numbers(kind, part)[0]) & 0xFF
        kind, part, at = self._element(body, at)
        shape = tuple(self._numbers(kind, part).tolist())
        kind, part, at = self._element(body, at)
        name = bytes(part).decode("latin-1")
        if wanted is not None and name != wanted:
            return name, None
        count = int(np.prod(shape))
        if form in _NUMERIC:
            kind, part, at = self._element(body, at)
            return name, self._numbers(kind, part).reshape(shape, order="F")
        if form == _CELL:
            cells = []
            for _ in range(count):
                _, part, at = self._element(body, at)
                cells.append(self._matrix(part)[1])
            return name, cells
        if form in (_STRUCT, _OBJECT):
            if form == _OBJECT:
                _, _, at = self._element(body, at)
            kind, part, at = self._element(body, at)
            width = int(self._numbers(kind, part)[0])
            _, part, at = self._element(body, at)
            names = [bytes(part[k : k + width]).split(b"\0")[0].decode("latin-1") for k in range(0, len(part), width)]
            rows = []
            for _ in range(count):
                row = {}
                for n in names:
                    _, part, at = self._element(body, at)
                    if self.fields is None or n in self.fields:
                        row[n] = self._matrix(part)[1]
                rows.append(row)
            return name, rows
        raise ValueError(f"unknown array class {form}")


def _runs(columns: list[str], schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            found = _NAME.search(path.as_py())
            try:
                cells = Container(content.as_py(), {FIELDS[c] for c in columns if c in FIELDS}).variables("data")["data"]
            except (ValueError, KeyError, zlib.error) as e:
                raise ValueError(f"{path.as_py()}: {e}") from e
            for cell in cells:
                for run in cell if isinstance(cell, list) else [cell]:
                    yield pa.record_batch([_column(c, run, found, schema.field(c).type) for c in columns], schema=schema)


def _column(name: str, run: dict, found: re.Match, kind: pa.DataType) -> pa.Array:
    if name == "subject":
        return pa.array([int(found[1])], kind)
    if name == "split":
        return pa.array([SPLITS[found[2]]], kind)
    value = np.asarray(run[FIELDS[name]])
    if name != "x":
        return pa.array([value.ravel(order="F").astype(np.int32)], kind)
    flat = np.ascontiguousarray(value, float)
    inner = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * (flat.shape[1] if flat.ndim > 1 else 0), pa.array(flat.ravel()))
    return pa.ListArray.from_arrays(np.array([0, len(flat)], np.int32), inner)


def read_recording_files(spark: SparkSession, path: str, subject: int | None = None, split: str | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Runs of all recording files of a folder, as ``read_recordings`` gives them: a row a run, files decoded side by side.

    Files are read by Spark, from any store that it reads; a name such as A03T.mat says
    the subject and whether it is for training (T) or evaluation (E). ``subject``, ``split``
    choose files before any is opened, ``columns`` what is decoded: without x the
    signals are stepped over. A run without trials has empty arrays. A file that is no
    such container, or is cut off, is an error that names it.
    """
    ship(spark)
    names = list(columns or RECORDING.names)
    schema = RECORDING.__class__([RECORDING[c] for c in names])
    letter = {"train": "T", "test": "E", None: "[TE]"}[split]
    files = spark.read.format("binaryFile").load(f"{path}/A{'[0-9]*' if subject is None else f'{subject:02d}'}{letter}.mat").select("path", "content")
    return files.mapInArrow(partial(_runs, names, to_arrow_schema(schema)), schema)
