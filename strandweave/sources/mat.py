"""MAT level 5 files: names, classes and shapes of the variables, and numeric values."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandweave.errors import SchemaError

# Element types and array classes of the format.
_ELEMENT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_CLASS = {1: "cell", 2: "struct", 3: "object", 4: "char", 5: "sparse", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}
_MATRIX, _COMPRESSED = 14, 15


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str
    shape: tuple[int, ...]
    data: bytes
    order: str

    def values(self) -> np.ndarray:
        """Numeric values in the file's column-major shape."""
        if self.kind in ("cell", "struct", "object", "sparse"):
            raise SchemaError(f"{self.name}: {self.kind} arrays have no plain values")
        element, body, _ = _element(self.data, 0, self.order)
        return np.frombuffer(body, self.order + _ELEMENT[element]).reshape(self.shape, order="F")


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """(type, content, where the next element begins); short elements hold up to four bytes in their tag."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    padded = size if kind == _COMPRESSED else -(-size // 8) * 8
    return kind, data[at + 8 : at + 8 + size], at + 8 + padded


def variables(content: bytes) -> Iterator[Variable]:
    """The top-level variables of a file."""
    if len(content) < 128 or content[126:128] not in (b"IM", b"MI"):
        raise SchemaError("not a MAT level 5 file")
    order = "<" if content[126:128] == b"IM" else ">"
    at = 128
    while at + 8 <= len(content):
        kind, body, at = _element(content, at, order)
        if kind == _COMPRESSED:
            kind, body, _ = _element(zlib.decompress(body), 0, order)
        if kind != _MATRIX:
            continue
        _, flags, p = _element(body, 0, order)
        _, shape, p = _element(body, p, order)
        _, name, p = _element(body, p, order)
        code = struct.unpack(order + "I", flags[:4])[0] & 0xFF
        yield Variable(name.decode("latin-1"), _CLASS.get(code, str(code)), tuple(np.frombuffer(shape, order + "i4").tolist()), body[p:], order)


def structure(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, kind, shape) of the variables of all files, one task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(variables(content))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found)), pa.array([v.name for v in found], pa.string()), pa.array([v.kind for v in found], pa.string()), pa.array([list(v.shape) for v in found], pa.list_(pa.int32()))],
                    names=["file", "name", "kind", "shape"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, name string, kind string, shape array<int>")


def numbers(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, i, value) of one numeric variable in column-major order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [v for v in variables(content) if v.name == name]
                if len(found) != 1:
                    raise SchemaError(f"{file}: {len(found)} variables named {name}")
                flat = found[0].values().ravel(order="F").astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(flat)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["file", "i", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, i bigint, value double")
