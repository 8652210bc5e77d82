"""Labels from MATLAB 5 files, read as binary files by Spark: compressed or plain elements, structures, numeric arrays.

Only what label files hold is read: a structure with numeric fields, in either byte order. A file is one row, decoded in one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import in_arrow

#: Fixed values of the format: NumPy's names of the number types by code, and the codes of compressed elements, matrices and structures.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_COMPRESSED, _MATRIX, _STRUCTURE = 15, 14, 2
_HEADER = 128


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """Type and content of each element; up to four bytes may stand within the tag, longer ones are padded to eight."""
    at = 0
    while at + 8 <= len(data):
        first, size = struct.unpack_from(f"{order}II", data, at)
        if first >> 16:
            yield first & 0xFFFF, data[at + 4 : at + 4 + (first >> 16)]
            at += 8
            continue
        yield first, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if first == _COMPRESSED else -size % 8)


def _numbers(kind: int, data: bytes, order: str) -> np.ndarray:
    if kind not in _NUMBERS:
        raise ValueError(f"elements of type {kind} aren't numbers")
    return np.frombuffer(data, order + _NUMBERS[kind])


def _matrix(data: bytes, order: str) -> tuple[str, np.ndarray | dict[str, bytes]]:
    """Name and values of a matrix; of a structure the matrices of its fields (of its first entry), by name."""
    parts = _elements(data, order)
    flags = _numbers(*next(parts), order)
    next(parts)  # dimensions: labels are read in the order of storage
    name = next(parts)[1].decode("latin1")
    if flags[0] & 0xFF != _STRUCTURE:
        return name, _numbers(*next(parts), order)
    width = int(_numbers(*next(parts), order)[0])
    names = next(parts)[1]
    fields = [names[k : k + width].split(b"\0")[0].decode("latin1") for k in range(0, len(names), width)]
    return name, {field: content for field, (_, content) in zip(fields, parts, strict=False)}


def decoded(data: bytes, key: str = "Clusters", field: str = "idx") -> np.ndarray:
    """The numbers of one field of a structure; a KeyError names what there is instead."""
    order = "<" if data[126:128] == b"IM" else ">"
    found: dict[str, np.ndarray | dict] = {}
    for kind, content in _elements(data[_HEADER:], order):
        if kind == _COMPRESSED:
            kind, content = next(_elements(zlib.decompress(content), order))
        if kind == _MATRIX:
            name, value = _matrix(content, order)
            found[name] = value
    if key not in found:
        raise KeyError(f"{key!r} is not among {sorted(found)}")
    fields = found[key] if isinstance(found[key], dict) else {}
    if field not in fields:
        raise KeyError(f"{field!r} is not among the fields {sorted(fields)} of {key!r}")
    return _matrix(fields[field], order)[1]


def labels(spark: SparkSession, path: str, key: str = "Clusters", field: str = "idx") -> DataFrame:
    """win (from 0, in the order of storage) and label (as it is) of a MATLAB file, in any store that Spark reads."""
    return labels_of(spark.read.format("binaryFile").load(path), key, field)


def labels_of(files: DataFrame, key: str = "Clusters", field: str = "idx") -> DataFrame:
    """The same from the column content of files."""

    def kernel(batches):
        for batch in batches:
            for content in batch.column(0):
                values = decoded(content.as_py(), key, field).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values.astype(np.int32))], ["win", "label"])

    return in_arrow(files.select("content"), kernel, "win long, label int")


def contents(table: DataFrame, key: str = "Clusters", field: str = "idx") -> DataFrame:
    """One row, content: a MATLAB file with the labels (from 0) of a table (win, label), in the order of win. A file is made by one task."""

    def kernel(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        win, label = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([encoded(label[np.argsort(win)], key, field)], pa.binary())], ["content"])

    return in_arrow(table.select(F.col("win").cast("long"), F.col("label").cast("int")).coalesce(1), kernel, "content binary")


def encoded(labels: np.ndarray, key: str = "Clusters", field: str = "idx", compress: bool = True) -> bytes:
    """A MATLAB file with a structure of one field, a column of whole numbers from 0."""
    kind, dtype = (2, "u1") if len(labels) == 0 or np.max(labels) < 256 else (6, "u4")

    def element(kind: int, content: bytes) -> bytes:
        return struct.pack("<II", kind, len(content)) + content + bytes(-len(content) % 8)

    def matrix(kind: int, rows: int, columns: int, name: str, rest: bytes) -> bytes:
        head = element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack("<ii", rows, columns)) + element(1, name.encode("latin1"))
        return element(_MATRIX, head + rest)

    inner = matrix(9, len(labels), 1, "", element(kind, np.asarray(labels, dtype).tobytes()))
    whole = matrix(_STRUCTURE, 1, 1, key, element(5, struct.pack("<i", 32)) + element(1, field.encode("latin1").ljust(32, b"\0")) + inner)
    if compress:
        packed = zlib.compress(whole)
        whole = struct.pack("<II", _COMPRESSED, len(packed)) + packed
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H2s", 0x0100, b"IM") + whole
