"""Binary matrix and vector files: big-endian, a class id, sizes, then rows' counts, columns and values.

Tasks read ranges of rows straight from the shared file: a first pass adds up the counts of each range, the driver the ranges'
totals, and a second pass reads each range's columns and values.  Nothing but one number a range reaches the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from gossamer.session import prepare

#: Class ids of matrices and vectors in such files.
MATRIX, VECTOR = 1211216, 1211214
#: Rows of a range.
RANGE = 1 << 20


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if ":" not in uri.split("/")[0]:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def opened(uri: str) -> pa.NativeFile:
    files, path = _place(uri)
    return files.open_input_file(path)


def write_bytes(uri: str, data: bytes) -> None:
    files, path = _place(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(data)


def _numbers(file: pa.NativeFile, kind: str, n: int, at: int) -> np.ndarray:
    return np.frombuffer(file.read_at(n * np.dtype(kind).itemsize, at), kind)


def read_matrix(spark: SparkSession, uri: str, wide: bool = False, rows: int = RANGE) -> tuple[DataFrame, int, int]:
    """(matrix, number of rows, number of columns); wide: indices of 64 bits."""
    index, head = (">i8", 4 + 24) if wide else (">i4", 16)
    size = np.dtype(index).itemsize
    with opened(uri) as file:
        if struct.unpack(">i", file.read_at(4, 0))[0] != MATRIX:
            raise ValueError("not a binary matrix")
        n, m, nnz = (int(x) for x in _numbers(file, index, 3, 4))
    prepare(spark)
    ranges = spark.range(-(-n // rows), numPartitions=max(1, min(-(-n // rows), 10_000)))

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(uri) as file:
            for k in (k for b in batches for k in b["id"].tolist()):
                yield pd.DataFrame({"id": [k], "n": [int(_numbers(file, index, min(rows, n - k * rows), head + k * rows * size).sum())]})

    before, total = {}, 0
    for r in sorted(ranges.mapInPandas(totals, "id long, n long").collect()):  # a number for each range
        before[r.id], total = total, total + r.n
    if total != nnz:
        raise ValueError("the rows' counts do not add up")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(uri) as file:
            for k in (k for b in batches for k in b["id"].tolist()):
                counts = _numbers(file, index, min(rows, n - k * rows), head + k * rows * size).astype(np.int64)
                ends, at = np.cumsum(counts), 0
                while at < len(counts):  # about as many entries as a range has rows at a time
                    begin = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, begin + rows, "right")))
                    some, first = int(ends[to - 1]) - begin, before[k] + begin
                    columns = _numbers(file, index, some, head + n * size + first * size).astype(np.int64)
                    values = _numbers(file, ">f8", some, head + (n + nnz) * size + first * 8).astype(float)
                    yield pd.DataFrame({"i": np.repeat(np.arange(k * rows + at, k * rows + to), counts[at:to]), "j": columns, "v": values})
                    at = to

    return ranges.mapInPandas(entries, "i long, j long, v double"), n, m


def read_vector(spark: SparkSession, uri: str, wide: bool = False, rows: int = RANGE, at: int = 0) -> DataFrame:
    """(i, x) of the vector that begins at byte `at`, as behind a matrix in one file."""
    index = ">i8" if wide else ">i4"
    head = at + 4 + np.dtype(index).itemsize
    with opened(uri) as file:
        if struct.unpack(">i", file.read_at(4, at))[0] != VECTOR:
            raise ValueError("not a binary vector")
        n = int(_numbers(file, index, 1, at + 4)[0])
    prepare(spark)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(uri) as file:
            for k in (k for b in batches for k in b["id"].tolist()):
                some = min(rows, n - k * rows)
                yield pd.DataFrame({"i": np.arange(k * rows, k * rows + some), "x": _numbers(file, ">f8", some, head + k * rows * 8).astype(float)})

    return spark.range(-(-n // rows)).mapInPandas(values, "i long, x double")


def matrix_bytes(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, m: int, wide: bool = False) -> bytes:
    """A small matrix in this format, for exchange and tests."""
    index, order = (">i8" if wide else ">i4"), np.lexsort((j, i))
    return struct.pack(">i", MATRIX) + np.array([n, m, len(v)], index).tobytes() + np.bincount(i, minlength=n).astype(index).tobytes() + j[order].astype(index).tobytes() + v[order].astype(">f8").tobytes()


def vector_bytes(x: np.ndarray, wide: bool = False) -> bytes:
    return struct.pack(">i", VECTOR) + np.array([len(x)], ">i8" if wide else ">i4").tobytes() + np.asarray(x, ">f8").tobytes()


def block_size(uri: str) -> int:
    """The block size that a matrix's side file (its name and .info) gives; 1 without one."""
    try:
        with opened(uri + ".info") as file:
            words = file.read().decode().split()
    except FileNotFoundError:
        return 1
    return next((int(b) for a, b in zip(words, words[1:]) if a.endswith("block_size")), 1)
