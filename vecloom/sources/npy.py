"""`.npy` files of any length: rows of one size behind a header, so that each task writes or reads its own stretch."""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.operators.ranks import numbered
from vecloom.sources.scratch import settled
from vecloom.sources.ship import ship

#: Bytes of a file that one task reads.
STRETCH = 32 << 20


def _header(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
    return out.getvalue()


def _writer(path: str, start: int, dtype: np.dtype, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        with open(path, "r+b") as f:  # made by the driver: a task that does not see it fails
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.column("num").to_numpy()
                value = batch.column("value")
                rows = np.asarray(value.to_pylist(), dtype=dtype) if dtype.kind == "U" else value.flatten().to_numpy().astype(dtype)
                rows = rows.reshape(len(at), width)
                order = np.argsort(at)
                at, rows = at[order], rows[order]
                ends = np.concatenate((np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]))
                begin = 0
                for end in ends:
                    f.seek(start + int(at[begin]) * width * dtype.itemsize)
                    f.write(rows[begin:end].tobytes())
                    begin = end
                written += len(at)
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([written], type=pa.int64())], names=["written"])

    return run


def write(rows: DataFrame, path: str, column: str, *order: str, dtype: str = "<f8") -> int:
    """One `.npy` file, which numpy.load reads: column of rows, in the order of columns that tell all rows apart.

    An array column of one length gives a matrix of `dtype`, a string column a vector of strings of the longest's width.
    path must lie on a file system that is mounted under the same name everywhere and takes writes in the middle of a
    file; elsewhere sinks.write_matrix writes Parquet.  The file gets its full length under another name first, every
    task writes the stretches of its rows, which a repeated attempt writes again alike, and the file takes its place when
    all rows are in: until then, and after any failure, an older one stands.  Returns the number of rows.

    A null, or arrays of different lengths, are refused.  Without rows there is a matrix of no rows and columns, or an
    empty vector.
    """
    spark = rows.sparkSession
    ship(spark)
    if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*:", path):
        raise ValueError(f"{path}: not on a mounted file system; write Parquet instead")
    path = re.sub(r"^file:/+", "/", path)
    strings = isinstance(rows.schema[column].dataType, T.StringType)
    value = F.col(column) if strings else F.col(column).cast("array<double>")
    data = settled(numbered(rows.select(*order, value.alias("value")), "num", *order).select(F.col("num").cast("long").alias("num"), "value"), "npy")
    size = F.length("value") if strings else F.size("value")
    hollow = F.col("value").isNull() if strings else F.col("value").isNull() | F.exists("value", lambda x: x.isNull())
    n, least, most, nulls = data.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.count_if(hollow)).head()
    if nulls:
        raise ValueError(f"{nulls} rows of {column} are null or hold nulls")
    if not strings and least != most:
        raise ValueError(f"rows of {column} have {least} to {most} entries")
    kind = np.dtype(f"<U{max(1, most or 0)}") if strings else np.dtype(dtype)
    width = 1 if strings else most or 0
    head = _header(kind, (n,) if strings else (n, width))
    new = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(new, "wb") as f:
            f.write(head)
            f.truncate(len(head) + n * width * kind.itemsize)
        written = data.mapInArrow(_writer(new, len(head), kind, width), "written long").agg(F.sum("written")).head()[0] or 0
        if written != n:
            raise OSError(f"{written} of {n} rows were written")
        os.replace(new, path)
    finally:
        if os.path.exists(new):
            os.remove(new)
    return n


def _open(path: str):
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":" in path else (fs.LocalFileSystem(), path)
    return files.open_input_file(at)


def read(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """row, vector of a `.npy` matrix, or row, value of a vector of numbers or strings; no task reads more than its stretch.

    The driver reads the header alone.  Matrices laid out by columns, and types other than numbers and strings, are
    refused.
    """
    ship(spark)
    with _open(path) as f:
        version = np.lib.format.read_magic(f)
        shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        start = f.tell()
    if (by_columns and len(shape) > 1) or len(shape) not in (1, 2) or dtype.kind not in "fiubU":
        raise ValueError(f"{path}: shape {shape}, type {dtype}, {'by columns' if by_columns else 'by rows'}")
    matrix, width = len(shape) == 2, shape[1] if len(shape) == 2 else 1
    each = max(1, stretch // max(1, width * dtype.itemsize))
    result = "row long, vector array<double>" if matrix else "row long, value string" if dtype.kind == "U" else "row long, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            for batch in batches:
                for part in batch.column("id").to_pylist():
                    begin, end = part * each, min(shape[0], (part + 1) * each)
                    f.seek(start + begin * width * dtype.itemsize)
                    rows = np.frombuffer(f.read((end - begin) * width * dtype.itemsize), dtype=dtype)
                    if len(rows) != (end - begin) * width:
                        raise OSError(f"{path} ends early")
                    if matrix:
                        ends = pa.array(np.arange(end - begin + 1, dtype=np.int32) * width)
                        out = pa.ListArray.from_arrays(ends, pa.array(rows.astype(float)))
                    else:
                        out = pa.array(rows.tolist() if dtype.kind == "U" else rows.astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, end)), out], names=["row", "vector" if matrix else "value"])

    parts = -(-shape[0] // each)
    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, result)
