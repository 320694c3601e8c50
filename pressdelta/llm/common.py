"""Helpers of the operators: scratch tables in the shared folder, files through any store, text columns in Arrow batches.

Tables that cut lineage are written as Parquet under the checkpoint folder that all executors share, so a lost executor
costs only its running tasks.
"""

from __future__ import annotations

import ctypes
import re
import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressdelta.session import checkpoint_dir

# white space that separates words, in regular expressions of Java and of Python
WORD = r"[^\x20\x09-\x0D]+"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
# rows without an id come last
LAST_ID = 2**63 - 1


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` as a scratch table and read it again: lineage ends here."""
    path = path or scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a local path or of the URI of any store pyarrow knows."""
    if "://" not in path and (m := re.match(r"(\w+):(/.*)", path)):
        path = f"{m[1]}://{m[2]}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def remove(path: str) -> None:
    """Delete a scratch folder; one that is not there is no error."""
    store_fs, inner = open_store(path)
    if store_fs.get_file_info(inner).type == fs.FileType.Directory:
        store_fs.delete_dir(inner)


def text_of(c: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def digest64(*parts: Column | int | str) -> Column:
    """64-bit hash of the parts; equal for equal values on every run."""
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def per_process(key: tuple, make):
    """An object a Python worker keeps from task to task: task code is loaded anew each time, so it lives in a module of its own."""
    kept = sys.modules.setdefault("pressdelta_worker_state", types.ModuleType("pressdelta_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column in one array, and where each value begins and ends in it; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def give_back() -> None:
    """Return memory that is free to the system: a worker lives on beside the executor's next tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices with at most about `most` bytes in `column`; a longer single value is a slice of its own."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    give_back()
