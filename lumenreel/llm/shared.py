"""Shared-folder tables, package shipping and Arrow helpers used by every operator of the subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

__all__ = ["WORD", "blocks", "discard", "file_system", "materialise", "new_folder", "remove_folder", "ship", "stored_bytes", "take_ragged", "utf8", "work_root"]

#: ASCII white space, the separators of every "word" in the contracts (space and 0x09-0x0D).
WORD = "[^\\x20\\x09-\\x0D]+"

_local_root: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset, a local session gets a temporary folder that goes at exit; any
    other session is refused, since no folder of the driver's machine is known to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local_root:
        folder = tempfile.mkdtemp(prefix="work-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_root[context.applicationId] = f"file://{folder}"
    return _local_root[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read back, which cuts the lineage safely."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path  # type: ignore[attr-defined]
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(df: DataFrame) -> None:
    """Deletes a materialised table that no later plan reads."""
    path = df.__dict__.get("stored_at")  # not by getattr, which a column of this name would answer
    if path:
        remove_folder(df.sparkSession, path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it, for tasks that write or read files by themselves."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def stored_bytes(df: DataFrame) -> int:
    """The size of a plan's result as Spark's statistics estimate it (of a scan, that of the files read), 0 if unknown."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 56 else 0


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def take_ragged(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates values[offsets[c]:offsets[c + 1]] for each c of codes; returns it with its own offsets."""
    starts, lengths = offsets[codes], np.diff(offsets)[codes]
    out = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    index = np.repeat(starts - out[:-1], lengths)
    index += np.arange(out[-1])
    return values[index], out


def give_back() -> None:
    """Returns memory that is free to the system: workers are used again, beside others, by steps that need it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def blocks(batches, most_bytes: int = 4 << 20, text: str = "text"):
    """Cuts Arrow batches so that no piece holds much more than most_bytes of text, or one row if that is longer."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array([0 if x is None else x for x in _lengths(column)], dtype=np.int64)
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)
    give_back()


def _lengths(column: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()
