"""The folder that the driver and all executors share, and tables and arrays in it."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of arrays that a worker keeps between batches.
MOST_KEPT = 256 << 20

_local: dict[str, str] = {}
_kept: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a temporary folder, any other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        folder = tempfile.mkdtemp(prefix="models-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local[context.applicationId] = f"file://{folder}"
    return _local[context.applicationId]


def new(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: made once, whatever becomes of an executor."""
    path = new(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path  # type: ignore[attr-defined]
    return out


def delete(spark: SparkSession, path: str) -> None:
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)


def discard(df: DataFrame) -> None:
    """Deletes a stored table that no later plan reads."""
    path = df.__dict__.get("stored_at")
    if path:
        delete(df.sparkSession, path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_arrays(folder: str, **arrays: np.ndarray) -> str:
    """Writes arrays as one file of the folder, under a name of its own, so that a repeated task harms nobody; returns its path."""
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    name = f"{uuid.uuid4().hex}.npz"
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    with fs.open_output_stream(f"{at}/{name}") as out:
        out.write(buf.getbuffer())
    return f"{folder}/{name}"


def write_bytes(folder: str, data) -> str:
    """Writes a file of raw bytes for read_range(); returns its path."""
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    name = f"{uuid.uuid4().hex}.raw"
    with fs.open_output_stream(f"{at}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def read_range(path: str, start: int, size: int) -> bytes:
    return read_ranges(path, [(start, size)])[0]


def read_ranges(path: str, ranges: list[tuple[int, int]]) -> list[bytes]:
    """The bytes of several ranges (start, size) of a file, which is opened once."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        return [f.read_at(size, start) for start, size in ranges]


def read_arrays(path: str, keep: bool = True) -> dict[str, np.ndarray]:
    """The arrays of a file; those read last stay in memory, up to MOST_KEPT bytes, unless keep is false."""
    if path in _kept:
        _kept.move_to_end(path)
        return _kept[path]
    fs, at = file_system(path)
    with fs.open_input_file(at) as f, np.load(io.BytesIO(f.read())) as z:
        found = {k: z[k] for k in z.files}
    return _keep(path, found) if keep else found


def read_kept(path: str, start: int, size: int) -> np.ndarray:
    """read_range() as an array of bytes that stays in memory as those of read_arrays() do; of a file it is always the same range."""
    if path in _kept:
        _kept.move_to_end(path)
        return _kept[path]["bytes"]
    return _keep(path, {"bytes": np.frombuffer(read_range(path, start, size), np.uint8)})["bytes"]


def _keep(path: str, found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    _kept[path] = found
    size = lambda: sum(a.nbytes for arrays in _kept.values() for a in arrays.values())
    while len(_kept) > 1 and size() > MOST_KEPT:
        _kept.popitem(last=False)
    return found
