"""Token-ID output: flat unsigned integer files plus 64-bit document offsets.

A shard is three files: ``.bin`` holds the ids of its documents back to back (little-endian, unsigned 16-bit if the
vocabulary fits, else 32-bit), ``.idx`` the n + 1 offsets of its n documents as little-endian 64-bit counts of ids, and
``.ids`` their n document ids (64-bit; the smallest value stands for null). Documents are range-partitioned on doc_id,
so that shards in their order hold all documents in ascending order; a shard's base is the prefix sum of the counts
before it. There are as many shards as shuffle partitions, or one for ``SHARD_BYTES`` of the stored table if that is more.
Readers map a shard into memory where its file system is local, and read it by ranges of ``READ`` ids elsewhere.

Null and empty texts give a document of the end id alone. Null doc_ids come first. Repeated rows and equal doc_ids each
keep an own entry, in the order of a hash of their texts. Very long texts are encoded whole, one at a time. Extra columns
are ignored, whatever their names. An empty table gives no shard.

A task writes below a name of its own and renames at the end, so a task run again after a lost executor replaces its
files by the same bytes.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import blocks, file_system, materialise, new_folder, ship, stored_bytes, utf8
from .tokens import default_tokenizer, encoder

NULL_ID = -(1 << 63)
SHARD_BYTES = 128 << 20
READ = 4_000_000
MANIFEST = "shard int, path string, n_docs long, n_tokens long, width int"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards of docs into folder; returns their manifest (shard, path, n_docs, n_tokens, width, base)."""
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()

    def write(batches):
        task = TaskContext.get()
        shard, name, unique = task.partitionId(), f"part-{task.partitionId():06d}", uuid.uuid4().hex
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        enc = encoder(path)
        files = {k: fs.open_output_stream(f"{root}/_{unique}-{name}.{k}") for k in ("bin", "idx", "ids")}
        files["idx"].write(np.zeros(1, "<i8").tobytes())
        docs_in = tokens = 0
        for b in blocks(batches):
            ids, at = enc.encode(utf8(b.column(1)))
            n = b.num_rows
            ends = at[1:] + np.arange(1, n + 1)  # each document grows by its end id
            flat = np.insert(ids, at[1:], enc.dtype.type(end_id))
            files["bin"].write(flat.astype(enc.dtype, copy=False).tobytes())
            files["idx"].write((ends + tokens).astype("<i8").tobytes())
            files["ids"].write(b.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs_in, tokens = docs_in + n, tokens + len(flat)
        for k, f in files.items():
            f.close()
            done = f"{root}/{name}.{k}"
            if docs_in:
                if fs.get_file_info(done).type != pafs.FileType.NotFound:
                    fs.delete_file(done)
                fs.move(f"{root}/_{unique}-{name}.{k}", done)
            else:
                fs.delete_file(f"{root}/_{unique}-{name}.{k}")
        if docs_in:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [docs_in], "n_tokens": [tokens], "width": pa.array([enc.dtype.itemsize], pa.int32())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Range bounds are sampled on the driver, so their key is two numbers and holds no text.
    tie = F.xxhash64("text")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(rows) // SHARD_BYTES))
    ordered = rows.repartitionByRange(shards, "id", tie).sortWithinPartitions("id", tie, "text")
    manifest = materialise(ordered.mapInArrow(write, MANIFEST), "shards")
    # A row for each shard, which are as many as partitions: one window task adds them up.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Part:
    """A file of fixed-width integers, read by slices: mapped into memory where its file system is local, else by ranges."""

    def __init__(self, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        fs, root = file_system(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.whole = np.memmap(root, dtype=self.dtype, mode="r") if local else None
        self.file = None if local else fs.open_input_file(root)
        self.size = len(self.whole) if local else self.file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, span: slice) -> np.ndarray:
        start, stop, _ = span.indices(self.size)
        if self.whole is not None:
            return np.array(self.whole[start:stop])
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(max(stop - start, 0) * width, start * width), dtype=self.dtype)


def open_shard(path: str, width: int) -> tuple[Part, Part, Part]:
    """ids, offsets and doc ids of a shard."""
    return Part(f"{path}.bin", f"<u{width}"), Part(f"{path}.idx", "<i8"), Part(f"{path}.ids", "<i8")


def documents_of(path: str, width: int, most: int = READ, docs: int = 20_000):
    """The documents of a shard, some at a time: their ids, their offsets (of the shard, one more than documents) and their doc ids."""
    ids, offsets, names = open_shard(path, width)
    for k in range(0, len(names), docs):
        at, own = offsets[k : k + docs + 1], names[k : k + docs]
        first = 0
        while first < len(own):  # of so many ids, or one document
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
            last = min(last, len(own))
            yield ids[int(at[first]) : int(at[last])], at[first : last + 1], own[first:last]
            first = last


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32."""
    ship(manifest.sparkSession)

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                for ids, at, own in documents_of(row["path"], row["width"]):
                    here = (at - at[0]).tolist()
                    crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(here[:-1], here[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID), "start": at[:-1] + row["base"], "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    shards = max(1, manifest.count())
    return manifest.coalesce(1).repartition(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    return read_token_files(write_token_files(docs, new_folder(spark, "tokens"), tokenizer, end_id))
