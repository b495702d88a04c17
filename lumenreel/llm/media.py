"""Telephony audio in media columns: G.711 mu-law and A-law, IMA ADPCM, WAV containers and resampled PCM.

A media value is a complete WAV file in a binary column. mu-law and A-law codes expand by tables of 256 entries that a
rule makes; ADPCM is decoded with numpy across the blocks of a whole batch, a sample of every block at each step.
``store`` writes a table with a payload's codes as the samples, ``load`` reads it back, checks the container and decodes.
Decoded PCM is resampled by linear interpolation and is a column of the result, a WAV file of 16-bit samples, so that
whoever writes the result stores it; the features are made of it.

Null and empty texts are a payload of one frame of spaces; payloads are padded with spaces to a positive multiple of the
frame. Very long texts are whole; batches are cut by bytes, so one text at least and not much more than 4 MB are decoded
at a time. Other columns are ignored, whatever their names. Every row gives a row, so repeated rows repeat, and rows of
a null doc_id are kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, new_folder, ship, utf8

ULAW, ALAW, ADPCM = 7, 6, 17  # WAV format tags
RATE = 8000
FRAME = 192


def _ulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _step_table() -> np.ndarray:
    """The 89 quantiser steps of IMA ADPCM, fixed values of the format."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
        544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], dtype=np.int32)


ULAW_TABLE, ALAW_TABLE, STEPS = _ulaw_table(), _alaw_table(), _step_table()
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def wav(tag: int, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file: 8-bit codes, 16-bit PCM (tag 1), or ADPCM blocks of 4 + FRAME bytes."""
    width = 2 if tag == 1 else 1
    bits, align, extra = {1: (16, 2, b""), ADPCM: (4, FRAME + 4, struct.pack("<HH", 2, FRAME * 2 + 1))}.get(tag, (8, 1, struct.pack("<H", 0)))
    per_second = rate * align // (FRAME * 2 + 1) if tag == ADPCM else rate * width
    head = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, sample rate and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, None, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a WAV file without data")


def adpcm_blocks(payload: bytes) -> bytes:
    """Blocks whose nibbles are the payload: a header of predictor 0 and step index 0, then FRAME bytes."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, FRAME)
    return np.concatenate([np.zeros((len(rows), 4), dtype=np.uint8), rows], axis=1).tobytes()


def decode_adpcm(data: bytes) -> np.ndarray:
    """16-bit samples of IMA ADPCM blocks, of one or many files; every step decodes one nibble of all blocks."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, FRAME + 4)
    at = np.ascontiguousarray(rows[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(rows[:, 4:].T)
    out = np.empty((1 + FRAME * 2, len(rows)), dtype=np.int16)
    out[0] = at
    for k in range(FRAME * 2):
        code = (codes[k // 2] >> 4 * (k % 2)) & 15
        step = STEPS[index]
        delta = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        at = np.clip(at + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, 88)
        out[k + 1] = at
    return out.T.reshape(-1)


def decode(tag: int, data: bytes) -> np.ndarray:
    if tag == ADPCM:
        return decode_adpcm(data)
    codes = np.frombuffer(data, dtype=np.uint8)
    return {ULAW: ULAW_TABLE, ALAW: ALAW_TABLE}[tag][codes]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation from one rate to another."""
    if rate == to or not len(pcm):
        return pcm
    n = len(pcm) * to // rate
    at = np.arange(n) * (rate / to)
    low = at.astype(np.int64)
    high = np.minimum(low + 1, len(pcm) - 1)
    share = (at - low).astype(np.float32)
    return np.rint(pcm[low] * (1 - share) + pcm[high] * share).astype(np.int16)


def payload_of(text: bytes, frame: int = FRAME) -> bytes:
    return text.ljust(max(frame, -(-len(text) // frame) * frame), b" ")


def codec_of(payload: bytes) -> int:
    """The codec a mixed store gives a payload: by its checksum, so equal texts agree."""
    return (ULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def store(docs: DataFrame, path: str, codec: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes doc_id, n_bytes and media (a WAV file of the payload in the given codec, else a mix) and returns the table."""
    spark = docs.sparkSession
    ship(spark)

    def make(batches):
        for b in blocks(batches):
            texts = utf8(b.column(1))
            files = []
            for t in texts:
                p = payload_of(t)
                tag = codec or codec_of(p)
                files.append(wav(tag, adpcm_blocks(p) if tag == ADPCM else p))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array(files, pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(make, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)
    return spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path)


def load(table: DataFrame, to_rate: int = 16000, keep_pcm: bool = False) -> DataFrame:
    """Reads stored media back: the payload's and the file's digests and a feature string; keep_pcm adds a PCM WAV file."""
    ship(table.sparkSession)
    names = {ULAW: "ulaw", ALAW: "alaw", ADPCM: "adpcm"}

    def read(batches):
        for b in blocks(batches, text="media"):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")}
            parsed = [(media, *parse_wav(media)) for media in b.column(2).to_pylist()]
            # The ADPCM blocks of all files of the batch are decoded together.
            samples = decode_adpcm(b"".join(data for _, tag, _, data in parsed if tag == ADPCM))
            at = 0
            for media, tag, rate, data in parsed:
                payload = np.frombuffer(data, dtype=np.uint8).reshape(-1, FRAME + 4)[:, 4:].tobytes() if tag == ADPCM else data
                if tag == ADPCM:
                    n = len(data) // (FRAME + 4) * (FRAME * 2 + 1)
                    raw, at = samples[at : at + n], at + n
                else:
                    raw = decode(tag, data)
                pcm = resample(raw, rate, to_rate)
                wide = pcm.astype(np.float32)
                rms = float(np.sqrt(np.square(wide, dtype=np.float32).mean(dtype=np.float64)))
                crossings = int(np.count_nonzero(np.signbit(pcm[1:]) != np.signbit(pcm[:-1])))
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["feature"].append(f"{names[tag]} {to_rate} Hz samples={len(pcm)} rms={rms:.2f} peak={int(np.abs(wide).max())} crossings={crossings} pcm={zlib.crc32(pcm.astype('<i2').tobytes()):08x}")
                if keep_pcm:
                    out["pcm"].append(wav(1, pcm.astype("<i2").tobytes(), to_rate))
            if not keep_pcm:
                del out["pcm"]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": b.column(1)} | {k: pa.array(v, {"feature": pa.string(), "pcm": pa.binary()}.get(k, pa.string() if k.endswith("256") else pa.int64())) for k, v in out.items()})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return table.select("doc_id", "n_bytes", "media").mapInArrow(read, schema + (", pcm binary" if keep_pcm else ""))


def media_columns(spark: SparkSession, docs: DataFrame, codec: int | None = None, to_rate: int = 16000) -> DataFrame:
    """Stores media, reads them back and returns their digests, a feature and the resampled PCM of each document."""
    return load(store(docs, new_folder(spark, "media"), codec), to_rate, keep_pcm=True)
