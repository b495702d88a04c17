"""Exact, cached encoding with a word-level BPE of the tokenizers library.

A tokenizer whose file has the normaliser and splitter below lower-cases and never joins anything across white space, nor
across the border between an ASCII letter and an ASCII punctuation mark other than the apostrophe. So whole texts are cut
there with numpy, each different piece is encoded once per batch and worker, and ids are gathered by piece. Any other
tokenizer encodes whole texts plainly. ``tests/llm`` holds the result against the plain encoding of whole texts.
"""

from __future__ import annotations

import json
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa

from .shared import take_ragged

#: Pieces a worker keeps, about; beyond that it forgets those it has not met lately, so that memory stays bounded.
CACHE_PIECES = 400_000

_WHITE = b"\t\n\x0b\x0c\r"
_FOLD = bytes(32 if b in _WHITE else b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.zeros(256, dtype=np.uint8)  # 1: ASCII letter, 2: ASCII punctuation but the apostrophe
for _b in range(33, 127):
    _KIND[_b] = 1 if chr(_b).isalpha() else 0 if chr(_b).isdigit() or _b == 39 else 2


#: Normaliser and splitter for which texts may be cut, fixed values of that tokenizer.
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def may_cut(description: dict) -> bool:
    """Whether a tokenizer's description (its file's JSON) is one whose texts may be cut into pieces."""
    normaliser, splitters = description.get("normalizer") or {}, (description.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    named = all(t["content"].startswith("<|") for t in description.get("added_tokens") or [])
    return named and normaliser.get("normalizers") == _NORMALISER and splitters[0].get("pattern") == {"Regex": _SPLITTER} and description["model"].get("type", "BPE") == "BPE" and not description.get("truncation") and not description.get("padding")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes batches of UTF-8 texts to unsigned ids; equal to encode(text, add_special_tokens=False) for each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cuts = may_cut(json.loads(self.tokenizer.to_str()))

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        other = []
        for p in pieces:
            if p.isalpha():  # bytes: ASCII letters only, which the normaliser and splitter leave as they are
                self.known[p] = np.array([t.id for t in self.model.tokenize(p.decode())], dtype=self.dtype).tobytes()
            else:
                other.append(p)
        for at in range(0, len(other), 2000):
            part = other[at : at + 2000]
            self.known.update(zip(part, self._plain([p.decode() for p in part]), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offset of each text in it."""
        if not self.cuts:
            return self._with_special(texts, set(range(len(texts))))
        special = [i for i, t in enumerate(texts) if b"<|" in t]  # might name a special token: encoded whole
        if special:
            return self._with_special(texts, set(special))
        buf = np.frombuffer(b" ".join(texts).translate(_FOLD), dtype=np.uint8)
        if not len(buf):
            return np.empty(0, self.dtype), np.zeros(len(texts) + 1, dtype=np.int64)
        kind = _KIND[buf]
        dark = buf != 32
        start = dark.copy()
        start[1:] &= ~dark[:-1] | ((kind[1:] ^ kind[:-1]) == 3)
        begins = np.flatnonzero(start)
        kept = np.flatnonzero(dark)
        offsets = np.append(np.searchsorted(kept, begins), len(kept)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(buf[kept])])
        coded = pieces.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_PIECES // 2:  # pieces not met since the last turn are forgotten
            self.older, self.known = self.known, {}
        if self.older:
            self.known.update((p, self.older[p]) for p in unique if p not in self.known and p in self.older)
        self._learn([p for p in unique if p not in self.known])
        ids = [self.known[p] for p in unique]
        width = self.dtype.itemsize
        ends = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum([len(x) // width for x in ids], out=ends[1:])
        values, at = take_ragged(np.frombuffer(b"".join(ids), dtype=self.dtype), ends, coded.indices.to_numpy(zero_copy_only=False))
        text_at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=text_at[1:])
        return values, at[np.searchsorted(begins, text_at)]

    def _with_special(self, texts: list[bytes], special: set[int]) -> tuple[np.ndarray, np.ndarray]:
        rest, at = self.encode([b"" if i in special else t for i, t in enumerate(texts)]) if len(special) < len(texts) else (np.empty(0, self.dtype), None)
        parts = [np.frombuffer(self._plain([t.decode()])[0], dtype=self.dtype) if i in special else rest[at[i] : at[i + 1]] for i, t in enumerate(texts)]
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in parts], out=offsets[1:])
        return np.concatenate([rest[:0], *parts]), offsets


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
