"""Exact top-k search: BM25 over an inverted index, with block-max WAND per shard and an exact merge.

Documents stay where they are read. A task cuts its documents into chunks of about ``CHUNK`` postings (a posting is a
term of a document) and writes each as one file of the shared folder: a dictionary of term hashes, and each document's
places in it with their counts. Chunks meet in shards of about ``SHARD`` postings, so a shard's memory is bounded by
postings, whatever documents' sizes are. Document frequencies, the number of documents and their mean length are counted
over all documents, so a score does not depend on the shards, and the best ``k`` of the shards' best are the best of all.

A shard orders its documents by theme (the nearest of the groups that share a most frequent term, by common terms; groups
alike are one) and their length, which brings texts of a language together. Every list is cut into blocks at windows of ``WINDOW`` documents (a
common term's, of a ``COMMON``-th of the documents or more, at every ``FINE``), and each block has the largest score in it. The search of a query (the set of terms of its text) is block-max WAND whose
cursors take a block at a step, since steps of single postings would be interpreted here. Lists are in the order
of what a posting of theirs may count, and the cursors of the first ones move through the windows first.
The pivot is the list from which on block maxima, with what a document has so far, do not add up to the k-th score: a
window in which no document reaches it is passed over by all cursors behind, and a document that does not is no candidate.
After each share of the postings (``SHARES``; after those of ``FULL`` the documents ahead are scored in full, from their
own terms, which raises the k-th score) the candidates that are left decide how the next lists are met: cursors read
them, in the windows that still have candidates, or, where that is less, the lists of common terms, which also lie as
rows of scores by document, are asked for the candidates alone.
Without candidates the search ends, and the rest of the lists, the longest, is not read at all. Scores are compared after rounding to ``DIGITS`` and ties go to
the smaller doc_id, so a bound must miss by more than ``SLACK`` to be passed over. A shard answers a query with one row,
and rows of a query meet in two steps. Shards are searched in waves, each ``WAVE`` times as many as all before it: the
k-th score of a query so far is what its documents in later shards must reach from the start.
There the queries of a group are searched together (``search_many``): a query's cursors pass over the windows whose block
maxima miss its need, those of the lists that are not common in a run of windows of one theme move through the others, and
blocks of ``FINE`` documents that cannot reach the need with the common terms' maxima are passed over. In the blocks that
any query of the group still needs, the common terms, kept as rows of scores by document, are added for all its queries by
one matrix product in single precision, whose error the bounds allow for; documents that may reach the need are scored in
full. In texts of one theme block maxima miss few needs, so there most documents are met: work stays queries times documents.
A task answers ``SLICE`` queries on one shard at most, so its time does not grow with the tables.
Queries are written once and read by each task in groups of ``GROUP``, so neither side is gathered or copied by a
shuffle; a task that is run again reads the same files.

Terms are runs of anything but ASCII white space, A-Z lower-cased, without the ASCII punctuation around them, known by a
64-bit hash. Null and empty texts are documents without terms: they match nothing, and a query without terms has no
answers. Very long texts are whole; a document is never cut. A document answers its own query. Documents without a term
of the query are no answers. Rows without doc_id are left out of both sides. Rows that share a doc_id are one document
each, and each can answer; as queries they are one query of all their terms. Extra columns are ignored, whatever their
names. An empty table, of documents or of queries, gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import runs_of, span_hashes
from .shared import blocks, discard, file_system, give_back, materialise, new_folder, remove_folder, ship, utf8

K1, B = 1.2, 0.75
WINDOW, FINE = 512, 64  # documents of a block, and of one of a common term
SHARES = (1 / 16, 1 / 8, 3 / 16, 1 / 4, 5 / 16, 3 / 8, 1 / 2, 3 / 4, 1)  # of a query's postings, after which candidates are counted
LATER = (3 / 16, 5 / 16, 1 / 2, 1)  # the same where the k-th score is known from the start
FULL = (1, 2)  # places in SHARES after which the k documents ahead are scored in full
COMMON = 20
ASK = 2  # what asking for a score takes against reading a posting
DENSE = 4_000_000  # scores in the rows of a shard's common terms, at most; other lists are always read
THEME = 50
THEMES, ALIKE = 64, 0.5  # themes that are told apart at most, and the cosine from which two are one
USUAL = 15  # a run's common terms are those of a USUAL-th of its documents or more
CELLS = 4_000_000  # scores of queries by documents that are held at once
DIGITS = 9
SLACK = 1e-9  # a rounded k-th score is up to 5e-10 above its own
CHUNK, SHARD = 1_000_000, 3_000_000
GROUP = 256
WAVE = 3
SLICE, LEAST_SLICE = 16384, 1024  # queries of a task at most, and those from which a wave of few shards is dealt to more tasks
MEET = 1000  # shards whose answers to a query meet at once

_PAIR = np.dtype([("doc", "<i4"), ("impact", "<f4")])
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WHITE = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])
_SOLID = np.array([not (b in b" \t\n\x0b\x0c\r" or 33 <= b < 127 and not chr(b).isalnum()) for b in range(256)])


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term hashes (in order, by text), their counts and their text, and the number of words of each text."""
    none = np.empty(0, np.int64)
    buf = np.frombuffer(b" ".join(texts).translate(_LOW), dtype=np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), none, none, np.zeros(len(texts), np.int64)
    starts, ends = runs_of(~_WHITE[buf])
    solid = np.flatnonzero(_SOLID[buf])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = last > first
    starts, ends = solid[first[some]], solid[last[some] - 1] + 1
    (h,) = span_hashes(buf, (starts, ends))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    order = np.lexsort((h, owner))
    h, at = h[order], owner[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))) if len(h) else none
    return h[new], np.diff(np.append(new, len(h))), at[new], np.bincount(owner, minlength=len(texts))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then the same from starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _write_chunk(folder: str, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Writes a chunk; returns its path, its different terms and how many documents have each."""
    names, code, df = np.unique(terms, return_inverse=True, return_counts=True)
    planes = {"ids": ids.astype("<i8"), "lengths": lengths.astype("<i8"), "sizes": sizes.astype("<i4"), "names": names.astype("<u8"), "code": np.diff(code, prepend=0).astype("<i4"), "counts": counts.astype("<i4")}
    row = pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.large_binary()) for k, v in planes.items()})
    path = f"{folder}/{uuid.uuid4().hex}.chunk"
    fs, root = file_system(path)
    with fs.open_output_stream(root) as out, pa.ipc.new_file(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(row)
    return path, names, df


def _read_chunk(path: str) -> dict[str, np.ndarray]:
    fs, root = file_system(path)
    with fs.open_input_file(root) as f:
        row = pa.ipc.open_file(f).get_batch(0)
    kinds = {"ids": "<i8", "lengths": "<i8", "sizes": "<i4", "names": "<u8", "code": "<i4", "counts": "<i4"}
    planes = {k: np.frombuffer(row.column(k)[0].as_buffer(), t) for k, t in kinds.items()}
    planes["code"] = np.cumsum(planes["code"], dtype=np.int32)
    return planes


_CHUNKS = "path string, docs long, words long, postings long, term long, df long"


def write_chunks(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the documents' terms into folder; returns a row for each chunk (path, docs, words, postings) and for each term of it (term, df)."""
    ship(docs.sparkSession)

    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        held, size = [], 0

        def flush():
            ids, lengths, sizes, terms, counts = (np.concatenate([h[i] for h in held]) for i in range(5))
            path, names, df = _write_chunk(folder, ids, lengths, sizes, terms, counts)
            n = len(names)
            none = lambda k: pa.nulls(n, k)
            yield pa.RecordBatch.from_arrays([pa.array([path]), *[pa.array([x], pa.int64()) for x in (len(ids), int(lengths.sum()), len(terms))], *[pa.nulls(1, pa.int64())] * 2], shape.names)
            yield pa.RecordBatch.from_arrays([none(pa.string()), *[none(pa.int64())] * 3, pa.array(names.view(np.int64)), pa.array(df)], shape.names)

        for b in blocks(batches, 2 << 20):
            h, n, at, words = terms_of(utf8(b.column(1)))
            held.append((b.column(0).to_numpy(zero_copy_only=False), words, np.bincount(at, minlength=b.num_rows), h, n))
            size += len(h)
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    shape = pa.schema([("path", pa.string()), *[(k, pa.int64()) for k in ("docs", "words", "postings", "term", "df")]])
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _CHUNKS)


def _up(x: np.ndarray) -> np.ndarray:
    """In single precision, no number below its own."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _spans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different numbers of x, which is in order, and where each begins and ends."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[first], first, np.append(first, len(x))[1:]


def _themes(first: np.ndarray, doc: np.ndarray, code: np.ndarray, counts: np.ndarray, df: np.ndarray) -> np.ndarray:
    """A theme of each document: the nearest of the most frequent first themes by common terms, those alike as one."""
    n = len(first)
    most = np.argsort(-df, kind="stable")[: min(256, DENSE // max(n, 1))]
    if not n or not len(most):
        return first
    place = np.full(len(df), -1, np.int64)
    place[most] = np.arange(len(most))
    mine = place[code] >= 0
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rows = np.zeros((n, len(most)), np.float32)
    rows[doc[mine], place[code[mine]]] = np.sqrt(counts[mine])
    rows = unit(rows)
    names, theme, size = np.unique(first, return_inverse=True, return_counts=True)
    kept = np.argsort(-size, kind="stable")[:THEMES]
    theme = np.where(np.isin(theme, kept), theme, -1)
    for turn in range(3):
        centres = np.array([rows[theme == t].sum(axis=0) for t in (kept if not turn else range(len(kept)))])
        theme = np.argmax(rows @ unit(centres).T, axis=1)
    centres = unit(np.array([rows[theme == t].sum(axis=0) for t in range(len(kept))]))
    one = np.arange(len(kept))
    for i, j in np.argwhere(centres @ centres.T >= ALIKE).tolist():
        one[one == one[j]] = one[i]
    return one[theme]


class Index:
    """The inverted index of a shard, made of chunks."""

    def __init__(self, chunks: list[dict[str, np.ndarray]], mean_length: float):
        names, code = np.unique(np.concatenate([c["names"] for c in chunks]), return_inverse=True)
        ends = np.cumsum([0] + [len(c["names"]) for c in chunks])
        code = np.concatenate([code[ends[i] : ends[i + 1]].astype(np.int32)[c["code"]] for i, c in enumerate(chunks)])
        ids, lengths, sizes, counts = (np.concatenate([c[k] for c in chunks]) for k in ("ids", "lengths", "sizes", "counts"))
        chunks.clear()
        some = sizes > 0  # texts without terms match nothing
        ids, lengths, sizes = ids[some], lengths[some], sizes[some].astype(np.int64)
        self.names, n = names, len(ids)
        df = np.bincount(code, minlength=len(names))
        # Documents in the order of their most frequent common term, then of their length.
        shown = np.where(df[code] * THEME >= n, counts.astype(np.int64) << 32 | code, 0)
        theme = np.maximum.reduceat(shown, np.cumsum(sizes) - sizes) & 0xFFFFFFFF if n else np.empty(0, np.int64)
        del shown
        theme = _themes(theme, np.repeat(np.arange(n), sizes), code, counts, df)
        order = np.lexsort((ids, lengths, theme))
        self.theme = theme[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.n = ids[order], n
        self.windows = -(-n // WINDOW)
        norm = K1 * (1 - B + B * lengths / mean_length)
        impact = counts * (K1 + 1) / (counts + np.repeat(norm, sizes))
        doc = np.repeat(place, sizes)
        # The documents' own terms, by document.
        by = np.argsort(doc, kind="stable")
        doc, self.own_code, self.own_impact = doc[by].astype(np.int32), code[by], impact[by]
        self.own = np.append(0, np.cumsum(np.bincount(doc, minlength=n))).astype(np.int64)
        # Lists, by term and document.
        by = np.argsort(self.own_code, kind="stable")
        code, self.doc, self.impact = self.own_code[by].astype(np.int64), doc[by], self.own_impact[by]
        del doc, impact, by
        slot = code * self.windows + self.doc // WINDOW
        self.edge = np.append(0, np.cumsum(np.bincount(slot, minlength=len(names) * self.windows))).astype(np.int32)  # by term and window
        new = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.empty(0, np.int64)
        self.top = np.zeros(len(names) * self.windows, np.float32)
        self.top[slot[new]] = _up(np.maximum.reduceat(self.impact, new)) if len(new) else 0
        self.top = self.top.reshape(len(names), -1)
        del slot, new, code
        self.df, self.row, self.runs = df, None, None  # rows are made when a search first needs them
        self.idf = np.zeros(len(names))
        self.asked = np.zeros(len(names))  # the idf of the terms of the query at hand
        self.met, self.read = 0, 0  # postings of the queries so far, and those read

    def _rows(self) -> None:
        """The lists of common terms as rows of scores by document, for search()."""
        most = np.argsort(-self.df, kind="stable")[: DENSE // max(self.n, 1)]
        most = most[self.df[most] * COMMON >= self.n]
        self.row = np.full(len(self.names), -1, np.int64)
        self.row[most] = np.arange(len(most))
        self.dense = np.zeros((len(most), self.windows * WINDOW))
        first, size = self.edge[most * self.windows].astype(np.int64), self.df[most]
        rows = _ragged(first, size)
        self.dense[np.repeat(np.arange(len(most)), size), self.doc[rows]] = self.impact[rows]
        self.fine = self.dense.reshape(len(most), self.windows * WINDOW // FINE, FINE).max(axis=2)

    def _runs(self) -> None:
        """Runs of windows of a theme, and of each the lists of its common terms as rows of scores by document, for search_many()."""
        self.pairs = np.empty(len(self.doc), _PAIR)  # document and score side by side, which are read at once
        self.pairs["doc"], self.pairs["impact"] = self.doc, self.impact
        theme = self.theme[::WINDOW]
        cuts = [*np.flatnonzero(np.append(True, theme[1:] != theme[:-1])).tolist(), self.windows] if self.windows else [0]
        every = np.arange(len(self.names)) * self.windows
        self.runs, self.run_of = [], np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        self.place = np.full((len(cuts) - 1, len(self.names)), -1, np.int32)  # of a term among a run's common ones
        for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            low = self.edge[every + a]
            df = self.edge[every + b] - low
            most = np.flatnonzero(df * USUAL >= min(b * WINDOW, self.n) - a * WINDOW)
            most = most[np.argsort(-df[most], kind="stable")[: DENSE // max(self.n, 1)]]
            self.place[r, most] = np.arange(len(most))
            scores = np.zeros((len(most), (b - a) * WINDOW), np.float32)
            rows = _ragged(low[most].astype(np.int64), df[most].astype(np.int64))
            scores[np.repeat(np.arange(len(most)), df[most]), self.doc[rows] - a * WINDOW] = self.impact[rows]
            self.runs.append((a, b, scores, scores.reshape(len(most), (b - a) * WINDOW // FINE, FINE).max(axis=2)))

    def codes(self, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms, and whether the shard has them; takes down their idf."""
        if not len(self.names):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
        once, back = np.unique(terms, return_inverse=True)  # in order, which is faster to look up
        at = np.minimum(np.searchsorted(self.names, once), len(self.names) - 1)
        known = (self.names[at] == once)[back]
        at = at[back]
        self.idf[at[known]] = idf[known]
        return at, known

    def _behind(self, code: np.ndarray, cuts: list[int]) -> np.ndarray:
        """What the lists from each cut on can add, by fine block: sums of their block maxima."""
        out = np.zeros((len(cuts) + 1, self.windows * (WINDOW // FINE)))
        share = np.searchsorted(cuts, np.arange(len(code)), side="right")  # the cut that a list comes before
        for mine, maxima in ((self.row[code] >= 0, None), (self.row[code] < 0, self.top)):
            if mine.any():
                own, of = code[mine], share[mine]
                tops = (self.fine[self.row[own]] if maxima is None else maxima[own]) * self.idf[own, None]
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                sums = np.add.reduceat(tops, first, axis=0)
                out[of[first]] += sums if maxima is None else np.repeat(sums, WINDOW // FINE, axis=1)
        return np.cumsum(out[::-1], axis=0)[::-1][1:] * (1 + 1e-12)

    def _whole(self, docs: np.ndarray) -> np.ndarray:
        """The full scores of documents, from their own terms."""
        size = self.own[docs + 1] - self.own[docs]
        rows = _ragged(self.own[docs], size)
        self.read += len(rows)
        return np.add.reduceat(self.asked[self.own_code[rows]] * self.own_impact[rows], np.cumsum(size) - size)

    def search(self, code: np.ndarray, k: int, need: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the k best documents, by score and then doc_id, or of those among them that reach need.

        code: places of known terms. need: what k documents elsewhere reach already.
        """
        if self.row is None:
            self._rows()
        full, shares = (FULL, SHARES) if need <= 0 else ((), LATER)
        self.asked[code] = self.idf[code]
        size = (self.edge[(code + 1) * self.windows] - self.edge[code * self.windows]).astype(np.int64)
        order = np.argsort(-self.top[code].max(axis=1, initial=0.0) * self.idf[code] / size, kind="stable")  # what a posting may count
        code = code[order]
        through = np.cumsum(size[order])
        cuts = [int(c) for c in np.searchsorted(through, np.array(shares[:-1]) * through[-1], side="right")] + [len(code)] if len(code) else [0] * len(shares)
        behind = self._behind(code, cuts)
        self.met += int(through[-1]) if len(through) else 0
        so_far = np.zeros(self.windows * WINDOW)
        best_ids, best, at = np.empty(0, np.int64), np.empty(0), 0

        def take(docs: np.ndarray, total: np.ndarray) -> None:
            nonlocal best_ids, best, need
            hit = (total >= need) & (total > 0)
            best_ids, best = np.append(best_ids, self.ids[docs[hit]]), np.append(best, np.round(total[hit], DIGITS))
            turn = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[turn], best[turn]
            if len(best) == k:
                need = max(need, float(best[-1]) - SLACK)

        left, scored = None, np.empty(0, np.int64)  # candidates, once there is a k-th score, and documents scored in full
        for turn, upto in enumerate(cuts):
            lists = code[at:upto]
            if left is not None:
                common = lists[self.row[lists] >= 0]
                longest = int((self.edge[(common + 1) * self.windows] - self.edge[common * self.windows]).sum(dtype=np.int64))
                if len(common) and ASK * len(common) * len(left) < longest:  # asked for the candidates alone; other documents are out of it
                    self.read += len(common) * len(left)
                    kept = so_far[left] + self.idf[common] @ self.dense[self.row[common][:, None], left]
                    so_far.fill(-np.inf)
                    so_far[left] = kept
                    lists = lists[self.row[lists] < 0]
            live = np.arange(self.windows) if left is None else np.flatnonzero(np.bincount(left // WINDOW, minlength=self.windows))
            if len(live) == self.windows:
                low, high, weight = self.edge[lists * self.windows], self.edge[(lists + 1) * self.windows], self.idf[lists]
            else:
                slot = (lists[:, None] * self.windows + live).ravel()
                low, high, weight = self.edge[slot], self.edge[slot + 1], np.repeat(self.idf[lists], len(live))
            size = (high - low).astype(np.int64)
            rows = _ragged(low.astype(np.int64), size)
            if len(rows):
                self.read += len(rows)
                so_far += np.bincount(self.doc[rows], self.impact[rows] * np.repeat(weight, size), minlength=len(so_far))
            at = upto
            so_far[scored] = -np.inf
            if at < len(code) and turn in full:
                ahead = np.argpartition(so_far, -k)[-k:] if len(so_far) > k else np.arange(len(so_far))
                ahead = ahead[(so_far[ahead] > 0) & (so_far[ahead] + behind[turn][ahead // FINE] >= need)]
                if len(ahead):
                    take(ahead, self._whole(ahead))
                    scored = np.append(scored, ahead)
                    so_far[ahead] = -np.inf
            if need and at < len(code):
                left = np.flatnonzero((so_far.reshape(-1, FINE) * (1 + 1e-12) + behind[turn][:, None]).ravel()[: self.n] >= need)
                if not len(left):
                    break
        else:  # all lists are met
            hit = np.flatnonzero((so_far >= need) & (so_far > 0))
            if len(hit) > 4 * k:  # what ties with the k-th of them stays
                hit = hit[so_far[hit] >= np.partition(so_far[hit], -k)[-k] - SLACK]
            take(hit, so_far[hit])
        self.asked[code] = 0
        return best_ids, best

    def search_many(self, code: np.ndarray, at: np.ndarray, k: int, need: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """What search() returns, for queries at once whose need is known. code[at[i] : at[i + 1]]: places of query i's terms."""
        if self.runs is None:
            self._runs()
        step, out = max(1, min(GROUP, CELLS // max(self.windows * WINDOW, 1))), []
        for a in range(0, len(need), step):
            b = min(a + step, len(need))
            out += self._search_some(code[at[a] : at[b]], at[a : b + 1] - at[a], k, need[a:b])
        return out

    def answers(self, terms: np.ndarray, idf: np.ndarray, at: np.ndarray, k: int, need: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """search() of each query; those whose need is known together. terms[at[i] : at[i + 1]]: the terms of query i."""
        code, known = self.codes(terms, idf)
        at = np.append(0, np.cumsum(known))[at]
        code = code[known]
        out = [(np.empty(0, np.int64), np.empty(0))] * len(need)
        for i in np.flatnonzero((need <= 0) & (np.diff(at) > 0)).tolist():
            out[i] = self.search(code[at[i] : at[i + 1]], k)
        some = np.flatnonzero(need > 0)
        size = np.diff(at)[some]
        for i, found in zip(some.tolist(), self.search_many(code[_ragged(at[some], size)], np.append(0, np.cumsum(size)), k, need[some]), strict=True):
            out[i] = found
        return out

    def _search_some(self, code: np.ndarray, at: np.ndarray, k: int, need: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        size, weight, per = np.diff(at), self.idf[code], WINDOW // FINE
        some = size > 0
        of = np.repeat(np.arange(len(need)), size)
        self.met += int(self.df[code].sum())
        least = np.nextafter(need.astype(np.float32), np.float32(-np.inf))[:, None]
        # Windows in which a query's block maxima do not add up to its need are passed over by all its cursors.
        bound = np.zeros((len(need), self.windows))
        if len(code):
            bound[some] = np.add.reduceat(self.top[code] * weight[:, None], at[:-1][some])
        live = bound * (1 + 1e-9) >= need[:, None]
        # What the common terms, which come last, can add to a block. Single precision errs by less than off in all.
        off = np.float32(1 + (max((len(r[2]) for r in self.runs), default=0) + 16) * 2.0**-22)
        behind = np.zeros((len(need), self.windows * per), np.float32)
        places, asks = self.place[:, code], []
        for (a, b, _, fine), place in zip(self.runs, places, strict=True):
            mine = place >= 0
            ask = np.zeros((len(need), len(fine)), np.float32)
            ask[of[mine], place[mine]] = weight[mine]
            asks.append(ask)
            behind[:, a * per : b * per] = ask @ fine
        # The cursors of the other lists move through the windows that are left.
        so_far = np.zeros((len(need), self.windows * WINDOW), np.float32)
        rare = places < 0
        turn = np.append(True, self.run_of[1:] != self.run_of[:-1])
        for q in np.flatnonzero(live.any(axis=1)).tolist():
            own, windows = slice(at[q], at[q + 1]), np.flatnonzero(live[q])
            new = np.append(True, (np.diff(windows) > 1) | turn[windows[1:]])  # windows side by side are one step
            start, end = windows[new], windows[np.append(new[1:], True)] + 1
            i, j = np.nonzero(rare[:, own].T[:, self.run_of[start]])
            first = code[own][i] * self.windows
            low = self.edge[first + start[j]]
            n = self.edge[first + end[j]] - low
            met = np.flatnonzero(n)
            low, n = low[met], n[met]
            rows = self.pairs.view(np.int64)[_ragged(low, n)].view(_PAIR)
            self.read += len(rows)
            so_far[q] = np.bincount(rows["doc"], rows["impact"] * np.repeat(weight[own][i[met]].astype(np.float32), n), minlength=so_far.shape[1])
        # The pivot: blocks where the best document so far and the common terms' maxima miss the need are passed over.
        open_ = ((so_far.reshape(len(need), self.windows * per, FINE).max(axis=2) + behind) * off >= least) & np.repeat(live, per, axis=1)
        found = []
        for (a, b, scores, fine), ask in zip(self.runs, asks, strict=True):
            mine = open_[:, a * per : b * per]
            q = np.flatnonzero(mine.any(axis=1))
            if not len(q):
                continue
            block = np.flatnonzero(mine.any(axis=0))
            first = so_far[q, a * WINDOW : b * WINDOW]
            if 4 * len(block) < 3 * mine.shape[1]:
                scores = scores.reshape(len(scores), mine.shape[1], FINE)[:, block].reshape(len(scores), len(block) * FINE)
                first = first.reshape(len(q), mine.shape[1], FINE)[:, block].reshape(len(q), len(block) * FINE)
            else:
                block = np.arange(mine.shape[1])
            self.read += int(np.count_nonzero(ask[q])) * first.shape[1]
            i, j = np.nonzero((ask[q] @ scores + first) * off >= least[q])
            found.append((q[i], a * WINDOW + block[j // FINE] * FINE + j % FINE))
        # Documents that may reach the need are scored in full.
        out = [(np.empty(0, np.int64), np.empty(0))] * len(need)
        if not found:
            return out
        q, docs = (np.concatenate(x) for x in zip(*found, strict=True))
        inside = docs < self.n
        q, docs = q[inside], docs[inside]
        order = np.argsort(q, kind="stable")
        q, docs = q[order], docs[order]
        for i, a, b in zip(*(x.tolist() for x in _spans(q)), strict=True):
            own = slice(at[i], at[i + 1])
            self.asked[code[own]] = weight[own]
            total = self._whole(docs[a:b])
            self.asked[code[own]] = 0
            hit = (total >= need[i]) & (total > 0)
            ids, total = self.ids[docs[a:b][hit]], np.round(total[hit], DIGITS)
            turn = np.lexsort((ids, -total))[:k]
            out[i] = ids[turn], total[turn]
        return out


def ask(queries: DataFrame) -> DataFrame:
    """query_id and term of each query (query_id, text), each pair once."""
    ship(queries.sparkSession)

    def run(batches):
        for b in blocks(batches, 2 << 20):
            h, _, at, _ = terms_of(utf8(b.column(1)))
            yield pa.RecordBatch.from_pydict({"query_id": b.column(0).take(pa.array(at)), "term": h.view(np.int64)})

    rows = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "query_id long, term long").distinct()


def _groups(folder: str, part: int = 0, parts: int = 1):
    """The queries of every parts-th file of a folder of Parquet files, a group at a time: ids, terms, idf, the offsets of each query and its need."""
    import pyarrow.fs as pafs

    fs, root = file_system(folder)
    files = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.path.endswith(".parquet"))
    for path in files[part::parts]:
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=GROUP, columns=["query_id", "terms", "idf", "need"]):
                if b.num_rows:
                    terms = b.column("terms")
                    at = terms.offsets.to_numpy()
                    yield b.column("query_id").to_numpy(), terms.flatten().to_numpy().view(np.uint64), b.column("idf").flatten().to_numpy(), at - at[0], b.column("need").to_numpy()


def search(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id and score: the k best documents (doc_id, text) of each query (query_id, text)."""
    ship(spark)
    folder = new_folder(spark, "chunks")
    written = materialise(write_chunks(docs, folder), "chunks")
    chunks = written.where("path IS NOT NULL")
    totals = chunks.agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
    n_docs = totals["n"] or 0
    mean_length = max((totals["words"] or 0) / max(n_docs, 1), 1e-9)
    df = written.where("path IS NULL").groupBy("term").agg(F.sum("df").cast("double").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    pairs = F.array_sort(F.collect_list(F.struct("term", idf.alias("idf"))))  # of one query
    weighed = ask(queries).join(df, "term").groupBy("query_id").agg(pairs.alias("t"))
    # Queries lie in files of about LEAST_SLICE; a task answers those of some files.
    files = max(1, queries.count() // LEAST_SLICE)
    asked = materialise(weighed.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"), F.lit(0.0).alias("need")).repartition(files), "asked")
    # A row for each chunk passes through one task, which lays chunks together into shards.
    before = F.coalesce(F.sum("postings").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = materialise(chunks.select("path", F.floor(before / F.lit(float(SHARD))).cast("int").alias("shard")).groupBy("shard").agg(F.sort_array(F.collect_list("path")).alias("paths")), "shards")

    answers = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("best", pa.list_(pa.struct([("less", pa.float64()), ("doc_id", pa.int64())])))])

    def answer(asked_at: str, parts: int):
        def run(batches):
            for b in batches:
                for shard, paths, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    index = Index([_read_chunk(p) for p in paths], mean_length)
                    for ids, terms, weights, at, needs in _groups(asked_at, part, parts):
                        out = [{"query_id": q, "part": shard // MEET, "best": [{"less": -s, "doc_id": d} for d, s in zip(found.tolist(), scores.tolist(), strict=True)]} for q, (found, scores) in zip(ids.tolist(), index.answers(terms, weights, at, k, needs), strict=True) if len(found)]
                        if out:
                            yield pa.RecordBatch.from_pylist(out, schema=answers)
            give_back()

        return run

    met = lambda: F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    best_of = lambda rows: rows.groupBy("query_id", "part").agg(met()).groupBy("query_id").agg(met())  # noqa: E731  # k of each of MEET shards, then k of each part
    last = shards.agg(F.max("shard")).first()[0]  # a chunk larger than a shard leaves numbers out
    n_shards, first, found = 0 if last is None else last + 1, 0, None
    n_asked, tasks = asked.count(), spark.sparkContext.defaultParallelism
    # In waves, each WAVE times as many shards as all before: the k-th scores so far are what later shards must reach.
    while first < n_shards or found is None:
        upto = max(1, first * (1 + WAVE))
        n_wave = max(1, min(upto, n_shards) - first)
        parts = max(1, -(-n_asked // SLICE), min(n_asked // LEAST_SLICE, files, tasks // n_wave))
        each = shards.where((F.col("shard") >= first) & (F.col("shard") < upto)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows = each.coalesce(1).repartition(n_wave * parts).mapInArrow(answer(asked.stored_at, parts), "query_id long, part int, best array<struct<less: double, doc_id: long>>")
        wave = materialise(rows, "found")
        before = found
        found = wave if before is None else materialise(before.unionByName(wave), "found")
        first = upto
        if first < n_shards:
            kth = best_of(found).where(F.size("best") == k).select(F.col("query_id").alias("q"), (-F.element_at("best", -1)["less"] - SLACK).alias("kth"))
            again = materialise(asked.join(kth, F.col("query_id") == F.col("q"), "left").select("query_id", "terms", "idf", F.coalesce("kth", "need").alias("need")).repartition(files), "asked")
            discard(asked)
            asked = again
        if before is not None:
            discard(before)
            discard(wave)
    for table in (written, asked, shards):
        discard(table)
    remove_folder(spark, folder)
    best = best_of(found)
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.doc_id", (-F.col("b.less")).alias("score"))


def search_documents(spark: SparkSession, docs: DataFrame, every: int = 50, k: int = 10) -> DataFrame:
    """Takes each document whose doc_id is divisible by every as a query against all documents."""
    queries = docs.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(spark, docs, queries, k)


_PUNCTUATION = r"[!-/:-@\[-`{-~]+"
#: Plain BM25 of the same queries over all documents.
ORACLE_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, unnest(list_filter(list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'),
  lambda x: regexp_replace(regexp_replace(x, '^{_PUNCTUATION}', ''), '{_PUNCTUATION}$', '')), lambda x: x <> '')) AS term FROM (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
l AS (SELECT r, count(*) AS length FROM w GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n, (SELECT sum(length) FROM l)::DOUBLE / count(*) AS mean FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT r, doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY ALL),
f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT doc_id AS query_id, term FROM p WHERE doc_id % 50 = 0),
s AS (SELECT q.query_id, p.r, p.doc_id, round(sum(ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))), 9) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN l ON l.r = p.r CROSS JOIN n GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""
