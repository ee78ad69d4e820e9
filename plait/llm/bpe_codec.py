"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as a whole. Second tier: the
remaining pre-tokens are merged with a heap of ranked pairs over linked bytes. Distinct pre-tokens are resolved once per
batch and kept in a bounded memo, so that a corpus costs vectorised passes plus one resolution of each distinct word.

Results for odd input: null and empty texts have no ids and decode to no bytes; a null id stays null; repeated rows give
repeated rows; an empty table gives an empty table; other columns are not read. Texts of special tokens are ordinary
text. A text is held whole by one task; its pre-tokens may have any length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import pretokens, ragged

_STEP = np.uint64(0xA24BAED4963EE407)


class PerfectHash:
    """A minimal perfect hash of n distinct 64-bit keys by bucket displacement: every key has its own slot below n."""

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = keys[order[ends[b] - sizes[b] : ends[b]]]
            tried, many = 0, 16
            while True:
                slots = self._slots(own[None, :], np.arange(tried, tried + many, dtype=np.uint64)[:, None])
                hit = next((i for i in np.flatnonzero(free[slots].all(axis=1)) if len(set(slots[i].tolist())) == len(own)), None)
                if hit is not None:
                    self.shift[b] = tried + hit
                    free[slots[hit]] = False
                    break
                tried, many = tried + many, min(2 * many, 1024)
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = -1 - np.flatnonzero(free)[: len(single)]  # lone keys name their slot

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (ragged.mix(keys + shift * _STEP) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(keys, np.maximum(shift, 0).astype(np.uint64)))


class Vocabulary:
    """Tokens and ranks with both tiers of lookup. Every single byte must be a token."""

    def __init__(self, content: bytes):
        self.name = hashlib.sha256(content).hexdigest()
        pairs = (line.split() for line in content.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.width = max(self.ranks.values()) + 1
        by_rank: list[bytes] = [b""] * self.width
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.offsets = np.append(0, np.cumsum([len(t) for t in by_rank])).astype(np.int64)
        self.flat = np.frombuffer(b"".join(by_rank), np.uint8)
        used = np.flatnonzero(np.diff(self.offsets) > 0)
        keys = self.keys_of(self.flat, self.offsets)[used]
        self.hash = PerfectHash(keys)
        slots = self.hash.slots(keys)
        self.slot_key, self.slot_rank = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
        self.slot_key[slots], self.slot_rank[slots] = keys, used

    @staticmethod
    def keys_of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return ragged.segment_hashes(ragged.spread(flat), offsets[:-1], offsets[1:])

    def merge(self, word: bytes) -> list[int]:
        """Ids of the word: the lowest-ranked pair first, from the left among equals."""
        ranks, n = self.ranks, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, stop = heapq.heappop(heap)
            middle = after[start]
            if middle <= start or middle >= n or after[middle] != stop:
                continue  # one of the two has been merged since
            after[start], after[middle] = stop, -1
            if stop < n:
                before[stop] = start
                if (r := ranks.get(word[start : after[stop]])) is not None:
                    heapq.heappush(heap, (r, start, after[stop]))
            left = before[start]
            if left >= 0 and (r := ranks.get(word[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[word[at : after[at]]])
            at = after[at]
        return out

    def whole(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ids of the words that are tokens as a whole, -1 for others: the perfect hash names the one token that each may
        be, and the token's own bytes decide."""
        keys = self.keys_of(flat, offsets)
        slots = self.hash.slots(keys)
        ids = self.slot_rank[slots]
        sizes = np.diff(offsets)
        may = np.flatnonzero((self.slot_key[slots] == keys) & (np.diff(self.offsets)[ids] == sizes) & (sizes > 0))
        out = np.full(len(ids), -1)
        if len(may):
            token, at = ragged.gather(self.flat, self.offsets, ids[may])
            own, _ = ragged.gather(flat, offsets, may)
            out[may] = np.where(np.logical_and.reduceat(token == own, at[:-1]), ids[may], -1)
        return out

    def resolve(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of the words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.whole(np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum(sizes)))
        out = [[i] if i >= 0 else self.merge(word) for word, i in zip(words, ids.tolist(), strict=True)]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for x in out for i in x), np.int32, int(counts.sum())), np.append(0, np.cumsum(counts))

    def encode(self, memo: ragged.Memo, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of each text."""
        text, points, ends = ragged.codepoints(flat, offsets)
        starts, before = pretokens.byte_level(points, ends)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        stops = np.append(starts[1:], len(points))
        codes, keys, first = ragged.distinct(ragged.segment_hashes(ragged.spread(points), starts, stops))

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self.resolve([text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)])

        rows = memo.rows(keys, make)
        ids, where = ragged.gather(memo.flat, memo.offsets, rows[codes])
        return ids, where[before]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ragged bytes of each sequence of ids."""
        flat, where = ragged.gather(self.flat, self.offsets, ids)
        return flat, where[offsets]


_built: dict[bytes, Vocabulary] = {}


def _shared(spark: SparkSession, ranks_path: str):
    """The vocabulary, built once on the driver; its size is that of its file, independent of the corpus."""
    with open(ranks_path, "rb") as f:
        content = f.read()
    if content not in _built:
        _built.clear()
        _built[content] = Vocabulary(content)
    return spark.sparkContext.broadcast(_built[content])


def encode(spark: SparkSession, docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of docs. No shuffle."""
    content, kinds = _shared(spark, ranks_path), pretokens.shared(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = content.value
        pretokens.adopt(kinds.value)
        memo = ragged.memo(f"bpe {vocabulary.name}", np.int32)
        for batch in batches:
            for part in ragged.cut(batch, "text"):
                ids, offsets = vocabulary.encode(memo, *ragged.utf8(part.column("text")))
                yield pa.record_batch([part.column("id"), _lists(ids, offsets)], ["id", "ids"])

    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))


def _binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def encode_decode(spark: SparkSession, docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded binary) for every row of docs: decode() of what encode() gives, by the same worker, so that one
    serves a task in place of two. No shuffle."""
    content, kinds = _shared(spark, ranks_path), pretokens.shared(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = content.value
        pretokens.adopt(kinds.value)
        memo = ragged.memo(f"bpe {vocabulary.name}", np.int32)
        for batch in batches:
            for part in ragged.cut(batch, "text"):
                ids, offsets = vocabulary.encode(memo, *ragged.utf8(part.column("text")))
                decoded = vocabulary.decode(ids, offsets)
                yield pa.record_batch([part.column("id"), _lists(ids, offsets), _binary(*decoded)], ["id", "ids", "decoded"])

    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def decode(spark: SparkSession, encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary) for every row of encoded; null ids decode to no bytes."""
    content = _shared(spark, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = content.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = part.column("ids")
                counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
                flat, offsets = vocabulary.decode(lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(counts)))
                yield pa.record_batch([part.column("id"), lists, _binary(flat, offsets)], ["id", "ids", "decoded"])

    picked = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
