"""Token ids in binary blocks with Elias-Fano document boundaries.

A store is a Parquet folder of self-contained blocks (shard, block, n_docs, n_tokens, payload), written by Spark's own
committers, so a lost executor never leaves half a file. Documents lie in ascending id order: shards are ranges of ids,
blocks follow one another in a shard, and a block closes at about BLOCK_TOKENS ids, always between documents. payload:

    "PTB1", width of an id in bytes (u32), n_docs, n_tokens, n_null (u64 each), base (i64)
    Elias-Fano sequence of the n_docs + 1 boundaries, Elias-Fano sequence of doc_id - base
    the ids, little-endian, width bytes each (2 where every id of the vocabulary fits, else 4)

An Elias-Fano sequence of n values below u keeps the low log2(u/n) bits of each value packed and the rest as unary
gaps; the place of every 64th one bit is sampled, so select(i) scans at most a few words. That is about 2 + log2(u/n)
bits a document instead of a 64-bit table.

Results for odd input: null and empty texts are documents of the end id alone; null ids come first (n_null of them in a
block); rows that share an id follow one another; empty tables give empty stores; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pretokens, ragged, scratch
from .token_counts import byte_symbols

BLOCK_TOKENS = 1 << 20
SAMPLE = 64
MAGIC = b"PTB1"


class EliasFano:
    """A non-decreasing sequence of integers from 0 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n, width), np.uint8)
        for b in range(width):
            low[:, b] = ((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QIQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, width, low, high, samples = struct.unpack_from("<QIQQQ", data, at)
        at += struct.calcsize("<QIQQQ")
        parts = []
        for kind, count in (("u1", low), ("u1", high), ("<u8", samples)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, width, *parts), at

    def select(self, i: int) -> int:
        """Value i, from the nearest sample before its one bit."""
        place = int(self.samples[i // SAMPLE])
        need, byte = i % SAMPLE + 1, place // 8
        skip = place % 8
        while True:
            bits = int(self.high[byte]) >> skip << skip
            if (here := bits.bit_count()) >= need:
                break
            need, byte, skip = need - here, byte + 1, 0
        for _ in range(need - 1):
            bits &= bits - 1
        one = 8 * byte + (bits & -bits).bit_length() - 1
        low = 0
        for b in range(self.low_bits):
            bit = i * self.low_bits + b
            low |= (int(self.low[bit // 8]) >> (bit % 8) & 1) << b
        return (one - i) << self.low_bits | low

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        for b in range(self.low_bits):
            out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out


def pack(doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    nulls = sum(x is None for x in doc_ids)
    own = [int(x) for x in doc_ids[nulls:]]
    base = own[0] if own else 0
    gaps = np.array([x - base for x in own], np.uint64)
    head = MAGIC + struct.pack("<IQQQq", width, len(doc_ids), int(offsets[-1]), nulls, base)
    return head + EliasFano.of(offsets).to_bytes() + EliasFano.of(gaps).to_bytes() + ids.astype(f"<u{width}").tobytes()


class Block:
    """A block read from its payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        self.width, self.n_docs, self.n_tokens, self.nulls, self.base = struct.unpack_from("<IQQQq", payload, 4)
        at = 4 + struct.calcsize("<IQQQq")
        self.bounds, at = EliasFano.from_bytes(payload, at)
        self.gaps, at = EliasFano.from_bytes(payload, at)
        self.ids = np.frombuffer(payload, f"<u{self.width}", self.n_tokens, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.base + int(x) for x in self.gaps.values()]

    def document(self, i: int) -> np.ndarray:
        """Ids of document i of the block, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class WordTokenizer:
    """A word-level tokenizer of the library: words are found by array passes, distinct words encoded by the library."""

    def __init__(self, content: str, odd: np.ndarray | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.model = self.library.model
        self.stand = {byte: shown for shown, byte in byte_symbols().items()}
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = ragged.Memo(np.int32, 1 << 21)
        self.odd = self._odd() if odd is None else odd

    def _odd(self) -> np.ndarray:
        """Marks code points that this Python's Unicode tables lack, and those that the library lower-cases, orders or
        composes in another way: alone, between a letter and a mark above or below, and as parts of a composed one."""
        odd = np.zeros(sys.maxunicode + 1, bool)
        for base in range(0, len(odd), 1 << 14):
            points = [c for c in range(base, base + (1 << 14)) if not 0xD800 <= c < 0xE000]
            odd[points] = [unicodedata.category(chr(c)) == "Cn" for c in points]
            probes = []
            for c in (c for c in points if not odd[c] and not chr(c).isspace()):
                parts = unicodedata.decomposition(chr(c)).split()
                marks = ["a" + chr(c) + mark for mark in "\u0301\u0323"] if unicodedata.combining(chr(c)) else []
                whole = ["".join(chr(int(x, 16)) for x in parts)] if len(parts) == 2 and not parts[0].startswith("<") else []
                probes += [([c], x) for x in (chr(c), *marks)] + [([int(x, 16) for x in parts], x) for x in whole]
            low = self.library.normalizer.normalize_str("\n".join(x for _, x in probes)).split(" ") if probes else []
            for (own, x), y in zip(probes, low, strict=True):
                if y != unicodedata.normalize("NFC", x).replace("Σ", "σ").lower():
                    odd[own] = True
        return odd

    def normal(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
        """(text, code points, offsets) in the library's normal form, but for white space. Python's own functions serve
        where they agree with the library; other texts go through it."""
        whole, points, ends = ragged.codepoints(flat, offsets)
        strange = ragged.sums(self.odd[points], ends) > 0
        if not strange.any() and "İ" not in whole and unicodedata.is_normalized("NFC", whole):
            text = whole.replace("Σ", "σ").lower()
        else:
            parts = [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            parts = [self.library.normalizer.normalize_str(p) if lib else unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p, lib in zip(parts, strange.tolist(), strict=True)]
            text, ends = "".join(parts), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
        return text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), ends

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of each text, as the library's encode() gives them without added special tokens."""
        data = flat.tobytes()
        found = [m for m in (s.encode() for s in self.specials) if m in data]
        text, points, ends = self.normal(flat, offsets)
        starts, stops, before = pretokens.word_level(points, ends)
        if len(starts):
            codes, keys, first = ragged.distinct(ragged.segment_hashes(ragged.spread(points), starts, stops))

            def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                words = (text[a:b] for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True))
                shown = (w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.stand) for w in words)
                ids = [[t.id for t in self.model.tokenize(w)] for w in shown]
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                return np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum())), np.append(0, np.cumsum(counts))

            rows = self.memo.rows(keys, make)
            ids, where = ragged.gather(self.memo.flat, self.memo.offsets, rows[codes])
            out = where[before]
        else:
            ids, out = np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if not found:
            return ids, out
        # Texts that hold a special token's text go through the library whole.
        each = []
        for i in range(len(offsets) - 1):
            t = data[offsets[i] : offsets[i + 1]]
            special = any(m in t for m in found)
            each.append(np.array(self.library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32) if special else ids[out[i] : out[i + 1]])
        return np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each])).astype(np.int64)


_loaded: dict[str, WordTokenizer] = {}
_odd_tables: dict[str, np.ndarray] = {}


def write_store(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, to: str | None = None) -> str:
    """Writes the store in ascending id order and returns its path (in the shared folder unless given). One shuffle, of
    the texts by range of id; a task holds one block at a time."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    token = hashlib.sha256(text.encode()).hexdigest()
    if token not in _odd_tables:
        _odd_tables[token] = WordTokenizer(text).odd
    content, kinds = spark.sparkContext.broadcast((text, _odd_tables[token])), pretokens.shared(spark)
    to = to or scratch.path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _loaded:
            _loaded.clear()
            pretokens.adopt(kinds.value)
            _loaded[token] = WordTokenizer(*content.value)
        tokenizer = _loaded[token]
        width = 2 if max(tokenizer.library.get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
        shard, block = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []

        def close() -> pa.RecordBatch:
            payload = pack(names, np.append(0, np.cumsum(sizes)), np.concatenate(held), width)
            row = pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([payload], pa.binary())], ["shard", "block", "n_docs", "n_tokens", "payload"])
            for x in (names, held, sizes):
                x.clear()
            return row

        total = 0
        for batch in batches:
            for part in ragged.cut(batch, "text"):
                ids, offsets = tokenizer.encode(*ragged.utf8(part.column("text")))
                ids = np.insert(ids.astype(np.uint32), offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                for i, name in enumerate(part.column("id").to_pylist()):
                    names.append(name)
                    held.append(ids[offsets[i] : offsets[i + 1]])
                    sizes.append(len(held[-1]))
                    total += sizes[-1]
                    if total >= BLOCK_TOKENS:
                        yield close()
                        block, total = block + 1, 0
        if names:
            yield close()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    ordered = picked.repartitionByRange(n, "id").sortWithinPartitions("id")
    ordered.mapInArrow(run, "shard int, block int, n_docs long, n_tokens long, payload binary").write.option("compression", "zstd").parquet(to)
    return to


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start (ids before it in the whole store), n_tokens, ids_crc32 of its ids as unsigned 32-bit
    little-endian integers."""
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(*(batch.column(c) for c in ("shard", "block", "payload")), strict=True):
                block = Block(payload.as_py())
                bounds = block.bounds.values().astype(np.int64)
                wide = block.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = block.n_docs
                yield pa.record_batch(
                    [pa.array([shard.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32()), pa.array(block.doc_ids(), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["shard", "block", "id", "at", "n_tokens", "ids_crc32"],
                )

    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("size"))  # one row a shard
    first = shards.select("shard", (F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("first"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    places = sizes.withColumn("inside", inside).join(first, "shard").select("shard", "block", (F.col("first") + F.col("inside")).alias("base"))
    rows = blocks.select("shard", "block", "payload").mapInArrow(run, "shard int, block int, id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(places, ["shard", "block"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_shard(spark: SparkSession, path: str, shard: int, to: str) -> int:
    """Writes one shard's blocks, in order, to a file on this machine for a trainer to map; returns its blocks."""
    count = 0
    with open(to, "wb") as f:
        for row in spark.read.parquet(path).filter(F.col("shard") == shard).orderBy("block").select("payload").toLocalIterator():
            f.write(struct.pack("<Q", len(row.payload)) + row.payload)
            count += 1
    return count
