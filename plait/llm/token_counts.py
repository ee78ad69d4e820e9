"""Token counts: rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch lie in one ragged array of symbols. In every round each sequence finds the lowest rank
among its adjacent pairs, and all sequences merge all places of their own lowest pair at once; the number of symbols
that survive is the number of tokens. A pair's merge can only make pairs of higher rank, so a round equals merging the
places one by one from the left. Counts of known pre-tokens are kept from batch to batch in a bounded memo.

Results for odd input: null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated
rows; an empty table gives an empty table; other columns are not read. The text of a special token counts 1, as the
library has it by default.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import pretokens, ragged


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Pair ranks of a byte-level vocabulary as sorted arrays."""

    def __init__(self, vocabulary: dict):
        model = vocabulary["model"]
        ids: dict[str, int] = model["vocab"]
        stand = byte_symbols()
        self.first = np.zeros(256, np.int64)
        for shown, byte in stand.items():
            self.first[byte] = ids[shown]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.width = max(ids.values()) + 1
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.specials = [x["content"] for x in vocabulary.get("added_tokens", []) if x.get("content")]

    def pair_places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in keys, -1 for pairs without a merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def count(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each sequence of bytes."""
        out = offsets[1:] - offsets[:-1]
        symbols = self.first[flat]
        owner = np.repeat(np.arange(len(out)), out)
        none = np.int64(len(self.keys))
        while len(symbols) > 1:
            at = self.pair_places(symbols[:-1], symbols[1:])
            at[owner[:-1] != owner[1:]] = -1
            ranks = np.append(np.where(at >= 0, self.ranks[at], none), none)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(ranks, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            active = lowest < none
            done = ~active
            out[owner[heads[done]]] = sizes[done]
            if not active.any():
                return out
            hit = (ranks == np.repeat(lowest, sizes)) & np.repeat(active, sizes)
            # Of overlapping places (a a a) every second one from the left merges.
            places = np.flatnonzero(hit)
            runs = np.append(True, np.diff(places) != 1)
            begin = places[np.flatnonzero(runs)][np.cumsum(runs) - 1]
            places = places[(places - begin) % 2 == 0]
            symbols[places] = self.made[at[places]]
            keep = np.repeat(active, sizes)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        out[owner] = 1
        return out


_loaded: dict[str, tuple[Merges, ragged.Memo]] = {}


def _count_texts(merges: Merges, memo: ragged.Memo, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    text, points, ends = ragged.codepoints(flat, offsets)
    starts, before = pretokens.byte_level(points, ends)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    stops = np.append(starts[1:], len(points))
    codes, keys, first = ragged.distinct(ragged.segment_hashes(ragged.spread(points), starts, stops))

    def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = merges.count(np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum(sizes)))
        return counts, np.arange(len(new) + 1)

    rows = memo.rows(keys, make)
    return ragged.sums(memo.flat[rows][codes].astype(np.int64), before)


def _with_specials(merges: Merges, memo: ragged.Memo, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """As _count_texts(), where the text of a special token is one token and separates what stands around it."""
    counts = _count_texts(merges, memo, flat, offsets)
    whole = flat.tobytes()
    for mark in (x.encode() for x in merges.specials):
        if mark not in whole:
            continue
        for row in range(len(counts)):
            text = whole[offsets[row] : offsets[row + 1]]
            if mark in text:
                parts = _split(text, [x.encode() for x in merges.specials])
                sizes = np.append(0, np.cumsum([len(p) for p, special in parts if not special]))
                rest = b"".join(p for p, special in parts if not special)
                counts[row] = _count_texts(merges, memo, np.frombuffer(rest, np.uint8), sizes.astype(np.int64)).sum() + sum(special for _, special in parts)
    return counts


def _split(text: bytes, marks: list[bytes]) -> list[tuple[bytes, bool]]:
    """Parts of the text between and at the leftmost, then longest, marks."""
    parts, at = [], 0
    while at < len(text):
        found = [(i, -len(m), m) for m in marks if (i := text.find(m, at)) >= 0]
        if not found:
            parts.append((text[at:], False))
            break
        i, _, mark = min(found)
        parts += [(text[at:i], False)] * (i > at) + [(mark, True)]
        at = i + len(mark)
    return parts


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Columns id, n_bytes, n_tokens, over_limit for every row of docs. No shuffle; memory is bounded by a batch."""
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    vocabulary, kinds, token = spark.sparkContext.broadcast(text), pretokens.shared(spark), hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _loaded:
            _loaded.clear()
            pretokens.adopt(kinds.value)
            _loaded[token] = (Merges(json.loads(vocabulary.value)), ragged.Memo(np.int32))
        merges, memo = _loaded[token]
        for batch in batches:
            for part in ragged.cut(batch, "text"):
                flat, offsets = ragged.utf8(part.column("text"))
                n = _with_specials(merges, memo, flat, offsets)
                yield pa.record_batch([part.column("id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
