"""Ragged numpy arrays over Arrow string columns.

All text operators see a batch as one flat array plus offsets, so that a step costs a few vectorised passes instead of
a Python call per document. Batches are cut to a bounded number of bytes first; only a single text longer than the
bound makes a larger piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"base": np.ones(1, U64), "inverse": np.ones(1, U64)}


def cut(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold about ``limit`` bytes, at least one row each."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def codepoints(flat: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """(text, code points, offsets in code points) of UTF-8 bytes."""
    text = flat.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(flat):
        return text, points, offsets
    seen = np.zeros(len(flat) + 1, np.int64)
    np.cumsum((flat & 0xC0) != 0x80, out=seen[1:])
    return text, points, seen[offsets]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["base"]) < n:
        for name, step in (("base", _BASE), ("inverse", _INVERSE)):
            grown = np.full(max(n, 1 << 16), step, U64)
            grown[0] = 1
            _powers[name] = np.cumprod(grown)
    return _powers["base"][:n], _powers["inverse"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def spread(symbols: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit value for each symbol, through a table when symbols are bytes."""
    if symbols.dtype == np.uint8:
        return mix(np.arange(1, 257, dtype=U64) * _BASE + U64(seed))[symbols]
    return mix(symbols.astype(U64) * _BASE + U64(seed + 1))


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal segments anywhere; values come from spread()."""
    base, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * base[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each, distinct values, first place of each distinct value), in order of appearance."""
    codes, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, np.asarray(values, U64), first


def gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat, offsets) of the given rows of a ragged array, one after another."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    places = np.repeat(offsets[:-1][rows] - out[:-1], lengths)
    places += np.arange(out[-1])
    return flat[places], out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each range of offsets, ranges without values giving 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Memo:
    """Remembers a ragged row of integers for each 64-bit key, up to ``limit`` keys; beyond that it starts anew."""

    def __init__(self, dtype, limit: int = 1 << 22):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, U64), np.zeros(0, np.int64)
        self.flat, self.offsets = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def rows(self, keys: np.ndarray, make) -> np.ndarray:
        """Row number of each of the distinct keys; make(places of the unknown keys) returns their (flat, offsets)."""
        if len(self.keys) + len(keys) > self.limit and len(self.keys):
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        rows = np.empty(len(keys), np.int64)
        rows[known] = self.places[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            flat, offsets = make(new)
            rows[new] = np.arange(len(new)) + len(self.offsets) - 1
            self.flat = np.concatenate([self.flat, np.asarray(flat, self.dtype)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.asarray(offsets[1:], np.int64)])
            order = np.argsort(keys[new])
            fresh = new[order]
            self.places = np.insert(self.places, at[fresh], rows[fresh])
            self.keys = np.insert(self.keys, at[fresh], keys[fresh])
        return rows


_memos: dict[str, Memo] = {}


def memo(name: str, dtype, limit: int = 1 << 20) -> Memo:
    """This worker's memo of that name, kept from task to task; workers serve one operator after another, so what they
    remembered for others goes."""
    if name not in _memos:
        _memos.clear()
        _memos[name] = Memo(dtype, limit)
    return _memos[name]
