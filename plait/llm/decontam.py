"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in normal form: lower case, with everything but letters and digits as single blanks. Benchmark items
are cut into overlapping windows of WINDOW characters (short items are one window). A window of m characters may occur in
a document with up to e = ERROR * m edits. Such an occurrence shares at least m + 1 - q (e + 1) q-grams with the window,
all within e + 1 neighbouring diagonals (document position less window position). Hits are counted in bands of diagonals
that overlap by e, bands that reach the bound are kept, and a banded alignment of the window to the text below the band
decides. So no occurrence within the budget is missed, and none beyond it is reported.

The benchmark is sent to all tasks in blocks of at most SHARE characters, whose index takes about 90 bytes a character;
a larger benchmark takes several passes over the documents, written between, so that one block is in memory at a time.
Documents are neither shuffled nor gathered, so an item that a third of all documents hold costs nothing special.

Results for odd input: null and empty texts have no leaks; items that are null or have fewer than q characters in normal
form take no part; items that share an id are searched each; repeated documents give repeated rows; empty tables give no
leaks; all other columns of docs are kept and a column named leaks is replaced. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens, ragged, scratch

Q, ERROR = 10, 0.08
WINDOW, STEP = 80, 20
SHARE = 1 << 19
_BITS = 22


def normal(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points in normal form, offsets, place of each in the text's own code points)."""
    text, points, ends = ragged.codepoints(flat, offsets)
    if not len(points):
        return points, ends, np.zeros(0, np.int64)
    low = np.frombuffer(text.replace("İ", "i").lower().replace("ς", "σ").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = pretokens.classes()[low]
    word = (kind == pretokens.LETTER) | (kind == pretokens.NUMBER)
    first = np.zeros(len(points) + 1, bool)
    first[ends] = True
    keep = word.copy()
    keep[1:] |= word[:-1] & ~first[1:-1]  # a blank after each word
    places = np.flatnonzero(keep)
    out = np.where(word, low, 0x20).astype(np.uint32)[places]
    return out, np.searchsorted(places, ends), places


class Windows:
    """The windows of benchmark items, and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, error: float = ERROR):
        self.q = q
        self.item: list[int] = []
        parts: list[np.ndarray] = []
        points, offsets, _ = normal(*ragged.utf8(pa.array([t for _, t in items], pa.string()))) if items else (np.zeros(0, np.uint32), np.zeros(1, np.int64), None)
        for i, (name, _) in enumerate(items):
            own = points[offsets[i] : offsets[i + 1]]
            own = own[: len(own) - 1] if len(own) and own[-1] == 0x20 else own
            if len(own) < q:
                continue
            starts = [0] if len(own) <= WINDOW else [*range(0, len(own) - WINDOW, STEP), len(own) - WINDOW]
            for s in starts:
                self.item.append(name)
                parts.append(own[s : s + WINDOW])
        self.length = np.array([len(p) for p in parts], np.int64)
        self.edits = np.minimum((error * self.length).astype(np.int64), (self.length - q) // q)
        self.bound = self.length + 1 - q * (self.edits + 1)
        self.step = np.int64(1) << np.ceil(np.log2(self.edits + 1)).astype(np.int64)
        self.points = np.zeros((len(parts), WINDOW), np.uint32)
        for i, p in enumerate(parts):
            self.points[i, : len(p)] = p
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        ends = np.append(0, np.cumsum(self.length)).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), self.length)
        at = np.arange(len(flat)) - ends[:-1][owner] if parts else np.zeros(0, np.int64)
        whole = np.flatnonzero(at <= self.length[owner] - q) if parts else np.zeros(0, np.int64)
        grams = ragged.segment_hashes(ragged.spread(flat), whole, whole + q)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.offsets = np.append(first, len(grams)).astype(np.int64)
        self.owner, self.at = owner[whole][order], at[whole][order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def regions(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, window, first diagonal) of the bands that reach the bound; diagonals are relative to the whole array."""
        if len(points) < self.q or not len(self.grams):
            return (np.zeros(0, np.int64),) * 3
        starts = np.arange(len(points) - self.q + 1)
        hashes = ragged.segment_hashes(ragged.spread(points), starts, starts + self.q)
        found = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, hashes[found]), len(self.grams) - 1)
        real = self.grams[at] == hashes[found]
        found, at = found[real], at[real]
        text = np.searchsorted(offsets, found, "right") - 1
        inside = found + self.q <= offsets[text + 1]
        found, at, text = found[inside], at[inside], text[inside]
        counts = self.offsets[at + 1] - self.offsets[at]
        rows, _ = ragged.gather(np.arange(len(self.owner)), self.offsets, at)
        window, place = self.owner[rows], np.repeat(found, counts)
        text = np.repeat(text, counts)
        diagonal = place - self.at[rows] + WINDOW  # never negative
        band = diagonal // self.step[window]
        lower = diagonal - band * self.step[window] < self.edits[window]  # also within the band below
        text, window, band = (np.concatenate([x, y[lower]]) for x, y in ((text, text), (window, window), (band, band - 1)))
        order = np.lexsort((band, window, text))
        text, window, band = text[order], window[order], band[order]
        if not len(text):
            return (np.zeros(0, np.int64),) * 3
        heads = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(window) != 0) | (np.diff(band) != 0)))
        enough = np.diff(np.append(heads, len(text))) >= self.bound[window[heads]]
        heads = heads[enough]
        return text[heads], window[heads], band[heads] * self.step[window[heads]] - WINDOW

    def align(self, points: np.ndarray, offsets: np.ndarray, text: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Least edits of each window within the band of its region, by dynamic programming over the band."""
        out = np.full(len(text), 1 << 30, np.int64)
        for a in range(0, len(text), 4096):
            t, w, d = text[a : a + 4096], window[a : a + 4096], diagonal[a : a + 4096]
            width = int((self.step + self.edits)[w].max()) + 1
            inside = np.arange(width)[None, :] < (self.step + self.edits)[w][:, None] + 1
            cost = np.where(inside, 0, 1 << 20)
            low, high = offsets[t], offsets[t + 1]
            ramp = np.arange(width)
            for j in range(int(self.length[w].max())):
                place = d[:, None] + j + ramp
                real = (place >= low[:, None]) & (place < high[:, None])
                seen = points[np.clip(place, 0, len(points) - 1)]
                step = cost + np.where(real & (seen == self.points[w, min(j, WINDOW - 1)][:, None]), 0, 1)
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                step = np.minimum.accumulate(step - ramp, axis=1) + ramp
                step[~inside] = 1 << 20
                cost = np.where((j < self.length[w])[:, None], step, cost)
            out[a : a + 4096] = cost.min(axis=1)
        return out

    def leaks(self, flat: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """For each text the items found: their least edits, and the code points of the text they cover."""
        points, ends, places = normal(flat, offsets)
        text, window, diagonal = self.regions(points, ends)
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        if not len(text):
            return out
        edits = self.align(points, ends, text, window, diagonal)
        heads = ragged.codepoints(flat, offsets)[2]
        best: dict[tuple[int, int], dict] = {}
        for t, w, d, e in zip(text.tolist(), window.tolist(), diagonal.tolist(), edits.tolist(), strict=True):
            if e > self.edits[w]:
                continue
            a, b = max(d, int(ends[t])), min(d + int(self.length[w] + self.step[w] + self.edits[w]), int(ends[t + 1])) - 1
            begin, end = int(places[a] - heads[t]), int(places[b] - heads[t]) + 1
            one = best.setdefault((t, self.item[w]), {"item_id": self.item[w], "edits": e, "start": begin, "end": end})
            one.update(edits=min(one["edits"], e), start=min(one["start"], begin), end=max(one["end"], end))
        for (t, _), one in sorted(best.items(), key=lambda x: x[0]):
            out[t].append(one)
        return out


_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with a column leaks: array<struct<item_id, edits, start, end>>. No shuffle."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("i"), benchmark[item_text_col].alias("t")).filter("i is not null and t is not null")
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // SHARE))
    docs, kinds = docs.drop("leaks"), pretokens.shared(spark)
    plain = docs.schema
    done = docs.withColumn("leaks", F.array().cast("array<struct<item_id:long,edits:long,start:long,end:long>>"))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i", "t").collect()  # SHARE characters or so
        shared = spark.sparkContext.broadcast(Windows([(r.i, r.t) for r in part]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pretokens.adopt(kinds.value)
            for batch in batches:
                for piece in ragged.cut(batch, text_col):
                    found = shared.value.leaks(*ragged.utf8(piece.column(text_col)))
                    before = piece.column("leaks").to_pylist()
                    columns = [piece.column(c) for c in plain.names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([x + y for x, y in zip(before, found, strict=True)], _KIND)], [*plain.names, "leaks"])

        done = done.mapInArrow(run, T.StructType([*plain.fields, done.schema["leaks"]]))
        if b < blocks - 1:
            done = scratch.write(done, "leaks")
            shared.unpersist()
    return done
