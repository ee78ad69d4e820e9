"""Suffix-array dedup: removes bytes covered by a string of WIDTH bytes that also starts earlier.

1. Texts equal to one of a smaller id are covered as a whole and leave.
2. Every string of WIDTH bytes is filed under its anchor, the least hash among its GRAM-byte substrings. Equal strings
   have equal anchors, and neighbouring strings share theirs, so a record is an anchor with a run of starts and the
   bytes under them. Records move once, as hashes, by anchor; of equal records all but the first are covered whole, as
   equal texts are. Bytes move only for the distinct records of anchors that have several. Anchors that a sample shows
   to be hot are dealt further, by the least hashes in ORDERS orders, and their rows are summed before they move.
3. These are dealt to shards by anchor, in order of document and place, and each shard's suffixes are sorted by
   induction: the leftmost smaller (LMS) suffixes are ordered, then queues of suffixes, one for each leading byte and
   filled in order, induce all others, from left to right and back. Queues carry places and common-prefix values and
   lie on disk beyond SPILL bytes, as the text does; neighbours with a common prefix of WIDTH bytes form groups whose
   first stays. A shard larger than SHARD, of one anchor with many surroundings, takes a few bytes of memory a byte.

Order matters to a depth of WIDTH bytes only, so LMS suffixes are ordered by refinement in words of eight bytes to that
depth, in place of a recursion on names (see the README).

Results for odd input: null and empty texts have no bytes and stay; rows with a null id neither lose bytes nor count
against others; rows that share an id share the spans found in any of them, as far as their text goes; an empty table
gives an empty table; other columns are not read. Matches never cross texts, which are taken whole.
"""

from __future__ import annotations

import collections
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged, scratch

WIDTH, GRAM = 100, 40
SHARD = 1 << 21
SPILL = 1 << 23
CHUNK = 1 << 19
SAMPLE, HEAVY, ORDERS = 64, 1024, 4
SLOTS = 1 << 18


class Queue:
    """Places and common-prefix values of one leading symbol, in order. What all queues of a task hold beyond SPILL bytes
    lies in files of that task's own, without a name, that go with it like Spark's own spill files; a lost task is done
    again from its input. Chunks come back one at a time."""

    held = 0

    def __init__(self):
        self.chunks: collections.deque = collections.deque()

    def put(self, places: np.ndarray, common: np.ndarray) -> None:
        size = places.nbytes + common.nbytes
        if Queue.held + size > SPILL:
            last = self.chunks[-1] if self.chunks else None
            if not isinstance(last, list) or last[1] >= CHUNK:
                last = [tempfile.TemporaryFile(), 0, []]
                self.chunks.append(last)
            last[0].write(places.tobytes() + common.tobytes())
            last[1] += len(places)
            last[2].append(len(places))
        else:
            Queue.held += size
            self.chunks.append((places, common))

    @staticmethod
    def _load(chunk) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(chunk, tuple):
            Queue.held -= chunk[0].nbytes + chunk[1].nbytes
            return chunk
        f, _, sizes = chunk
        f.seek(0)
        data, out, at = f.read(), [], 0
        f.close()
        for n in sizes:
            out.append((np.frombuffer(data, np.int64, n, at), np.frombuffer(data, np.uint8, n, at + 8 * n)))
            at += 9 * n
        return np.concatenate([p for p, _ in out]), np.concatenate([c for _, c in out])

    def take(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The first chunks, of about CHUNK places; None when there are none."""
        out, n = [], 0
        while self.chunks and n < CHUNK:
            out.append(self._load(self.chunks.popleft()))
            n += len(out[-1][0])
        return (np.concatenate([p for p, _ in out]), np.concatenate([c for _, c in out])) if out else None

    def take_last(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The last chunk."""
        return self._load(self.chunks.pop()) if self.chunks else None


def _kinds(text: np.ndarray) -> np.ndarray:
    """1 for S-type suffixes (smaller than the next), 0 for others; the last counts as S. Made from the right, a chunk at
    a time."""
    n = len(text)
    out = np.ones(n, np.uint8)
    after = np.uint8(1)  # the type of the place behind the chunk
    for a in range((n - 2) // CHUNK * CHUNK, -1, -CHUNK):
        here, there = text[a : min(a + CHUNK, n - 1)], text[a + 1 : min(a + CHUNK, n - 1) + 1]
        m = len(here)
        # The next place whose successor differs decides; behind the last one, what follows the chunk does.
        decides = np.append(np.flatnonzero(here != there), m)
        value = np.append((here < there)[decides[:-1]].astype(np.uint8), after)
        out[a : a + m] = np.repeat(value, np.diff(np.append(-1, decides)))[:m]
        after = out[a]
    return out


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight symbols from each place, the first highest; zeros beyond the end."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        inside = at + k < len(text)
        out = (out << np.uint64(8)) | np.where(inside, text[np.where(inside, at + k, 0)], 0).astype(np.uint64)
    return out


def _shared(text: np.ndarray, a: int, b: int, depth: int) -> int:
    """Common prefix of two suffixes, up to depth."""
    n = min(depth, len(text) - max(a, b))
    differs = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differs[0]) if len(differs) else n


def _order(text: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places ordered by their first depth symbols, common prefix of each with the one before)."""
    n = len(places)
    common = np.zeros(n, np.uint8)
    if not n:
        return places, common
    group = np.zeros(n, np.int64)  # by rank of the first member
    live = np.arange(n)
    out = places.copy()
    for k in range(0, depth, 8):
        key = _words(text, out[live] + k)
        order = np.lexsort((key, group[live]))
        out[live] = out[live][order]  # live places are contiguous within each group
        key, own = key[order], group[live]
        same = own[1:] == own[:-1]
        split = key[1:] != key[:-1]
        cut = np.flatnonzero(same & split)
        if len(cut):
            lead = key[1:][cut] ^ key[:-1][cut]
            high = np.zeros(len(cut), np.int64)
            for bits in (32, 16, 8):
                big = (lead >> np.uint64(bits)) > 0
                high += np.where(big, bits, 0)
                lead = np.where(big, lead >> np.uint64(bits), lead)
            common[live[1:][cut]] = np.minimum(k + 7 - high // 8, depth)
        begins = np.append(True, ~same | split)
        heads = live[np.flatnonzero(begins)]
        sizes = np.diff(np.append(np.flatnonzero(begins), len(live)))
        group[live] = np.repeat(heads, sizes)
        live = live[np.repeat(sizes > 1, sizes)]
        if not len(live):
            break
    if len(live):
        tied = live[np.append(False, group[live][1:] == group[live][:-1])]
        common[tied] = depth
    return out, common


class _Minima:
    """Minimum of values over ranges, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            last, half = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over values[a:b], for a < b."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for k in range(len(self.rows)):
            own = np.flatnonzero(level == k)
            if len(own):
                out[own] = np.minimum(self.rows[k][a[own]], self.rows[k][b[own] - 2**k])
        return out


class _Pass:
    """One pass of induction over buckets of leading symbols."""

    def __init__(self, text: np.ndarray, s_type: np.ndarray, depth: int, to_s: bool):
        self.text, self.s_type, self.depth, self.to_s = text, s_type, depth, to_s
        self.queues = [Queue() for _ in range(256)]
        self.since = np.zeros(256, np.uint8)  # least common prefix since the last suffix induced into a bucket

    def feed(self, places: np.ndarray, common: np.ndarray) -> None:
        """Induces the suffixes one place to the left of sorted suffixes; common: with the suffix fed before."""
        if not len(places):
            return
        left = np.maximum(places - 1, 0)
        takes = (places > 0) & ((self.s_type[left] == 1) == self.to_s)
        index = np.flatnonzero(takes)
        symbols = self.text[left[index]]
        order = np.argsort(symbols, kind="stable")
        index, symbols = index[order], symbols[order]
        table = _Minima(common)
        if len(index):
            first = np.append(True, symbols[1:] != symbols[:-1])
            begin = np.where(first, 0, np.append(0, index[:-1] + 1))
            least = table.of(begin, index + 1)
            heads = np.flatnonzero(first)
            least[heads] = np.minimum(least[heads], self.since[symbols[heads]])
            made = np.minimum(least.astype(np.int64) + 1, self.depth).astype(np.uint8)
            ends = np.append(heads[1:], len(index))
            for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
                self.queues[symbols[a]].put(left[index[a:b]], made[a:b])
        self.since = np.minimum(self.since, common.min())
        if len(index):
            last = index[ends - 1]
            rest = last + 1 < len(places)
            after = np.full(len(last), 255, np.uint8)
            after[rest] = table.of(last[rest] + 1, np.full(int(rest.sum()), len(places)))
            self.since[symbols[heads]] = after


def suffix_groups(text: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefix with the suffix before, up to depth) of all suffixes in order, by descending leading
    symbol and, within, from the last to the first; text must end with a 0 that is its least symbol."""
    s_type = _kinds(text)
    starts = np.flatnonzero(s_type[1:] > s_type[:-1]) + 1
    lms, lms_common = _order(text, starts, depth)
    bounds = np.searchsorted(text[lms], np.arange(257))

    def seam(a: int, b: int) -> int:
        return _shared(text, a, b, depth) if a >= 0 else 0

    # From left to right: L-type suffixes, from those before them in order.
    right = _Pass(text, s_type, depth, False)
    larger = [Queue() for _ in range(256)]
    previous = -1  # the suffix fed last
    for symbol in range(256):
        while (wave := right.queues[symbol].take()) is not None:
            places, common = wave[0], wave[1].copy()
            common[0] = seam(previous, int(places[0]))  # what comes first of a wave lies behind the suffix fed before it
            larger[symbol].put(places, common)
            right.feed(places, common)
            previous = int(places[-1])
        for a in range(int(bounds[symbol]), int(bounds[symbol + 1]), CHUNK):
            b = min(a + CHUNK, int(bounds[symbol + 1]))
            own, common = lms[a:b], lms_common[a:b].copy()
            common[0] = seam(previous, int(own[0]))
            right.feed(own, common)
            previous = int(own[-1])
    # From right to left: S-type suffixes, from those behind them; common is with the suffix fed before, further right.
    left = _Pass(text, s_type, depth, True)
    previous = -1
    for symbol in range(255, -1, -1):
        while (wave := left.queues[symbol].take()) is not None:
            places, common = wave[0], wave[1].copy()
            common[0] = seam(previous, int(places[0]))
            yield places, common
            left.feed(places, common)
            previous = int(places[-1])
        while (wave := larger[symbol].take_last()) is not None:
            places, common = wave[0][::-1], np.append(np.uint8(0), wave[1][::-1][:-1])  # now with the suffix further right
            common[0] = seam(previous, int(places[0]))
            left.feed(places, common)
            previous = int(places[-1])
            yield places, common


def repeated_starts(records: list[bytes], starts: list[int], width: int) -> np.ndarray:
    """Marks, for starts 0..n-1 of all records one after another, those whose string of width bytes starts earlier in
    the list. Bytes are shifted by one so that 0 ends records; byte 255 does not occur in UTF-8. The text lies in a file
    of the task's own that is mapped, as the suffixes to the left of sorted ones are read from all over it."""
    sizes = np.fromiter(map(len, records), np.int64, len(records)) + 1
    ends = np.cumsum(sizes)
    many = np.asarray(starts, np.int64)
    first, number = ends - sizes, np.append(0, np.cumsum(many))
    out = np.zeros(int(number[-1]), bool)
    held: np.ndarray = np.zeros(0, np.int64)  # the unfinished group

    def close(places: np.ndarray, heads: np.ndarray) -> None:
        least = np.minimum.reduceat(places, heads)
        late = places[places != np.repeat(least, np.diff(np.append(heads, len(places))))]
        owner = np.searchsorted(ends, late, "right")
        inside = late - first[owner]
        begins = inside < many[owner]
        out[number[owner[begins]] + inside[begins]] = True

    with tempfile.TemporaryFile() as f:
        for r in records:
            f.write(r + b"\xff")
        f.flush()
        text = np.memmap(f, np.uint8, "r+", shape=(int(ends[-1]),))
        for a in range(0, len(text), CHUNK):
            text[a : a + CHUNK] += np.uint8(1)
        for places, common in suffix_groups(text, width):
            heads = np.flatnonzero(common < width) + len(held)
            places = np.concatenate([held, places])
            heads = np.append(0, heads[heads > 0])
            cut = int(heads[-1])
            if cut:
                close(places[:cut], heads[:-1])
            held = places[cut:]
        if len(held):
            close(held, np.zeros(1, np.int64))
        del text
    return out


def _least(keys: np.ndarray, span: int, count: int) -> np.ndarray:
    """Least of keys[i : i + span] for i below count."""
    size = -(-len(keys) // span) * span
    blocks = np.append(keys, np.full(size - len(keys), np.iinfo(np.uint64).max, np.uint64)).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[span - 1 : span - 1 + count])


def _anchors(flat: np.ndarray, offsets: np.ndarray, width: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start in it, number of starts, anchor, hash of the bytes, whether the anchor is hot) of the runs of
    starts with one anchor. Starts with a hot anchor are dealt further by their least hashes in other orders."""
    n, span = len(flat), width - GRAM + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    if n < width:
        return none
    places = np.arange(n - GRAM + 1)
    hashes = ragged.segment_hashes(ragged.spread(flat), places, places + GRAM)
    low = np.uint64(max(20, int(n).bit_length()))
    mask = (np.uint64(1) << low) - np.uint64(1)
    count = n - width + 1
    text = np.searchsorted(offsets, np.arange(count), "right") - 1
    starts = np.flatnonzero(np.arange(count) + width <= offsets[text + 1])
    if not len(starts):
        return none

    # For every start the place of its least hash, the leftmost of equals.
    text, at = text[starts], (_least((hashes >> low << low) | places.astype(np.uint64), span, count)[starts] & mask).astype(np.int64)
    anchor = hashes[at]
    is_hot = np.isin(anchor, hot) if len(hot) else np.zeros(len(anchor), bool)
    if is_hot.any():
        # The substrings below runs of hot starts, one run after another.
        own = starts[is_hot]
        heads = np.flatnonzero(np.append(True, np.diff(own) != 1))
        sizes = np.diff(np.append(heads, len(own)))
        before = np.append(0, np.cumsum(sizes + span - 1))
        below = np.repeat(own[heads] - before[:-1], sizes + span - 1) + np.arange(before[-1])
        inside = np.arange(len(own)) + np.repeat(np.arange(len(heads)) * (span - 1), sizes)
        for k in range(1, ORDERS):
            order = ragged.mix(hashes[below] ^ np.uint64(0x9E37 * k))
            key = (order >> low << low) | np.arange(len(below), dtype=np.uint64)
            first = (_least(key, span, len(below) - span + 1)[inside] & mask).astype(np.int64)
            anchor[is_hot] = ragged.mix(anchor[is_hot] + hashes[below[first]] * np.uint64(2 * k + 1))
    split = np.append(True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (~is_hot[1:] & (at[1:] != at[:-1])))
    heads = np.flatnonzero(split)
    runs = np.diff(np.append(heads, len(starts)))
    begin = starts[heads]
    record = ragged.segment_hashes(ragged.spread(flat, 99), begin, begin + runs + width - 1)
    return text[heads], begin - offsets[text[heads]], runs, anchor[heads], record, is_hot[heads]


def _runs(docs: DataFrame, width: int, hot: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.cut(batch, "text"):
                text, start, many, anchor, record, is_hot = _anchors(*ragged.utf8(part.column("text")), width, hot)
                yield pa.record_batch(
                    [pa.array(anchor.view(np.int64)), pa.array(record.view(np.int64)), part.column("id").take(pa.array(text)), pa.array(start), pa.array(many.astype(np.int32)), pa.array(is_hot)],
                    ["anchor", "record", "id", "start", "many", "hot"],
                )

    return docs.mapInArrow(run, "anchor long, record long, id long, start long, many int, hot boolean")


def _hot_anchors(docs: DataFrame, width: int) -> np.ndarray:
    """Anchors that a sample of the texts, one in SAMPLE by hash of id, shows with more than a HEAVY-th of its rows: HEAVY
    at most. They take another way to the same result, so the sample decides on speed alone."""
    sample = scratch.write(_runs(docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), width, np.zeros(0, np.uint64)).select("anchor"), "sample")
    rows = sample.count()
    found = sample.groupBy("anchor").agg(F.count("*").alias("n")).filter((F.col("n") * HEAVY > rows) & (F.col("n") > 16))
    return np.array([r.anchor for r in found.select("anchor").collect()], np.int64).view(np.uint64)  # HEAVY numbers at most


def _hot_repeated(runs: DataFrame) -> DataFrame:
    """What _repeated() gives, for rows of hot anchors: rows of a record are summed up before they are shuffled, and
    those of the HEAVY most common records are told from their first row by a table that is sent to all tasks."""
    firsts = scratch.write(runs.groupBy("anchor", "record").agg(F.min(F.struct("id", "start", "many")).alias("first"), F.count("*").alias("n")), "hot-records")
    rows = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    several = firsts.groupBy("anchor").agg(F.count("*").alias("records")).filter("records > 1")
    many = F.col("n") * HEAVY > rows
    common = firsts.filter(many).select("anchor", "record", "first.id", "first.start").collect()  # fewer than HEAVY rows
    shared = runs.sparkSession.sparkContext.broadcast({(r.anchor, r.record): (r.id, r.start) for r in common})
    names = ["anchor", "record", "id", "start", "many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of common records other than the first (again), and all rows of other records (not again)."""
        table = sorted(shared.value.items())
        pairs = np.array([k for k, _ in table], np.int64).reshape(-1, 2)
        first = np.array([v for _, v in table], np.int64).reshape(-1, 2)
        keys = ragged.mix(pairs[:, 0].view(np.uint64) + ragged.mix(pairs[:, 1].copy().view(np.uint64))) if len(pairs) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        for batch in batches:
            anchor, record, name, start = (batch.column(c).to_numpy() for c in names[:4])
            own = ragged.mix(anchor.view(np.uint64) + ragged.mix(record.view(np.uint64)))
            at = order[np.minimum(np.searchsorted(keys[order], own), len(keys) - 1)] if len(keys) else np.zeros(len(own), np.int64)
            known = (pairs[at] == np.stack([anchor, record], axis=1)).all(axis=1) if len(keys) else np.zeros(len(own), bool)
            is_first = known & (first[at] == np.stack([name, start], axis=1)).all(axis=1) if len(keys) else known
            keep = pa.array(~is_first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in names), pa.array(known[~is_first])], [*names, "again"])

    told = scratch.write(runs.select(*names).mapInArrow(run, "anchor long, record long, id long, start long, many int, again boolean"), "hot-told")
    twice = firsts.filter((F.col("n") > 1) & ~many).select("anchor", "record", "first")
    rest = told.filter("not again").drop("again").join(twice, ["anchor", "record"]).filter(F.struct("id", "start") > F.struct("first.id", "first.start"))
    again = told.filter("again").unionByName(rest.select(*names, F.lit(True).alias("again")))
    return again.unionByName(firsts.join(several, "anchor").select("anchor", "record", "first.id", "first.start", "first.many", F.lit(False).alias("again")))


def _repeated(runs: DataFrame) -> DataFrame:
    """Of runs whose anchor occurs twice: later rows of a record (again), and first rows where the anchor has several
    records. A partition streams through in order of anchor, record, id and start."""
    names = ["anchor", "record", "id", "start", "many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # first rows of the last anchor's records, one unless it has several
        last = (None, None)
        several = False

        def marked(rows, again: bool):
            return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() if isinstance(rows, pa.Table) else rows.column(c) for c in names), pa.array([again] * rows.num_rows, pa.bool_())], [*names, "again"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, record = (batch.column(c).to_numpy() for c in ("anchor", "record"))
            new_anchor = np.append(last[0] is None or anchor[0] != last[0], anchor[1:] != anchor[:-1])
            new_record = new_anchor | np.append(last[1] is None or record[0] != last[1], record[1:] != record[:-1])
            if not new_record.all():
                yield marked(batch.filter(pa.array(~new_record)), True)
            firsts = np.flatnonzero(new_record)
            group = np.cumsum(new_anchor)[firsts]  # 0: the anchor of the batch before
            sizes = np.bincount(group, minlength=int(new_anchor.sum()) + 1)
            end = len(sizes) - 1
            out = sizes[group] > 1
            if sizes[0] and held is not None:
                out[group == 0] = True
                if not several:
                    yield marked(held, False)
                several = True
            elif sizes[0]:
                out[group == 0] = True  # the anchor's earlier rows are out already
            if end:  # the last anchor may go on in the next batch
                several = bool(sizes[end] > 1)
                held = None if several else pa.Table.from_batches([batch.slice(int(firsts[-1]), 1)])
            elif several:
                held = None
            if out.any():
                yield marked(batch.take(pa.array(firsts[out])), False)
            last = (anchor[-1], record[-1])

    dealt = runs.select(*names).repartition("anchor").sortWithinPartitions("anchor", "record", "id", "start")
    return dealt.mapInArrow(run, "anchor long, record long, id long, start long, many int, again boolean")


def _sieve(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of docs that may be among ids, rows that are not), by a table of SLOTS numbers at most."""
    slots = F.broadcast(ids.select(F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("slot")).distinct())
    own = docs.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)))
    return own.join(slots, "slot", "left_semi").drop("slot"), own.join(slots, "slot", "left_anti").drop("slot")


def _records(docs: DataFrame, width: int, shards: int) -> DataFrame:
    """docs with runs array<struct<start, many, anchor>> to rows with bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text, runs in zip(*(batch.column(c) for c in ("id", "text", "runs")), strict=True):
                data, rows = text.as_py().encode("utf-8", "surrogatepass"), runs.as_py()
                pieces = [data[r["start"] : r["start"] + r["many"] + width - 1] for r in rows]
                n = len(rows)
                yield pa.record_batch(
                    [pa.array([r["anchor"] % shards for r in rows], pa.int64()), pa.array([name.as_py()] * n, pa.int64()), pa.array([r["start"] for r in rows], pa.int64()), pa.array([r["many"] for r in rows], pa.int32()), pa.array(pieces, pa.binary())],
                    ["shard", "id", "start", "many", "bytes"],
                )

    return docs.mapInArrow(run, "shard long, id long, start long, many int, bytes binary")


def _spans(records: DataFrame, width: int) -> DataFrame:
    """Spans (id, start, stop) covered by strings that start earlier among the records of a shard."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        late = repeated_starts([r[3] for r in rows], [r[2] for r in rows], width)
        many = np.array([r[2] for r in rows])
        owner = np.repeat(np.arange(len(rows)), many)
        place = np.array([r[1] for r in rows])[owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
        hit = np.flatnonzero(late)
        if not len(hit):
            return pa.record_batch([pa.array([], pa.int64())] * 3, ["id", "start", "stop"])
        heads = np.append(True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]]))
        first = hit[heads]
        last = hit[np.append(np.flatnonzero(heads)[1:] - 1, len(hit) - 1)]
        names = np.array([r[0] for r in rows])[owner[first]]
        return pa.record_batch([pa.array(names), pa.array(place[first]), pa.array(place[last] + width)], ["id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "start", "many", "bytes")), strict=True):
                if s != shard:
                    if rows:
                        yield solve(rows)
                    shard, rows = s, []
                rows.append(tuple(row))
        if rows:
            yield solve(rows)

    return records.repartition("shard").sortWithinPartitions("shard", "id", "start").mapInArrow(run, "id long, start long, stop long")


def _cut(docs: DataFrame) -> DataFrame:
    """docs with spans array<struct<start, stop>> to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in ragged.cut(batch, "text")):
            out = []
            for name, text, spans in zip(*(part.column(c) for c in ("id", "text", "spans")), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, at, removed, count = [], 0, 0, 0
                begin = end = -1
                for x in [*sorted((x["start"], min(x["stop"], len(data))) for x in spans.as_py() or [] if x["start"] < len(data)), (len(data) + 1, 0)]:
                    if x[0] <= end:
                        end = max(end, x[1])
                        continue
                    if end > begin:
                        kept.append(data[at:begin])
                        at, removed, count = end, removed + end - begin, count + 1
                    begin, end = x
                kept.append(data[at:])
                out.append((name.as_py(), len(data), removed, count, b"".join(kept)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_bytes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for every row of docs."""
    if width < GRAM + 8:
        raise ValueError(f"width must be {GRAM + 8} at least")
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    keys = texts.filter("id is not null").filter(F.octet_length("text") >= width).select("id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(3), "text").alias("h2"))
    firsts = scratch.write(keys.groupBy("size", "h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("top"), F.count("*").alias("n")).filter("first < top"), "copied")
    # Groups of more than a HEAVY-th of all copies, so fewer than HEAVY, meet their copies by broadcast.
    rows = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    heavy = F.broadcast(firsts.filter(F.col("n") * HEAVY > rows).drop("top", "n"))
    on = ["size", "h1", "h2"]
    met = keys.join(heavy, on).unionByName(keys.join(heavy, on, "left_anti").join(firsts.filter(F.col("n") * HEAVY <= rows).drop("top", "n"), on))
    copies = scratch.write(met.filter("id > first").select("id", "size").distinct(), "copies")
    maybe, rest = _sieve(texts.filter("id is not null"), copies)
    own = rest.unionByName(maybe.join(copies, "id", "left_anti"))

    hot = _hot_anchors(own, width)
    runs = _runs(own, width, hot)
    if len(hot):
        runs = scratch.write(runs, "anchors")
        found = scratch.write(_repeated(runs.filter("not hot")).unionByName(_hot_repeated(runs.filter("hot").drop("hot"))), "runs")
    else:
        found = scratch.write(_repeated(runs), "runs")
    need = found.filter("not again")
    size = need.agg(F.coalesce(F.sum(F.col("many") + (width - 1)), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-size // SHARD))
    by_doc = need.groupBy("id").agg(F.collect_list(F.struct("start", "many", "anchor")).alias("runs"))
    searched, _ = _sieve(own, need.select("id"))
    partial = _spans(_records(searched.join(by_doc, "id"), width, shards), width)
    whole = found.filter("again").select("id", "start", (F.col("start") + F.col("many") + (width - 1)).alias("stop"))
    every = partial.unionByName(whole).unionByName(copies.select("id", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop")))
    spans = scratch.write(every.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    touched, clean = _sieve(texts, spans)
    cut = _cut(touched.join(spans, "id", "left").unionByName(clean.withColumn("spans", F.lit(None).cast("array<struct<start:long,stop:long>>"))))
    return cut.withColumnRenamed("id", id_col)
