"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of word shingles; two link when their Jaccard similarity reaches num / den. Documents with equal sets
are one class, under its smallest id. Classes that can link must share one of the first |x| - ceil(num |x| / den) + 1
shingles of both, in any one order of all shingles. The order here is by hash, with the most frequent shingles found
(HOT of them at most) put last, so that prefixes are made of rare ones. Classes of like size that share a prefix shingle
are members of the group of the smallest of them. Members that cannot link with any other by the bounds on size and on
the parity sketch (a bit for every two shingles; it differs in no more bits than the sets differ in shingles) leave
(groups beyond SIEVE members, and beyond LARGE that are a HEAVY-th of all, are left as they are); the others go to their
groups with their whole sets.

Within a group an inverted index answers T-occurrence queries: the T - 1 longest lists of a query are left out of the
merge, the short rest is heap-merged into candidates, and candidates are looked up in the long lists by binary search
until they reach T or cannot any more. A group is done when all classes that have not been queried are known to be
connected, so a group of near copies costs a few queries, not all pairs; what comes out are links that connect
everything that is connected. Groups beyond BLOCK shingles are dealt to blocks: each block links its classes with the
group's centre and with each other, and only what stays apart from the centre is then searched in all other blocks.
Nothing is capped.

Results for odd input: null texts, empty texts and texts of white space have no shingles and link with nothing, so they
are their own component; rows with a null id are counted but link with nothing and have a null component; rows that
share an id are linked through it only if their sets link; an empty table gives an empty table; other columns are not
read. Texts are read whole; a text's own set must fit a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged, scratch

HOT = 1 << 18
RARE = 16
BLOCK = 1 << 21
SIEVE, HEAVY, LARGE = 4096, 1024, 1024


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ragged sorted distinct shingle hashes of texts: words between ASCII white space, A-Z in lower case."""
    white = (flat == 32) | ((flat >= 9) & (flat <= 13))
    lower = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.flatnonzero(~white & (np.append(True, white[:-1]) | edge[:-1]))
    stops = np.flatnonzero(~white & (np.append(white[1:], True) | edge[1:])) + 1
    words = ragged.segment_hashes(ragged.spread(lower), starts, stops)
    before = np.searchsorted(starts, offsets)
    counts = np.diff(before)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(before[1:], counts) - np.arange(len(words))  # words from here to the end of the text
    whole = np.minimum(counts, width)[owner] if len(words) else owner
    first = (left >= width) | (left == counts[owner])
    value = np.zeros(len(words), np.uint64)
    for k in range(width):
        reach = np.flatnonzero(left > k)
        take = reach[whole[reach] > k]
        value[take] = ragged.mix(value[take] * np.uint64(0x9E3779B97F4A7C15) + words[take + k])
    value = ragged.mix(value + whole.astype(np.uint64))
    value, owner = value[first], owner[first]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) if len(value) else np.zeros(0, bool)
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def prefix_sizes(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n + (-n * num) // den + 1, 0)


class Inverted:
    """An inverted index over a few sets; answers which of them reach the required overlap with one of them."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, num: int, den: int):
        self.num, self.den, self.offsets = num, den, offsets
        _, self.tokens = np.unique(values, return_inverse=True)
        self.sizes = np.diff(offsets)
        order = np.argsort(self.tokens, kind="stable")
        self.members = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]  # ascending in every list
        self.bounds = np.append(0, np.cumsum(np.bincount(self.tokens)))
        self.sorted = [np.sort(self.tokens[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def lists(self, i: int) -> np.ndarray:
        return self.bounds[self.sorted[i] + 1] - self.bounds[self.sorted[i]]

    def query(self, i: int, skip: np.ndarray) -> list[int]:
        """Sets that reach the threshold with set i, leaving out those marked in skip."""
        own, a = self.sorted[i], int(self.sizes[i])
        least = -(-self.num * a // self.den)  # the overlap that any partner needs
        order = np.argsort(self.lists(i), kind="stable")
        short, long = own[order[: a - least + 1]], np.sort(own[order[a - least + 1 :]])
        pieces = [self.members[self.bounds[t] : self.bounds[t + 1]] for t in short.tolist()]
        if sum(map(len, pieces)) <= 2048:
            found: dict[int, int] = {}
            for m in heapq.merge(*(p.tolist() for p in pieces)):
                found[m] = found.get(m, 0) + 1
            candidates, seen = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        else:
            counts = np.bincount(np.concatenate(pieces), minlength=len(self.sizes))
            candidates = np.flatnonzero(counts)
            seen = counts[candidates]
        b = self.sizes[candidates]
        fits = (candidates != i) & ~skip[candidates] & (b * self.den >= a * self.num) & (a * self.den >= b * self.num)
        out = []
        for c, have in zip(candidates[fits].tolist(), seen[fits].tolist(), strict=True):
            need = -(-self.num * (a + int(self.sizes[c])) // (self.den + self.num))
            if have + len(long) < need:
                continue
            other = self.sorted[c]
            at = np.minimum(np.searchsorted(other, long), len(other) - 1)
            if have + int((other[at] == long).sum()) >= need:
                out.append(c)
        return out


def connect(index: Inverted, asking: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that connect what is connected, component of each set). With asking, pairs without a marked set don't
    count."""
    n = len(index.sizes)
    part, links = np.arange(n), []
    weight = [float(index.lists(i).mean()) if index.sizes[i] else 0.0 for i in range(n)]
    order = np.argsort(-np.array(weight), kind="stable").tolist()

    def ask(i: int) -> None:
        for j in index.query(i, part == part[i]):
            a, b = sorted((int(part[i]), int(part[j])))
            if a != b:
                part[part == b] = a
                links.append((i, j))

    centre = order[0]
    for i in order:
        # Without asking, sets in the centre's component need no query: what they may link with is queried itself.
        if asking[i] if asking is not None else i == centre or part[i] != part[centre]:
            ask(i)
    return links, part


def _prefixes(spark: SparkSession, docs: DataFrame, width: int, num: int, den: int, hot: np.ndarray, known: np.ndarray | None = None) -> DataFrame:
    """(id, n, fp, prefix, sketch): the set's size, its fingerprint and its prefix, with the hot shingles last. With known, the
    prefix lacks what it was when only those were hot."""
    shared = spark.sparkContext.broadcast((hot, known))  # HOT shingles at most

    def first(values: np.ndarray, owner: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> np.ndarray:
        late = np.isin(values, last) if len(last) else np.zeros(len(values), bool)
        order = np.lexsort((late, owner)) if late.any() else np.arange(len(values))  # stable: by hash within
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values)) - offsets[:-1][owner[order]]
        return rank < sizes[owner]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, known = shared.value
        for batch in batches:
            for part in ragged.cut(batch, "text"):
                values, offsets = shingle_sets(*ragged.utf8(part.column("text")), width)
                n = np.diff(offsets)
                owner = np.repeat(np.arange(len(n)), n)
                total = np.append(np.uint64(0), np.cumsum(ragged.mix(values ^ np.uint64(0x5DEECE66D))))
                fp = ragged.mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64))
                sizes = prefix_sizes(n, num, den)
                keep = first(values, owner, offsets, sizes, hot)
                if known is not None:
                    keep &= ~first(values, owner, offsets, sizes, known)
                ends = np.append(0, np.cumsum(keep))[offsets]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[keep].view(np.int64)))
                yield pa.record_batch([part.column("id"), pa.array(n), pa.array(fp.view(np.int64)), lists, sketches(values, owner, n)], ["id", "n", "fp", "prefix", "sketch"])

    return docs.mapInArrow(run, "id long, n long, fp long, prefix array<long>, sketch binary")


def sketches(values: np.ndarray, owner: np.ndarray, n: np.ndarray) -> pa.Array:
    """The parity of the number of shingles that fall on each bit; bits are a power of two, at least 64 and n / 2."""
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(n / 2, 64))).astype(np.int64)
    base = np.append(0, np.cumsum(bits))
    place = (ragged.mix(values + np.uint64(0x5BF03635)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64) + base[owner]
    packed = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((base // 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])


def has_partner(sizes: np.ndarray, sketch: list[bytes], num: int, den: int) -> np.ndarray:
    """Marks the sets that may reach the threshold with another one, by sizes and sketches."""
    out = np.zeros(len(sizes), bool)
    bits = np.array([8 * len(x) for x in sketch])
    for b in np.unique(bits):
        own = np.flatnonzero((bits == b) | (bits == 2 * b))  # sizes that differ more cannot link
        if len(own) < 2:
            continue
        halves = [np.frombuffer(sketch[i], np.uint64) for i in own]
        m = np.stack([h if 64 * len(h) == b else h[: len(h) // 2] ^ h[len(h) // 2 :] for h in halves])
        n = sizes[own]
        step = max(1, (1 << 21) // m.size)
        for a in range(0, len(own), step):
            part = slice(a, a + step)
            both = n[part][:, None] + n[None, :]
            may = (n[part][:, None] * den >= n * num) & (n * den >= n[part][:, None] * num)
            differ = np.bitwise_count(m[part][:, None, :] ^ m[None, :, :]).sum(axis=2, dtype=np.int64)
            may &= differ <= both - 2 * (-(-num * both // (num + den)))
            rows = np.arange(len(n[part]))
            may[rows, rows + a] = False
            out[own[part]] |= may.any(axis=1)
    return out


def _sieved(members: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (g, rep, n, sketch) of groups, without those that have no possible partner; groups of more than SIEVE stay."""

    kinds = (pa.int64(), pa.int64(), pa.int64())

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["g", "rep", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, large, out = None, [], False, []

        def close() -> None:
            keep = np.full(len(rows), True) if large else has_partner(np.array([r[1] for r in rows]), [r[2] for r in rows], num, den) if rows else []
            out.extend((group, r[0], r[1]) for r, k in zip(rows, keep, strict=True) if k)
            rows.clear()

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "rep", "n", "sketch")), strict=True):
                if g != group:
                    close()
                    group, large = g, False
                rows.append(tuple(row))
                if len(rows) > SIEVE:  # a large group streams through as it is
                    large = True
                    close()
                if len(out) > 8192:
                    yield packed(out)
                    out.clear()
        close()
        if out:
            yield packed(out)

    return members.repartition("g").sortWithinPartitions("g", "rep").mapInArrow(run, "g long, rep long, n long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.cut(batch, "text"):
                values, offsets = shingle_sets(*ragged.utf8(part.column("text")), width)
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))], ["rep", "shingles"])

    return docs.mapInArrow(run, "rep long, shingles array<long>")


def _link(parts: DataFrame, num: int, den: int, asking: bool) -> DataFrame:
    """Rows (g, b, rep, ask, shingles) to rows (g, a, c, stray): links a - c, and classes a apart from their centre."""

    def solve(g: int, reps: list, ask: list, values: list[np.ndarray]) -> Iterator[tuple]:
        unique: dict[int, int] = {}
        for i, r in enumerate(reps):
            unique.setdefault(r, i)
            ask[unique[r]] |= ask[i]
        places = list(unique.values())
        flat = [values[i].view(np.uint64) for i in places]
        index = Inverted(np.concatenate(flat), np.append(0, np.cumsum([len(x) for x in flat])), num, den)
        marks = np.array([ask[i] for i in places])
        links, roots = connect(index, marks if asking else None)
        names = [reps[i] for i in places]
        for a, c in links:
            yield g, names[a], names[c], False
        if not asking and marks.any():  # a block of a large group; ask marks its centre
            centre = roots[int(np.flatnonzero(marks)[0])]
            for i in np.flatnonzero(roots != centre).tolist():
                yield g, names[i], None, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, ask, values = None, [], [], []
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["g", "a", "c", "stray"])

        for batch in batches:
            flat = batch.column("shingles").flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(batch.column("shingles").value_lengths().to_numpy(zero_copy_only=False)))
            for i, (g, b, rep, asks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "b", "rep", "ask")), strict=True)):
                if (g, b) != key:
                    if len(reps) > 1:
                        out += solve(key[0], reps, ask, values)
                    key, reps, ask, values = (g, b), [], [], []
                reps.append(rep)
                ask.append(asks)
                values.append(flat[ends[i] : ends[i + 1]])
            if len(out) > 4096:
                yield packed()
                out = []
        if len(reps) > 1:
            out += solve(key[0], reps, ask, values)
        if out:
            yield packed()

    return parts.repartition("g", "b").sortWithinPartitions("g", "b", "rep").mapInArrow(run, "g long, a long, c long, stray boolean")


def components(links: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of links (a, c) reaches, by repeated minima and pointer jumping."""
    edges = scratch.write(links.select("a", "c").union(links.select(F.col("c").alias("a"), F.col("a").alias("c"))).distinct(), "edges")
    labels = scratch.write(edges.groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("v", "c"), "c").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "v").select("v", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = lower.select(F.col("v").alias("label"), F.col("label").alias("next"))
        after = scratch.write(lower.join(jump, "label", "left").select("v", F.least("label", F.coalesce("next", "label")).alias("label"), "old"), "labels")
        labels = after.select("v", "label")
        if after.filter("label <> old").isEmpty():
            return labels


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs: the size of its set and the smallest id it reaches."""
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    none = np.zeros(0, np.uint64)
    sets = scratch.write(_prefixes(spark, texts, width, num, den, none), "prefixes")
    classes = scratch.write(sets.filter("n > 0 and id is not null").groupBy("fp", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    rows = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    reps = classes.select(F.col("rep").alias("id"), "n", "fp")

    def frequent(prefixes: DataFrame) -> np.ndarray:
        """The most frequent shingles in the prefixes of classes, HOT at most."""
        own = prefixes.join(reps, ["id", "n", "fp"], "left_semi").select(F.explode("prefix").alias("t"))
        top = own.groupBy("t").agg(F.count("*").alias("df")).filter(F.col("df") > RARE).orderBy(F.desc("df"), "t").limit(HOT)
        return top.select("t").toArrow().column("t").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    hot, known = frequent(sets), none
    for _ in range(2):  # what takes the place of hot shingles in the prefixes may be hot too
        if len(hot) == len(known) or len(hot) >= HOT:
            break
        more = frequent(_prefixes(spark, texts, width, num, den, hot, known))
        known, hot = hot, np.union1d(hot, more)
    prefixes = scratch.write(_prefixes(spark, texts, width, num, den, hot), "ordered") if len(hot) else sets
    posted = prefixes.join(reps, ["id", "n", "fp"], "left_semi").select(F.explode("prefix").alias("t"), F.col("id").alias("rep"), "n")
    shared = posted.groupBy("t").agg(F.min("rep").alias("low"), F.max("rep").alias("top")).filter("low < top").select("t")
    met = scratch.write(posted.join(shared, "t"), "postings")
    # Sizes of a pair fall in the same or neighbouring steps of den / num.
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)) + 1e-12)
    sized = met.select(F.col("t"), "rep", "n", F.explode(F.array(level, level + 1)).alias("level"))
    meeting = sized.groupBy("t", "level").agg(F.min("rep").alias("g"), F.max("rep").alias("top")).filter("g < top").drop("top")
    loose = sized.join(meeting, ["t", "level"]).select("g", "rep", "n").distinct()
    sketched = prefixes.join(reps, ["id", "n", "fp"], "left_semi").select(F.col("id").alias("rep"), "sketch").dropDuplicates(["rep"])
    met = scratch.write(loose, "met")
    size = met.count()
    # Large groups of more than a HEAVY-th of all members, so fewer than HEAVY, are not gathered for the sieve.
    large = F.broadcast(met.groupBy("g").agg(F.count("*").alias("_n")).filter((F.col("_n") * HEAVY > size) & (F.col("_n") > LARGE)).select("g"))
    gathered = met.join(large, "g", "left_anti").join(sketched, "rep")
    members = scratch.write(_sieved(gathered, num, den).unionByName(met.join(large, "g", "left_semi").select("g", "rep", "n")), "members")

    # The class that named the group may have left it; the smallest that stayed is the centre.
    wide = members.groupBy("g").agg(F.sum("n").alias("size"), F.min("rep").alias("centre"))
    wide = wide.select("g", "centre", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(wide, "g").select("g", "rep", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("b"))
    # The centre of a large group goes to each of its blocks.
    centre = wide.filter("blocks > 1").select("g", F.col("centre").alias("rep"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    routed = dealt.withColumn("ask", F.lit(False)).unionByName(centre.withColumn("ask", F.lit(True)))
    needed = members.select(F.col("rep").alias("id")).distinct()
    # Of rows that share an id, only the one whose set gave the class.
    chosen = texts.join(needed, "id", "left_semi")
    whole = scratch.write(_sets(chosen, width).join(members.select("rep", "n").distinct(), "rep").filter(F.size("shingles") == F.col("n")).drop("n"), "sets")
    first = scratch.write(_link(routed.join(whole, "rep").select("g", "b", "rep", "ask", "shingles"), num, den, False), "links")
    links = first.filter("not stray").select("a", "c")
    strays = first.filter("stray").select("g", F.col("a").alias("rep")).distinct()
    if not strays.isEmpty():
        every = strays.join(wide, "g").select("g", "rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).withColumn("ask", F.lit(True))
        again = dealt.join(strays.select("g").distinct(), "g", "left_semi").select("g", "rep", "b").withColumn("ask", F.lit(False)).unionByName(every)
        second = _link(again.join(whole, "rep").select("g", "b", "rep", "ask", "shingles"), num, den, True)
        links = links.unionByName(second.select("a", "c"))
    labels = components(links)
    named = scratch.write(classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("fp", "n", "copies", F.coalesce("label", "rep").alias("component_id")), "named")
    # Classes of more than a HEAVY-th of all documents, so fewer than HEAVY, meet their copies by broadcast.
    is_heavy = F.col("copies") * HEAVY > rows
    heavy, light = F.broadcast(named.filter(is_heavy).drop("copies")), named.filter(~is_heavy).drop("copies")
    own = sets.select("id", "n", "fp")
    filled, on = own.filter("n > 0 and id is not null"), ["fp", "n"]
    out = filled.join(heavy, on).unionByName(filled.join(heavy, on, "left_anti").join(light, on))
    out = out.unionByName(own.filter("n = 0 or id is null").withColumn("component_id", F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


#: The same rows by a plain self-join, for tables of a few thousand documents (four words, 0.85).
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from i),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as (select x as a, y as b from l union select y, x from l),
r as (select a as v, a as w from e union select r.v, e.b from r join e on r.w = e.a),
m as (select v, min(w) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component_id, d.doc_id) as component_id from documents d left join n using (doc_id) left join m on m.v = d.doc_id
"""
