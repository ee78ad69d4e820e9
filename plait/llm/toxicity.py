"""Toxicity by a linear-chain conditional random field over words.

Each word is tagged clean or toxic. Emissions sum weights of hashed word features (the word, its prefixes, its suffix),
transitions join neighbours. Labels come by document, so training tags are made first: words and prefixes that stand out
in toxic documents mark the toxic words there; everything in clean documents is clean. Forward-backward marginals then
give the toxic spans of any text, and a logistic curve over their strongest and summed values gives the document score.

The model is fitted on at most FIT_DOCS labelled documents of each class (the first by hash of the id, of at most
FIT_CHARS characters each), a documented bound; rows with crc32(id) mod 3 = 1 never take part, and of near copies among
the chosen (the same band of three of twelve min-hashes of their word sets) only the first does, so that a group of copies
does not decide the weights. Scores see the text alone.

Results for odd input: null and empty texts get the score of a text without words; a null id is scored, and is held out
as the crc32 of no text is not 1 (false); labels that are null or have no document are skipped; without labels of both
classes the score is 0 for all; repeated rows give repeated rows; empty tables give empty tables; other columns are not
read. Long texts are scored whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens, ragged

FIT_DOCS = 1000
FIT_CHARS = 20_000
BUCKETS = 1 << 18
OFTEN = 5
THRESHOLD = 0.7


@dataclass
class Words:
    """Words of several texts: ragged codes into the distinct words."""

    codes: np.ndarray
    keys: np.ndarray
    spell: _Lazy | list[str]
    starts: np.ndarray
    stops: np.ndarray
    before: np.ndarray
    ends: np.ndarray  # bounds of the texts, in code points


def words_of(flat: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters and digits, in lower case."""
    text, points, ends = ragged.codepoints(flat, offsets)
    kind = pretokens.classes()[points] if len(points) else np.zeros(0, np.uint8)
    inside = (kind == pretokens.LETTER) | (kind == pretokens.NUMBER)
    edge = np.zeros(len(points) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1])) if len(points) else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1 if len(points) else np.zeros(0, np.int64)
    codes, keys, first = ragged.distinct(ragged.segment_hashes(ragged.spread(points), starts, stops))
    return Words(codes, keys, _Lazy(text, starts[first], stops[first]), starts, stops, np.searchsorted(starts, ends), ends)


class _Lazy:
    """The spelling of distinct words, cut out when asked for."""

    def __init__(self, text: str, starts: np.ndarray, stops: np.ndarray):
        self.text, self.starts, self.stops = text, starts, stops

    def __getitem__(self, places: np.ndarray) -> list[str]:
        return [self.text[a:b].lower() for a, b in zip(self.starts[places].tolist(), self.stops[places].tolist(), strict=True)]


KINDS = 7


def features(words: list[str]) -> np.ndarray:
    """Hashed features of each word: a row of KINDS buckets, of which repeats of short words go to bucket 0."""
    parts = [(w, w[:3] if len(w) > 3 else "", w[:4] if len(w) > 4 else "", w[:5] if len(w) > 5 else "", w[:6] if len(w) > 6 else "", w[-3:] if len(w) > 3 else "") for w in words]
    flat = "".join(x for p in parts for x in p).encode("utf-32-le", "surrogatepass")
    sizes = np.fromiter((len(x) for p in parts for x in p), np.int64, (KINDS - 1) * len(words))
    ends = np.cumsum(sizes)
    hashes = ragged.segment_hashes(ragged.spread(np.frombuffer(flat, np.uint32)), ends - sizes, ends).reshape(-1, KINDS - 1)
    hashes = ragged.mix(hashes + np.arange(1, KINDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(words), KINDS), np.int64)
    out[:, 0] = 1  # the bias
    out[:, 1:] = np.where(sizes.reshape(-1, KINDS - 1) > 0, (hashes % np.uint64(BUCKETS - 2)).astype(np.int64) + 2, 0)
    return out


SEGMENT = 64


def _odds(maps: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Odds behind every place of ragged maps x -> (a x + b) / (c x + d), rows (a, b, c, d), the first of a text from odds
    1. Places go in step, a segment of each text at a time; what reaches a segment comes from the segments' own products
    in the same way, so the steps grow with the logarithm of a text's length."""
    lengths = np.diff(before)
    many = -(-lengths // SEGMENT)
    cuts = np.append(0, np.cumsum(many))
    inside = np.arange(cuts[-1]) - np.repeat(cuts[:-1], many)  # number of the segment in its text
    first = np.repeat(before[:-1], many) + inside * SEGMENT
    size = np.minimum(np.repeat(lengths, many) - inside * SEGMENT, SEGMENT)
    x = np.ones(len(first))
    if len(first) and many.max() > 1:
        product = maps[first].copy()
        for s in range(1, SEGMENT):
            live = np.flatnonzero(size > s)
            if not len(live):
                break
            (a, b, c, d), (e, f, g, h) = maps[first[live] + s].T, product[live].T
            joined = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h], axis=1)
            product[live] = joined / joined.max(axis=1)[:, None]
        after = _odds(product, cuts)
        x[inside > 0] = after[np.flatnonzero(inside > 0) - 1]
    order = np.argsort(-size, kind="stable")
    first, size, x = first[order], size[order], x[order]
    out = np.empty(len(maps))
    for s in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -s, "left"))  # segments longer than s
        at = first[:n] + s
        a, b, c, d = maps[at].T
        x[:n] = (a * x[:n] + b) / (c * x[:n] + d)
        out[at] = x[:n]
    return out


def marginals(emit: np.ndarray, before: np.ndarray, chain: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(probability of the toxic tag of each word, expected transitions 2 x 2) for ragged emissions (toxic less clean).
    chain: log weights of transitions."""
    lengths = np.diff(before)
    t = np.exp(chain)
    gain = np.exp(np.clip(emit, -40, 40))
    heads = before[:-1][lengths > 0]
    maps = np.stack([t[1, 1] * gain, t[0, 1] * gain, np.full(len(emit), t[1, 0]), np.full(len(emit), t[0, 0])], axis=1)
    maps[heads] = np.stack([gain[heads], np.zeros(len(heads)), np.zeros(len(heads)), np.ones(len(heads))], axis=1)
    forward = _odds(maps, before)
    # From the right, through the mirrored texts: odds of what follows a word, by the word's tag.
    maps = np.stack([t[1, 1] * gain, np.full(len(emit), t[1, 0]), t[0, 1] * gain, np.full(len(emit), t[0, 0])], axis=1)
    mirrored = np.empty_like(maps)
    mirrored[1:] = maps[:0:-1]
    ends = len(emit) - before[::-1]
    mirrored[ends[:-1][np.diff(ends) > 0]] = (1, 0, 0, 1)
    backward = _odds(mirrored, ends)[::-1]
    odds = forward * backward
    p = odds / (1 + odds)
    expected = np.zeros((2, 2))
    if pairs and len(emit) > 1:
        follows = np.ones(len(emit), bool)
        follows[heads] = False
        right = np.flatnonzero(follows)
        x, y = forward[right - 1], gain[right] * backward[right]
        cells = np.stack([t[0, 0] + 0 * x, t[0, 1] * y, t[1, 0] * x, t[1, 1] * x * y])
        expected = (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return p, expected


def _marginals_in_parts(emit: np.ndarray, before: np.ndarray, chain: np.ndarray, texts: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """marginals() with expected transitions, some texts at a time."""
    p, expected = np.empty(len(emit)), np.zeros((2, 2))
    for i in range(0, len(before) - 1, texts):
        own = before[i : i + texts + 1]
        part = slice(own[0], own[-1])
        p[part], more = marginals(emit[part], own - own[0], chain, pairs=True)
        expected += more
    return p, expected


def _summary(p: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per text: a constant, the log odds of the strongest word, the log of the summed probabilities, and that of their
    share of the words, as long texts come upon some toxic-looking words by chance."""
    n = len(before) - 1
    many = np.diff(before)
    out = np.zeros((n, 4))
    out[:, 0], out[:, 1] = 1, -6
    filled = np.flatnonzero(many > 0)
    total = np.zeros(n)
    if len(filled):
        top = np.maximum.reduceat(p, before[:-1][filled])
        out[filled, 1] = np.clip(np.log((top + 1e-9) / (1 - top + 1e-9)), -6, 6)
        total[filled] = np.add.reduceat(np.where(p > 0.05, p, 0), before[:-1][filled])  # many faint words say nothing
    out[:, 2] = np.log1p(total)
    out[:, 3] = np.log((total + 0.02) / (many + 20))
    return out


class Model:
    def __init__(self, weights: np.ndarray, chain: np.ndarray, curve: np.ndarray):
        self.weights, self.chain, self.curve = weights.astype(np.float32), chain, curve

    def emissions(self, words: list[str]) -> np.ndarray:
        return self.weights[features(words)].sum(axis=1, dtype=np.float64)

    def score(self, p: np.ndarray, before: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_summary(p, before) @ self.curve))


def _independent(w: Words, n: int) -> np.ndarray:
    """Texts that are no near copies of an earlier one: none of four bands of three min-hashes of their word sets is the
    same as an earlier text's."""
    seen: set[tuple] = set()
    keep = []
    for i in range(n):
        own = w.keys[np.unique(w.codes[w.before[i] : w.before[i + 1]])]
        bands = {(b, *(int(ragged.mix(own ^ np.uint64(0x51 + 977 * (3 * b + k))).min()) for k in range(3))) for b in range(4)} if len(own) else {()}
        if not bands & seen:
            keep.append(i)
        seen |= bands
    return np.array(keep, np.int64)


def _words_in_parts(texts: list[str]) -> tuple[Words, list[str]]:
    """words_of() all texts, a megabyte at a time, and the spelling of each distinct word."""
    keys, counts, names = [], [], {}
    for part in ragged.cut(pa.record_batch([pa.array(texts, pa.string())], ["text"]), "text"):
        w = words_of(*ragged.utf8(part.column("text")))
        keys.append(w.keys[w.codes])
        counts.append(np.diff(w.before))
        names |= zip(w.keys.tolist(), w.spell[np.arange(len(w.keys))], strict=True)
    codes, distinct, _ = ragged.distinct(np.concatenate(keys))
    none = np.zeros(0, np.int64)
    return Words(codes, distinct, [], none, none, np.append(0, np.cumsum(np.concatenate(counts))), none), [names[k] for k in distinct.tolist()]


def _summed(theta: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Sum of each row's weights, a column at a time."""
    return sum((theta[f[:, k]] for k in range(1, KINDS)), theta[f[:, 0]])


def fit(texts: list[str], toxic: list[int], rounds: int = 60) -> Model | None:
    """A model from labelled texts, None unless there are both classes."""
    labels = np.array(toxic)
    if len(set(labels.tolist())) < 2:
        return None
    w, spelled = _words_in_parts(texts)
    kept = _independent(w, len(texts))
    codes = [w.codes[w.before[i] : w.before[i + 1]] for i in kept]
    labels = labels[kept]
    if len(set(labels.tolist())) < 2:
        return None
    flat, before = np.concatenate(codes), np.append(0, np.cumsum([len(c) for c in codes]))
    f = np.concatenate([features(spelled[a : a + 8192]) for a in range(0, max(1, len(spelled)), 8192)]).astype(np.int32)

    # Features that stand out in toxic texts: by their rate among all words, a text counting OFTEN times at most.
    doc = np.repeat(np.arange(len(codes)), np.diff(before))
    step = 64  # texts at a time, to keep their words' features small
    which, times, owner = [], [], []
    for i in range(0, len(codes), step):
        part = slice(before[i], before[min(i + step, len(codes))])
        pairs, counts = np.unique(doc[part, None] * BUCKETS + f[flat[part], 1:], return_counts=True)
        which.append(pairs % BUCKETS)
        owner.append(pairs // BUCKETS)
        times.append(np.minimum(counts, OFTEN))
    place, times, bad = np.concatenate(which), np.concatenate(times).astype(float), labels[np.concatenate(owner)] == 1
    t, c = np.bincount(place[bad], times[bad], BUCKETS), np.bincount(place[~bad], times[~bad], BUCKETS)
    texts_with = np.bincount(place[bad], minlength=BUCKETS)
    words_t, words_c = (max(1, int(np.diff(before)[labels == y].sum())) for y in (1, 0))
    share, n = words_t / (words_t + words_c), np.maximum(t + c, 1)
    # The log likelihood against an even spread; 12 makes chance hits rare among 100,000 features.
    gain = t * np.log(np.maximum(t, 1) / (n * share)) + c * np.log(np.maximum(c, 1) / (n * (1 - share)))
    marks = (gain > 12) & (t / words_t > 12 * c / words_c) & (texts_with >= 4)
    marks[:2] = False
    tagged = marks[f[:, 1:]].any(axis=1)
    tags = (tagged[flat] & (labels[doc] == 1)).astype(float)

    # The random field, by Adam on the mean log likelihood of a text.
    theta, chain = np.zeros(BUCKETS), np.zeros((2, 2))
    theta[1] = -4.0
    follows = np.ones(len(flat), bool)
    follows[before[:-1][np.diff(before) > 0]] = False
    right = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[right - 1].astype(int), tags[right].astype(int)), 1)
    used = np.unique(f)
    moments = [np.zeros(len(used)), np.zeros(len(used)), np.zeros((2, 2)), np.zeros((2, 2))]
    for k in range(1, rounds + 1):
        p, expected = _marginals_in_parts(_summed(theta, f)[flat], before, chain)
        by_word = np.bincount(flat, tags - p, minlength=len(f))
        grad = np.zeros(BUCKETS)
        for column in range(KINDS):
            grad += np.bincount(f[:, column], by_word, minlength=BUCKETS)
        grad[0] = 0
        steps = ((grad[used] / len(codes) - 1e-4 * theta[used], 0, 0.25), ((seen - expected) / len(codes) - 1e-3 * chain, 2, 0.1))
        for g, m, rate in steps:
            moments[m] = 0.8 * moments[m] + 0.2 * g
            moments[m + 1] = 0.95 * moments[m + 1] + 0.05 * g * g
            move = rate * (moments[m] / (1 - 0.8**k)) / (np.sqrt(moments[m + 1] / (1 - 0.95**k)) + 1e-6)
            if m:
                chain = chain + move
            else:
                theta[used] += move
    p, _ = _marginals_in_parts(_summed(theta, f)[flat], before, chain)
    x, y = _summary(p, before), labels.astype(float)
    curve = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method with a small penalty
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        curve += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(len(curve)), x.T @ (y - q) - 0.05 * curve)
    return Model(theta, chain, curve)


def held_out(doc_id):
    """Whether crc32 of the id's decimal text has remainder 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> Model | None:
    """Fits on at most fit_docs labelled documents of each class that aren't held out."""
    own = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out(F.col("id")))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).filter((F.length("text") > 0) & (F.length("text") <= FIT_CHARS))
    # Twice as many ids as needed, since some have no text here; 16 bytes each.
    picked = own.filter("y = 0").orderBy(F.xxhash64("id"), "id").limit(2 * fit_docs).unionByName(own.filter("y = 1").orderBy(F.xxhash64("id"), "id").limit(2 * fit_docs))
    found = texts.join(F.broadcast(picked), "id")
    chosen = found.filter("y = 0").orderBy(F.xxhash64("id"), "id").limit(fit_docs).unionByName(found.filter("y = 1").orderBy(F.xxhash64("id"), "id").limit(fit_docs))
    rows = sorted(chosen.select("id", "text", "y").collect())
    return fit([r.text for r in rows], [r.y for r in rows])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(p: np.ndarray, before: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> pa.Array:
    """For each text its runs of words tagged toxic."""
    hits = np.flatnonzero(p >= 0.5)
    owner = np.searchsorted(before, hits, "right") - 1
    follows = np.append(False, (np.diff(hits) == 1) & (owner[1:] == owner[:-1])) if len(hits) else np.zeros(0, bool)
    heads = np.flatnonzero(~follows)
    tails = np.append(heads[1:], len(hits))[: len(heads)] - 1
    bounds = np.searchsorted(owner[heads], np.arange(len(before)))
    places = pa.StructArray.from_arrays([pa.array(begins[hits[heads]], pa.int64()), pa.array(stops[hits[tails]], pa.int64())], fields=list(_SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), places, type=_SPANS)


def score(spark: SparkSession, docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with columns score and spans (code points of runs of words tagged toxic). No shuffle."""
    docs = docs.drop("score", "spans")
    plain = docs.schema
    shared, kinds = spark.sparkContext.broadcast(model), pretokens.shared(spark)  # BUCKETS weights, whatever the corpus
    digest = "" if model is None else hashlib.sha256(model.weights.tobytes()).hexdigest()

    def scored(part: pa.RecordBatch, model: Model | None, memo: ragged.Memo) -> pa.RecordBatch:
        w = words_of(*ragged.utf8(part.column(text_col)))

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return model.emissions(w.spell[new]), np.arange(len(new) + 1)

        if model is None:
            values, spans = np.zeros(part.num_rows), pa.array([[]] * part.num_rows, _SPANS)
        else:
            known = memo.rows(w.keys, make) if len(w.keys) else np.zeros(0, np.int64)
            p, _ = marginals(memo.flat[known][w.codes], w.before, model.chain)
            heads = w.ends[:-1].repeat(np.diff(w.before))
            values, spans = model.score(p, w.before), _spans(p, w.before, w.starts - heads, w.stops - heads)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in plain.names), pa.array(values), spans], [*plain.names, "score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, ragged.memo(f"toxicity {digest}", np.float64)
        pretokens.adopt(kinds.value)
        for batch in batches:
            for part in ragged.cut(batch, text_col):
                yield scored(part, model, memo)

    added = T.StructType.fromDDL("score double, spans array<struct<start:long,end:long>>")
    return docs.mapInArrow(run, T.StructType([*plain.fields, *added.fields]))
