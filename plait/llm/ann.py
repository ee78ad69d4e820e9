"""Approximate nearest neighbours by additive quantisation.

A vector is stored as the sum of one codeword from each of M full-dimensional codebooks. Codebooks come from k-means on
the residuals of a bounded sample (TRAIN vectors or TRAIN_BYTES at most, the first by hash; one task fits them) and are
then refitted to the sample's codes; every vector is encoded by a beam search that keeps the BEAM best partial sums.
Squared norms of the sums are stored beside the codes, for Euclidean nearness. A query scores a vector by M look-ups in
its table of inner products with the codewords; the DEPTH best of each block of vectors are then ranked exactly on the
original vectors, in double precision.

Equal vectors are one class with its smallest ids, so copies neither crowd out others nor cost anything: a search for k
neighbours needs k + 1 ids of a class at most. Classes lie in blocks of BLOCK; queries meet every block, in blocks.

Results for odd input: vectors that are null, empty, zero, or hold a null or a component that isn't finite take no part,
neither do those of another length than the commonest, nor rows with a null id; rows that share an id are one candidate
if equal, else one each; a table without vectors gives no rows; with fewer than k candidates all are returned; ties in
score go to smaller ids. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

TRAIN, TRAIN_BYTES = 16384, 1 << 23
BOOKS, WORDS, BEAM = 16, 256, 4
BLOCK, QUERIES, DEPTH = 16384, 512, 512


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centre of each row, in pieces that bound the table of distances."""
    norms = (centres**2).sum(axis=1)
    return np.concatenate([np.argmin(norms - 2 * x[a : a + 1024] @ centres.T, axis=1) for a in range(0, len(x), 1024)])


def _means(x: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the rows of each owner, their number)."""
    counts = np.bincount(owner, minlength=k)
    order = np.argsort(owner, kind="stable")
    filled = np.flatnonzero(counts)
    total = np.zeros((k, x.shape[1]), x.dtype)
    total[filled] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[filled], axis=0)
    return total, counts


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres; with fewer rows than k, the rest are zero."""
    centres = x[rng.permutation(len(x))[:k]]
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        total, counts = _means(x, _nearest(x, centres), k)
        filled = counts > 0
        centres[filled] = total[filled] / counts[filled, None]
        centres[~filled] = x[rng.integers(0, len(x), int((~filled).sum()))]
    return centres


class Quantiser:
    """M full-dimensional codebooks of K words. Inner products of words are made book by book when first needed, so what
    travels is the books alone: M * K * d floats."""

    def __init__(self, books: np.ndarray):
        self.books = books  # M, K, d
        self.norms = (books**2).sum(axis=2)
        self._cross: dict[tuple[int, int], np.ndarray] = {}

    def cross(self, j: int, i: int) -> np.ndarray:
        if (j, i) not in self._cross:
            self._cross[j, i] = 2 * self.books[j] @ self.books[i].T
        return self._cross[j, i]

    @classmethod
    def train(cls, x: np.ndarray, m: int = BOOKS, k: int = WORDS, rounds: int = 5, fits: int = 2, sweeps: int = 6, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        residual, books = x.copy(), []
        for _ in range(m):
            books.append(_kmeans(residual, k, rounds, rng))
            residual -= books[-1][_nearest(residual, books[-1])]
        # The beam finds better codes than the greedy residuals do: each book in turn takes the least squares for them,
        # which are the means of what the other books leave.
        out = cls(np.stack(books))
        for _ in range(fits):
            codes = np.concatenate([out.encode(x[a : a + 1024])[0] for a in range(0, len(x), 1024)]).astype(np.int64)
            residual = x.copy()
            for i in range(m):
                residual -= out.books[i][codes[:, i]]
            for i in [*range(m)] * sweeps:
                own = codes[:, i]
                total, counts = _means(residual, own, k)
                move = total / (counts[:, None] + 0.5)
                out.books[i] += move
                residual -= move[own]
            out = cls(out.books)
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norm of their sum) of each vector."""
        m, k, _ = self.books.shape
        n = len(x)
        x = x.astype(np.float32)
        codes = np.zeros((n, 1, 0), np.int64)
        cost = np.zeros((n, 1), np.float32)  # |sum|^2 - 2 <x, sum>
        for i in range(m):
            step = (self.norms[i] - 2 * x @ self.books[i].T)[:, None, :]
            for j in range(i):
                step = step + self.cross(j, i)[codes[:, :, j]]
            whole = (cost[:, :, None] + step).reshape(n, -1)
            keep = min(beam, whole.shape[1])
            best = np.argpartition(whole, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(whole, best, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
        codes = codes[np.arange(n), np.argmin(cost, axis=1)]
        total = np.zeros_like(x)
        for i in range(m):
            total += self.books[i][codes[:, i]]
        return codes.astype(np.uint8), (total**2).sum(axis=1)


_local: dict[str, Quantiser] = {}


def _quantiser(shared: Broadcast) -> Quantiser:
    """The quantiser of this worker process for the books that were sent."""
    name, books = shared.value
    if name not in _local:
        _local.clear()
        _local[name] = Quantiser(books)
    return _local[name]


@dataclass
class Index:
    blocks: DataFrame
    books: Broadcast | None  # (name, M x K x d floats)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vid, vec) that take part, all of the commonest length."""
    v = vectors.select(vectors[id_col].cast("long").alias("vid"), vectors[vec_col].cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("vec", lambda c: c != 0)
    v = v.filter("vid is not null").filter(F.coalesce(fine, F.lit(False)))
    length = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    row = length.first()
    return v.filter(F.size("vec") == (row.d if row else 0)).select("vid", F.transform("vec", lambda c: c + 0.0).alias("vec"))  # one zero


def build_index(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> Index:
    """The index as a table of blocks (block, ids array<array<long>>, codes, norms, vectors as binaries): every class of
    equal vectors with its k + 1 smallest ids."""
    rows = valid(vectors, id_col, vec_col).select("vid", "vec").distinct()
    place = Window.partitionBy("vec").orderBy("vid")
    few = rows.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k + 1)  # limited before the shuffle too
    classes = scratch.write(few.groupBy("vec").agg(F.sort_array(F.collect_list("vid")).alias("ids")), "vectors")
    schema = "block int, n int, dim int, ids array<array<long>>, codes binary, norms binary, vecs binary"
    first = classes.select(F.size("vec").alias("d")).first()
    if first is None:
        return Index(spark.createDataFrame([], schema), None)
    dim = first.d
    picked = classes.select(F.xxhash64("vec").alias("h"), "ids", F.col("vec").cast("array<float>").alias("vec")).orderBy("h", "ids").limit(max(WORDS, min(TRAIN, TRAIN_BYTES // (4 * dim)))).select("vec")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.asarray(b.column("vec").flatten()).reshape(-1, dim) for b in batches if b.num_rows])
        yield pa.record_batch([pa.array([Quantiser.train(x).books.tobytes()], pa.binary())], ["books"])

    made = picked.coalesce(1).mapInArrow(train, "books binary").first().books
    books = spark.sparkContext.broadcast((hashlib.sha256(made).hexdigest(), np.frombuffer(made, np.float32).reshape(BOOKS, WORDS, dim)))
    blocks = max(1, -(-classes.count() // BLOCK))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        x = np.array(table.column("vec").combine_chunks().flatten()).reshape(table.num_rows, -1)
        quantiser = _quantiser(books)
        parts = [quantiser.encode(x[i : i + 1024]) for i in range(0, len(x), 1024)]
        codes, norms = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ids = table.column("ids").combine_chunks()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(x)], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))), "codes": [codes.tobytes()], "norms": [norms.astype(np.float32).tobytes()], "vecs": [x.tobytes()]})

    dealt = classes.select(F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int").alias("block"), "vec", "ids", F.col("ids")[0].alias("first"))
    return Index(scratch.write(dealt.groupBy("block").applyInArrow(run, schema), "index"), books)


def _select(scores: np.ndarray, depth: int) -> np.ndarray:
    """Places of the depth best of each row, ties to earlier places."""
    if scores.shape[1] <= depth:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    edge = -np.partition(-scores, depth - 1, axis=1)[:, depth - 1]
    out = np.empty((len(scores), depth), np.int64)
    for i, row in enumerate(scores):
        above = np.flatnonzero(row > edge[i])
        out[i, : len(above)] = above
        out[i, len(above) :] = np.flatnonzero(row == edge[i])[: depth - len(above)]
    return out


def search(spark: SparkSession, index: Index, vectors: DataFrame, wanted, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, metric: str = "ip", depth: int = DEPTH) -> DataFrame:
    """The k nearest of each vector that meets the condition ``wanted`` (on a column vid), without itself: query_id,
    rank, vec_id, score. metric: "ip" (largest inner product) or "l2" (smallest squared distance, as negative score)."""
    result = "query_id long, rank int, vec_id long, score double"
    if index.books is None:
        return spark.createDataFrame([], result)
    shared = index.books
    queries = valid(vectors, id_col, vec_col).filter(wanted).select("vid", "vec").distinct()
    many = max(1, -(-queries.count() // QUERIES))
    packed = queries.select(F.pmod(F.xxhash64("vid", "vec"), F.lit(many)).alias("part"), F.struct("vid", "vec").alias("q")).groupBy("part").agg(F.sort_array(F.collect_list("q")).alias("qs"))
    # Every block of queries goes to every block of the index, by key.
    blocks = [r.block for r in index.blocks.select("block").collect()]  # one number for each BLOCK vectors
    sent = packed.withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks])))
    pairs = sent.join(index.blocks, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value[1]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("qs", "n", "dim", "ids", "codes", "norms", "vecs")}
                n, dim = row["n"].as_py(), row["dim"].as_py()
                qs = row["qs"].values
                names = qs.field("vid").to_numpy(zero_copy_only=False)
                q = qs.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(names), dim)
                codes = np.frombuffer(row["codes"].as_py(), np.uint8).reshape(n, -1).T.astype(np.intp)
                norms = np.frombuffer(row["norms"].as_py(), np.float32)
                x = np.frombuffer(row["vecs"].as_py(), np.float64).reshape(n, dim)
                lists = row["ids"].values
                flat, bounds = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
                out_q, out_v, out_s = [], [], []
                for a in range(0, len(q), 64):
                    part = q[a : a + 64]
                    tables = np.einsum("qd,mkd->mqk", part.astype(np.float32), books, optimize=True)
                    scores = tables[0][:, codes[0]]
                    for m in range(1, len(codes)):
                        scores += tables[m][:, codes[m]]
                    if metric == "l2":
                        scores = 2 * scores - norms
                    near = _select(scores, depth)
                    for j in range(len(part)):
                        own = near[j]
                        exact = np.einsum("nd,d->n", x[own], part[j]) if metric == "ip" else -((x[own] - part[j]) ** 2).sum(axis=1)
                        firsts = flat[bounds[own]]
                        best = np.lexsort((firsts, -exact))[: k + 1]
                        sizes = bounds[own[best] + 1] - bounds[own[best]]
                        ids = np.concatenate([flat[bounds[o] : bounds[o + 1]] for o in own[best]])
                        value = np.repeat(exact[best], sizes)
                        others = ids != names[a + j]
                        ids, value = ids[others], value[others]
                        top = np.lexsort((ids, -value))[:k]
                        out_q.append(np.full(len(top), names[a + j]))
                        out_v.append(ids[top])
                        out_s.append(value[top])
                yield pa.record_batch([pa.array(np.concatenate(z)) for z in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    found = pairs.select("qs", "n", "dim", "ids", "codes", "norms", "vecs").mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
