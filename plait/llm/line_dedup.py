"""Line dedup over levelled sorted runs of line hashes.

Batches of documents go from large ids to small ones, and a batch's line keys come to one row a key with the number of
its documents and the largest of them, bucketed and sorted by 128-bit hash. Each batch merge-anti-joins the runs so far:
the keys that no run holds are new and become a run of level 0; FANOUT runs of a level are compacted into one of the
next. So a key lies in one run only, with the document that brought it, the largest of all. Runs and batches share their
buckets, so the joins move no rows of a run. Runs are kept under a folder and can be opened again for later batches, of
smaller ids.

A key is the line without ASCII white space at both ends and with A-Z in lower case. Keys of at least ``min_chars`` code
points in at least ``min_docs`` documents lose their lines everywhere but in the largest document.

Results for odd input: null and empty texts are one empty line, which has no key; rows that share an id are one document
for counting and keep their own texts; a null id counts as smaller than any other; an empty table gives an empty table;
all columns of docs are kept, whatever their names, and n_lines and n_dropped replace columns of these names. A document
that loses every line stays with an empty text.

All steps are DataFrame functions. Counts are summed before they are shuffled. Lines of the few keys that hold more than a
HEAVY-th of all lines meet their key by broadcast (HEAVY keys at most), others by hash, so no task gets a hot line's rows.
Texts are shuffled once, by document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

FANOUT = 3
#: Batches: BATCHES at least, and so many that a task gets about KEYS lines of one.
BATCHES, KEYS = 4, 1 << 20
HEAVY = 1024
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAST = -(1 << 63)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


class Runs:
    """Levelled sorted runs under a folder: rows (h1, h2, n, last), each key in one run. They are bucketed by the hash;
    names in the session's catalogue tell Spark so, until close()."""

    ROWS = "h1 long, h2 long, n long, last long"

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.own = root is None  # runs of one call go with the driver
        self.root = root or scratch.path(spark, "runs")
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.names: list[str] = []
        self.levels: list[list[str]] = []  # names of runs in the folder
        for name in sorted(scratch.names(spark, self.root)):
            level, buckets, _ = name.split("-")
            self.buckets = int(buckets)
            self._level(int(level)).append(name)
        self.opened: dict[str, DataFrame] = {}

    def _level(self, level: int) -> list[str]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _open(self, path: str) -> DataFrame:
        if path not in self.opened:
            name = f"plait_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {name} ({self.ROWS}) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{path}'")
            self.names.append(name)
            self.opened[path] = self.spark.table(name)
        return self.opened[path]

    def store(self, rows: DataFrame, path: str, dealt: bool = False) -> DataFrame:
        """rows written to a bucketed table at path; dealt: they lie by bucket already."""
        name = f"plait_{uuid.uuid4().hex}"
        rows = rows if dealt else rows.repartition(self.buckets, "h1", "h2")
        rows.select("h1", "h2", "n", "last").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("parquet.block.size", scratch.ROW_GROUP).saveAsTable(name)
        self.names.append(name)
        if self.own:
            scratch.until_exit(self.spark, path)
        self.opened[path] = self.spark.table(name)
        return self.opened[path]

    def every(self) -> list[DataFrame]:
        return [self._open(f"{self.root}/{name}") for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """batch: a bucketed table of store(), one row for each key. Only keys that no run holds are added."""
        new = batch
        for run in self.every():
            new = new.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._put(new, 0, True)

    def _put(self, rows: DataFrame, level: int, dealt: bool) -> None:
        name = f"{level}-{self.buckets}-{uuid.uuid4().hex}"
        self.store(rows, f"{self.root}/{name}", dealt)
        own = self._level(level)
        own.append(name)
        if len(own) >= self.fanout:
            merged = _union([self._open(f"{self.root}/{x}") for x in own])
            old = list(own)
            own.clear()
            self._put(merged, level + 1, False)
            for x in old:
                scratch.remove(self.spark, f"{self.root}/{x}")
                del self.opened[f"{self.root}/{x}"]

    def close(self) -> None:
        """Takes the names from the catalogue; the files stay."""
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        self.names, self.opened = [], {}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def common_keys(held: DataFrame, min_docs: int, batches: int) -> tuple[DataFrame, int]:
    """((h1, h2, n, last) of the keys in at least min_docs documents, number of lines) for lines (doc, h1, h2)."""
    spark = held.sparkSession
    marks = [i / 256 for i in range(1, 256)]
    seen = held.agg(F.count("*").alias("n"), F.percentile_approx("doc", marks, 10_000).alias("cuts")).first()
    runs = Runs(spark)
    many = min(256, max(batches, -(-seen.n // (KEYS * runs.buckets))))
    cuts = seen.cuts or []
    bounds = sorted({cuts[min(254, 256 * i // many - 1)] for i in range(1, many)}, reverse=True) if cuts else []
    ledger = []
    for i in range(len(bounds) + 1):
        part = held
        if i < len(bounds):
            part = part.filter(F.col("doc") > bounds[i])
        if i:
            part = part.filter(F.col("doc") <= bounds[i - 1])
        batch = part.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last"))
        ledger.append(runs.store(batch, scratch.path(spark, "batch")))
        runs.add(ledger[-1])
    counts = _union(ledger).groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
    first = _union(runs.every()).select("h1", "h2", "last")
    common = scratch.write(counts.join(first, ["h1", "h2"]), "common")
    runs.close()
    return common, seen.n


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES) -> DataFrame:
    """docs with text_col cleaned, and columns n_lines (before) and n_dropped."""
    own, mark = F.coalesce(docs[id_col].cast("long"), F.lit(_LEAST)), F.xxhash64(docs[text_col])
    found = docs.select(own.alias("doc"), mark.alias("mark"), F.posexplode(lines(docs[text_col])).alias("pos", "line"))
    keyed = found.select("doc", "mark", "pos", key(F.col("line")).alias("k")).filter(F.char_length("k") >= min_chars)
    held = scratch.write(keyed.select("doc", "mark", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k", F.lit(11)).alias("h2")), "line-keys")
    common, rows = common_keys(held.select("doc", "h1", "h2"), min_docs, batches)
    heavy = F.broadcast(common.filter(F.col("n") * HEAVY > rows))  # fewer than HEAVY, as n documents have n lines at least
    hot = held.join(heavy, ["h1", "h2"])
    rest = held.join(heavy, ["h1", "h2"], "left_anti").join(common.filter(F.col("n") * HEAVY <= rows), ["h1", "h2"])
    lost = hot.unionByName(rest).filter(F.col("doc") < F.col("last")).groupBy("doc", "mark").agg(F.collect_set("pos").alias("lost"))

    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    packed = docs.select(own.alias("doc"), mark.alias("mark"), F.struct(*[docs[c] for c in kept]).alias("row"))
    both = packed.join(lost, ["doc", "mark"], "left")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    split = both.select("row", lines(text).alias("every"), "lost")
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("every") - 1), F.col("lost")), lambda i: F.col("every")[i])
    cleaned = F.when(F.col("lost").isNull(), text).otherwise(F.array_join(stays, "\n"))
    columns = [cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept]
    return split.select(*columns, F.size("every").cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"))


SQL = """
with l as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines,
    [translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') for x in string_split(coalesce(text, ''), chr(10))] as keys
  from documents),
k as (select doc_id, unnest(list_distinct([x for x in keys if length(x) >= 20])) as key from l),
c as (select key, max(doc_id) as last from k group by key having count(distinct doc_id) >= 3),
d as (select k.doc_id, list(k.key) as lost from k join c using (key) where k.doc_id < c.last group by k.doc_id),
s as (
  select l.doc_id, len(l.lines) as n_lines, [l.lines[i] for i in range(1, len(l.lines) + 1) if not list_contains(coalesce(d.lost, []), l.keys[i])] as stays
  from l left join d using (doc_id))
select doc_id, n_lines, n_lines - len(stays) as n_dropped, sha256(coalesce(array_to_string(stays, chr(10)), '')) as kept_sha256 from s
"""
