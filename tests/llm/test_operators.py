"""Every operator on odd rows and empty tables, against plain versions of its contract."""

from __future__ import annotations

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plait.llm import ann, bpe_codec, chat, decontam, jaccard, line_dedup, queries, ragged, suffix_dedup, token_counts, token_store, toxicity

from . import odd

BYTE, MULTI, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))


def same(got, want):
    key = lambda x: tuple(repr(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_token_store(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    docs = odd.documents(spark, [(20, "<|startoftext|> x"), (21, "ΣΑΣ İ é")])
    got = token_store.read_store(spark, token_store.write_store(spark, docs, WORD)).collect()
    want = collections.Counter()
    for i, t in odd.pairs(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.append(0, np.cumsum([r.n_tokens for r in ordered]))[:-1].tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known)
    assert token_store.read_store(spark, token_store.write_store(spark, odd.empty(spark), WORD)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(3)
    for top in (0, 1, 7, 1000, 1 << 40):
        for n in (0, 1, 2, 63, 64, 65, 500):
            v = np.sort(rng.integers(0, top + 1, n))
            e, at = token_store.EliasFano.from_bytes(token_store.EliasFano.of(v).to_bytes(), 0)
            assert e.values().tolist() == v.tolist()
            assert [e.select(i) for i in range(n)] == v.tolist()
    ids = np.arange(10)
    block = token_store.Block(token_store.pack([None, -4, -4, 9], np.array([0, 0, 3, 3, 10]), ids, 2))
    assert block.doc_ids() == [None, -4, -4, 9]
    assert [block.document(i).tolist() for i in range(4)] == [[], [0, 1, 2], [], list(range(3, 10))]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, x[i].tolist(), 0) for i in range(300)] + [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None] + [1.0] * 15, 1), (405, [1.0] * 3, 1), (None, [1.0] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ann.search(spark, ann.build_index(spark, table), table, F.col("vid") % 20 == 0).toPandas()
    s = x.astype(float) @ x.astype(float).T
    for q, g in got.groupby("query_id"):
        want = sorted((j for j in range(300) if j != q), key=lambda j: (-s[q, j], j))[:20]
        assert g.sort_values("rank").vec_id.tolist() == want
    assert set(got.query_id) == set(range(0, 300, 20))
    assert ann.search(spark, ann.build_index(spark, table.limit(0)), table.limit(0), F.col("vid") % 20 == 0).count() == 0
    few = ann.search(spark, ann.build_index(spark, table.filter("vec_id < 4")), table.filter("vec_id < 4"), F.col("vid") == 0, metric="l2")
    assert few.count() == 3


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(k, odd.words(rng, 12 + 6 * k)) for k in range(5)] + [(7, None), (8, "short"), (9, "")]
    leak = items[3][1]
    edited = leak[:20].upper() + "," + leak[21:60] + "zz" + leak[60:]
    docs = odd.documents(spark, [(30, "before. " + leak + " after"), (31, edited), (32, leak[: len(leak) // 4])])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in decontam.find_leaks(spark, docs, bench).collect()}
    assert got[30] == {3} and got[31] == {3} and got[32] == set()
    assert sum(map(len, got.values())) == 2
    assert decontam.find_leaks(spark, docs, bench.limit(0)).filter(F.size("leaks") > 0).count() == 0
    assert decontam.find_leaks(spark, odd.empty(spark), bench).count() == 0


def test_decontamination_filter_loses_nothing():
    rng = random.Random(3)
    letters = "abcdefgh "
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(5, 200)))) for k in range(20)]
    windows = decontam.Windows(items)
    docs = []
    for _ in range(30):
        x = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 14)):
            p = rng.randrange(len(x))
            x[p : p + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2)
            x = x or ["a"]
        docs.append("".join(rng.choice(letters) for _ in range(rng.randrange(60))) + "".join(x))
    import pyarrow as pa

    flat, offsets = ragged.utf8(pa.array(docs))
    found = windows.leaks(flat, offsets)
    points, ends, _ = decontam.normal(flat, offsets)
    for i in range(len(docs)):
        text, want = points[ends[i] : ends[i + 1]].tolist(), set()
        for v in range(len(windows.item)):
            row = [0] * (len(text) + 1)
            for j in range(windows.length[v]):
                new = [j + 1]
                for k in range(1, len(text) + 1):
                    new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (int(windows.points[v, j]) != text[k - 1])))
                row = new
            if min(row) <= windows.edits[v]:
                want.add(windows.item[v])
        assert {x["item_id"] for x in found[i]} == want


def brute_components(docs, width, num, den):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, width, num):
    rng = random.Random(width)
    base = odd.words(rng, 90).split()
    near = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        near.append((100 + k, " ".join(w)))
    docs = odd.documents(spark, near).filter("doc_id is null or doc_id not in (16, 17)")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark, docs, width=width, num=num, den=100).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_components([p for p in odd.pairs(docs) if p[0] is not None], width, num, 100)
    assert jaccard.near_duplicates(spark, odd.empty(spark)).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    base = odd.words(rng, 60).split()
    docs = []
    for k in range(80):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(30))
        docs.append((k, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK", 600)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark, table, width=3, num=70, den=100).collect()}
    assert got == brute_components(docs, 3, 70, 100)


def test_near_duplicates_in_blocks_without_the_smallest_id(spark, monkeypatch):
    words = [f"word{i}" for i in range(600)]
    hashes, _ = jaccard.shingle_sets(*ragged.utf8(pa.array(words)), 1)
    words = [w for _, w in sorted(zip(hashes.tolist(), words, strict=True))]
    low, rest = words[:31], words[31:]  # a prefix of 200 shingles at 0.85 has 31: near copies meet by low only
    docs = [(0, " ".join(low + rest[169:338]))]  # in their group, but like none of them
    for k in range(12):
        own = list(rest[:169])
        own[5 * k : 5 * k + 5] = rest[400 + 5 * k : 405 + 5 * k]
        docs.append((1 + k, " ".join(low + own)))
    monkeypatch.setattr(jaccard, "BLOCK", 600)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark, table, width=1, num=85, den=100).collect()}
    assert got == brute_components(docs, 1, 85, 100)
    assert {got[k][1] for k in range(1, 13)} == {1}


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["scrofblex", "scrofblat", "vorpnak"]
    rows, labels = [], []
    for i in range(400):
        w = odd.words(rng, rng.randrange(20, 80)).split()
        if toxic := i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs = odd.documents(spark, [(1000 + i, t) for i, t in rows])
    marks = spark.createDataFrame([(1000 + i, q, t) for i, q, t in labels] + [(None, 1, 1), (1, None, None), (5555, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_on(docs, marks)
    got = toxicity.score(spark, docs, model)
    assert got.count() == docs.count()
    known = got.join(marks, "doc_id").filter(toxicity.held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).collect()
    assert len(known) > 50
    assert all((r.score >= toxicity.THRESHOLD) == (r.toxic == 1) for r in known)
    for r in known:
        assert {w for s in r.spans for w in r.text[s.start : s.end].split()} <= set(bad)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(spark, odd.empty(spark), model).count() == 0
    assert {r.score for r in toxicity.score(spark, docs, toxicity.fit_on(docs, marks.limit(0))).collect()} == {0.0}


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    before = np.array([0, 4, 4, 5, 11])
    emit, chain = rng.normal(size=11), rng.normal(size=(2, 2))
    p, pairs = toxicity.marginals(emit, before, chain, pairs=True)
    want, total = np.zeros(11), np.zeros((2, 2))
    for a, b in zip(before[:-1], before[1:], strict=True):
        weights, rows, cells = [], [], []
        for y in itertools.product((0, 1), repeat=int(b - a)):
            s = sum(emit[a + k] * v for k, v in enumerate(y)) + sum(chain[u, v] for u, v in zip(y, y[1:], strict=False))
            weights.append(np.exp(s))
            rows.append(y)
            c = np.zeros((2, 2))
            for u, v in zip(y, y[1:], strict=False):
                c[u, v] += 1
            cells.append(c)
        w = np.array(weights) / sum(weights)
        if b > a:
            want[a:b] = (w[:, None] * np.array(rows)).sum(axis=0)
            total += (w[:, None, None] * np.array(cells)).sum(axis=0)
    assert np.allclose(p, want) and np.allclose(pairs, total)


def test_codec(spark):
    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.documents(spark, [(40, "a" * 3000 + " I'll  <|endoftext|>\n\n'S x's"), (41, "  \n ")])
    got = bpe_codec.decode(spark, bpe_codec.encode(spark, docs, MULTI), MULTI).collect()
    same([(r.doc_id, r.ids, bytes(r.decoded)) for r in got], [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd.pairs(docs)])
    assert bpe_codec.encode(spark, odd.empty(spark), MULTI).count() == 0


def test_perfect_hash():
    keys = ragged.mix(np.arange(1, 5001, dtype=np.uint64))
    slots = bpe_codec.PerfectHash(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(5000))


def test_line_dedup(spark):
    line = "\n a line that many documents hold "
    docs = odd.documents(spark, [(60, line), (60, "x" + line), (60, "x" + line), (61, line * 3), (62, line)]).withColumns({"n_lines": F.lit("x"), "mark": F.lit(1), "h1": F.lit(2)})
    rows = odd.pairs(docs)
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(blank))
    order = lambda i: -(1 << 63) if i is None else i
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(order(i))
    want = []
    for i, t in rows:
        each = (t or "").split("\n")
        kept = [x for x in each if len(held[key(x)]) < 3 or order(i) == max(held[key(x)])]
        want.append((i, "\n".join(kept), len(each), len(each) - len(kept)))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"]
    same([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()], want)
    assert line_dedup.dedup_lines(odd.empty(spark)).count() == 0


def test_runs_hold_a_key_once(spark, tmp_path):
    def batch(runs, k):
        rows = spark.createDataFrame([(1, 1, 1, 10 - k), (k + 2, 0, 2, 10 - k)], line_dedup.Runs.ROWS)
        return runs.store(rows, str(tmp_path / f"batch{k}"))

    root = str(tmp_path / "runs")
    runs = line_dedup.Runs(spark, root, buckets=3, fanout=2)
    for k in range(3):
        runs.add(batch(runs, k))
    runs.close()
    runs = line_dedup.Runs(spark, root, buckets=8, fanout=2)  # opened again, with the buckets that it has
    assert runs.buckets == 3
    for k in range(3, 5):
        runs.add(batch(runs, k))
    assert sum(map(len, runs.levels)) <= 3 and len(runs.levels) > 1
    got = sorted((r.h1, r.n, r["last"]) for run in runs.every() for r in run.collect())
    assert got == sorted([(1, 1, 10), *((k + 2, 2, 10 - k) for k in range(5))])
    runs.close()


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_dedup(spark, monkeypatch, hot):
    rng = random.Random(12)
    phrase = odd.words(rng, 26)
    more = [(200 + k, odd.words(rng, rng.randrange(30)) + phrase[rng.randrange(20) :] + odd.words(rng, rng.randrange(30)) + phrase * (k % 7 == 0)) for k in range(60)]
    docs = odd.documents(spark, more).filter("doc_id is null or doc_id not in (16, 17)")
    if hot:  # every anchor takes the way of hot ones
        texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        anchors = suffix_dedup._runs(texts, 100, np.zeros(0, np.uint64)).select("anchor").distinct().collect()
        monkeypatch.setattr(suffix_dedup, "_hot_anchors", lambda *_: np.array([r.anchor for r in anchors[::2]], np.int64).view(np.uint64))
    seen, want = set(), []
    for i, t in sorted((p for p in odd.pairs(docs) if p[0] is not None), key=lambda p: p[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = suffix_dedup.dedup_bytes(spark, docs).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got if r.doc_id is not None], want)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert sum(w[2] for w in want) > 1000
    assert suffix_dedup.dedup_bytes(spark, odd.empty(spark)).count() == 0


def test_induced_sorting(monkeypatch):
    rng = random.Random(4)
    for turn in range(160):
        monkeypatch.setattr(suffix_dedup, "SPILL", (64, 300, 1 << 20)[turn % 3])  # nearly every queue goes to disk
        monkeypatch.setattr(suffix_dedup, "CHUNK", (1, 7, 40, 1 << 19)[turn % 4])
        width, letters = rng.choice([3, 8, 20]), rng.choice(["a", "ab", "abcdefghijkl"])
        pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(4)]
        records = [r for _ in range(rng.randrange(1, 30)) if len(r := (rng.choice(pool) + rng.choice(pool))[rng.randrange(5) :].encode()) >= width]
        if not records:
            continue
        starts, seen, want = [len(r) - width + 1 for r in records], set(), []
        for r, many in zip(records, starts, strict=True):
            for i in range(many):
                want.append(r[i : i + width] in seen)
                seen.add(r[i : i + width])
        assert suffix_dedup.repeated_starts(records, starts, width).tolist() == want


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    docs = odd.documents(spark, [(50, "<|endoftext|>a<|endoftext|> b"), (51, "aaaaaaaaa" * 300)])
    got = token_counts.count_tokens(spark, docs, BYTE).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in odd.pairs(docs)]
    same(got, want)
    assert token_counts.count_tokens(spark, odd.empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("flush", [20, 1 << 20])
def test_chat(spark, monkeypatch, flush):
    rng = random.Random(6)
    pieces = ["<", "s", ">", "/", "[", "INST", "]", "\\", "<<", "SYS", ">>", "<s>", "</s>", "[/INST]", "TEXT", "é\n"]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))])))
    rows += [(None, 0, "user", "x"), (99, None, "assistant", "y"), (99, 1, "assistant", "z"), (99, 1, "assistant", "z")]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, example int")
    monkeypatch.setattr(chat, "FLUSH", flush)
    examples = chat.format_examples(turns)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        shown = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(learnt))
        assert got[c].turns_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    chars = collections.Counter()
    replies = collections.Counter()
    for r in chat.expand(examples).collect():
        whole = list(chat.parse(r.text))
        chars[r.conv_id] += len(r.text)
        own = [(x[2] or "", x[3] or "") for x in by[r.conv_id]]
        assert whole == own[: len(whole)]
        if r.loss_start is not None:
            assert whole[-1] == ("assistant", chat.unescape(r.text[r.loss_start : r.loss_end]))
            replies[r.conv_id] += 1
        else:
            assert len(whole) == len(own) and own[-1][0] != "assistant"
    assert {c: got[c].formatted_chars for c in by} == chars
    assert replies == collections.Counter(r[0] for r in rows if r[2] == "assistant")
    assert chat.digest(chat.format_examples(turns.limit(0))).count() == 0


def test_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
    assert json.loads(json.dumps(list(queries.ORACLE_SQL)))
