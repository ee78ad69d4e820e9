"""Every registered query of the corpus operators over the whole smallest tables, against plain versions."""

from __future__ import annotations

import base64
import collections
import hashlib
import json
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plait.llm import ann, bpe_codec, decontam, jaccard, queries, ragged, token_counts, token_store, toxicity

from .test_operators import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else bytes(x)).hexdigest()


def rows(spark, name, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect()}


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rows(spark, "op1_token_store", "start", "n_tokens", "ids_crc32") == want


def test_op2(spark):
    own = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    fine = {i: np.array(v, float) for i, v in own.items() if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids])
    got = collections.defaultdict(list)
    for r in queries.op2_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        s = x @ fine[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        assert [r for r, _, _ in got[q]] == list(range(1, len(order) + 1))
        assert all(abs(v - fine[q] @ fine[i]) < 1e-12 for _, i, v in got[q])
        hits += len({i for _, i, _ in got[q]} & {int(ids[j]) for j in order}) / len(order)
    assert hits / len(asked) >= 0.9


def test_recall_through_the_codes(spark, monkeypatch):
    """More vectors than are ranked exactly, so that the codes choose."""
    monkeypatch.setattr(ann, "BLOCK", 2048)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 32))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), "a", "b", 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, vid string, ids string, block int")
    for metric in ("ip", "l2"):
        got = ann.search(spark, ann.build_index(spark, table), table, F.col("vid") % 50 == 0, metric=metric, depth=128).toPandas()
        near = x.astype(float) @ x.astype(float).T
        if metric == "l2":
            near = 2 * near - np.diag(near)[None] - np.diag(near)[:, None]
        found = 0.0
        for q, g in got.groupby("query_id"):
            order = [j for j in np.lexsort((np.arange(6000), -near[q])) if j != q][:20]
            found += len(set(g.vec_id) & set(order)) / 20
        assert found / got.query_id.nunique() >= 0.9


def test_op3(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    got = collections.defaultdict(set)
    for r in queries.op3_decontamination(spark, SF).collect():
        got[r.doc_id].add(r.item_id)
        assert 0 <= r.start < r.end <= len(texts[r.doc_id]) and r.edits >= 0
    for i, t in texts.items():
        own = plain(t)
        for item, text in items:
            passage = plain(text)
            if len(passage) >= 20 and passage in own:
                assert item in got[i]  # nothing that is held as a whole is missed
    windows = decontam.Windows(items)
    for i, found in got.items():  # and what is found is there, within the edits
        for item in found:
            own = np.frombuffer(plain(texts[i]).encode("utf-32-le"), np.uint32)
            best = min(plain_edits(own, windows.points[v, : windows.length[v]]) - windows.edits[v] for v in range(len(windows.item)) if windows.item[v] == item)
            assert best <= 0


def plain_edits(text: np.ndarray, window: np.ndarray) -> int:
    """Least edits of the window anywhere in the text."""
    row = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    for j, c in enumerate(window):
        new = np.empty_like(row)
        new[0] = j + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != c))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def test_op4(spark, texts):
    assert rows(spark, "op4_ngram_jaccard", "n_shingles", "component_id") == brute_components(list(texts.items()), 4, 85, 100)


def test_op5(spark, texts):
    got = rows(spark, "op5_toxicity", "held_out", "score", "predicted")
    assert {i: g[0] for i, g in got.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    assert all(0 <= s <= 1 and p == int(s >= 0.7) for _, s, p in got.values())


def test_op5_on_held_out_labels(spark):
    """Of the larger table's labels that the fit never saw."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op5_toxicity(spark, sf).filter("held_out").collect()}
    known = [(r.toxic, *got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and r.toxic is not None]
    bad = [p for t, _, p in known if t == 1]
    good = [p for t, _, p in known if t == 0]
    assert len(bad) > 30 and len(good) > 300
    assert np.mean(bad) >= 0.9 and np.mean(good) <= 0.02


def test_scores_belong_to_their_model(spark):
    """Two models in one worker: neither takes the other's remembered words."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "gamma delta", "alpha gamma"] * 5)], "doc_id long, text string")
    models = [toxicity.Model(w * np.ones(toxicity.BUCKETS), np.zeros((2, 2)), np.array([0.0, 1.0, 0.0, 0.0])) for w in (0.5, -0.5)]
    for model in (*models, *models):
        flat, offsets = ragged.utf8(__import__("pyarrow").array([r.text for r in docs.collect()]))
        w = toxicity.words_of(flat, offsets)
        p, _ = toxicity.marginals(model.emissions(w.spell[np.arange(len(w.keys))])[w.codes], w.before, model.chain)
        assert np.allclose([r.score for r in toxicity.score(spark, docs, model).collect()], model.score(p, w.before))


def test_op6(spark, texts):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(t or ""))
    assert rows(spark, "op6_bpe_codec", "n_tokens", "ids_sha256", "decoded_sha256") == want


def plain_lines(texts):
    """{doc: (lines, lines left)}"""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = {}
    for i, t in texts.items():
        each = (t or "").split("\n")
        out[i] = (each, [x for x in each if len(key(x)) < 20 or len(held[key(x)]) < 3 or i == max(held[key(x)])])
    return out


def test_op7(spark, texts):
    want = {i: (len(a), len(a) - len(b), sha("\n".join(b))) for i, (a, b) in plain_lines(texts).items()}
    assert rows(spark, "op7_line_dedup", "n_lines", "n_dropped", "kept_sha256") == want


def test_op8(spark, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[i] = (len(b), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), sha(np.frombuffer(b, np.uint8)[~gone[:-1]]))
    assert rows(spark, "op8_suffix_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op9(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in texts.items()}
    assert rows(spark, "op9_token_counts", "n_bytes", "n_tokens", "over_limit") == want


def test_op10(spark):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, SF).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        own.sort()
        learnt = "".join(t for _, role, t in own if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), sha(learnt))
        contexts = sum(sum(len(t) for _, _, t in own[: k + 1]) for k, x in enumerate(own) if x[1] == "assistant")
        assert got[c].formatted_chars >= contexts


@pytest.mark.parametrize("size", [1 << 22])
def test_very_long_texts(spark, size):
    """Texts beyond every piece that tasks cut, through the operators that take texts whole."""
    from tokenizers import Tokenizer

    word = "lorem ipsum dolor sit amet, consectetur 12 adipiscing\n"
    docs = spark.createDataFrame([(1, word * (size // len(word))), (2, "ab " * 10), (3, "x" * 200_000)], "doc_id long, text string")
    want = {r.doc_id: r.text for r in docs.collect()}
    byte, word_path, multi = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
    library = Tokenizer.from_file(byte)
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark, docs, byte).collect()}
    assert counts[1] == len(library.encode(want[1], add_special_tokens=False).ids) and counts[2] == len(library.encode(want[2], add_special_tokens=False).ids)
    decoded = {r.doc_id: bytes(r.decoded).decode() for r in bpe_codec.decode(spark, bpe_codec.encode(spark, docs, multi), multi).collect()}
    assert decoded == want
    store = token_store.read_store(spark, token_store.write_store(spark, docs, word_path)).orderBy("doc_id").collect()
    assert [r.start for r in store] == np.append(0, np.cumsum([r.n_tokens for r in store]))[:-1].tolist()
    sets = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark, docs).collect()}
    assert sets[3] == (1, 3) and sets[2][0] == 1


def test_pipeline(spark, texts):
    """Each stage against a plain version of it, on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("own") for c in ("score", "spans", "leaks", "n_lines", "n_dropped", "row", "mark", "lost")})
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    from plait.llm import scratch

    def run(name, df):
        out = scratch.write(stages[name](spark, df, SF), "test")
        assert out.columns == docs.columns
        assert out.filter("score <> 'own' or leaks <> 'own' or n_lines <> 'own' or row <> 'own'").count() == 0
        return out

    model = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = run("toxicity", docs)
    scores = {r.doc_id: r.score for r in toxicity.score(spark, docs.select("doc_id", "text"), model).collect()}
    assert set(read(clean)) == {i for i, s in scores.items() if s < 0.7}
    lines = run("line_dedup", clean)
    assert read(lines) == {i: "\n".join(b) for i, (_, b) in plain_lines(read(clean)).items()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = run("near_duplicates", lines)
    parts = brute_components(list(read(lines).items()), 5, 80, 100)
    assert set(read(near)) == {i for i, (_, c) in parts.items() if c == i}
    kept = run("decontamination", near)
    leaks = {r.doc_id for r in decontam.find_leaks(spark, near.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")).filter(F.size("leaks") > 0).collect()}
    assert set(read(kept)) == set(read(near)) - leaks
    tokens = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in stages["token_ids"](spark, kept, SF).collect()}
    assert {i: x[1] for i, x in tokens.items()} == {i: sha(t) for i, t in read(kept).items()}


def test_pipeline_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word", "en", "s", 4), (3, "word", "en", "s", 4), (None, "no id at all", "en", "s", 12), (4, "one two three four five six", None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty, odd = stage(spark, empty, SF), stage(spark, odd, SF)
        assert empty.count() == 0
        assert odd.count() == 6, name


def test_registered_queries_are_all_tested():
    here = open(__file__).read()
    assert all(f"def test_op{n}(" in here for n in range(1, 11))
    assert json.loads(json.dumps(sorted(queries.QUERIES))) == sorted(queries.QUERIES)
