"""Readers and writers on small files, the step runner, and job states."""

import json

import pytest
from pyspark.sql import functions as F

from plait.operators import graphs, intervals, windows
from plait.plans.steps import Steps
from plait.sources import readers, sinks
from plait.streaming import jobs


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_member_lists(spark, tmp_path):
    txt = put(tmp_path, "a.txt", "# list\n1abc,A,1:50\n\n1abc,A,60:80 # more\n2xyz,B\n")
    assert [(r.domain, r.ranges) for r in readers.read_members_txt(spark, txt).orderBy("line_no").collect()] == [("1abc_A_00", "1:50"), ("1abc_A_01", "60:80"), ("2xyz_B_00", ":")]
    one = {"domain": "d1", "pdb": "1abc", "chain_id": "A", "ranges": ":"}
    flat, grouped = put(tmp_path, "f.json", json.dumps([one])), put(tmp_path, "g.json", json.dumps({"1abc": [one, {**one, "domain": "d2"}]}))
    assert [r.domain for r in readers.read_members_json(spark, flat).collect()] == ["d1"]
    assert sorted(r.domain for r in readers.read_members_json(spark, grouped).collect()) == ["d1", "d2"]


def test_small_texts(spark, tmp_path):
    kv = put(tmp_path, "info.txt", "id: 7\nname: a: b\n")
    assert {(r.key, r.value) for r in readers.read_key_values(spark, kv).collect()} == {("id", "7"), ("name", "a: b")}
    m = put(tmp_path, "m.tsv", "#dtype=float\n#shape=2,2\n\tx\ty\na\t1\t2\nb\t3\tnan?\n")
    assert {(r.row, r.col, r.value) for r in readers.read_matrix(spark, m).collect()} == {("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), ("b", "y", None)}
    i = put(tmp_path, "i.txt", "header\n-----\n1ABC x\n1abc\n2DEF\n")
    assert sorted(r.id for r in readers.read_index(spark, i).collect()) == ["1abc", "2def"]
    c = put(tmp_path, "c.txt", "# c\n1.10 a b\n 2.20   c d\n")
    assert [tuple(r) for r in readers.read_columns(spark, c, [0, 2]).collect()] == [("1.10", "b"), ("2.20", "d")]


def test_elements(spark, tmp_path):
    e = lambda n, k: {"label": n, "chain_id": "A", "start": 1, "end": 5, "type": k, "start_vector": [0, 0, 0], "end_vector": [1, 1, 1]}
    path = put(tmp_path, "e.json", json.dumps({"m1": {"secondary_structure_elements": [e("a", "E"), e("b", "E")], "beta_connectivity": [["b", "a", -1], ["a", "a", 1], ["a", "zz", 1]]}}))
    elements, edges = readers.read_elements(spark, path)
    assert elements.count() == 2
    assert [tuple(r) for r in edges.collect()] == [("m1", 0, 1, -1)]


def test_tag_values(spark, tmp_path):
    text = "data_X\n# note\n_cell.a 'it''s' \n_cell.b ?\nloop_\n_atom.id\n_atom.name\n_atom.x\n1 'C A' 1.5\n2 \"N'\" .\n3\n;long\ntext\n;\n '?'\n_end.z 5\n"
    path = put(tmp_path, "x.cif", text.replace("''", "'"))
    cells = readers.read_tag_values(spark, path)
    rows = readers.category_table(cells.filter("category = 'atom'"), {"id": "int", "name": "string", "x": "string"}).orderBy("row").collect()
    assert [(r.id, r.name, r.x) for r in rows] == [(1, "C A", "1.5"), (2, "N'", None), (3, "long\ntext", "?")]
    assert {(r["item"], r["value"]) for r in cells.filter("category <> 'atom'").collect()} == {("a", "it's"), ("b", None), ("z", "5")}
    df = spark.createDataFrame([(1, "C A", None), (2, "x", "q'r")], "n int, a string, b string")
    back = "\n".join(r.line for r in sinks.category_lines(df, "cat", "n").orderBy("n").collect())
    again = readers.category_table(readers.read_tag_values(spark, put(tmp_path, "y.cif", "data_y\n" + back + "\n")), {"a": "string", "b": "string"})
    assert {(r.a, r.b) for r in again.collect()} == {("C A", None), ("x", "q'r")}
    assert sinks.category_lines(df.limit(0), "cat", "n").first().line.startswith("#")
    assert [r.line for r in sinks.category_lines(df.limit(1), "cat", "n").orderBy("n").collect()] == ["_cat.a 'C A'", "_cat.b ?"]


def test_fixed_width(spark, tmp_path):
    line = "ATOM      1  CA  ALA A  12      11.104   6.134  -6.504  1.00  0.00           C  "
    got = readers.read_fixed_width(spark, put(tmp_path, "p.pdb", line + "\nTER\n")).first()
    assert (got.name, got.resn, got.chain, got.resi, got.x, got.z, got.symbol) == ("CA", "ALA", "A", 12, 11.104, -6.504, "C")
    with pytest.raises(Exception, match="too wide"):
        spark.range(1).select(sinks.fixed_width([(F.lit("abcd"), 3, "left")])).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1abc", None), ("2bcd", "x")], "id string, v string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert readers.read_table(spark, str(tmp_path / "csv")).count() == 2
    sinks.write_by_middle(df, str(tmp_path / "by"), "id")
    assert spark.read.json(str(tmp_path / "by")).select("sub").distinct().count() == 2
    sinks.write_json(df, str(tmp_path / "js"), "id")
    assert spark.read.json(str(tmp_path / "js")).count() == 2


def test_errors_are_raised(spark):
    falls = spark.createDataFrame([(1, 1, 5), (1, 2, 3)], "k int, pos int, n int")
    with pytest.raises(Exception, match="decreases"):
        windows.fragments(falls, windows.over("k", "pos"), "n").collect()
    with pytest.raises(ValueError, match="cycle"):
        graphs.reduction(spark.createDataFrame([(1, 2), (2, 1)], "a int, b int"))


@pytest.mark.parametrize("mode", ["trim", "mirror", "straight", "original"])
def test_smoothing_keeps_lines_straight(spark, mode):
    df = spark.createDataFrame([(1, i, 2.0 * i) for i in range(9)] + [(2, i, 1.0) for i in range(3)], "k int, pos int, v double")
    got = windows.smooth(df, "k", ["pos"], "v", mode).collect()
    assert all(abs(r.smooth - r.v) < 1e-9 for r in got if mode != "mirror" or 2 <= r.pos <= 6 or r.k == 2)
    assert len(got) == (5 if mode == "trim" else 12)


def test_intervals_parse(spark):
    rows = spark.createDataFrame([("1:50,120:",), (":",), (None,)], "r string").select(intervals.parse(F.col("r")).alias("r")).collect()
    assert [(x.start, x.end) for x in rows[0].r] == [(1, 50), (120, 2**31 - 1)]
    assert [len(r.r) for r in rows] == [2, 1, 1]


def test_steps():
    s, done = Steps(), []
    for n in "ABCD":
        s.step(n)(lambda c, n=n: done.append(n))
    s.step("Z", always=True)(lambda c: done.append("Z"))
    assert s.chosen("B:C") == ["B", "C", "Z"] and s.chosen(":A") == ["A", "Z"] and s.chosen("B+") == ["B", "C", "Z"] and s.chosen("C:, A") == ["A", "C", "D", "Z"]
    s.run({}, "A:B")
    assert done == ["A", "B", "Z"]


def test_job_stream(spark, tmp_path):
    log = [("j1", 1.0, "Pending"), ("j1", 2.0, "Running"), ("j1", 3.0, "Completed"), ("j2", 1.0, "Running"), ("j3", 1.0, "Pending"), ("j3", 2.0 + jobs.TIMEOUT_S, "Running")]
    df = spark.createDataFrame(log, "job string, at double, to string")
    want = {("j1", 1.0, "Pending", True), ("j1", 2.0, "Running", True), ("j1", 3.0, "Completed", True), ("j2", 1.0, "Nonexistent", False), ("j3", 1.0, "Pending", True), ("j3", 1.0 + jobs.TIMEOUT_S, "Failed", True), ("j3", 2.0 + jobs.TIMEOUT_S, "Failed", False)}
    assert {tuple(r) for r in jobs.replay(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.track(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("states").collect()} == want
