"""Readers of the text formats: member lists, matrices, element files, tag-value files, fixed-width files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MEMBER = T.StructType([T.StructField(n, T.StringType()) for n in ("domain", "pdb", "chain_id", "ranges", "auth_chain_id", "auth_ranges", "uniprot_id")])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, line) of text files; line numbers restart in each file."""
    own = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return own.select("file", F.posexplode(F.split("value", "\r?\n")).alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), "line")


def named_members(df: DataFrame) -> DataFrame:
    """Rows (line_no, line) of "pdb,chain[,ranges]" with # comments to members named pdb_chain_NN."""
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    part = F.split(text, ",", 3)
    own = df.filter(text != "").select("line_no", F.trim(part[0]).alias("pdb"), F.trim(F.try_element_at(part, F.lit(2))).alias("chain_id"), F.coalesce(F.nullif(F.trim(F.try_element_at(part, F.lit(3))), F.lit("")), F.lit(":")).alias("ranges"))
    number = F.row_number().over(Window.partitionBy("pdb", "chain_id").orderBy("line_no")) - 1
    return own.withColumn("domain", F.concat_ws("_", "pdb", "chain_id", F.lpad(number.cast("string"), 2, "0")))


def read_members_txt(spark: SparkSession, path: str) -> DataFrame:
    return named_members(lines(spark, path))


def read_members_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of members, or an object of lists by pdb."""
    text = spark.read.text(path, wholetext=True)
    items = T.ArrayType(MEMBER)
    flat = F.from_json("value", items)
    grouped = F.flatten(F.map_values(F.from_json("value", T.MapType(T.StringType(), items))))
    return text.select(F.explode(F.when(F.ltrim("value").startswith("["), flat).otherwise(grouped)).alias("m")).select("m.*")


def validate_submission(df: DataFrame) -> DataFrame:
    """Rows (line_no, line) to (line_no, pdb, chain_id, ranges, error): ids of four letters and digits, a digit first, in
    lower case; rows that fail keep their number and say why."""
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    part = F.split(text, ",", 3)
    pdb = F.lower(F.trim(part[0]))
    chain = F.coalesce(F.trim(F.try_element_at(part, F.lit(2))), F.lit(""))
    ranges = F.coalesce(F.nullif(F.trim(F.try_element_at(part, F.lit(3))), F.lit("")), F.lit(":"))
    error = F.when(~pdb.rlike("^[0-9][0-9a-z]{3}$"), "bad id").when(chain == "", "no chain").when(~ranges.rlike(r"^(-?\d*:-?\d*)(,-?\d*:-?\d*)*$"), "bad ranges")
    return df.filter(text != "").select("line_no", pdb.alias("pdb"), chain.alias("chain_id"), ranges.alias("ranges"), error.alias("error"))


def read_key_values(spark: SparkSession, path: str, separator: str = ":") -> DataFrame:
    """(file, key, value) of "key: value" or "key=value" lines."""
    part = F.split("line", re.escape(separator), 2)
    return lines(spark, path).filter(F.col("line").contains(separator)).select("file", F.trim(part[0]).alias("key"), F.trim(part[1]).alias("value"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A named matrix (tab-separated, # comments, a header row, row names) in long form (row, col, value)."""
    own = lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    head = own.groupBy("file").agg(F.min_by(F.split("line", "\t"), "line_no").alias("head"), F.min("line_no").alias("first"))
    body = own.join(F.broadcast(head), "file").filter("line_no > first").withColumn("cells", F.split("line", "\t"))
    return body.select(F.col("cells")[0].alias("row"), "head", F.posexplode(F.slice("cells", 2, 1 << 20)).alias("i", "text")).select("row", F.col("head")[F.col("i") + 1].alias("col"), F.col("text").try_cast("double").alias("value"))


def read_table(spark: SparkSession, path: str, separator: str = ";", header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=separator, header=header, comment="#", nullValue="")


def read_columns(spark: SparkSession, path: str, take: list[int]) -> DataFrame:
    """Chosen columns of white-space separated lines with # comments."""
    part = F.split(F.trim("line"), r"\s+")
    return lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select(*[part[i].alias(f"c{i}") for i in take])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first words, in lower case, of the lines after a rule of dashes."""
    own = lines(spark, path)
    rule = own.filter(F.col("line").startswith("---")).groupBy("file").agg(F.min("line_no").alias("rule"))
    return own.join(F.broadcast(rule), "file").filter("line_no > rule").select(F.lower(F.split(F.trim("line"), r"\s+")[0]).alias("id")).filter("id <> ''").distinct()


ELEMENT = "struct<label:string,chain_id:string,start:int,end:int,type:string,start_vector:array<double>,end_vector:array<double>>"


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(elements, edges) of JSON files {member: {elements, typed edges by label}}: edges by position; loops and edges to
    missing labels go."""
    kind = f"map<string,struct<secondary_structure_elements:array<{ELEMENT}>,beta_connectivity:array<array<string>>>>"
    own = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("member", "v"))
    elements = own.select("member", F.posexplode("v.secondary_structure_elements").alias("pos", "e")).select("member", "pos", "e.*")
    named = own.select("member", F.explode("v.beta_connectivity").alias("x")).select("member", F.col("x")[0].alias("la"), F.col("x")[1].alias("lb"), F.col("x")[2].try_cast("int").alias("orient"))
    place = elements.select("member", "label", "pos")
    a, b = place.select("member", F.col("label").alias("la"), F.col("pos").alias("pa")), place.select("member", F.col("label").alias("lb"), F.col("pos").alias("pb"))
    edges = named.join(a, ["member", "la"]).join(b, ["member", "lb"]).filter("pa <> pb")
    return elements, edges.select("member", F.least("pa", "pb").alias("i"), F.greatest("pa", "pb").alias("j"), "orient").distinct()


def read_fixed_width(spark: SparkSession, path: str) -> DataFrame:
    """Atom rows of fixed-width structure files."""
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    own = lines(spark, path).filter(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))
    return own.select("file", "line_no", cut(1, 6).alias("group"), cut(7, 5).try_cast("int").alias("id"), cut(13, 4).alias("name"), cut(17, 1).alias("alt"), cut(18, 3).alias("resn"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resi"), cut(31, 8).try_cast("double").alias("x"), cut(39, 8).try_cast("double").alias("y"), cut(47, 8).try_cast("double").alias("z"), cut(77, 2).alias("symbol"))


_TOKENS = re.compile(r"""(?:^;(?P<long>.*?)\n;(?=\s|$))|(?P<comment>\#[^\n]*)|'(?P<single>[^\n]*?)'(?=\s|$)|"(?P<double>[^\n]*?)"(?=\s|$)|(?P<bare>\S+)""", re.M | re.S)


def parse_tag_values(text: str) -> Iterator[tuple[str, str, str, int, str, bool]]:
    """(block, category, item, row, value, quoted) of tag-value text: data_ blocks, loop_ tables, bare, quoted and
    semicolon texts, comments. A frame (save_) counts as a block of its own."""
    tokens: list[tuple[str, bool]] = []
    for m in _TOKENS.finditer(text):
        if m["comment"] is None:
            plain = m["bare"]
            tokens.append((plain, False) if plain is not None else (next(m[k] for k in ("long", "single", "double") if m[k] is not None), True))
    block, i, counts = "", 0, {}
    while i < len(tokens):
        word, quoted = tokens[i]
        low = word.lower()
        i += 1
        if quoted:
            continue
        if low.startswith("data_") or low.startswith("save_") and len(low) > 5:
            block, counts = word[5:], {}
        elif low == "loop_":
            tags = []
            while i < len(tokens) and not tokens[i][1] and tokens[i][0].startswith("_"):
                tags.append(tokens[i][0][1:])
                i += 1
            n = 0
            while tags and i < len(tokens) and (tokens[i][1] or not re.match(r"_|loop_$|data_|save_", tokens[i][0], re.I)):
                category, _, item = tags[n % len(tags)].partition(".")
                yield block, category, item, n // len(tags), *tokens[i]
                n, i = n + 1, i + 1
        elif word.startswith("_") and i < len(tokens):
            category, _, item = word[1:].partition(".")
            yield block, category, item, counts.setdefault((category, item), 0), *tokens[i]
            i += 1


def read_tag_values(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """(file, block, category, item, row, value, quoted) of tag-value files; one file is parsed by one task. Unquoted .
    and ? are null."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf.file, pdf["value"], strict=True):
                rows = [(file, *r) for r in parse_tag_values(text) if category is None or r[1] == category]
                yield pd.DataFrame(rows, columns=["file", "block", "category", "item", "row", "value", "quoted"])

    out = files.mapInPandas(run, "file string, block string, category string, item string, row int, value string, quoted boolean")
    return out.withColumn("value", F.when(F.col("quoted") | ~F.col("value").isin(".", "?"), F.col("value")))


def category_table(cells: DataFrame, items: dict[str, str]) -> DataFrame:
    """Rows of a category from its cells: the items asked for, cast as asked."""
    wide = cells.groupBy("file", "block", "row").agg(*[F.max(F.when(F.col("item") == i, F.col("value"))).alias(i) for i in items])
    return wide.select("file", "block", "row", *[F.col(i).try_cast(t).alias(i) for i, t in items.items()])


def first_available(wanted: DataFrame, sources: list[tuple[str, DataFrame]], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the content of the first source that has the key, keys that none has)."""
    out = wanted.select(key)
    for i, (_, df) in enumerate(sources):
        out = out.join(df.select(key, F.col("content").alias(f"_c{i}")), key, "left")
    name = F.coalesce(*[F.when(F.col(f"_c{i}").isNotNull(), n) for i, (n, _) in enumerate(sources)])
    found = out.select(key, F.coalesce(*[F.col(f"_c{i}") for i in range(len(sources))]).alias("content"), name.alias("source"))
    return found.filter("content is not null"), found.filter("content is null").select(key)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of lines of an id and a name of several words, maybe packed."""
    text = F.trim("line")
    return lines(spark, path).filter(text != "").select(F.regexp_extract(text, r"^(\S+)", 1).alias("id"), F.regexp_extract(text, r"^\S+\s+(.*)$", 1).alias("name"))


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    """(domain, family, idfam, length, resolution) of lines of a domain, four numbers of its family, four of its sequence
    family, their count, its length and resolution."""
    own = read_columns(spark, path, list(range(12)))
    return own.select(F.col("c0").alias("domain"), F.concat_ws(".", *[f"c{i}" for i in range(1, 5)]).alias("family"), F.concat_ws(".", *[f"c{i}" for i in range(5, 9)]).alias("idfam"), F.col("c10").try_cast("int").alias("length"), F.col("c11").try_cast("double").alias("resolution"))


def read_accession(spark: SparkSession, path: str, accession: str) -> DataFrame:
    """(pdb, domain, chain, auth_chain, start, end) of a saved answer {accession: {"PDB": {pdb: mappings or {"mappings":
    mappings}}}}; an accession that it lacks has no rows, an entry of another kind is an error."""
    one = "struct<domain:string,struct_asym_id:string,chain_id:string,start:struct<residue_number:int>,end:struct<residue_number:int>>"
    own = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<PDB:map<string,string>>>")[accession]["PDB"].alias("m"))
    entry = own.select(F.explode("m").alias("pdb", "entry"))
    plain = F.from_json("entry", f"array<{one}>")
    inner = F.from_json("entry", f"struct<mappings:array<{one}>>")["mappings"]
    found = F.when(F.ltrim("entry").startswith("["), plain).otherwise(inner)
    kind = f"array<{one}>"
    checked = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no mappings for "), F.col("pdb"))).cast(kind))
    x = entry.select("pdb", F.explode(checked).alias("x"))
    return x.select("pdb", "x.domain", F.col("x.struct_asym_id").alias("chain"), F.col("x.chain_id").alias("auth_chain"), F.col("x.start.residue_number").alias("start"), F.col("x.end.residue_number").alias("end"))


def read_lists(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Member lists in all folders below one, with the name of the file that each comes from: (source, domain, pdb, ...)."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    own = text.select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1).alias("source"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    part = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), ",", 3)
    named = own.filter(F.trim(F.regexp_replace("line", "#.*$", "")) != "").select("source", "line_no", F.trim(part[0]).alias("pdb"), F.trim(F.try_element_at(part, F.lit(2))).alias("chain_id"), F.coalesce(F.nullif(F.trim(F.try_element_at(part, F.lit(3))), F.lit("")), F.lit(":")).alias("ranges"))
    number = F.row_number().over(Window.partitionBy("source", "pdb", "chain_id").orderBy("line_no")) - 1
    return named.withColumn("domain", F.concat_ws("_", "pdb", "chain_id", F.lpad(number.cast("string"), 2, "0"))).drop("line_no")


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """Atom rows of tag-value structure files, of each file's first model: (file, row, and the items that it needs)."""
    items = {"group_PDB": "string", "id": "int", "type_symbol": "string", "label_atom_id": "string", "label_alt_id": "string", "label_comp_id": "string", "label_asym_id": "string", "label_seq_id": "int", "Cartn_x": "double", "Cartn_y": "double", "Cartn_z": "double", "pdbx_PDB_model_num": "string"}
    atoms = category_table(read_tag_values(spark, path, "atom_site"), items)
    first = atoms.groupBy("file", "block").agg(F.min_by(F.struct("pdbx_PDB_model_num"), "row").alias("_first"))
    return atoms.join(first, ["file", "block"]).filter(F.col("pdbx_PDB_model_num").eqNullSafe(F.col("_first.pdbx_PDB_model_num"))).drop("_first")


#: Fixed pattern: one line of a structure-similarity hit list.
HIT = r"^\s*(\d+):\s+(\S{4})-(\S)\s+(-?[\d.]+)\s+([\d.]+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(.*?)\s*$"


def parse_hits(df: DataFrame) -> DataFrame:
    """(rank, pdb, chain_id, z, rmsd, aligned, residues, identity, description) of the hit lines among rows (line)."""
    part = lambda i: F.regexp_extract("line", HIT, i)
    hits = df.filter(F.col("line").rlike(HIT))
    return hits.select(part(1).cast("int").alias("rank"), F.lower(part(2)).alias("pdb"), part(3).alias("chain_id"), part(4).cast("double").alias("z"), part(5).cast("double").alias("rmsd"), part(6).cast("int").alias("aligned"), part(7).cast("int").alias("residues"), part(8).cast("int").alias("identity"), part(9).alias("description"))


#: Fixed pattern: one line of a recursive folder listing with full times.
LISTING = r"^-\S+\s+\d+\s+\S+\s+\S+\s+(\d+)\s+(\d{4}-\d\d-\d\d)\s+(\d\d:\d\d(?::\d\d)?)\S*\s+(?:[+-]\d{4}\s+)?(.+)$"


def parse_listing(df: DataFrame) -> DataFrame:
    """(name, size, modified) of the file lines of a listing."""
    part = lambda i: F.regexp_extract("line", LISTING, i)
    return df.filter(F.col("line").rlike(LISTING)).select(part(4).alias("name"), part(1).try_cast("long").alias("size"), F.try_to_timestamp(F.concat(part(2), F.lit(" "), F.rpad(part(3), 8, ":00")), F.lit("yyyy-MM-dd HH:mm:ss")).alias("modified"))


def hierarchy(spark: SparkSession, path: str, depth: int = 4) -> DataFrame:
    """(id, example) of every node but the root of a JSON tree {id, example_domain_id, children}, to a depth."""
    node = "id string, example string"
    for _ in range(depth):
        node = f"id string, example string, children array<struct<{node}>>"
    level = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", node)["children"]).alias("n"))
    out = level.select("n.id", "n.example")
    for _ in range(depth - 1):
        level = level.select(F.explode("n.children").alias("n"))
        out = out.union(level.select("n.id", "n.example"))
    return out.filter("id is not null")
