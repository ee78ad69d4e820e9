"""Writers of the text formats. Each makes one text column in order, or a partitioned folder, and leaves files to Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    """Null is an empty field."""
    df.write.mode("overwrite").csv(path, sep=separator, header=True, nullValue="", emptyValue="")


def write_by_middle(df: DataFrame, path: str, key: str) -> None:
    """JSON in folders by the second and third character of the key."""
    df.withColumn("sub", F.substring(key, 2, 2)).write.mode("overwrite").partitionBy("sub").json(path)


def matrix_lines(cells: DataFrame, columns: list[str], kind: str = "float64") -> DataFrame:
    """(n, line) of a named matrix from long cells (row, col, value): dtype and shape comments, header, rows."""
    wide = cells.groupBy("row").agg(*[F.first(F.when(F.col("col") == c, F.col("value")), ignorenulls=True).alias(f"_{i}") for i, c in enumerate(columns)])
    body = wide.select(F.concat(F.lit("3"), F.col("row")).alias("n"), F.concat_ws("\t", "row", *[F.when(F.col(f"_{i}").isNull(), "0").otherwise(F.format_string("%s", F.col(f"_{i}"))) for i in range(len(columns))]).alias("line"))
    size = wide.agg(F.count("*").alias("rows")).select(F.lit("1").alias("n"), F.concat(F.lit("#shape="), F.col("rows").cast("string"), F.lit(f",{len(columns)}")).alias("line"))
    spark = cells.sparkSession
    fixed = spark.createDataFrame([("0", f"#dtype={kind}"), ("2", "\t".join(["", *columns]))], "n string, line string")
    return fixed.union(size).union(body)


def quote(value: Column) -> Column:
    """A value as the tag-value format shows it."""
    plain = ~value.rlike(r"""[\s'"#]|^[_$\[\];]|^(?i)(data_|loop_|save_)""") & (value != "") & ~value.isin(".", "?")
    return F.when(value.isNull(), "?").when(plain, value).when(~value.contains("'"), F.concat(F.lit("'"), value, F.lit("'"))).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def category_lines(df: DataFrame, category: str, order: str) -> DataFrame:
    """(n, line) of a category: a comment without rows, one item a line for one row, else a loop."""
    names = [c for c in df.columns if c != order]
    spark = df.sparkSession
    n = df.limit(2).count()
    if n == 0:
        return spark.createDataFrame([(0, f"# no rows in {category}")], "n long, line string")
    shown = df.select(F.col(order).cast("long").alias("n"), *[quote(F.col(c).cast("string")).alias(c) for c in names])
    if n == 1:
        items = F.array(*[F.struct(F.lit(i).cast("long").alias("n"), F.concat(F.lit(f"_{category}.{c} "), F.col(c)).alias("line")) for i, c in enumerate(names)])
        return shown.select(F.explode(items).alias("x")).select("x.*")
    head = spark.createDataFrame([(-len(names) - 1, "loop_")] + [(i - len(names), f"_{category}.{c}") for i, c in enumerate(names)], "n long, line string")
    return head.union(shown.select("n", F.concat_ws(" ", *names).alias("line")))


def fixed_width(widths: list[tuple[Column, int, str]]) -> Column:
    """Fields side by side, padded on the side named; a text wider than its field is an error."""
    out = []
    for text, width, side in widths:
        text = F.coalesce(text.cast("string"), F.lit(""))
        padded = F.lpad(text, width, " ") if side == "right" else F.rpad(text, width, " ")
        out.append(F.when(F.length(text) <= width, padded).otherwise(F.raise_error(F.concat(F.lit("too wide: "), text)).cast("string")))
    return F.concat(*out)


def html_rows(df: DataFrame, columns: list[str], order: list[str], most: int = 50) -> DataFrame:
    """A table's first rows as HTML lines, and how many there are. The limit is the page's."""
    cells = [F.concat(F.lit("<td>"), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>")) for c in columns]
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(most).select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line")).crossJoin(F.broadcast(total))


def archive_list(wanted: DataFrame, actual: DataFrame, key: str, alternative: str) -> DataFrame:
    """Content for every wanted key: the actual one, or the alternative, with a mark for what is missing."""
    return wanted.select(key).join(actual.select(key, "content"), key, "left").select(key, F.coalesce("content", F.lit(alternative)).alias("content"), F.col("content").isNull().alias("missing"))


def write_distinct(df: DataFrame, path: str, key: str, form: str = "json") -> None:
    """The distinct keys, in order, as JSON or CSV."""
    own = df.select(key).distinct().orderBy(key)
    (own.write.mode("overwrite").json(path) if form == "json" else write_csv(own, path))


def structure_lines(points: DataFrame, order: str, name: str = "structure") -> DataFrame:
    """(n, line) of a structure of points (x, y, z, occupancy) as tag-value text: one trace atom a point, in order."""
    number = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(order))
    place = [F.format_string("%.3f", F.col(c).cast("double")).alias(f"Cartn_{c}") for c in "xyz"]
    own = points.select(number.alias("_n"), F.lit("ATOM").alias("group_PDB"), number.alias("id"), F.lit("C").alias("type_symbol"), F.lit("CA").alias("label_atom_id"), F.lit("X").alias("label_asym_id"), number.alias("label_seq_id"), *place, F.format_string("%.3f", F.col("occupancy").cast("double")).alias("occupancy"))
    head = points.sparkSession.createDataFrame([(-1000, f"data_{name}")], "n long, line string")
    return head.union(category_lines(own, "atom_site", "_n"))


def alignment_lines(matches: DataFrame, letters: DataFrame, a: str, b: str) -> DataFrame:
    """(pair, name, line): both sequences of each pair one above the other, unmatched places against dashes. matches: (pair,
    i, j); letters: (pair, side, pos, letter) with side "a" or "b"."""
    x = letters.filter("side = 'a'").select("pair", F.col("pos").alias("i"), F.col("letter").alias("la"))
    y = letters.filter("side = 'b'").select("pair", F.col("pos").alias("j"), F.col("letter").alias("lb"))
    both = matches.join(x, ["pair", "i"]).join(y, ["pair", "j"])
    only_a = x.join(matches.select("pair", "i"), ["pair", "i"], "left_anti").select("pair", "i", F.lit(None).cast("int").alias("j"), "la", F.lit("-").alias("lb"))
    only_b = y.join(matches.select("pair", "j"), ["pair", "j"], "left_anti").select("pair", F.lit(None).cast("int").alias("i"), "j", F.lit("-").alias("la"), "lb")
    every = both.select("pair", "i", "j", "la", "lb").unionByName(only_a).unionByName(only_b)
    # A place of one sequence alone stands behind the last match before it; those of the first come first.
    last_i = F.coalesce(F.col("i"), F.lit(-1))
    pairs = matches.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("_m"))
    placed = every.join(pairs, "pair", "left").withColumn("_k", F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), F.size(F.filter("_m", lambda m: m["i"] <= F.col("i")))).when(F.col("i").isNotNull(), F.size(F.filter("_m", lambda m: m["i"] < F.col("i")))).otherwise(F.size(F.filter("_m", lambda m: m["j"] < F.col("j")))))
    placed = placed.withColumn("_k", F.when(F.col("_m").isNull(), 0).otherwise(F.col("_k")))
    rank = F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), 0).when(F.col("i").isNotNull(), 1).otherwise(2)
    cells = placed.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct(F.col("_k").alias("k"), rank.alias("r"), last_i.alias("i"), F.coalesce(F.col("j"), F.lit(-1)).alias("j"), "la", "lb"))).alias("c"))
    line = lambda n: F.array_join(F.transform("c", lambda x: x[n]), "")
    return cells.select("pair", F.explode(F.array(F.struct(F.lit(a).alias("name"), line("la").alias("line")), F.struct(F.lit(b).alias("name"), line("lb").alias("line")))).alias("x")).select("pair", "x.*")
