"""Readers and writers of the text formats: baskets, labelled graphs, mined patterns, edge lists, logs, candidates.

Readers take a DataFrame of lines, so that the same parser serves files, tables and literals. Formats whose lines stand for
themselves are read by plain_lines(), in splits. Formats with blocks need the order of lines: lines() numbers them within
their file; a file of blocks is one unit of work, many files are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of files whose lines stand for themselves; line_no ascends within a file, with gaps between splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def literal_lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("", i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no int, value string")


def words(c: Column | str = "value") -> Column:
    return F.split(F.trim(c), "\\s+")


# ---- baskets and series ----------------------------------------------------------------------------------------------


def read_baskets(rows: DataFrame) -> DataFrame:
    """txn_id (the line number), items."""
    return rows.where(F.trim("value") != "").select(F.col("line_no").cast("long").alias("txn_id"), F.transform(words(), lambda x: x.cast("int")).alias("items"))


def write_baskets(baskets: DataFrame, path: str) -> None:
    """txn_id, items -> one line each."""
    baskets.select(F.array_join(F.col("items").cast("array<string>"), " ").alias("value")).write.mode("overwrite").text(path)


def read_series(spark: SparkSession, path: str, columns: tuple[str, ...] = ("apriori_time", "fpgrowth_time")) -> DataFrame:
    return spark.read.schema(f"support int, {', '.join(f'{c} double' for c in columns)}").csv(path, header=True).orderBy("support")


def append_series(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


# ---- logs ------------------------------------------------------------------------------------------------------------


def read_run_log(rows: DataFrame) -> DataFrame:
    """alg, support, seconds of lines ``<alg> runtime at <s>% support: <t> seconds``; unreadable seconds are 0, rows of
    unreadable support are dropped, other lines ignored."""
    w = words()
    at = lambda i: F.try_element_at(w, F.lit(i))
    log = rows.where(F.col("value").contains("runtime at")).select("line_no", at(1).alias("alg"), F.replace(at(4), F.lit("%"), F.lit("")).try_cast("int").alias("support"), F.coalesce(at(6).try_cast("int"), F.lit(0)).alias("seconds"))
    return log.where("support is not null").select("alg", "support", "seconds")


# ---- labelled graphs ---------------------------------------------------------------------------------------------------


def normal_label(c: Column) -> Column:
    """An integer if it is one, without leading zeros."""
    return F.coalesce(c.try_cast("bigint").cast("string"), c)


def read_graphs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (gid, nid, label) and edges (gid, u, v, label): blocks begin with ``#`` or ``t``; ``v id label``, ``e u v label``.

    Edges are undirected (u <= v); of repeated ones the first label stays, of repeated nodes the last. gid counts the
    headers of a file; ids are unique with the file column for several files.
    """
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.where(F.trim("value") != "").select("file", "line_no", F.trim("value").alias("value"))
    marked = marked.withColumn("gid", F.sum(F.when(F.col("value").startswith("#") | F.col("value").startswith("t"), 1).otherwise(0)).over(order) - 1).where("gid >= 0")
    w = words()
    vs = marked.where(F.col("value").startswith("v")).select("file", "gid", "line_no", w[1].cast("long").alias("nid"), w[2].alias("label"))
    nodes = vs.groupBy("file", "gid", "nid").agg(F.max_by("label", "line_no").alias("label"))
    es = marked.where(F.col("value").startswith("e")).select("file", "gid", "line_no", w[1].cast("long").alias("a"), w[2].cast("long").alias("b"), w[3].alias("label"))
    edges = es.groupBy("file", "gid", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min_by("label", "line_no").alias("label"))
    return nodes.drop("file"), edges.drop("file")


def graph_count(rows: DataFrame) -> DataFrame:
    """How many graphs the headers announce."""
    return rows.where(F.col("value").startswith("#") | F.col("value").startswith("t")).agg(F.count("*").alias("graphs"))


def label_map(labels: DataFrame) -> DataFrame:
    """label, code: integers stand for themselves, other labels are numbered from 1 in order of the label."""
    every = labels.select(normal_label(F.col("label")).alias("label")).distinct()
    number = every.where(F.col("label").try_cast("bigint").isNull()).select("label", F.row_number().over(Window.orderBy("label")).cast("long").alias("code"))
    return every.where(F.col("label").try_cast("bigint").isNotNull()).select("label", F.col("label").cast("long").alias("code")).unionByName(number)


def render_graphs(nodes: DataFrame, edges: DataFrame, header: str = "t # ") -> DataFrame:
    """gid, value: a block of text per graph, nodes renumbered from 0 in order of their ids."""
    order = Window.partitionBy("gid").orderBy("nid")
    new = nodes.withColumn("new", F.row_number().over(order) - 1)
    vs = new.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("new", "label"))).alias("vs"))
    at = new.select("gid", F.col("nid").alias("n"), "new")
    es = edges.join(at.select("gid", F.col("n").alias("u"), F.col("new").alias("a")), ["gid", "u"]).join(at.select("gid", F.col("n").alias("v"), F.col("new").alias("b")), ["gid", "v"])
    es = es.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("a", "b", "label"))).alias("es"))
    vline = F.transform("vs", lambda x: F.concat_ws(" ", F.lit("v"), x["new"].cast("string"), x["label"]))
    eline = F.transform(F.coalesce("es", F.array().cast("array<struct<a: int, b: int, label: string>>")), lambda x: F.concat_ws(" ", F.lit("e"), x["a"].cast("string"), x["b"].cast("string"), x["label"]))
    head = F.array(F.concat(F.lit(header), F.col("gid").cast("string")))
    return vs.join(es, "gid", "left").select("gid", F.array_join(F.concat(head, vline, eline), "\n").alias("value"))


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str, header: str = "t # ") -> None:
    render_graphs(nodes, edges, header).repartitionByRange("gid").sortWithinPartitions("gid").select("value").write.mode("overwrite").text(path)


def write_label_maps(node_codes: DataFrame, edge_codes: DataFrame, path: str) -> None:
    """(label, code) of nodes and edges -> one line of JSON {"nodes": {label: code}, "edges": {...}}; label sets are catalogues."""
    as_map = lambda codes, name: codes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "code")))).alias(name))
    both = as_map(node_codes, "nodes").crossJoin(as_map(edge_codes, "edges"))  # one row each
    both.select(F.to_json(F.struct("nodes", "edges")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_label_maps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, code) of nodes and of edges, from such a line."""
    maps = rows.where(F.trim("value") != "").select(F.from_json("value", "nodes map<string, long>, edges map<string, long>").alias("m"))
    one = lambda name: maps.select(F.explode(F.col(f"m.{name}")).alias("label", "code"))
    return one("nodes"), one("edges")


def read_patterns(rows: DataFrame, node_codes: DataFrame | None = None, edge_codes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pid, support; pid, nid, label; pid, u, v, label of mined patterns: ``# support`` before ``t n``, or ``t # n * support``, and
    ``v``, ``e`` lines. With (label, code) tables labels are decoded, unknown codes stay."""
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    value = F.trim("value")
    w = F.split(value, "\\s+")
    last = F.last(F.when(value.startswith("#"), F.try_element_at(w, F.lit(2)).try_cast("long")), ignorenulls=True).over(order)
    pid = F.sum(F.when(value.startswith("t"), 1).otherwise(0)).over(order) - 1
    marked = rows.where(value != "").withColumn("last", last).withColumn("pid", pid).where("pid >= 0").withColumn("w", w)
    own = F.regexp_extract("value", r"\*\s*([0-9]+)", 1).try_cast("long")
    heads = marked.where(value.startswith("t")).select("pid", F.coalesce(own, "last").alias("support"))
    vs = marked.where(value.startswith("v")).select("pid", F.col("w")[1].cast("long").alias("nid"), F.col("w")[2].alias("label"))
    es = marked.where(value.startswith("e")).select("pid", F.col("w")[1].cast("long").alias("u"), F.col("w")[2].cast("long").alias("v"), F.col("w")[3].alias("label"))
    return heads, decode_labels(vs, node_codes) if node_codes is not None else vs, decode_labels(es, edge_codes) if edge_codes is not None else es


def write_patterns(supports: DataFrame, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """gid, support and the patterns' nodes and edges (gid) -> blocks of ``# support``, ``t gid``, ``v`` and ``e`` lines."""
    blocks = render_graphs(nodes, edges, "t ").join(supports.select("gid", "support"), "gid")
    text = F.concat(F.lit("# "), F.col("support").cast("string"), F.lit("\n"), "value")
    blocks.repartitionByRange("gid").sortWithinPartitions("gid").select(text.alias("value")).write.mode("overwrite").text(path)


def write_features(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Selected patterns as ``# gid``, ``v`` and ``e`` lines, in order of gid."""
    write_graphs(nodes, edges, path, "# ")


def write_matrix(bits: DataFrame, features: int, path: str) -> None:
    """gid, bits -> a Parquet table of gid and row, an array of 0 and 1 per feature."""
    row = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda f: F.getbit("bits", f).cast("tinyint"))
    bits.select("gid", row.alias("row")).write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """gid, bits of such a table."""
    power = F.array(*[F.lit(1 << i).cast("long") for i in range(63)])
    bits = F.aggregate(F.zip_with("row", F.slice(power, F.lit(1), F.size("row")), lambda one, p: one.cast("long") * p), F.lit(0).cast("long"), lambda a, x: a + x)
    return spark.read.parquet(path).select("gid", bits.alias("bits"))


def decode_labels(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """label decoded by (label, code); unknown codes stay."""
    back = codes.select(F.col("code").cast("string").alias("c"), F.col("label").alias("name"))
    return rows.join(F.broadcast(back) if codes.count() <= 100_000 else back, F.col("label") == F.col("c"), "left").withColumn("label", F.coalesce("name", "label")).drop("c", "name")


def write_candidates(found: DataFrame, path: str) -> None:
    """qid, gid -> ``q # i`` / ``c # j ...``."""
    rows = found.groupBy("qid").agg(F.array_sort(F.collect_set("gid")).alias("g"))
    text = F.concat(F.lit("q # "), F.col("qid").cast("string"), F.lit("\nc # "), F.array_join(F.col("g").cast("array<string>"), " "))
    rows.repartitionByRange("qid").sortWithinPartitions("qid").select(text.alias("value")).write.mode("overwrite").text(path)


# ---- edge lists --------------------------------------------------------------------------------------------------------


def read_digraph(rows: DataFrame) -> DataFrame:
    """u, v, p of lines ``u v p``; comments and short lines are skipped."""
    w = words()
    some = rows.where((F.trim("value") != "") & ~F.trim("value").startswith("#") & (F.size(w) >= 3))
    return some.select(w[0].cast("long").alias("u"), w[1].cast("long").alias("v"), w[2].cast("double").alias("p"))


def read_seeds(rows: DataFrame) -> DataFrame:
    return rows.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(F.trim("value").cast("long").alias("node")).distinct()


def write_edges(edges: DataFrame, path: str) -> None:
    """rank, u, v -> ``u v`` in order of rank; the number of ranks is the caller's budget."""
    edges.orderBy("rank").select(F.concat_ws(" ", F.col("u").cast("string"), F.col("v").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """u, v of a tab-separated list of exactly two integer columns."""
    return spark.read.schema("u long, v long").csv(path, sep="\t", mode="FAILFAST")


def read_points_json(rows: DataFrame, field: str = "X") -> DataFrame:
    """id, features of JSON texts {"X": [[...], ...]}."""
    parsed = F.from_json("value", f"{field} array<array<double>>")
    return rows.select(F.posexplode(parsed[field]).alias("id", "features"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """id, features of a two-dimensional .npy file (by Spark's binary reader), or of JSON text under that name."""
    import io
    import json

    import numpy as np
    import pandas as pd

    def load(frames):
        for pdf in frames:
            for raw in pdf["content"]:
                raw = bytes(raw)
                x = np.load(io.BytesIO(raw), allow_pickle=False) if raw[:6] == b"\x93NUMPY" else np.array(json.loads(raw)["X"])
                for a in range(0, len(x), 10_000):
                    part = x[a : a + 10_000].astype(float)
                    yield pd.DataFrame({"id": np.arange(a, a + len(part)), "features": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "id long, features array<double>")


def support_threshold(graphs: Column) -> Column:
    """Least support for an index: 1.5 % above 10,000 graphs, else 4 %, rounded down, at least 1."""
    n = graphs.cast("long")
    return F.greatest(F.lit(1), F.when(n > 10_000, F.floor(n * 15 / 1000)).otherwise(F.floor(n * 4 / 100))).cast("long")


def support_of_percent(graphs: Column, percent: Column) -> Column:
    """Absolute support of a percentage, halves to the even number, as C's %.0f rounds."""
    return F.bround(graphs.cast("double") * percent / 100, 0).cast("long")
