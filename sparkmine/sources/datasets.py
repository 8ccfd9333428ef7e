"""Attributed graphs, link sets, predictions and models as tables in a folder: readers, writers and their checks.

A node dataset is a folder of Parquet tables ``nodes`` (id, x), ``edges`` (src, dst) and ``labels`` (id, y, split); a link
dataset holds ``nodes``, ``{train,valid}_pos.txt`` (two tab-separated ids a line) and negatives per split, hard ones
before plain ones. Wrong names, missing columns and rows that don't fit raise ValueError with what was wrong.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmine.functions.hashing import uniform
from sparkmine.sources.text import read_npy, read_pairs

SPLITS = ("train", "valid", "test")
#: Task -> columns of its predictions: classes, scores of one class, scores of positive and negative links.
PREDICTIONS = {"A": "id long, y_pred long", "B": "id long, y_score double", "C": "pid long, k int, score double"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _columns(table: DataFrame, name: str, wanted: tuple[str, ...]) -> DataFrame:
    missing = [c for c in wanted if c not in table.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")
    return table.select(*wanted)


@dataclass
class NodeDataset:
    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame

    @property
    def num_classes(self) -> int:
        return (self.labels.agg(F.max("y").alias("y")).first()["y"] or 0) + 1

    def stats(self) -> DataFrame:
        """nodes, edges, features, classes, and rows per split: one row."""
        per = self.labels.agg(*[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in SPLITS], F.countDistinct("y").alias("classes"))
        counts = self.nodes.agg(F.count("*").alias("nodes"), F.max(F.size("x")).alias("features"))
        return counts.crossJoin(self.edges.agg(F.count("*").alias("edges"))).crossJoin(per)  # one row each


@dataclass
class LinkDataset:
    nodes: DataFrame
    positives: dict[str, DataFrame]
    negatives: dict[str, DataFrame]
    hard: dict[str, bool]


def read_nodes(spark: SparkSession, folder: str, cache: bool = False) -> NodeDataset:
    nodes = _columns(spark.read.parquet(f"{folder}/nodes"), "nodes", ("id", "x"))
    edges = _columns(spark.read.parquet(f"{folder}/edges"), "edges", ("src", "dst"))
    labels = _columns(spark.read.parquet(f"{folder}/labels"), "labels", ("id", "y", "split"))
    return NodeDataset(*[t.cache() if cache else t for t in (nodes, edges, labels)])


def read_links(spark: SparkSession, folder: str) -> LinkDataset:
    """Negatives (pid, k, u, v): of ``{split}_neg_hard.npy``, rows of [u, v, u, v, ...] per positive, where there is one, else of
    ``{split}_neg.txt``, whose lines are dealt to the positives in turn."""
    positives, negatives, hard = {}, {}, {}
    for split in SPLITS:
        if not _exists(spark, f"{folder}/{split}_pos.txt"):
            continue
        positives[split] = read_pairs(spark, f"{folder}/{split}_pos.txt")
        hard[split] = _exists(spark, f"{folder}/{split}_neg_hard.npy")
        if hard[split]:
            rows = read_npy(spark, f"{folder}/{split}_neg_hard.npy")
            pairs = rows.select(F.col("id").alias("pid"), F.posexplode(F.sequence(F.lit(0), F.floor(F.size("features") / 2).cast("int") - 1)).alias("k", "i"), "features")
            negatives[split] = pairs.select("pid", "k", F.get("features", F.col("i") * 2).cast("long").alias("u"), F.get("features", F.col("i") * 2 + 1).cast("long").alias("v"))
        elif _exists(spark, f"{folder}/{split}_neg.txt"):
            n = max(1, positives[split].count())
            lines = read_pairs(spark, f"{folder}/{split}_neg.txt").withColumn("line", F.monotonically_increasing_id())
            negatives[split] = lines.select((F.col("line") % n).alias("pid"), F.floor(F.col("line") / n).cast("int").alias("k"), "u", "v")
    if not positives:
        raise ValueError(f"{folder} holds no positive links")
    return LinkDataset(_columns(spark.read.parquet(f"{folder}/nodes"), "nodes", ("id", "x")), positives, negatives, hard)


READERS = {"A": read_nodes, "B": read_nodes, "C": read_links}


def check_task(task: str) -> str:
    if task not in READERS:
        raise ValueError(f"task must be one of {sorted(READERS)}, not {task!r}")
    return task


def load(spark: SparkSession, task: str, folder: str) -> NodeDataset | LinkDataset:
    """The dataset of a task: A many classes, B two, C links."""
    if not folder or not _exists(spark, folder):
        raise ValueError(f"there is no folder {folder!r}")
    return READERS[check_task(task)](spark, folder)


def training_rows(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """u, v, label: positive links as 1, negative ones as 0."""
    return pos.select("u", "v", F.lit(1.0).alias("label")).unionAll(neg.select("u", "v", F.lit(0.0).alias("label")))


def minibatches(rows: DataFrame, keys: list[str], size: int, epoch: int = 0) -> DataFrame:
    """rows with batch: about size each, dealt by a hash of the keys that differs by epoch; nothing is ordered or gathered."""
    batches = max(1, -(-rows.count() // size))
    return rows.withColumn("batch", F.floor(uniform("batch", epoch, *[F.col(k) for k in keys]) * batches).cast("int"))


# ---- predictions -----------------------------------------------------------------------------------------------------


def check_predictions(task: str, rows: DataFrame, wanted: DataFrame, classes: int | None = None) -> DataFrame:
    """rows in the task's columns, if there is exactly one for each of wanted's keys, of finite scores and known classes."""
    schema = PREDICTIONS[check_task(task)]
    names = [c.split()[0] for c in schema.split(", ")]
    keys = names[:-1]
    rows = _columns(rows, f"predictions of task {task}", tuple(names)).to(rows.sparkSession.createDataFrame([], schema).schema)
    value = F.col(names[-1])
    bad = value.isNull() | ((value < 0) | (value >= (classes or 1 << 62)) if task == "A" else F.isnan(value) | (F.abs(value) == float("inf")))
    seen = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(F.when(bad, 1)).alias("bad"))
    both = wanted.select(*keys).withColumn("asked", F.lit(1)).join(seen, keys, "full")
    wrong = both.agg(
        F.count(F.when(F.col("rows").isNull(), 1)).alias("missing"), F.count(F.when(F.col("asked").isNull(), 1)).alias("unasked"), F.count(F.when(F.col("rows") > 1, 1)).alias("repeated"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    ).first()
    if any(wrong):
        raise ValueError(f"predictions of task {task}: " + ", ".join(f"{n} {k}" for k, n in wrong.asDict().items() if n))
    return rows


def random_predictions(task: str, wanted: DataFrame, classes: int = 2, seed: int = 0) -> DataFrame:
    """Uniform predictions for wanted's keys, where there is no model; the same on every run."""
    names = [c.split()[0] for c in PREDICTIONS[check_task(task)].split(", ")]
    draw = uniform("random", seed, *[F.col(k) for k in names[:-1]])
    value = F.floor(draw * classes).cast("long") if task == "A" else draw
    return wanted.select(*names[:-1], value.alias(names[-1]))


def write_predictions(task: str, rows: DataFrame, wanted: DataFrame, path: str, classes: int | None = None) -> None:
    check_predictions(task, rows, wanted, classes).write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, task: str, path: str) -> DataFrame:
    return _columns(spark.read.parquet(path), path, tuple(c.split()[0] for c in PREDICTIONS[check_task(task)].split(", ")))


def predict(task: str, wanted: DataFrame, path: str, scorer=None, classes: int = 2) -> DataFrame:
    """Scores wanted's keys by scorer(wanted), or at random without one, checks, writes and rereads them."""
    rows = scorer(wanted) if scorer else random_predictions(task, wanted, classes)
    write_predictions(task, rows, wanted, path, classes if task == "A" else None)
    return read_predictions(wanted.sparkSession, task, path)


# ---- models ------------------------------------------------------------------------------------------------------------


def save_weights(spark: SparkSession, weights: dict[str, list[list[float]]], path: str) -> None:
    """Named matrices, a row of the table per row of a matrix."""
    rows = [(name, i, [float(x) for x in row]) for name, matrix in weights.items() for i, row in enumerate(matrix)]
    spark.createDataFrame(rows, "name string, row int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, list[list[float]]]:
    out: dict[str, list[list[float]]] = {}
    for r in spark.read.parquet(path).orderBy("name", "row").collect():  # a model's rows
        out.setdefault(r["name"], []).append(r["weights"])
    return out
