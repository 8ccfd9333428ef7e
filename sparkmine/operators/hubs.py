"""Exact and approximate nearest neighbours by squared distance, and the vectors that are neighbours most often."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmine.lineage import cut

#: Rows of the base compared at once in a task, and parts that each cell of an inverted file is dealt into.
BLOCK, PARTS = 2048, 4


def knn(queries: DataFrame, base: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """qid, bid, d2, rank: exact, in blocks. Both sides are dealt into blocks, each pair of blocks is one matrix product
    that keeps k rows per query, and the blocks' results are ranked. queries, base: id, x array<double>.

    Every query meets every base row, so work grows with their product; hubs_within() and ivf() are for large tables.
    """
    spark = base.sparkSession
    n, m = base.count(), queries.count()
    cells, parts = blocks or max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    b = base.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(cells)).alias("cell")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    q = queries.select("id", "x", F.pmod(F.hash("id"), F.lit(parts)).alias("part")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>")))

    def compare(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "bid": np.zeros(0, np.int64), "d2": np.zeros(0)})
        a, c, ids = np.stack(left["x"].tolist()), np.stack(right["x"].tolist()), right["id"].to_numpy()
        own, other = (a * a).sum(1), (c * c).sum(1)
        d = own[:, None] - 2 * (a @ c.T) + other[None]
        # the product's rounding can't hide a neighbour: all within it of the k-th are compared exactly
        kth = np.partition(d, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
        row, col = np.nonzero(d <= kth[:, None] + 1e-9 * (own[:, None] + other.max()) + 1e-12)
        exact = ((c[col] - a[row]) ** 2).sum(1)
        order = np.lexsort((ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        begins = np.searchsorted(row, np.arange(len(a)))
        keep = np.arange(len(row)) - begins[row] < k
        return pd.DataFrame({"qid": left["id"].to_numpy()[row[keep]], "bid": ids[col[keep]], "d2": exact[keep]})

    found = q.groupBy("cell", "part").cogroup(b.groupBy("cell", "part")).applyInPandas(compare, "qid long, bid long, d2 double")
    order = Window.partitionBy("qid").orderBy("d2", "bid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hub_counts(neighbours: DataFrame, base: DataFrame) -> DataFrame:
    """id, hits: how often each base vector is among the neighbours, zeros included."""
    hits = neighbours.groupBy(F.col("bid").alias("id")).agg(F.count("*").alias("hits"))
    return base.select("id").join(hits, "id", "left").select("id", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def top_hubs(counts: DataFrame, most: int) -> DataFrame:
    return counts.orderBy(F.desc("hits"), "id").limit(most)


def cells_for(rows: int) -> int:
    """Cells of an inverted file: four times the root of the rows, 512 to 2048, and not more than rows."""
    return max(1, min(rows, 2048, max(512, round(4 * rows**0.5))))


def probes_for(seconds: float) -> int:
    """Cells that a query looks into, by the seconds it may take."""
    return 48 if seconds <= 25 else 96 if seconds <= 50 else 256


class InvertedFile:
    """The base rows by the cell of their nearest centre. The centres, cells of them, live on the driver."""

    def __init__(self, base: DataFrame, cells: int, seed: int = 42, rounds: int = 5):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        from sparkmine.operators.clusters import assign

        rows = base.select(array_to_vector("x").alias("features"))
        self.centres = np.array(KMeans(k=cells, seed=seed, maxIter=rounds).fit(rows).clusterCenters())
        self.placed = cut(assign(base, self.centres).select(F.col("id").alias("bid"), "cluster").join(base.select(F.col("id").alias("bid"), "x"), "bid"))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """qid, bid, d2, rank: a query meets only the base rows of its closest cells. Cells are dealt into parts, so that a large
        one isn't one task's."""
        centres, wide = self.centres, (self.centres * self.centres).sum(1)
        probes = min(probes, len(centres))

        def probed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for at in range(0, len(pdf), 1024):
                    some = pdf.iloc[at : at + 1024]
                    x = np.stack(some["x"].tolist())
                    near = np.argpartition(wide[None] - 2 * (x @ centres.T), probes - 1, axis=1)[:, :probes]
                    yield pd.DataFrame({"qid": np.repeat(some["id"].to_numpy(), probes), "cluster": near.ravel().astype(np.int64), "qx": list(np.repeat(x, probes, axis=0))})

        def compare(_key, asked: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(here):
                return pd.DataFrame({"qid": np.zeros(0, np.int64), "bid": np.zeros(0, np.int64), "d2": np.zeros(0)})
            c, ids, out = np.stack(here["x"].tolist()), here["bid"].to_numpy(), []
            other = (c * c).sum(1)
            for at in range(0, len(asked), 1024):
                a = np.stack(asked["qx"].iloc[at : at + 1024].tolist())
                d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + other[None]
                near = np.argpartition(d, min(k, len(c)) - 1, axis=1)[:, : min(k, len(c))]
                row = np.repeat(np.arange(len(a)), near.shape[1])
                col = near.ravel()
                out.append(pd.DataFrame({"qid": asked["qid"].to_numpy()[at + row], "bid": ids[col], "d2": ((c[col] - a[row]) ** 2).sum(1)}))
            return pd.concat(out)

        part = F.pmod(F.hash("bid"), F.lit(PARTS))
        asked = queries.select("id", "x").mapInPandas(probed, "qid long, cluster long, qx array<double>").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = asked.groupBy("cluster", "part").cogroup(self.placed.withColumn("part", part).groupBy("cluster", "part")).applyInPandas(compare, "qid long, bid long, d2 double")
        order = Window.partitionBy("qid").orderBy("d2", "bid")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ivf(queries: DataFrame, base: DataFrame, k: int, cells: int, probes: int, seed: int = 42) -> DataFrame:
    """qid, bid, d2, rank: approximate, through an inverted file."""
    return InvertedFile(base, cells, seed).search(queries, k, probes)


def hubs_within(queries: DataFrame, base: DataFrame, k: int, most: int, seconds: float, batch: int = 10_000) -> tuple[DataFrame, float]:
    """The most frequent neighbours found within the seconds (id, hits), and the share of the queries that were searched.

    Queries are searched in batches by a hash of their id. After each, the average time of a query (the last batch counting
    half) says whether another still fits.
    """
    began = time.monotonic()
    index = InvertedFile(base, cells_for(base.count()))
    batches = max(1, -(-queries.count() // batch))
    dealt = queries.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch"))
    found, each = [], None
    for i in range(batches):
        start = time.monotonic()
        if each is not None and start - began + each > seconds:
            break
        near = index.search(dealt.where(F.col("batch") == i), k, probes_for(seconds))
        found.append(cut(near.groupBy(F.col("bid")).agg(F.count("*").alias("n"))))
        took = time.monotonic() - start
        each = took if each is None else (each + took) / 2
    hits = reduce(DataFrame.unionByName, found).groupBy(F.col("bid").alias("id")).agg(F.sum("n").alias("hits"))
    counts = base.select("id").join(hits, "id", "left").select("id", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))
    return top_hubs(counts, most), len(found) / batches
