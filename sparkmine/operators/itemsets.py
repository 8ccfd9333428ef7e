"""Frequent itemsets, level by level or by FP-growth, and synthetic baskets."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmine.functions.hashing import uniform


def least_support(baskets: DataFrame, fraction: float) -> int:
    """The smallest count that reaches the fraction of transactions."""
    return max(1, math.ceil(baskets.select("txn_id").distinct().count() * fraction - 1e-9))


def item_support(baskets: DataFrame) -> DataFrame:
    return baskets.groupBy("item").agg(F.count("*").alias("support"))


def apriori(baskets: DataFrame, support: int, longest: int) -> DataFrame:
    """items (sorted array), size, support; baskets: distinct (txn_id, item).

    A basket's frequent items are one sorted array, so each level is a local expansion and one aggregation: candidates
    of size k extend a frequent set of size k - 1 by a larger item, and sets that weren't frequent are dropped by a join.
    """
    frequent = item_support(baskets).where(F.col("support") >= support)
    found = frequent.select(F.array("item").alias("items"), F.lit(1).alias("size"), "support")
    kept = baskets.join(F.broadcast(frequent.select("item")) if frequent.count() <= 100_000 else frequent.select("item"), "item")
    rows = kept.groupBy("txn_id").agg(F.array_sort(F.collect_list("item")).alias("all"))
    level = rows.select("txn_id", "all", F.explode("all").alias("i")).select("txn_id", "all", F.array("i").alias("items"))
    for size in range(2, longest + 1):
        longer = level.select("txn_id", "all", "items", F.explode(F.filter("all", lambda x: x > F.element_at("items", -1))).alias("more")).select("txn_id", "all", F.concat("items", F.array("more")).alias("items"))
        counted = longer.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= support)
        found = found.unionByName(counted.select("items", F.lit(size).alias("size"), "support"))
        level = longer.join(counted.select("items"), "items", "left_semi")
    return found


def fp_growth(baskets: DataFrame, support: int) -> DataFrame:
    """items (sorted array), size, support, by Spark's distributed FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    rows = baskets.groupBy("txn_id").agg(F.collect_list("item").alias("items"))
    n = rows.count()
    # the library rounds its threshold up from a fraction
    model = FPGrowth(itemsCol="items", minSupport=(support - 0.5) / max(n, 1)).fit(rows)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("support"))


def support_sweep(baskets: DataFrame, percents: tuple[int, ...], cap: float = 3600.0) -> list[tuple[int, int, float]]:
    """(percent, frequent itemsets, seconds) of a miner run per support, highest first; once one takes longer than the cap,
    lower supports aren't run and count as the cap, with no itemsets."""
    rows, n = [], baskets.select("txn_id").distinct().count()
    for percent in sorted(percents, reverse=True):
        if rows and rows[-1][2] >= cap:
            rows.append((percent, 0, cap))
            continue
        began = time.monotonic()
        found = fp_growth(baskets, max(1, -(-n * percent // 100))).count()
        rows.append((percent, found, min(cap, time.monotonic() - began)))
    return rows


def core_items(spark: SparkSession, universe: int, core_fraction: float = 0.1) -> DataFrame:
    """item, core: max(1, int(universe * fraction)) items drawn as core, the rest rare."""
    order = Window.orderBy(uniform("core", F.col("item")), "item")
    ranked = spark.range(universe).select(F.col("id").alias("item")).withColumn("r", F.row_number().over(order))
    return ranked.select("item", (F.col("r") <= max(1, int(core_fraction * universe))).alias("core"))


def synthetic_baskets(spark: SparkSession, universe: int, transactions: int, core_fraction: float = 0.1, core_prob: float = 0.9, noise_prob: float = 0.05) -> DataFrame:
    """txn_id, line: items of a transaction as text in shuffled order; an empty one gets one item at random."""
    items = core_items(spark, universe, core_fraction).agg(F.collect_list(F.struct("item", "core")).alias("items"))
    drawn = spark.range(transactions).select(F.col("id").alias("txn_id")).join(F.broadcast(items))
    coin = lambda x: uniform("basket", F.col("txn_id"), x["item"])
    order = lambda x: F.md5(F.concat_ws(":", F.lit("order"), F.col("txn_id").cast("string"), x.cast("string")))
    taken = F.transform(F.filter("items", lambda x: coin(x) < F.when(x["core"], core_prob).otherwise(noise_prob)), lambda x: x["item"])
    lone = F.array(F.floor(uniform("lone", F.col("txn_id")) * universe))
    full = F.when(F.size(taken) > 0, taken).otherwise(lone)
    mixed = F.transform(F.array_sort(F.transform(full, lambda x: F.struct(order(x).alias("o"), x.alias("item")))), lambda x: x["item"])
    return drawn.select("txn_id", F.array_join(mixed, " ").alias("line"))
