"""Accuracy, area under the curve, hits at k, cross-entropy losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmine.lineage import cut


def accuracy(rows: DataFrame) -> DataFrame:
    """accuracy of (p, y)."""
    return rows.agg(F.avg((F.col("p") == F.col("y")).cast("double")).alias("accuracy"))


def auc(rows: DataFrame, parts: int = 64) -> DataFrame:
    """auc of (score, y), ties counting half.

    Rows are first added up per distinct score. Scores are dealt into ranges; running sums stay within a range, and what lies
    below it is added from the ranges' totals, of which there are parts at most.
    """
    y, score = F.col("y"), F.col("score")
    per = cut(rows.where(y.isNotNull() & score.isNotNull()).groupBy("score").agg(F.sum(F.when(y == 1, 1.0).otherwise(0.0)).alias("pos"), F.sum(F.when(y == 0, 1.0).otherwise(0.0)).alias("neg")))
    bounds = sorted(set(per.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 100 * parts).alias("b")).first()["b"] or []))
    at = F.lit(0) if not bounds else F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda n, b: n + F.when(b <= score, 1).otherwise(0))
    per = per.withColumn("part", at)
    totals = per.groupBy("part").agg(F.sum("neg").alias("part_neg"))
    totals = totals.select("part", F.coalesce(F.sum("part_neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    below = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    # ranges are as many as parts: their totals are broadcast
    ranked = per.withColumn("within", F.coalesce(F.sum("neg").over(below), F.lit(0.0))).join(F.broadcast(totals), "part")
    won = F.col("pos") * (F.col("base") + F.col("within") + F.col("neg") / 2)
    return ranked.select("pos", "neg", won.alias("won")).agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def hits_at(pos: DataFrame, neg: DataFrame, k: int) -> DataFrame:
    """The share of positives with fewer than k negatives strictly above; pos: pid, score; neg: pid, score."""
    above = neg.select("pid", F.col("score").alias("n")).join(pos.select("pid", F.col("score").alias("p")), "pid", "right")
    per = above.groupBy("pid").agg(F.sum(F.when(F.col("n") > F.col("p"), 1).otherwise(0)).alias("higher"))
    return per.agg(F.avg((F.col("higher") < k).cast("double")).alias("hits"))


def cross_entropy(rows: DataFrame) -> DataFrame:
    """Weighted mean of -log softmax(logits)[y]; rows: logits array<double>, y int, weight double."""
    top = F.array_max("logits")
    lse = top + F.log(F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    loss = lse - F.element_at("logits", F.col("y") + 1)
    return rows.agg((F.sum(loss * F.col("weight")) / F.sum("weight")).alias("loss"))


def binary_cross_entropy(rows: DataFrame, pos_weight: float = 1.0) -> DataFrame:
    """Mean over (logit, y), stable for large logits."""
    x = F.col("logit")
    soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return rows.agg(F.avg(F.when(F.col("y") == 1, soft(-x) * pos_weight).otherwise(soft(x))).alias("loss"))


def running_mean(rows: DataFrame, keys: list[str], order: list[str], value: str, last: int = 20) -> DataFrame:
    """rows with mean (of all values so far) and recent (of the last so many), per key in the given order."""
    per = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("mean", F.avg(value).over(per.rowsBetween(Window.unboundedPreceding, 0))).withColumn("recent", F.avg(value).over(per.rowsBetween(1 - last, 0)))


def ema(values: Column, alpha: float = 0.5) -> Column:
    """Exponential moving average over an ordered array: the first value, then alpha times each next plus the rest of the
    average so far."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(values, F.lit(0)), lambda a, x: x * alpha + a * (1 - alpha))
