"""Attributed graphs: feature statistics, neighbourhood means, propagation, layers with fixed weights, link scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmine.functions.hashing import uniform
from sparkmine.functions.vectors import clip, cosine, dense, dot, finite, l2_normalize, relu
from sparkmine.lineage import cut


#: Rounds of drawing negatives before the exact search.
MORE = 4


def weights(rows: int, columns: int) -> list[list[float]]:
    """Fixed small weights made by a rule, for forward passes that any engine can repeat."""
    return [[((31 * i + 17 * j) % 13 - 6) / 13 for j in range(columns)] for i in range(rows)]


def feature_stats(nodes: DataFrame, width: int) -> DataFrame:
    """dim, mean, std (of the sample, at least 1e-6): one pass, one row of sums per task."""
    sums = [f(F.element_at("x", i + 1)).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    one = nodes.agg(*sums)
    rows = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"m{i}").alias("mean"), F.greatest(F.coalesce(F.col(f"s{i}"), F.lit(0.0)), F.lit(1e-6)).alias("std")) for i in range(width)])
    return one.select(F.explode(rows).alias("r")).select("r.dim", "r.mean", "r.std")


def standardize(nodes: DataFrame, stats: list[tuple[float, float]], limit: float = 10.0) -> DataFrame:
    """id, x: (x - mean) / std, clipped, non-finite inputs as 0; stats of bounded width come from the driver."""
    one = lambda i, m, s: clip((finite(F.element_at("x", i + 1)) - F.lit(m)) / F.lit(s), -limit, limit)
    return nodes.select("id", F.array(*[one(i, m, s) for i, (m, s) in enumerate(stats)]).alias("x"))


def class_weights(labels: DataFrame, classes: int) -> DataFrame:
    """y, n, weight: total / max(n, 1), scaled to a mean of 1; classes without rows included."""
    counts = labels.groupBy("y").agg(F.count("*").alias("n"))
    every = labels.sparkSession.range(classes).select(F.col("id").cast("int").alias("y")).join(counts, "y", "left").select("y", F.coalesce("n", F.lit(0)).alias("n"))
    whole = Window.partitionBy()
    raw = every.withColumn("raw", F.sum("n").over(whole).cast("double") / F.greatest("n", F.lit(1)))
    return raw.select("y", "n", (F.col("raw") / F.avg("raw").over(whole)).alias("weight"))


def positive_weight(labels: DataFrame) -> DataFrame:
    pos, neg = F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.sum(F.when(F.col("y") == 0, 1).otherwise(0))
    return labels.agg((F.greatest(neg, F.lit(1)) / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, degree, log_degree by source; zeros included."""
    d = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree")).withColumn("log_degree", F.log1p(F.col("degree").cast("double")))


def symmetrized(links: DataFrame) -> DataFrame:
    """Each edge and its reverse; edges given both ways are there twice."""
    return links.select("src", "dst").unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _sums(column: str, width: int) -> list[Column]:
    return [F.sum(F.element_at(column, i + 1)).alias(f"s{i}") for i in range(width)]


def in_mean(values: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """id, h: the mean of x over a node's in-neighbours; zeros without any. Sums are combined before the shuffle."""
    sent = links.join(values.select(F.col("id").alias("src"), "x"), "src")
    mean = sent.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), *_sums("x", width))
    mean = mean.select("id", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(width)]).alias("h"))
    return values.select("id").join(mean, "id", "left").select("id", F.coalesce("h", F.array(*[F.lit(0.0)] * width)).alias("h"))


def propagate(base: DataFrame, links: DataFrame, width: int, alpha: float, steps: int, anchors: DataFrame | None = None, limits: tuple[float, float] = (0.0, 1.0)) -> list[DataFrame]:
    """States after each step: (1 - alpha) base + alpha * in-mean, anchors (id, a) overwritten, clipped. base: id, x."""
    state, out = base, []
    for _ in range(steps):
        near = in_mean(state, links, width)
        mixed = base.withColumnRenamed("x", "b").join(near, "id").select("id", F.zip_with("b", "h", lambda b, h: clip(b * F.lit(1 - alpha) + h * F.lit(alpha), *limits)).alias("x"))
        if anchors is not None:
            mixed = mixed.join(anchors, "id", "left").select("id", F.coalesce("a", "x").alias("x"))
        state = cut(mixed)
        out.append(state)
    return out


def tune(base: DataFrame, links: DataFrame, width: int, truth: DataFrame, alphas: list[float], steps: list[int], anchors: DataFrame | None = None) -> list[tuple[float, int, float]]:
    """(alpha, steps, accuracy) over the grid; states of one alpha are extended, not recomputed. truth: id, y."""
    rows = []
    for alpha in alphas:
        states = propagate(base, links, width, alpha, max(steps), anchors)
        for s in steps:
            guess = states[s - 1].select("id", argmax("x").alias("p")).join(truth, "id")
            rows.append((alpha, s, guess.agg(F.avg((F.col("p") == F.col("y")).cast("double")).alias("a")).first()["a"]))
    return rows


def argmax(column: str) -> Column:
    """0-based; the first of ties."""
    return (F.array_position(column, F.array_max(column)) - 1).cast("int")


def gcn(nodes: DataFrame, links: DataFrame, w: list[list[float]], skip: list[list[float]] | None = None) -> DataFrame:
    """id, h: D^-1/2 (A + I) D^-1/2 X W, by destination, with self loops; optionally plus a skip map of x."""
    width = len(w)
    every = links.select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    deg = every.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("d"))
    z = nodes.join(deg, "id").select("id", "d", dense(F.col("x"), w).alias("z")).select("id", "d", F.transform("z", lambda v: v / F.sqrt("d")).alias("z"))
    got = every.join(z.select(F.col("id").alias("src"), "z"), "src").groupBy(F.col("dst").alias("id")).agg(*_sums("z", width))
    h = got.join(deg, "id").select("id", F.array(*[F.col(f"s{i}") / F.sqrt("d") for i in range(width)]).alias("h"))
    if skip is None:
        return h
    return h.join(nodes.select("id", dense(F.col("x"), skip).alias("k")), "id").select("id", F.zip_with("h", "k", lambda a, b: a + b).alias("h"))


def sage(nodes: DataFrame, links: DataFrame, own: list[list[float]], near: list[list[float]], width: int) -> DataFrame:
    """id, h: W1 x + W2 mean of the in-neighbours."""
    mean = in_mean(nodes.select("id", "x"), links, width)
    return nodes.select("id", "x").join(mean, "id").select("id", F.zip_with(dense(F.col("x"), own), dense(F.col("h"), near), lambda a, b: a + b).alias("h"))


def gat(nodes: DataFrame, links: DataFrame, left: list[list[float]], right: list[list[float]], attention: list[float], slope: float = 0.2) -> DataFrame:
    """id, h: attention over in-neighbours and the node itself: softmax of a . leaky_relu(L x_dst + R x_src), over R x_src."""
    width = len(left)
    every = links.select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    z = nodes.select("id", dense(F.col("x"), left).alias("l"), dense(F.col("x"), right).alias("r"))
    met = every.join(z.select(F.col("id").alias("src"), "r"), "src").join(z.select(F.col("id").alias("dst"), "l"), "dst")
    leaky = F.zip_with("l", "r", lambda a, b: F.when(a + b > 0, a + b).otherwise((a + b) * slope))
    scored = met.select("dst", "r", dot(leaky, F.array(*map(F.lit, attention))).alias("e"))
    # scores are bounded by the fixed weights, but the greatest per node is taken off all the same
    top = scored.groupBy("dst").agg(F.max("e").alias("m"))
    soft = scored.join(top, "dst").select("dst", "r", F.exp(F.col("e") - F.col("m")).alias("w"))
    agg = soft.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("t"), *[F.sum(F.col("w") * F.element_at("r", i + 1)).alias(f"s{i}") for i in range(width)])
    return agg.select("id", F.array(*[F.col(f"s{i}") / F.col("t") for i in range(width)]).alias("h"))


def mlp(x: Column, layers: list[list[list[float]]]) -> Column:
    """Dense layers with ReLU between them."""
    for w in layers[:-1]:
        x = relu(dense(x, w))
    return dense(x, layers[-1])


def pair_features(pairs: DataFrame, nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """The columns of pairs and f: [u, v, u * v, |u - v|, deg u, deg v]; nodes: id, x; degree: id, log_degree."""
    both = nodes.join(degree.select("id", "log_degree"), "id")
    at = pairs.join(both.select(F.col("id").alias("u"), F.col("x").alias("xu"), F.col("log_degree").alias("du")), "u").join(both.select(F.col("id").alias("v"), F.col("x").alias("xv"), F.col("log_degree").alias("dv")), "v")
    f = F.concat("xu", "xv", F.zip_with("xu", "xv", lambda a, b: a * b), F.zip_with("xu", "xv", lambda a, b: F.abs(a - b)), F.array("du", "dv"))
    return at.select(*pairs.columns, f.alias("f"))


def cosine_scores(pairs: DataFrame, graph_side: DataFrame, feature_side: DataFrame, a: float = 0.0, temperature: float = 1.0) -> DataFrame:
    """pairs with score: (sigmoid(a) cos of the one + (1 - sigmoid(a)) cos of the other) * temperature; sides: id, x."""
    import math

    share = 1 / (1 + math.exp(-a))
    z = graph_side.select("id", F.col("x").alias("g")).join(feature_side.select("id", F.col("x").alias("f")), "id")
    at = pairs.join(z.select(F.col("id").alias("u"), F.col("g").alias("gu"), F.col("f").alias("fu")), "u").join(z.select(F.col("id").alias("v"), F.col("g").alias("gv"), F.col("f").alias("fv")), "v")
    return at.select(*pairs.columns, ((cosine(F.col("gu"), F.col("gv")) * share + cosine(F.col("fu"), F.col("fv")) * (1 - share)) * temperature).alias("score"))


def bpr_loss(pos: DataFrame, neg: DataFrame, margin: float = 0.5) -> DataFrame:
    """Mean of log(1 + exp(-(pos - neg - margin))) over the pairs; pos: pid, score; neg: pid, score."""
    gap = F.col("p") - F.col("n") - margin
    stable = F.greatest(-gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))
    return pos.select("pid", F.col("score").alias("p")).join(neg.select("pid", F.col("score").alias("n")), "pid").agg(F.avg(stable).alias("loss"))


def negative_edges(pos: DataFrame, links: DataFrame, nodes: int, attempts: int = 8) -> DataFrame:
    """pid, u, v: for each positive a hash-drawn v that is neither u nor linked to it either way; the first attempt that fits.

    Positives whose attempts all fail get as many more, and after MORE rounds the least v that fits, by an exact search; one
    whose u is linked to every node has a null v.
    """
    known = cut(symmetrized(links).select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    open_, found, first = pos.select("pid", "u"), [], 0
    for _ in range(MORE):
        tries = open_.withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(first + attempts - 1))))
        drawn = tries.withColumn("v", F.floor(uniform("neg", F.col("pid"), F.col("t")) * nodes)).where("u <> v")
        found.append(cut(drawn.join(known, ["u", "v"], "left_anti").groupBy("pid", "u").agg(F.min_by("v", "t").alias("v"))))
        open_ = cut(open_.join(found[-1], ["pid", "u"], "left_anti"))
        first += attempts
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
    taken = known.join(open_.select("u").distinct(), "u", "left_semi").groupBy("u").agg(F.collect_set("v").alias("taken"))
    # the least free number is at most as large as there are taken ones, itself included
    free = F.filter(F.sequence(F.lit(0).cast("long"), F.size("taken").cast("long") + 1), lambda v: (v < nodes) & (v != F.col("u")) & ~F.array_contains("taken", v))
    last = open_.join(taken, "u").select("pid", "u", F.get(free, F.lit(0)).alias("v"))
    return reduce(DataFrame.unionByName, [*found, last])


def pair_scores(pairs: DataFrame, nodes: DataFrame, degree: DataFrame, hidden: list[list[float]], out: list[float]) -> DataFrame:
    """The columns of pairs and score: a ReLU layer and a linear one over the pair features."""
    found = pair_features(pairs, nodes, degree)
    return found.select(*pairs.columns, dot(relu(dense(F.col("f"), hidden)), F.array(*map(F.lit, out))).alias("score"))


def gram(nodes: DataFrame, width: int) -> np.ndarray:
    """The Gram matrix of x, uncentred; each task sends one matrix of bounded width."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((width, width))
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["x"].tolist())
                g += x.T @ x
        yield pd.DataFrame({"i": np.arange(width), "g": list(g)})

    rows = nodes.select("x").mapInPandas(part, "i int, g array<double>").groupBy("i").agg(F.array(*[F.sum(F.element_at("g", j + 1)) for j in range(width)]).alias("g"))
    whole = np.zeros((width, width))
    for r in rows.collect():  # as many rows as the vectors are wide
        whole[r["i"]] = r["g"]
    return whole


def singular_vectors(nodes: DataFrame, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest singular values of x, and their right vectors (columns), each with its largest entry positive."""
    values, vectors = np.linalg.eigh(gram(nodes, width))
    values, vectors = np.sqrt(np.maximum(values[::-1][:most], 0)), vectors[:, ::-1][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def singular_values(nodes: DataFrame, width: int, most: int) -> list[tuple[int, float]]:
    return [(k, float(v)) for k, v in enumerate(singular_vectors(nodes, width, most)[0])]


def reduced(nodes: DataFrame, width: int, most: int) -> DataFrame:
    """id, x: projected on the greatest right singular vectors and scaled to length one."""
    vectors = singular_vectors(nodes, width, most)[1]
    return nodes.select("id", l2_normalize(dense(F.col("x"), vectors.T.tolist())).alias("x"))
