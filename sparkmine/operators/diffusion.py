"""Spread on probabilistic digraphs: live-edge samples, hop-bounded reachability, and greedy edge blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmine.functions.hashing import uniform
from sparkmine.lineage import cut


def live_edges(edges: DataFrame, samples: int) -> DataFrame:
    """sample, u, v: each edge is live in a sample if its own coin falls below p."""
    rows = edges.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
    return rows.where(uniform("live", F.col("sample"), F.col("u"), F.col("v")) < F.col("p")).select("sample", "u", "v")


def reach(live: DataFrame, starts: DataFrame, hops: int, keys: list[str] = ["sample"]) -> DataFrame:  # noqa: B006
    """keys, node, depth: what is reached within so many hops (below 0: all), by frontier joins.

    live: keys, u, v; starts: keys, node. Every round keeps only nodes that weren't reached before.
    """
    seen = cut(starts.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while hops < 0 or depth < hops:
        depth += 1
        near = frontier.select(*keys, F.col("node").alias("u")).join(live, [*keys, "u"]).select(*keys, F.col("v").alias("node")).distinct()
        frontier = cut(near.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def prune(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Edges whose source is within fewer than hops of a seed; below 0 hops: any reachable source; 0: none."""
    at = reach(edges.select(F.lit(0).alias("sample"), "u", "v"), seeds.select(F.lit(0).alias("sample"), "node"), hops)
    if hops >= 0:
        at = at.where(F.col("depth") < hops)
    return edges.join(at.select(F.col("node").alias("u")), "u", "left_semi").select("u", "v", "p")


def in_samples(seeds: DataFrame, samples: int) -> DataFrame:
    return seeds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("sample"), "node")


def spread(live: DataFrame, seeds: DataFrame, samples: int, hops: int) -> DataFrame:
    """sample, reached: seeds included; every sample has a row."""
    return reach(live, in_samples(seeds, samples), hops).groupBy("sample").agg(F.count("*").alias("reached"))


def candidates(live: DataFrame, reached: DataFrame) -> DataFrame:
    """sample, u, v: live edges whose source is reached."""
    return live.join(reached.select("sample", F.col("node").alias("u")), ["sample", "u"], "left_semi").select("sample", "u", "v")


def shortlist(cands: DataFrame, most: int) -> DataFrame:
    """u, v, samples: the edges that are candidates in most samples."""
    return cands.groupBy("u", "v").agg(F.count("*").alias("samples")).orderBy(F.desc("samples"), "u", "v").limit(most)


def gains(live: DataFrame, seeds: DataFrame, some: DataFrame, samples: int, hops: int) -> DataFrame:
    """u, v, gain: the mean number of nodes that a sample loses without the edge.

    All candidate edges are blocked at once, each in its own copy of the samples where it is live and reached, with one
    frontier join for all.
    """
    base = spread(live, seeds, samples, hops)
    where = candidates(live, reach(live, in_samples(seeds, samples), hops)).join(some.select("u", "v"), ["u", "v"], "left_semi")
    cases = cut(where.select("sample", F.col("u").alias("bu"), F.col("v").alias("bv")))
    starts = cases.join(in_samples(seeds, samples), "sample").select("sample", "bu", "bv", "node")
    seen = starts.withColumn("depth", F.lit(0))
    frontier, depth = seen, 0
    while hops < 0 or depth < hops:
        depth += 1
        near = frontier.select("sample", "bu", "bv", F.col("node").alias("u")).join(live, ["sample", "u"]).where("not (u = bu and v = bv)").select("sample", "bu", "bv", F.col("v").alias("node")).distinct()
        frontier = cut(near.join(seen.select("sample", "bu", "bv", "node"), ["sample", "bu", "bv", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    left = seen.groupBy("sample", "bu", "bv").agg(F.count("*").alias("without"))
    return left.join(base, "sample").groupBy(F.col("bu").alias("u"), F.col("bv").alias("v")).agg((F.sum(F.col("reached") - F.col("without")) / F.lit(float(samples))).alias("gain"))


def greedy_block(edges: DataFrame, seeds: DataFrame, k: int, samples: int, hops: int, short: int = 5) -> DataFrame:
    """rank, u, v, gain: edges blocked one after the other, each time that of most gain; filled up to k as pad() does, without a
    gain. Only where k is above short, and short * k candidates are fewer than there are, the most frequent ones are tried."""
    spark = edges.sparkSession
    pruned = cut(prune(edges, seeds, hops))
    live = cut(live_edges(pruned, samples))
    rows = []
    for rank in range(1, k + 1):
        cands = cut(candidates(live, reach(live, in_samples(seeds, samples), hops)).groupBy("u", "v").agg(F.count("*").alias("samples")))
        some = cands.orderBy(F.desc("samples"), "u", "v").limit(short * k) if k > short and cands.count() > short * k else cands
        best = gains(live, seeds, some, samples, hops).orderBy(F.desc("gain"), "u", "v").first()
        if best is None:
            break
        rows.append((rank, best["u"], best["v"], best["gain"]))
        live = cut(live.where(~((F.col("u") == best["u"]) & (F.col("v") == best["v"]))))
    chosen = spark.createDataFrame(rows, "rank int, u long, v long, gain double")
    padded = pad(chosen.select("rank", "u", "v"), edges, seeds, pruned, k)
    return padded.join(chosen.drop("rank"), ["u", "v"], "left").select(F.col("rank").cast("int").alias("rank"), "u", "v", "gain")


def one_hop_sources(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: seeds and what they point to."""
    hop = edges.join(seeds.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node"))
    return seeds.select("node").unionByName(hop).distinct()


def pad(chosen: DataFrame, edges: DataFrame, seeds: DataFrame, pruned: DataFrame, k: int) -> DataFrame:
    """rank, u, v: chosen (rank, u, v), filled up to k: edges from seeds, then from one-hop sources, then any; within each
    the pruned graph's before the whole one's."""
    hop = one_hop_sources(edges, seeds)
    at = lambda e, s: e.join(s.select(F.col("node").alias("u")), "u", "left_semi")
    tiers = [at(pruned, seeds), at(edges, seeds), at(pruned, hop), at(edges, hop), pruned, edges]
    rows = chosen.select(F.lit(0).alias("tier"), F.col("rank").cast("long").alias("r"), "u", "v")
    for i, t in enumerate(tiers, 1):
        # no tier can give more than k rows, so each passes on its first k
        rows = rows.unionByName(t.select(F.lit(i).alias("tier"), F.lit(0).cast("long").alias("r"), "u", "v").orderBy("u", "v").limit(2 * k))
    first = rows.groupBy("u", "v").agg(F.min(F.struct("tier", "r")).alias("t")).select("u", "v", "t.tier", "t.r").orderBy("tier", "r", "u", "v").limit(k)
    from pyspark.sql import Window

    return first.select(F.row_number().over(Window.orderBy("tier", "r", "u", "v")).cast("long").alias("rank"), "u", "v")
