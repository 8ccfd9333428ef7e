"""Subgraph containment as joins compiled from a pattern, feature bits, and dominance filtering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmine.lineage import cut
from sparkmine.operators.mining import Pattern


def matches(adj: DataFrame, pattern: Pattern, induced: bool = True) -> DataFrame:
    """gid of the graphs that hold the pattern; induced: without further edges between its nodes.

    Pattern edges are joined in an order in which each touches what is bound; all joins are on the graph id.
    """
    labels, edges = pattern
    left = list(edges)
    i, j, el = left.pop(0)
    rows = adj.where((F.col("lu") == labels[i]) & (F.col("lv") == labels[j]) & (F.col("el") == el)).select("gid", F.col("u").alias(f"n{i}"), F.col("v").alias(f"n{j}"))
    bound = {i, j}
    while left:
        e = next(x for x in left if x[0] in bound or x[1] in bound)
        left.remove(e)
        a, b = (e[0], e[1]) if e[0] in bound else (e[1], e[0])
        step = adj.where((F.col("lu") == labels[a]) & (F.col("lv") == labels[b]) & (F.col("el") == e[2])).select("gid", F.col("u").alias(f"n{a}"), F.col("v").alias("_v"))
        if b in bound:
            rows = rows.join(step.withColumnRenamed("_v", f"n{b}"), ["gid", f"n{a}", f"n{b}"], "left_semi")
        else:
            rows = rows.join(step, ["gid", f"n{a}"])
            for x in bound:
                rows = rows.where(F.col("_v") != F.col(f"n{x}"))
            rows = rows.withColumnRenamed("_v", f"n{b}")
            bound.add(b)
    if induced:
        joined = {frozenset(e[:2]) for e in edges}
        pairs = adj.select("gid", "u", "v")  # an anti join needs no distinct rows
        for a in range(len(labels)):
            for b in range(a + 1, len(labels)):
                if frozenset((a, b)) not in joined:
                    rows = rows.join(pairs.select("gid", F.col("u").alias(f"n{a}"), F.col("v").alias(f"n{b}")), ["gid", f"n{a}", f"n{b}"], "left_anti")
    return rows.select("gid").distinct()


def matches_sql(pattern: Pattern, induced: bool = True) -> str:
    """The SQL twin over adj(gid, u, lu, el, v, lv)."""
    labels, edges = pattern
    first: dict[int, str] = {}
    where = []
    for k, (i, j, el) in enumerate(edges):
        where += [f"e{k}.lu = '{labels[i]}' and e{k}.lv = '{labels[j]}' and e{k}.el = '{el}'"]
        if k:
            where.append(f"e{k}.gid = e0.gid")
        for v, c in ((i, f"e{k}.u"), (j, f"e{k}.v")):
            where += [f"{first[v]} = {c}"] if v in first else []
            first.setdefault(v, c)
    where += [f"{first[a]} <> {first[b]}" for a in first for b in first if a < b]
    if induced:
        joined = {frozenset(e[:2]) for e in edges}
        where += [f"not exists (select 1 from adj x where x.gid = e0.gid and x.u = {first[a]} and x.v = {first[b]})" for a in first for b in first if a < b and frozenset((a, b)) not in joined]
    return f"select distinct e0.gid from {', '.join(f'adj e{k}' for k in range(len(edges)))} where {' and '.join(where)}"


def bit_rows(bits: DataFrame, n: int) -> DataFrame:
    """f, ones, graphs: how many graphs hold each feature."""
    flags = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.struct(f.alias("f"), F.getbit("bits", f).cast("long").alias("one"))))
    return bits.select(flags.alias("x")).groupBy(F.col("x.f").alias("f")).agg(F.sum("x.one").alias("ones"), F.count("*").alias("graphs"))


def feature_overlap(bits: DataFrame, n: int) -> DataFrame:
    """f, g, jaccard for f < g: graphs that hold both over those that hold either, at least one."""
    by_mask = bits.groupBy("bits").agg(F.count("*").alias("c"))
    pairs = [F.struct(F.lit(f).alias("f"), F.lit(g).alias("g")) for f in range(n) for g in range(f + 1, n)]
    rows = by_mask.select("bits", "c", F.explode(F.array(*pairs)).alias("p")).select("bits", "c", "p.f", "p.g")
    a, b = F.getbit("bits", F.col("f")), F.getbit("bits", F.col("g"))
    return rows.groupBy("f", "g").agg((F.sum(F.col("c") * (a.bitwiseAND(b))) / F.greatest(F.lit(1), F.sum(F.col("c") * (a.bitwiseOR(b))))).alias("jaccard"))


def select_features(variance: dict[int, float], jaccard: dict[tuple[int, int], float], most: int = 50) -> list[int]:
    """Greedy on the driver over a bounded table: most variance first, then variance times (1 - greatest overlap)."""
    left, picked = sorted(variance), []
    while left and len(picked) < most:
        score = {f: variance[f] * (1 - max((jaccard[min(f, g), max(f, g)] for g in picked), default=0)) for f in left}
        best = min(left, key=lambda f: (-score[f], f))
        picked.append(best)
        left.remove(best)
    return picked


#: Parts that each feature's masks are dealt into, and distinct masks of the queries that are broadcast at most.
PARTS, BROADCAST_ROWS = 16, 100_000


def mask_pairs(queries: DataFrame, masks: DataFrame) -> DataFrame:
    """bits, mask for each distinct bits of the queries and each mask that holds all of them; masks: distinct.

    Joined by equality: a query's bits meet only the masks that hold the rarest of its features; each feature's masks are
    dealt into PARTS. Bits without any feature are in every mask.
    """
    every = F.sequence(F.lit(0), F.lit(62))
    set_of = lambda c: F.filter(every, lambda f: F.getbit(c, f) == 1)
    held = masks.select("mask", F.explode(set_of(F.col("mask"))).alias("f"))
    counts = {r["f"]: r["n"] for r in held.groupBy("f").agg(F.count("*").alias("n")).collect()}  # a row per feature, 63 at most
    order = F.array(*[F.lit(f) for f in sorted(range(63), key=lambda f: (counts.get(f, 0), f))])
    q = queries.select("bits").distinct()
    some = q.where("bits <> 0").withColumn("f", F.get(F.filter(order, lambda f: F.getbit("bits", f) == 1), F.lit(0)))
    some = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = held.withColumn("part", F.pmod(F.hash("mask"), F.lit(PARTS)))
    met = dealt.join(F.broadcast(some) if q.count() <= BROADCAST_ROWS else some, ["f", "part"]).where(F.col("bits").bitwiseAND(F.bitwise_not("mask")) == 0)
    none = masks.select(F.lit(0).cast("long").alias("bits"), "mask")
    return met.select("bits", "mask").unionByName(none)


def dominating(queries: DataFrame, database: DataFrame) -> DataFrame:
    """qid, gid of every database graph whose bits hold all of the query's. Only distinct masks are compared."""
    pairs = mask_pairs(queries, database.select(F.col("bits").alias("mask")).distinct())
    return queries.join(pairs, "bits").join(database.withColumnRenamed("bits", "mask"), "mask").select("qid", "gid")


def candidate_counts(queries: DataFrame, database: DataFrame) -> DataFrame:
    """qid, candidates, first, last: how many database graphs remain, and their least and greatest id, from sums per mask."""
    masks = cut(database.groupBy(F.col("bits").alias("mask")).agg(F.count("*").alias("n"), F.min("gid").alias("least"), F.max("gid").alias("most")))
    per = mask_pairs(queries, masks.select("mask")).join(masks, "mask").groupBy("bits").agg(F.sum("n").alias("candidates"), F.min("least").alias("first"), F.max("most").alias("last"))
    return queries.join(per, "bits").select("qid", "candidates", "first", "last")


def label_signature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, signature: sorted node labels, and sorted edges between labels; not canonical, as nodes of one label are alike."""
    vs = nodes.groupBy("gid").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("ns"))
    to = nodes.select("gid", F.col("nid").alias("u"), F.col("label").alias("lu"))
    fro = nodes.select("gid", F.col("nid").alias("v"), F.col("label").alias("lv"))
    es = edges.join(to, ["gid", "u"]).join(fro, ["gid", "v"])
    text = F.concat(F.least("lu", "lv"), F.lit("-"), F.greatest("lu", "lv"), F.lit(":"), "label")
    es = es.groupBy("gid").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("es"))
    return vs.join(es, "gid", "left").select("gid", F.concat(F.lit("N["), "ns", F.lit("]|E["), F.coalesce("es", F.lit("")), F.lit("]")).alias("signature"))


def first_of_each(signatures: DataFrame) -> DataFrame:
    """signature, gid (the least), copies."""
    return signatures.groupBy("signature").agg(F.min("gid").alias("gid"), F.count("*").alias("copies"))


def on_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, nid, in_cycle: whether a node touches an edge that isn't a bridge. Graphs are small; each is one row."""
    ends = edges.groupBy("gid").agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))

    def ringed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            gids, nids = [], []
            for gid, us, vs in zip(pdf["gid"], pdf["us"], pdf["vs"], strict=True):
                for n in cycle_nodes(list(zip(map(int, us), map(int, vs), strict=True))):
                    gids.append(gid)
                    nids.append(n)
            yield pd.DataFrame({"gid": gids, "nid": nids})

    found = ends.mapInPandas(ringed, "gid long, nid long").withColumn("hit", F.lit(True))
    return nodes.select("gid", "nid").join(found, ["gid", "nid"], "left").select("gid", "nid", F.coalesce("hit", F.lit(False)).alias("in_cycle"))


def cycle_nodes(edges: list[tuple[int, int]]) -> set[int]:
    """Nodes on edges that stay connected when removed: depth-first low points, without recursion."""
    around: dict[int, list[tuple[int, int]]] = {}
    for k, (u, v) in enumerate(edges):
        around.setdefault(u, []).append((v, k))
        around.setdefault(v, []).append((u, k))
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    bridges: set[int] = set()
    for root in around:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack = [(root, -1, iter(around[root]))]
        while stack:
            v, via, rest = stack[-1]
            for w, k in rest:
                if k == via:
                    continue
                if w in seen:
                    low[v] = min(low[v], seen[w])
                    continue
                seen[w] = low[w] = len(seen)
                stack.append((w, k, iter(around[w])))
                break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > seen[u]:
                        bridges.add(via)
    return {n for k, e in enumerate(edges) if k not in bridges for n in e}
