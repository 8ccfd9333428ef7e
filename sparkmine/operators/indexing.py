"""An index of discriminating patterns: mined, ranked by support, picked for variance and little overlap, and looked up.

Graphs are small and many: each is one row (graph_rows), and a worker matches all patterns against it, so that hundreds
of patterns take one pass and no join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmine.lineage import cut
from sparkmine.operators import matching, mining
from sparkmine.operators.mining import Pattern

#: Pattern sizes, how many are tried and picked, graphs they are tried on, and patterns taken where none has such a size.
SIZES, TRIED, PICKED, SAMPLE, FALLBACK = (2, 9), 300, 50, 500, 200


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, nids, labels, us, vs, els: a graph's nodes and edges as arrays."""
    vs = nodes.groupBy("gid").agg(F.collect_list(F.struct("nid", "label")).alias("n"))
    es = edges.groupBy("gid").agg(F.collect_list(F.struct("u", "v", "label")).alias("e"))
    return vs.join(es, "gid", "left").select("gid", F.col("n.nid").alias("nids"), F.col("n.label").alias("labels"), F.col("e.u").alias("us"), F.col("e.v").alias("vs"), F.col("e.label").alias("els"))


def plan(pattern: Pattern) -> list[tuple[str, list[tuple[int, str]], list[int]]]:
    """Vertices in an order in which each touches an earlier one: its label, its edges to earlier ones, and the earlier ones it
    doesn't touch."""
    labels, edges = pattern
    around: dict[int, dict[int, str]] = {v: {} for v in range(len(labels))}
    for i, j, label in edges:
        around[i][j] = around[j][i] = label
    order = [max(around, key=lambda v: (len(around[v]), -v))]
    while len(order) < len(labels):
        order.append(max((v for v in around if v not in order), key=lambda v: (sum(w in around[v] for w in order), -v)))
    at = {v: k for k, v in enumerate(order)}
    return [(labels[v], [(at[w], around[v][w]) for w in order[: at[v]] if w in around[v]], [at[w] for w in order[: at[v]] if w not in around[v]]) for v in order]


def holds(steps: list, labels: dict, around: dict, induced: bool = True) -> bool:
    """Whether the graph (labels by node; neighbours and edge labels by node) holds the planned pattern."""
    bound: list = []

    def fits(v, step) -> bool:
        label, to, apart = step
        if labels[v] != label or v in bound:
            return False
        near = around.get(v, {})
        return all(near.get(bound[k]) == el for k, el in to) and not (induced and any(bound[k] in near for k in apart))

    def extend(k: int) -> bool:
        if k == len(steps):
            return True
        to = steps[k][1]
        for v in around.get(bound[to[0][0]], ()) if to else labels:
            if fits(v, steps[k]):
                bound.append(v)
                if extend(k + 1):
                    return True
                bound.pop()
        return False

    return extend(0)


def pattern_hits(graphs: DataFrame, patterns: list[Pattern], induced: bool = True) -> DataFrame:
    """gid, hits: the ascending numbers of the patterns that the graph holds. graphs: graph_rows()."""
    plans = [plan(p) for p in patterns]

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            hits = []
            for r in pdf.itertuples(index=False):
                labels, around = dict(zip(r.nids, r.labels, strict=True)), {}
                for u, v, el in zip(r.us, r.vs, r.els, strict=True) if r.us is not None else ():
                    around.setdefault(u, {})[v] = el
                    around.setdefault(v, {})[u] = el
                hits.append([i for i, steps in enumerate(plans) if holds(steps, labels, around, induced)])
            yield pd.DataFrame({"gid": pdf["gid"], "hits": hits})

    return graphs.mapInPandas(look, "gid long, hits array<int>")


def hit_bits(hits: DataFrame) -> DataFrame:
    """gid, bits of up to 63 patterns."""
    power = F.array(*[F.lit(1 << i).cast("long") for i in range(63)])
    return hits.select("gid", F.aggregate("hits", F.lit(0).cast("long"), lambda a, f: a + F.get(power, f)).alias("bits"))


def ranked(found: list[tuple[Pattern, int]], graphs: int, sizes: tuple[int, int] = SIZES, fallback: int = FALLBACK) -> list[tuple[int, Pattern, int]]:
    """(number, pattern, support) of the patterns of those sizes, or the first few where there are none, by how near the support
    is to half of the graphs; ties in order."""
    numbered = [(i, p, n) for i, (p, n) in enumerate(found)]
    some = [x for x in numbered if sizes[0] <= len(x[1][1]) <= sizes[1]] or numbered[:fallback]
    return sorted(some, key=lambda x: abs(x[2] - graphs / 2))


def pick(rows: list[tuple[int, Pattern, int]], held: np.ndarray, most: int = PICKED) -> list[int]:
    """Positions in rows: greedily by variance times (1 - the greatest overlap with what is picked), then the first others.

    held: booleans, a row per tried pattern and a column per graph; patterns that don't vary over the graphs are passed.
    """
    ones = held.sum(1)
    varies = [i for i in range(len(held)) if 0 < ones[i] < held.shape[1]]
    share = ones / max(1, held.shape[1])
    both = held.astype(np.int64) @ held.T.astype(np.int64)
    either = np.maximum(1, ones[:, None] + ones[None] - both)
    overlap = {(i, j): float(both[i, j] / either[i, j]) for i in varies for j in varies if i < j}
    picked = matching.select_features({i: float(share[i] * (1 - share[i])) for i in varies}, overlap, most)
    return picked + [i for i in range(len(rows)) if i not in picked][: most - len(picked)]


def index_features(nodes: DataFrame, edges: DataFrame, support: int | None = None, sizes: tuple[int, int] = SIZES, tried: int = TRIED, picked: int = PICKED, sample: int = SAMPLE) -> list[tuple[Pattern, int]]:
    """(pattern, support) in the order of picking.

    Graphs of one label signature are mined once; their least id stands for them. support: of unique graphs, by default
    the rule of sources.text.support_threshold.
    """
    unique = cut(matching.first_of_each(matching.label_signature(nodes, edges)).select("gid"))
    nodes, edges = cut(nodes.join(unique, "gid", "left_semi")), cut(edges.join(unique, "gid", "left_semi"))
    total = unique.count()
    support = support or max(1, total * 15 // 1000 if total > 10_000 else total * 4 // 100)
    rows = ranked(mining.frequent_subgraphs(nodes, edges, support, sizes[1]), total, sizes)
    some = unique.orderBy("gid").limit(sample)
    hits = pattern_hits(graph_rows(nodes.join(some, "gid", "left_semi"), edges.join(some, "gid", "left_semi")), [p for _, p, _ in rows[:tried]])
    held = np.zeros((min(tried, len(rows)), min(sample, total)), bool)
    for k, r in enumerate(hits.orderBy("gid").collect()):  # as many rows as are sampled
        held[r["hits"], k] = True
    return [(rows[i][1], rows[i][2]) for i in pick(rows, held, picked)]
