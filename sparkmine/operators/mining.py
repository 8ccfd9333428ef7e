"""Frequent subgraphs, level by level: embeddings are joined to adjacency, patterns are told apart by a canonical code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmine.lineage import cut

#: A pattern: vertex labels and edges (i, j, label) with i < j, in canonical order.
Pattern = tuple[tuple[str, ...], tuple[tuple[int, int, str], ...]]


def _refined(klass: list[int], around: list[list[tuple[str, int]]]) -> list[int]:
    """Classes parted by their neighbours' classes until none parts any more; the order of classes is kept."""
    while True:
        keys = [(klass[v], tuple(sorted((label, klass[w]) for label, w in around[v]))) for v in range(len(klass))]
        rank = {k: i for i, k in enumerate(sorted(set(keys)))}
        new = [rank[k] for k in keys]
        if new == klass:
            return klass
        klass = new


def canonical(labels: tuple[str, ...], edges: tuple[tuple[int, int, str], ...]) -> tuple[Pattern, tuple[int, ...]]:
    """The least form over the numberings that a search tree reaches, and which old vertex each new one is.

    Vertices are classed by label and, round after round, by their neighbours' classes. Where a class holds several,
    each in turn is put before the others and the classes are refined again, so that a symmetric ring of n vertices
    takes 2 n numberings and not n factorial. Equal forms belong to isomorphic patterns.
    """
    n = len(labels)
    around: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    for i, j, label in edges:
        around[i].append((label, j))
        around[j].append((label, i))
    rank = {x: i for i, x in enumerate(sorted(set(labels)))}
    best = None
    open_ = [_refined([rank[x] for x in labels], around)]
    while open_:
        klass = open_.pop()
        size = [0] * n
        for k in klass:
            size[k] += 1
        tied = next((k for k in range(n) if size[k] > 1), None)
        if tied is not None:
            for v in (v for v in range(n) if klass[v] == tied):
                keys = [(k, w != v if k == tied else False) for w, k in enumerate(klass)]
                place = {k: i for i, k in enumerate(sorted(set(keys)))}
                open_.append(_refined([place[k] for k in keys], around))
            continue
        order = sorted(range(n), key=klass.__getitem__)
        form = (tuple(labels[v] for v in order), tuple(sorted((min(klass[i], klass[j]), max(klass[i], klass[j]), label) for i, j, label in edges)))
        if best is None or form < best[0]:
            best = (form, tuple(order))
    return best


def kind(pattern: Pattern) -> str:
    """path, tree or cyclic; patterns are connected."""
    labels, edges = pattern
    if len(edges) >= len(labels):
        return "cyclic"
    degree = [sum(v in (i, j) for i, j, _ in edges) for v in range(len(labels))]
    return "path" if max(degree) <= 2 else "tree"


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """gid, u, lu, el, v, lv: each edge from both ends."""
    both = edges.select("gid", "u", "v", F.col("label").alias("el")).unionByName(edges.select("gid", F.col("v").alias("u"), F.col("u").alias("v"), F.col("label").alias("el")))
    at = nodes.select("gid", F.col("nid").alias("u"), F.col("label").alias("lu"))
    to = nodes.select("gid", F.col("nid").alias("v"), F.col("label").alias("lv"))
    return both.join(at, ["gid", "u"]).join(to, ["gid", "v"]).select("gid", "u", "lu", "el", "v", "lv")


def node_label_support(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.countDistinct("gid").alias("support"))


def edge_triple_support(adj: DataFrame) -> DataFrame:
    """l1, el, l2 with l1 <= l2, and the number of graphs that hold such an edge."""
    return adj.where("lu <= lv").groupBy(F.col("lu").alias("l1"), "el", F.col("lv").alias("l2")).agg(F.countDistinct("gid").alias("support"))


#: The kinds of pattern that each phase grows; every part of such a pattern is of them too.
PHASES = {"path": ("path",), "tree": ("path", "tree"), "cyclic": ("path", "tree", "cyclic")}


def frequent_subgraphs(nodes: DataFrame, edges: DataFrame, support: int, max_edges: int, max_nodes: int | None = None, phase: str = "cyclic") -> list[tuple[Pattern, int]]:
    """All connected patterns of 1 to max_edges edges that occur (not necessarily induced) in so many graphs; phase: paths
    only, trees too, or all.

    Only keys of distinct extensions, of which there are as many as label combinations, come to the driver. An
    occurrence is kept once, whatever its automorphisms: every vertex is extended at the next level.
    """
    adj = adjacency(nodes, edges)
    triples = edge_triple_support(adj).where(F.col("support") >= support).collect()
    spark = nodes.sparkSession
    patterns: list[Pattern] = []
    out: list[tuple[Pattern, int]] = []
    seeds = []
    for r in triples:
        pattern, order = canonical((r["l1"], r["l2"]), ((0, 1, r["el"]),))
        patterns.append(pattern)
        out.append((pattern, r["support"]))
        seeds.append((r["l1"], r["el"], r["l2"], len(patterns) - 1))
    if not seeds:
        return out
    seed_rows = F.broadcast(spark.createDataFrame(seeds, "lu string, el string, lv string, pid int"))
    # rare triples can't be part of a frequent pattern
    common = F.broadcast(spark.createDataFrame(sorted({(a, e, b) for x, e, y, _ in seeds for a, b in ((x, y), (y, x))}), "lu string, el string, lv string"))
    adj = cut(adj.join(common, ["lu", "el", "lv"]).select("gid", "u", "lu", "el", "v", "lv"))
    found = adj.where("lu < lv or (lu = lv and u < v)").join(seed_rows, ["lu", "el", "lv"]).select("pid", "gid", F.array("u", "v").alias("vs"))
    for _ in range(2, max_edges + 1):
        step = found.select("pid", "gid", "vs", F.posexplode("vs").alias("i", "u")).join(adj.select("gid", "u", "el", "v", "lv"), ["gid", "u"])
        step = step.withColumn("j", F.array_position("vs", F.col("v")) - 1)
        held = spark.createDataFrame([(p, i, j) for p, (_, es) in enumerate(patterns) for a, b, _l in es for i, j in ((a, b), (b, a))], "pid int, i int, j long")
        step = step.join(F.broadcast(held), ["pid", "i", "j"], "left_anti").where("j < 0 or i < j")
        if max_nodes:
            step = step.where(f"j >= 0 or size(vs) < {max_nodes}")
        step = cut(step.select("pid", "gid", "vs", "i", "j", "el", "v", "lv"))
        keys = step.select("pid", "i", "j", "el", F.when(F.col("j") < 0, F.col("lv")).alias("lv")).distinct().collect()
        new: dict[Pattern, int] = {}
        moves = []
        for k in keys:
            labels, es = patterns[k["pid"]]
            grown = labels if k["j"] >= 0 else (*labels, k["lv"])
            to = k["j"] if k["j"] >= 0 else len(labels)
            pattern, order = canonical(grown, (*es, (min(k["i"], to), max(k["i"], to), k["el"])))
            if kind(pattern) not in PHASES[phase]:
                continue
            pid = new.setdefault(pattern, len(new))
            moves.append((k["pid"], k["i"], k["j"], k["el"], k["lv"] or "", pid, [int(x) for x in order], [[i, j] for i, j, _ in pattern[1]]))
        if not moves:
            break
        move = F.broadcast(spark.createDataFrame(moves, "pid int, i int, j long, el string, lv string, new int, order array<int>, ends array<array<int>>"))
        grown = step.withColumn("lv", F.when(F.col("j") < 0, F.col("lv")).otherwise("")).join(move, ["pid", "i", "j", "el", "lv"])
        grown = grown.withColumn("vs", F.when(F.col("j") < 0, F.concat("vs", F.array("v"))).otherwise(F.col("vs")))
        grown = grown.select(F.col("new").alias("pid"), "gid", F.transform("order", lambda o: F.element_at("vs", o + 1)).alias("vs"), "ends")
        at = lambda e, k: F.element_at("vs", F.element_at(e, F.lit(k)) + 1)
        bound = F.array_sort(F.transform("ends", lambda e: F.array(F.least(at(e, 1), at(e, 2)), F.greatest(at(e, 1), at(e, 2)))))
        one = cut(grown.withColumn("bound", bound).groupBy("pid", "gid", "bound").agg(F.first("vs").alias("vs")).drop("bound"))
        counts = {r["pid"]: r["n"] for r in one.groupBy("pid").agg(F.countDistinct("gid").alias("n")).collect()}
        names = {pid: p for p, pid in new.items()}
        keep = sorted(pid for pid, n in counts.items() if n >= support)
        if not keep:
            break
        out += [(names[pid], counts[pid]) for pid in keep]
        patterns = [names[pid] for pid in keep]
        ids = F.broadcast(spark.createDataFrame(list(zip(keep, range(len(keep)), strict=True)), "pid int, p int"))
        found = one.join(ids, "pid").select(F.col("p").alias("pid"), "gid", "vs")
    return out


def pattern_rows(spark, found: list[tuple[Pattern, int]]) -> DataFrame:
    """code, kind, n_nodes, n_edges, support."""
    rows = [(",".join(labels) + "|" + ",".join(f"{i}-{j}:{label}" for i, j, label in edges), kind((labels, edges)), len(labels), len(edges), n) for (labels, edges), n in found]
    return spark.createDataFrame(rows, "code string, kind string, n_nodes int, n_edges int, support long")
