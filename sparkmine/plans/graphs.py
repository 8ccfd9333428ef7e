"""Queries over the graph database: signatures, supports, mining, containment, features, candidates."""

from pyspark.sql import functions as F

from sparkmine.lineage import cut
from sparkmine.operators import indexing, matching, mining
from sparkmine.plans.registry import query
from sparkmine.sources.tables import GRAPHS_SQL, graphs
from sparkmine.sources.text import support_threshold

FRACTION = 0.001
#: Patterns as (labels, edges): an edge, paths of two edges, a triangle.
FEATURES = [
    (("N", "N"), ((0, 1, "O"),)),
    (("A", "R"), ((0, 1, "F"),)),
    (("A", "A", "A"), ((0, 1, "F"), (1, 2, "F"))),
    (("A", "R", "A"), ((0, 1, "F"), (1, 2, "F"))),
    (("R", "A", "R"), ((0, 1, "F"), (1, 2, "F"))),
    (("N", "N", "N"), ((0, 1, "O"), (0, 2, "O"), (1, 2, "O"))),
]
_SIG = f"""{GRAPHS_SQL},
ns as (select gid, string_agg(label, ',' order by label) as ns from node group by gid),
es as (select gid, string_agg(t, ',' order by t) as es from (select e.gid, least(p.label, q.label) || '-' || greatest(p.label, q.label) || ':' || e.label as t from edge e join node p on p.gid = e.gid and p.nid = e.u join node q on q.gid = e.gid and q.nid = e.v) group by gid),
sig as (select ns.gid, 'N[' || ns || ']|E[' || coalesce(es, '') || ']' as signature from ns left join es on ns.gid = es.gid)"""
_NEED = f"need as (select greatest(1, cast(ceil(count(distinct gid) * {FRACTION}) as bigint)) as m from node)"


def _support(nodes):
    import math

    return max(1, math.ceil(nodes.select("gid").distinct().count() * FRACTION))


@query("graph_label_signature", f"with {_SIG} select gid, signature from sig")
def signature(spark, sf_dir):
    return matching.label_signature(*graphs(spark, sf_dir))


@query("graph_dedup", f"with {_SIG} select signature, min(gid) as gid, count(*) as copies from sig group by signature")
def dedup(spark, sf_dir):
    return matching.first_of_each(matching.label_signature(*graphs(spark, sf_dir)))


@query("node_label_support", f"with {GRAPHS_SQL} select label, count(distinct gid) as support from node group by label")
def node_labels(spark, sf_dir):
    return mining.node_label_support(graphs(spark, sf_dir)[0])


_TRIPLES = "select lu as l1, el, lv as l2, count(distinct gid) as support from adj where lu <= lv group by 1, 2, 3"


@query("edge_triple_support", f"with {GRAPHS_SQL} {_TRIPLES}")
def triples(spark, sf_dir):
    return mining.edge_triple_support(mining.adjacency(*graphs(spark, sf_dir)))


@query("support_threshold", f"with {GRAPHS_SQL}, c as (select count(distinct gid) as n from node) select n as graphs, greatest(1, case when n > 10000 then n * 15 // 1000 else n * 4 // 100 end) as support from c")
def threshold(spark, sf_dir):
    return graphs(spark, sf_dir)[0].agg(F.countDistinct("gid").alias("graphs")).select("graphs", support_threshold(F.col("graphs")).alias("support"))


_PATH2 = """select case when s.lv || s.el <= t.lv || t.el then s.lv else t.lv end as l1, case when s.lv || s.el <= t.lv || t.el then s.el else t.el end as e1, s.lu as l2,
case when s.lv || s.el <= t.lv || t.el then t.el else s.el end as e2, case when s.lv || s.el <= t.lv || t.el then t.lv else s.lv end as l3, count(distinct s.gid) as support from adj s join adj t on s.gid = t.gid and s.u = t.u and s.v < t.v group by 1, 2, 3, 4, 5"""


@query("fsm_paths2", f"with {GRAPHS_SQL}, {_NEED}, p as ({_PATH2}) select l1, e1, l2, e2, l3, support from p, need where support >= m")
def paths2(spark, sf_dir):
    nodes, edges = graphs(spark, sf_dir)
    rows = []
    for (labels, es), n in mining.frequent_subgraphs(nodes, edges, _support(nodes), 2):
        if len(es) == 2:
            centre = next(v for v in range(3) if all(v in e[:2] for e in es))
            (a, ea), (b, eb) = sorted(((labels[i + j - centre], label) for i, j, label in es), key=lambda x: x[0] + x[1])
            rows.append((a, ea, labels[centre], eb, b, n))
    return spark.createDataFrame(rows, "l1 string, e1 string, l2 string, e2 string, l3 string, support long")


_PATH3 = """select least(a, b) as walk, count(distinct gid) as support from (select s.gid, s.lu || s.el || s.lv || t.el || t.lv || w.el || w.lv as a, w.lv || w.el || t.lv || t.el || s.lv || s.el || s.lu as b
from adj s join adj t on t.gid = s.gid and t.u = s.v and t.v <> s.u join adj w on w.gid = t.gid and w.u = t.v and w.v <> t.u and w.v <> s.u) group by 1"""
_TRIANGLE = """select t, count(distinct gid) as support from (select s.gid, least(s.lu || s.el || s.lv || t.el || t.lv || w.el, s.lu || w.el || t.lv || t.el || s.lv || s.el) as t
from adj s join adj t on t.gid = s.gid and t.u = s.v and t.v <> s.u join adj w on w.gid = t.gid and w.u = t.v and w.v = s.u) group by 1"""


def _walks(labels, es):
    """Both ways along a path."""
    around = {v: [(j if i == v else i, label) for i, j, label in es if v in (i, j)] for v in range(len(labels))}
    out = []
    for start in (v for v in around if len(around[v]) == 1):
        seen, at, text = {start}, start, labels[start]
        while nxt := [(w, label) for w, label in around[at] if w not in seen]:
            at, label = nxt[0]
            seen.add(at)
            text += label + labels[at]
        out.append(text)
    return out


@query("fsm_paths3", f"with {GRAPHS_SQL}, {_NEED}, p as ({_PATH3}) select walk, support from p, need where support >= m")
def paths3(spark, sf_dir):
    nodes, edges = graphs(spark, sf_dir)
    found = mining.frequent_subgraphs(nodes, edges, _support(nodes), 3)
    return spark.createDataFrame([(min(_walks(*p)), n) for p, n in found if len(p[1]) == 3 and mining.kind(p) == "path"], "walk string, support long")


# a triangle's name: the least walk around it from any corner, either way
@query("fsm_triangles", f"with {GRAPHS_SQL}, {_NEED}, p as (select min(t) over (partition by gid, k) as t, gid from (select s.gid, least(s.u, t.u, w.u) || ':' || greatest(s.u, t.u, w.u) || ':' || (s.u + t.u + w.u) as k, s.lu || s.el || s.lv || t.el || t.lv || w.el as t from adj s join adj t on t.gid = s.gid and t.u = s.v and t.v <> s.u join adj w on w.gid = t.gid and w.u = t.v and w.v = s.u)), c as (select t as walk, count(distinct gid) as support from p group by t) select walk, support from c, need where support >= m")
def triangles(spark, sf_dir):
    nodes, edges = graphs(spark, sf_dir)
    rows = []
    for (labels, es), n in mining.frequent_subgraphs(nodes, edges, _support(nodes), 3):
        if len(es) == 3 and len(labels) == 3:
            by = {frozenset(e[:2]): e[2] for e in es}
            rows.append((min(labels[a] + by[frozenset((a, b))] + labels[b] + by[frozenset((b, c))] + labels[c] + by[frozenset((c, a))] for a, b, c in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))), n))
    return spark.createDataFrame(rows, "walk string, support long")


@query("fsm_class_counts")
def class_counts(spark, sf_dir):
    """Patterns of up to nine edges by size and kind."""
    nodes, edges = graphs(spark, sf_dir)
    rows = mining.pattern_rows(spark, mining.frequent_subgraphs(nodes, edges, 5 * _support(nodes), indexing.SIZES[1]))
    return rows.groupBy("n_edges", "kind").agg(F.count("*").alias("patterns"))


def _match_sql(induced: bool) -> str:
    return f"with {GRAPHS_SQL} " + " union all ".join(f"select {i} as feature, count(*) as graphs from ({matching.matches_sql(p, induced)})" for i, p in enumerate(FEATURES))


def _match(spark, sf_dir, induced):
    adj = cut(mining.adjacency(*graphs(spark, sf_dir)))  # read once for every pattern edge
    out = None
    for i, p in enumerate(FEATURES):
        one = matching.matches(adj, p, induced).agg(F.lit(i).alias("feature"), F.count("*").alias("graphs"))
        out = one if out is None else out.unionByName(one)
    return out


@query("match_monomorphic", _match_sql(False))
def monomorphic(spark, sf_dir):
    return _match(spark, sf_dir, False)


@query("match_induced", _match_sql(True))
def induced(spark, sf_dir):
    return _match(spark, sf_dir, True)


@query("in_cycle_nodes", f"with {GRAPHS_SQL} select gid, nid, count(*) over (partition by gid) >= 3 as in_cycle from node")
def cycles(spark, sf_dir):
    return matching.on_cycles(*graphs(spark, sf_dir))


_BITS = f"{GRAPHS_SQL}, hit as ({' union all '.join(f'select gid, {1 << i} as bit from ({matching.matches_sql(p)})' for i, p in enumerate(FEATURES))}), g as (select distinct gid from node), bits as (select g.gid, cast(coalesce(sum(bit), 0) as bigint) as bits from g left join hit on hit.gid = g.gid group by 1)"
_FLAGS = f"flag as (select gid, f, (bits >> f) & 1 as one from bits, (select unnest(range({len(FEATURES)})) as f) t)"


def _bits(spark, sf_dir):
    return cut(indexing.hit_bits(indexing.pattern_hits(indexing.graph_rows(*graphs(spark, sf_dir)), FEATURES)))


@query("feature_bits", f"with {_BITS} select gid, bits from bits")
def bits(spark, sf_dir):
    return _bits(spark, sf_dir)


@query("feature_variance", f"with {_BITS}, {_FLAGS} select f, round(var_pop(one), 6) as variance from flag group by f having sum(one) > 0 and sum(one) < count(*)")
def variance(spark, sf_dir):
    rows = matching.bit_rows(_bits(spark, sf_dir), len(FEATURES)).where("ones > 0 and ones < graphs")
    share = F.col("ones") / F.col("graphs")
    return rows.select(F.col("f").cast("long").alias("f"), F.round(share * (1 - share), 6).alias("variance"))


_JACCARD = f"jac as (select a.f as f, b.f as g, sum(a.one & b.one) / cast(greatest(1, sum(a.one | b.one)) as double) as j from flag a join flag b on a.gid = b.gid and a.f < b.f group by 1, 2)"


@query("feature_jaccard", f"with {_BITS}, {_FLAGS}, {_JACCARD} select f, g, round(j, 6) as jaccard from jac")
def jaccard(spark, sf_dir):
    return matching.feature_overlap(_bits(spark, sf_dir), len(FEATURES)).select(F.col("f").cast("long").alias("f"), F.col("g").cast("long").alias("g"), F.round("jaccard", 6).alias("jaccard"))


@query(
    "feature_greedy2",
    f"""with {_BITS}, {_FLAGS}, {_JACCARD}, var as (select f, var_pop(one) as v from flag group by f having sum(one) > 0 and sum(one) < count(*)),
one as (select f from var order by v desc, f limit 1),
two as (select var.f from var, one, jac where var.f <> one.f and jac.f = least(var.f, one.f) and jac.g = greatest(var.f, one.f) order by v * (1 - j) desc, var.f limit 1)
select cast(1 as bigint) as rank, f from one union all select 2, f from two""",
)
def greedy(spark, sf_dir):
    masks = _bits(spark, sf_dir).groupBy("bits").agg(F.count("*").alias("n"))
    masks = [(r["bits"], r["n"]) for r in masks.collect()]  # at most 2 ** features
    every, total = range(len(FEATURES)), sum(n for _, n in masks)
    ones = {f: sum(n for b, n in masks if b >> f & 1) for f in every}
    var = {f: ones[f] / total * (1 - ones[f] / total) for f in every if 0 < ones[f] < total}
    over = {(f, g): sum(n for b, n in masks if b >> f & b >> g & 1) / max(1, sum(n for b, n in masks if (b >> f | b >> g) & 1)) for f in every for g in every if f < g}
    return spark.createDataFrame(list(enumerate(matching.select_features(var, over, 2), 1)), "rank long, f long")


@query("candidate_filter", f"with {_BITS} select q.gid as qid, count(*) as candidates, min(d.gid) as first, max(d.gid) as last from bits q join bits d on (q.bits & ~d.bits) = 0 where q.gid % 20 = 0 group by 1")
def candidate_filter(spark, sf_dir):
    rows = _bits(spark, sf_dir)
    return matching.candidate_counts(rows.where("gid % 20 = 0").withColumnRenamed("gid", "qid"), rows)


@query("candidate_stats", f"with {_BITS}, c as (select q.gid as qid, count(*) as n from bits q join bits d on (q.bits & ~d.bits) = 0 where q.gid % 20 = 0 group by 1) select min(n) as least, max(n) as most, round(avg(n), 6) as mean from c")
def candidate_stats(spark, sf_dir):
    rows = _bits(spark, sf_dir)
    counts = matching.candidate_counts(rows.where("gid % 20 = 0").withColumnRenamed("gid", "qid"), rows)
    return counts.agg(F.min("candidates").alias("least"), F.max("candidates").alias("most"), F.round(F.avg("candidates"), 6).alias("mean"))


def _index(spark, sf_dir):
    return indexing.index_features(*graphs(spark, sf_dir))


@query("feature_select50")
def select50(spark, sf_dir):
    """The index's patterns in the order of picking: mined, of two to nine edges, near half support, of little overlap."""
    rows = mining.pattern_rows(spark, _index(spark, sf_dir)).collect()  # fifty at most
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, code string, kind string, n_nodes int, n_edges int, support long")


@query("index_candidates")
def index_candidates(spark, sf_dir):
    """How many graphs remain for each query graph (ids divisible by 20) when looked up in the index of mined patterns."""
    picked = [p for p, _ in _index(spark, sf_dir)]
    bits = cut(indexing.hit_bits(indexing.pattern_hits(indexing.graph_rows(*graphs(spark, sf_dir)), picked)))
    return matching.candidate_counts(bits.where("gid % 20 = 0").withColumnRenamed("gid", "qid"), bits).select("qid", "candidates")
