"""Small fixtures with results by hand, and properties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmine.functions import vectors
from sparkmine.operators import clusters, diffusion, hubs, indexing, itemsets, layers, matching, metrics, mining
from sparkmine.sources import datasets, text


def test_itemsets_by_hand_and_both_ways(spark):
    rows = spark.createDataFrame([(t, i) for t, items in enumerate(("abc", "ab", "ac", "b")) for i in items], "txn_id long, item string")
    want = {("a",): 3, ("b",): 3, ("c",): 2, ("a", "b"): 2, ("a", "c"): 2}
    assert {tuple(r["items"]): r["support"] for r in itemsets.apriori(rows, 2, 3).collect()} == want
    assert {tuple(r["items"]): r["support"] for r in itemsets.fp_growth(rows, 2).collect()} == want


def test_graph_text(spark):
    rows = text.literal_lines(spark, "# g\nv 0 A\nv 1 B\ne 1 0 x\ne 0 1 y\n\nt 1\nv 0 A")
    nodes, edges = text.read_graphs(rows)
    assert {tuple(r) for r in nodes.collect()} == {(0, 0, "A"), (0, 1, "B"), (1, 0, "A")}
    assert [tuple(r) for r in edges.collect()] == [(0, 0, 1, "x")]
    assert text.graph_count(rows).first()[0] == 2


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 5, "A"), (0, 7, "B"), (1, 2, "C")], "gid long, nid long, label string")
    edges = spark.createDataFrame([(0, 5, 7, "x")], "gid long, u long, v long, label string")
    text.write_graphs(nodes, edges, f"file://{tmp_path}/g")
    back, links = text.read_graphs(spark.read.text(f"file://{tmp_path}/g", wholetext=True).select(F.lit("").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where("value <> ''"))
    assert {(r["nid"], r["label"]) for r in back.collect() if r["gid"] == 0} == {(0, "A"), (1, "B")}
    assert links.count() == 1


def test_patterns_and_labels(spark):
    rows = text.literal_lines(spark, "# 7\nt 0\nv 0 1\nv 1 9\ne 0 1 3\nt # 1 * 4\nv 0 2")
    heads, nodes, edges = text.read_patterns(rows)
    assert [tuple(r) for r in heads.orderBy("pid").collect()] == [(0, 7), (1, 4)]
    assert {tuple(r) for r in nodes.collect()} == {(0, 0, "1"), (0, 1, "9"), (1, 0, "2")} and [tuple(r) for r in edges.collect()] == [(0, 0, 1, "3")]
    codes = spark.createDataFrame([("A", 1)], "label string, code long")
    assert {r["label"] for r in text.decode_labels(spark.createDataFrame([("1",), ("9",)], "label string"), codes).collect()} == {"A", "9"}


def test_edge_lists(spark, tmp_path):
    rows = text.literal_lines(spark, "# c\n1 2 0.5\n\n3 4\n 2   3  1 ")
    assert {tuple(r) for r in text.read_digraph(rows).collect()} == {(1, 2, 0.5), (2, 3, 1.0)}
    assert {r[0] for r in text.read_seeds(text.literal_lines(spark, "1\n\n1\n2")).collect()} == {1, 2}
    text.write_edges(spark.createDataFrame([(2, 3, 4), (1, 1, 2)], "rank int, u long, v long"), f"file://{tmp_path}/e")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/e").collect()] == ["1 2", "3 4"]


def test_points(spark, tmp_path):
    got = text.read_points_json(spark.createDataFrame([('{"X": [[1, 2], [3, 4.5]]}',)], "value string")).orderBy("id").collect()
    assert [r["features"] for r in got] == [[1.0, 2.0], [3.0, 4.5]]
    np.save(tmp_path / "x.npy", np.arange(6).reshape(3, 2))
    assert [r["features"] for r in text.read_npy(spark, f"file://{tmp_path}/x.npy").orderBy("id").collect()] == [[0, 1], [2, 3], [4, 5]]


@pytest.mark.parametrize(("n", "want"), [(20000, 300), (100, 4), (10, 1)])
def test_support_rule(spark, n, want):
    assert spark.range(1).select(text.support_threshold(F.lit(n))).first()[0] == want


TRIANGLE = ([(0, i, "A") for i in range(3)], [(0, 0, 1, "x"), (0, 1, 2, "x"), (0, 0, 2, "x")])


def test_induced_or_not(spark):
    nodes, edges = spark.createDataFrame(TRIANGLE[0], "gid long, nid long, label string"), spark.createDataFrame(TRIANGLE[1], "gid long, u long, v long, label string")
    adj, path = mining.adjacency(nodes, edges), (("A", "A", "A"), ((0, 1, "x"), (1, 2, "x")))
    assert matching.matches(adj, path, induced=False).count() == 1
    assert matching.matches(adj, path, induced=True).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 6), st.randoms(use_true_random=False))
def test_canonical_code_ignores_numbering(n, r):
    labels = tuple(r.choice("AB") for _ in range(n))
    edges = {(r.randrange(v), v): r.choice("xy") for v in range(1, n)}
    edges |= {tuple(sorted(r.sample(range(n), 2))): "x" for _ in range(2)}
    order = list(range(n))
    r.shuffle(order)
    moved = tuple(labels[order.index(i)] for i in range(n))
    again = tuple((min(order[i], order[j]), max(order[i], order[j]), e) for (i, j), e in edges.items())
    assert mining.canonical(labels, tuple((i, j, e) for (i, j), e in edges.items()))[0] == mining.canonical(moved, again)[0]


def test_mining_is_anti_monotone(spark):
    r = random.Random(3)
    nodes = [(g, i, r.choice("AB")) for g in range(12) for i in range(5)]
    edges = [(g, min(i, j), max(i, j), "x") for g in range(12) for i, j in {tuple(sorted(r.sample(range(5), 2))) for _ in range(6)}]
    found = mining.frequent_subgraphs(spark.createDataFrame(nodes, "gid long, nid long, label string"), spark.createDataFrame(edges, "gid long, u long, v long, label string"), 3, 3)
    by_size = {}
    for (_, es), n in found:
        by_size.setdefault(len(es), []).append(n)
    assert len({p for p, _ in found}) == len(found) and max(by_size[3]) <= max(by_size[2]) <= max(by_size[1])
    adj = mining.adjacency(spark.createDataFrame(nodes, "gid long, nid long, label string"), spark.createDataFrame(edges, "gid long, u long, v long, label string"))
    for p, n in found[:: max(1, len(found) // 6)]:
        assert matching.matches(adj, p, induced=False).count() == n


def test_cycles():
    assert matching.cycle_nodes([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)]) == {0, 1, 2, 3, 4, 5}
    assert matching.cycle_nodes([(0, 1), (1, 2)]) == set()


def test_dominance(spark):
    d = spark.createDataFrame([(0, 7), (1, 4), (2, 5)], "gid long, bits long")
    q = spark.createDataFrame([(0, 5)], "qid long, bits long")
    assert {r["gid"] for r in matching.dominating(q, d).collect()} == {0, 2}
    assert matching.candidate_counts(q, d).first()["candidates"] == 2


def test_spread_by_hand(spark):
    live = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 1, 4)], "sample long, u long, v long")
    seed = spark.createDataFrame([(1,)], "node long")
    for hops, want in ((0, 1), (1, 3), (2, 4), (-1, 4)):
        assert diffusion.spread(live, seed, 1, hops).first()["reached"] == want
    some = live.select("u", "v")
    assert diffusion.gains(live, seed, some, 1, -1).where("u = 1 and v = 2").first()["gain"] == 2
    assert diffusion.prune(some.withColumn("p", F.lit(1.0)), seed, 0).count() == 0


def test_blocking_never_helps_spread(spark):
    r = random.Random(1)
    edges = spark.createDataFrame([(a, b, 0.6) for a in range(6) for b in range(6) if a != b and r.random() < 0.4], "u long, v long, p double")
    seed = spark.createDataFrame([(0,)], "node long")
    cut = diffusion.greedy_block(edges, seed, 2, 3, -1)
    before = diffusion.spread(diffusion.live_edges(edges, 3), seed, 3, -1).agg(F.sum("reached")).first()[0]
    after = diffusion.spread(diffusion.live_edges(edges, 3).join(cut.select("u", "v"), ["u", "v"], "left_anti"), seed, 3, -1).agg(F.sum("reached")).first()[0]
    assert after <= before


def test_hub_ties(spark):
    counts = spark.createDataFrame([(0, 1), (1, 3), (2, 3), (3, 0)], "id long, hits long")
    assert [r["id"] for r in hubs.top_hubs(counts, 4).collect()] == [1, 2, 0, 3]


def test_hub_counts_add_up_over_blocks(spark):
    r = np.random.default_rng(0)
    base = spark.createDataFrame([(i, [float(x) for x in r.standard_normal(4)]) for i in range(60)], "id long, x array<double>")
    near = hubs.knn(base.where("id < 20"), base, 5, blocks=3)
    one = hubs.knn(base.where("id < 20"), base, 5)
    assert sorted(map(tuple, near.select("qid", "bid", "rank").collect())) == sorted(map(tuple, one.select("qid", "bid", "rank").collect()))
    assert hubs.hub_counts(near, base).agg(F.sum("hits")).first()[0] == 100


def test_elbow(spark):
    assert clusters.elbow(spark.createDataFrame([(1, 10.0), (2, 2.0), (3, 1.0), (4, 0.0)], "k int, sse double")).first()["k"] == 2


def test_lloyd_error_never_rises(spark):
    r = np.random.default_rng(2)
    points = spark.createDataFrame([(i, [float(x) for x in r.standard_normal(3)]) for i in range(80)], "id long, x array<double>")
    start = clusters.first_points(points, 4)
    errors = [clusters.lloyd(points, start, k)[1] for k in (1, 2, 4)]
    assert errors == sorted(errors, reverse=True)
    assert len(clusters.seed_plus_plus(points, 3)) == 3


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, score double")
    assert metrics.auc(rows).first()[0] == 0.875
    pos = spark.createDataFrame([(0, 0.5), (1, 0.5)], "pid long, score double")
    neg = spark.createDataFrame([(0, 0.5), (0, 0.4), (1, 0.6)], "pid long, score double")
    assert metrics.hits_at(pos, neg, 1).first()[0] == 0.5
    assert abs(metrics.binary_cross_entropy(spark.createDataFrame([(1, 0.0)], "y int, logit double")).first()[0] - np.log(2)) < 1e-12


def test_propagation_by_hand(spark):
    base = spark.createDataFrame([(0, [1.0]), (1, [0.0])], "id long, x array<double>")
    edge = spark.createDataFrame([(0, 1)], "src long, dst long")
    assert {r["id"]: r["x"] for r in layers.propagate(base, edge, 1, 0.5, 1)[0].collect()} == {0: [0.5], 1: [0.5]}


def test_jaccard(spark):
    bits = spark.createDataFrame([(0, 0b01), (1, 0b11), (2, 0b10)], "gid long, bits long")
    assert abs(matching.feature_overlap(bits, 2).first()["jaccard"] - 1 / 3) < 1e-12


def test_pattern_files_and_label_maps(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 0, "C"), (0, 1, "N"), (1, 0, "8")], "gid long, nid long, label string")
    edges = spark.createDataFrame([(0, 0, 1, "s")], "gid long, u long, v long, label string")
    codes, kinds = text.label_map(nodes), text.label_map(edges)
    assert {tuple(r) for r in codes.collect()} == {("8", 8), ("C", 1), ("N", 2)}
    text.write_label_maps(codes, kinds, f"file://{tmp_path}/map")
    back = text.read_label_maps(text.plain_lines(spark, f"file://{tmp_path}/map"))
    assert sorted(map(tuple, back[0].collect())) == sorted(map(tuple, codes.collect())) and back[1].count() == 1
    coded = nodes.join(codes, "label").select("gid", "nid", F.col("code").cast("string").alias("label"))
    lines = edges.join(kinds, "label").select("gid", "u", "v", F.col("code").cast("string").alias("label"))
    text.write_patterns(spark.createDataFrame([(0, 12), (1, 5)], "gid long, support long"), coded, lines, f"file://{tmp_path}/p")
    whole = spark.read.text(f"file://{tmp_path}/p").orderBy(F.monotonically_increasing_id()).collect()
    heads, vs, es = text.read_patterns(text.literal_lines(spark, "\n".join(r[0] for r in whole)), codes, kinds)
    assert {tuple(r) for r in heads.collect()} == {(0, 12), (1, 5)}
    assert {tuple(r) for r in vs.collect()} == {tuple(r) for r in nodes.collect()} and {tuple(r) for r in es.collect()} == {tuple(r) for r in edges.collect()}
    text.write_features(nodes, edges, f"file://{tmp_path}/f")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/f").collect()][:2] == ["# 0", "v 0 C"]
    bits = spark.createDataFrame([(0, 5), (1, 0), (2, 7)], "gid long, bits long")
    text.write_matrix(bits, 3, f"file://{tmp_path}/m")
    assert sorted(map(tuple, text.read_matrix(spark, f"file://{tmp_path}/m").collect())) == [(0, 5), (1, 0), (2, 7)]


@pytest.mark.parametrize(("n", "percent", "want"), [(1000, 5, 50), (10, 25, 2), (30, 5, 2), (50, 5, 2), (70, 5, 4)])
def test_support_of_percent_rounds_halves_to_even(spark, n, percent, want):
    assert spark.range(1).select(text.support_of_percent(F.lit(n), F.lit(percent))).first()[0] == want


def test_symmetric_rings_have_few_numberings():
    ring = tuple((i, (i + 1) % 12, "x") for i in range(12))
    form, order = mining.canonical(("A",) * 12, tuple((min(i, j), max(i, j), e) for i, j, e in ring))
    assert len(form[1]) == 12 and sorted(order) == list(range(12))


def brute_patterns(graphs, most):
    """form -> graphs that hold it, by taking every connected set of up to most edges of every graph."""
    from itertools import combinations

    found = {}
    for g, (labels, edges) in graphs.items():
        for k in range(1, most + 1):
            for some in combinations(edges, k):
                vs = sorted({x for i, j, _ in some for x in (i, j)})
                near, todo = {vs[0]}, True
                while todo:
                    more = {x for i, j, _ in some if i in near or j in near for x in (i, j)} - near
                    near, todo = near | more, bool(more)
                if len(near) == len(vs):
                    at = {v: n for n, v in enumerate(vs)}
                    form = mining.canonical(tuple(labels[v] for v in vs), tuple((min(at[i], at[j]), max(at[i], at[j]), e) for i, j, e in some))[0]
                    found.setdefault(form, set()).add(g)
    return found


@pytest.fixture(scope="module")
def small_graphs(spark):
    r = random.Random(11)
    graphs = {}
    for g in range(10):
        n = r.randrange(4, 7)
        edges = {(r.randrange(v), v): r.choice("xy") for v in range(1, n)}
        edges |= {tuple(sorted(r.sample(range(n), 2))): "x" for _ in range(2)}
        graphs[g] = ([r.choice("AB") for _ in range(n)], [(i, j, e) for (i, j), e in sorted(edges.items())])
    nodes = spark.createDataFrame([(g, i, x) for g, (labels, _) in graphs.items() for i, x in enumerate(labels)], "gid long, nid long, label string")
    return graphs, nodes, spark.createDataFrame([(g, *e) for g, (_, edges) in graphs.items() for e in edges], "gid long, u long, v long, label string")


@pytest.mark.parametrize("phase", ["path", "tree", "cyclic"])
def test_mining_of_trees_and_cycles_against_brute_force(small_graphs, phase):
    graphs, nodes, edges = small_graphs
    want = {p: len(g) for p, g in brute_patterns(graphs, 5).items() if len(g) >= 2 and mining.kind(p) in mining.PHASES[phase]}
    assert dict(mining.frequent_subgraphs(nodes, edges, 2, 5, phase=phase)) == want
    assert {mining.kind(p) for p in want} == set(mining.PHASES[phase])


@pytest.mark.parametrize("induced", [True, False])
def test_pattern_hits_are_the_joins(small_graphs, induced):
    graphs, nodes, edges = small_graphs
    patterns = [p for p in brute_patterns(graphs, 4)][::9]
    adj = mining.adjacency(nodes, edges)
    hits = {r["gid"]: set(r["hits"]) for r in indexing.pattern_hits(indexing.graph_rows(nodes, edges), patterns, induced).collect()}
    for f, p in enumerate(patterns[:12]):
        assert {r["gid"] for r in matching.matches(adj, p, induced).collect()} == {g for g, h in hits.items() if f in h}


def test_index_chain(small_graphs):
    graphs, nodes, edges = small_graphs
    chosen = indexing.index_features(nodes, edges, support=2, sizes=(2, 4), tried=30, picked=8)
    every = brute_patterns(graphs, 4)
    assert len(chosen) == 8 and all(len(every[p]) == n and 2 <= len(p[1]) <= 4 for p, n in chosen)
    rows = [(0, p, n) for p, n in chosen]
    held = np.array([[True, True, False, False], [True, True, False, False], [True, False, True, False], [False] * 4])
    assert indexing.pick(rows[:4], held, 3) == [0, 2, 1] and indexing.pick(rows[:4], held, 4) == [0, 2, 1, 3]
    assert [n for n, _, _ in indexing.ranked([(((), ((0, 1, "x"),)), 5), (((), ((0, 1, "x"), (1, 2, "x"))), 9), (((), ((0, 1, "x"), (1, 2, "x"))), 4)], 10)] == [2, 1]
    assert [n for n, _, _ in indexing.ranked([(((), ((0, 1, "x"),)), 5)] * 3, 10, fallback=2)] == [0, 1]


def test_masks_are_joined_by_their_rarest_feature(spark):
    r = random.Random(5)
    masks = {g: r.getrandbits(12) & r.getrandbits(12) for g in range(200)} | {200: 0, 201: (1 << 62) | 1}
    d = spark.createDataFrame(list(masks.items()), "gid long, bits long")
    got = {x["qid"]: tuple(x)[1:] for x in matching.candidate_counts(d.where("gid % 20 in (0, 1)").withColumnRenamed("gid", "qid"), d).collect()}
    for q in (g for g in masks if g % 20 in (0, 1)):
        held = [g for g, m in masks.items() if masks[q] & ~m == 0]
        assert got[q] == (len(held), min(held), max(held))


def test_rounds_of_many_starts_read_the_points_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(x):
        seen.add(1)
        return x

    rows = [(i, [float(i % 7), float(i * i % 11)]) for i in range(60)]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    starts = [np.array([rows[i][1] for i in range(s, s + 3)]) for s in range(4)]
    want = clusters.lloyd_many(points, starts, 10)
    monkeypatch.setattr(clusters, "SUMS", 1)  # other tasks add the sums up
    monkeypatch.setattr(clusters, "BLOCK", 8)
    found = clusters.lloyd_many(points.repartition(4).select("id", counted("x").alias("x")), starts, 10)
    assert seen.value == len(rows)
    for (a, x), (b, y) in zip(found, want, strict=True):
        assert np.allclose(a, b) and x == pytest.approx(y)
        assert x == pytest.approx(sum(min(((np.array(p) - c) ** 2).sum() for c in a) for _, p in rows))


def test_many_lloyds_are_single_ones(spark):
    r = np.random.default_rng(4)
    points = spark.createDataFrame([(i, [float(x) for x in r.standard_normal(3) + 5 * (i % 3)]) for i in range(90)], "id long, x array<double>")
    starts = clusters.seeds_plus_plus(points, 4, [0, 1, 2])
    assert [len(s) for s in starts] == [4, 4, 4] and (clusters.seed_plus_plus(points, 2, 1) == starts[1][:2]).all()
    many = clusters.lloyd_many(points, [*starts, starts[0][:1]], 20)
    for (c, e), start in zip(many, [*starts, starts[0][:1]], strict=True):
        one, error = clusters.lloyd(points, start, 20)
        assert np.allclose(c, one) and abs(e - error) < 1e-6 * error
    series = clusters.sweep(points, range(1, 6), restarts=3, rounds=30)
    x = np.array([p["x"] for p in points.collect()])
    assert abs(series[0][1] - ((x - x.mean(0)) ** 2).sum()) < 1e-6 and [k for k, _ in series] == [1, 2, 3, 4, 5]
    assert all(a >= b - 1e-9 for (_, a), (_, b) in zip(series, series[1:], strict=False))


def test_auc_over_ranges_against_all_pairs(spark):
    r = np.random.default_rng(8)
    rows = [(int(y), float(s)) for y, s in zip(r.integers(0, 2, 400), np.round(r.standard_normal(400), 1), strict=True)] + [(None, 0.1), (1, None)]
    pos, neg = [s for y, s in rows if y == 1 and s is not None], [s for y, s in rows if y == 0]
    want = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert abs(metrics.auc(spark.createDataFrame(rows, "y int, score double"), parts=7).first()[0] - want) < 1e-12


def test_negatives_after_failed_draws(spark):
    pos = spark.createDataFrame([(0, 0), (1, 1)], "pid long, u long")
    links = spark.createDataFrame([(0, v) for v in range(1, 40) if v != 37] + [(1, v) for v in range(2, 40)], "src long, dst long")
    got = {r["pid"]: r["v"] for r in layers.negative_edges(pos, links, 40, attempts=1).collect()}
    assert got == {0: 37, 1: None}


def test_singular_vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((50, 6))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    values, right = layers.singular_vectors(nodes, 6, 3)
    u, s, vt = np.linalg.svd(x)
    assert np.allclose(values, s[:3]) and np.allclose(np.abs(right.T @ vt[:3].T), np.eye(3), atol=1e-8)
    got = {q["id"]: q["x"] for q in layers.reduced(nodes, 6, 3).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())


def test_knn_is_exact_with_ties(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 3, (80, 3)).astype(float)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(q["qid"], q["rank"]): q["bid"] for q in hubs.knn(base.where("id < 10"), base, 6, blocks=2).collect()}
    for q in range(10):
        order = sorted(range(80), key=lambda j: (((x[j] - x[q]) ** 2).sum(), j))[:6]
        assert [got[q, k + 1] for k in range(6)] == order


def test_hubs_within_a_budget(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 8))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    near = hubs.ivf(base, base, 5, 10, 4)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {q: set(np.argsort(d[q], kind="stable")[:5].tolist()) for q in range(300)}
    assert sum(p["bid"] in want[p["qid"]] for p in near.collect()) >= 0.85 * 1500
    top, share = hubs.hubs_within(base, base, 5, 10, 600.0, batch=200)
    exact = hubs.top_hubs(hubs.hub_counts(hubs.knn(base, base, 5), base), 10)
    assert share == 1.0 and len({q["id"] for q in top.collect()} & {q["id"] for q in exact.collect()}) >= 9
    assert (hubs.probes_for(20), hubs.probes_for(50), hubs.probes_for(51)) == (48, 96, 256) and (hubs.cells_for(100), hubs.cells_for(10**6)) == (100, 2048)


def test_shortlist_only_for_large_budgets_and_padding(spark):
    edges = spark.createDataFrame([(0, i, 1.0) for i in range(1, 9)] + [(i, 20 + i, 1.0) for i in range(1, 9)] + [(50, 51, 1.0)], "u long, v long, p double")
    seed = spark.createDataFrame([(0,)], "node long")
    got = diffusion.greedy_block(edges, seed, 3, 2, 2).orderBy("rank").collect()
    assert [(r["u"], r["v"], r["gain"]) for r in got] == [(0, 1, 2.0), (0, 2, 2.0), (0, 3, 2.0)]
    lone = diffusion.greedy_block(spark.createDataFrame([(7, 8, 1.0), (9, 7, 1.0)], "u long, v long, p double"), seed, 2, 2, 2).orderBy("rank").collect()
    assert [(r["u"], r["v"], r["gain"]) for r in lone] == [(7, 8, None), (9, 7, None)]


def test_datasets(spark, tmp_path):
    top = f"file://{tmp_path}"
    x = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, x array<double>")
    x.write.parquet(f"{top}/a/nodes")
    spark.createDataFrame([(0, 1)], "src long, dst long").write.parquet(f"{top}/a/edges")
    spark.createDataFrame([(0, 1, "train"), (1, 2, "test")], "id long, y long, split string").write.parquet(f"{top}/a/labels")
    data = datasets.load(spark, "A", f"{top}/a")
    assert data.num_classes == 3 and data.stats().first().asDict() == {"nodes": 2, "features": 1, "edges": 1, "train": 1, "valid": 0, "test": 1, "classes": 2}
    x.write.parquet(f"{top}/c/nodes")
    (tmp_path / "c/train_pos.txt").write_text("0\t1\n1\t0\n")
    (tmp_path / "c/valid_pos.txt").write_text("0\t1\n")
    (tmp_path / "c/train_neg.txt").write_text("1\t1\n0\t0\n")
    np.save(tmp_path / "c/valid_neg_hard.npy", np.array([[[0, 0], [1, 1]]]).reshape(1, 4))
    links = datasets.load(spark, "C", f"{top}/c")
    assert links.hard == {"train": False, "valid": True} and sorted(map(tuple, links.negatives["valid"].collect())) == [(0, 0, 0, 0), (0, 1, 1, 1)]
    assert {tuple(r) for r in links.negatives["train"].select("u", "v").collect()} == {(1, 1), (0, 0)}
    assert {tuple(r) for r in datasets.training_rows(links.positives["valid"], links.negatives["valid"]).collect()} == {(0, 1, 1.0), (0, 0, 0.0), (1, 1, 0.0)}
    for task, folder in (("D", f"{top}/a"), ("A", f"{top}/none"), ("C", f"{top}/a"), ("A", f"{top}/c")):
        with pytest.raises(Exception):  # noqa: B017
            datasets.load(spark, task, folder)


def test_predictions(spark, tmp_path):
    wanted = spark.createDataFrame([(0,), (1,)], "id long")
    got = datasets.predict("A", wanted, f"file://{tmp_path}/a", classes=4).collect()
    assert {r["id"] for r in got} == {0, 1} and all(0 <= r["y_pred"] < 4 for r in got)
    scorer = lambda w: w.select("id", (F.col("id") / 2).alias("y_score"))
    assert {tuple(r) for r in datasets.predict("B", wanted, f"file://{tmp_path}/b", scorer).collect()} == {(0, 0.0), (1, 0.5)}
    for bad in ([(0, 0.1)], [(0, 0.1), (1, 0.2), (1, 0.3)], [(0, 0.1), (1, float("nan"))], [(0, 0.1), (2, 0.2)]):
        with pytest.raises(ValueError, match="predictions of task B"):
            datasets.check_predictions("B", spark.createDataFrame(bad, "id long, y_score double"), wanted)
    weights = {"a": [[1.0, 2.0], [3.0, 4.0]], "b": [[0.5]]}
    datasets.save_weights(spark, weights, f"file://{tmp_path}/w")
    assert datasets.load_weights(spark, f"file://{tmp_path}/w") == weights


def test_layer_norm_by_hand(spark):
    row = spark.range(1).select(vectors.layer_norm(F.array(F.lit(1.0), F.lit(3.0)), [1.0, 2.0], [0.0, 1.0], eps=0.0).alias("x")).first()["x"]
    assert np.allclose(row, [-1.0, 3.0])


def test_support_sweep(spark):
    rows = spark.createDataFrame([(t, i) for t, items in enumerate(("abc", "ab", "ac", "b")) for i in items], "txn_id long, item string")
    assert [(p, n) for p, n, _ in itemsets.support_sweep(rows, (50, 75))] == [(75, 2), (50, 5)]
    assert itemsets.support_sweep(rows, (50, 75), cap=0.0)[1] == (50, 0, 0.0)
