"""SimHash, fingerprints, nearest neighbours, mixing, and the pipeline."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmine.llm import fingerprints, mixing, neighbours, simhash


def brute_components(fps, bits=simhash.BITS):
    fps, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= bits):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(seed, centres, per, flips):
    r = np.random.default_rng(seed)
    out = []
    for c in r.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(per):
            x = c
            for b in r.integers(0, 64, flips):
                x ^= np.uint64(1) << np.uint64(b)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("seed", range(4))
def test_two_tries_find_every_link(seed):
    keys = near(seed, 30, 12, 2)
    links = []
    for swap in (False, True):
        k = np.sort(simhash._swap(keys)) if swap else keys
        label = simhash.trie_components(k)
        back = simhash._swap(k) if swap else k
        links += [(int(back[i]), int(back[j])) for i, j in enumerate(label)]
    index = {int(k): i for i, k in enumerate(keys)}
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(index[a]), find(index[b])))
        parent[b] = a
    assert [find(i) for i in range(len(keys))] == brute_components(keys)


def test_links_over_tasks(spark):
    keys = near(9, 60, 10, 2).astype(np.int64)
    df = spark.createDataFrame([(int(k),) for k in keys], "fp long")
    groups = simhash.groups_of(df.withColumn("doc_id", F.col("fp"))).collect()
    by = {}
    for r in groups:
        by.setdefault(r["component"], set()).add(r["fp"])
    want = {}
    for k, c in zip(keys.tolist(), brute_components(keys.astype(np.uint64)), strict=True):
        want.setdefault(c, set()).add(k)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("subtree", [30])
def test_large_subtrees_are_parted(spark, subtree):
    """Fingerprints that share their first bits fill one subtree, which is parted until it is small."""
    r = np.random.default_rng(2)
    keys = np.concatenate([near(5, 20, 12, 2), near(6, 12, 15, 2) & np.uint64(0x0000_0FFF_FFFF_FFFF), near(7, 8, 15, 3) & ~np.uint64(0xFFFF_F000)])
    keys = np.unique(np.concatenate([keys, keys[::7] ^ (np.uint64(1) << r.integers(0, 64, len(keys[::7]), dtype=np.uint64))]))
    df = spark.createDataFrame([(int(k),) for k in keys.astype(np.int64)], "fp long")
    index = {int(k): i for i, k in enumerate(keys.astype(np.int64))}
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for row in simhash.links(df, subtree=subtree).collect():
        a, b = sorted((find(index[row["fp"]]), find(index[row["root"]])))
        parent[b] = a
    assert [find(i) for i in range(len(keys))] == brute_components(keys)


def test_connected_on_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)]
    got = {r["node"]: r["label"] for r in simhash.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 31)} == {0} and {got[i] for i in range(101, 140)} == {100}


def test_simhash_of_hostile(hostile, empty):
    got = simhash.near_duplicates(hostile).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == hostile.count() and by[1]["component_id"] == 0 and by[7]["component_id"] == 7
    assert {by[i]["fp"] for i in (2, 3, 4)} == {0} and by[4]["component_id"] == 2
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_of_the_table(sample):
    rows = sample.select("doc_id", "text").collect()
    fps = [simhash.text_fingerprint(r["text"]) for r in rows]
    want = [min(rows[j]["doc_id"] for j, c in enumerate(comp) if c == comp[i]) for comp in [brute_components(np.array(fps, np.int64).astype(np.uint64))] for i in range(len(rows))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(sample).collect()}
    assert [got[r["doc_id"]] for r in rows] == want
    kept = {r["doc_id"] for r in simhash.one_of_each(sample).collect()}
    assert kept == set(want)


def test_one_of_each_hostile(hostile, empty):
    got = simhash.one_of_each(hostile)
    assert got.columns == hostile.columns and simhash.one_of_each(empty).count() == 0
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == [0, 2, 5, 6, 7, 8, 9]


def edited_texts(seed, originals=25, words=60):
    """Texts and copies of them with one to four words changed: resemblances from 0.5 up."""
    r = np.random.default_rng(seed)
    texts = []
    for _ in range(originals):
        base = [f"w{x}" for x in r.integers(0, 3000, words)]
        texts.append(" ".join(base))
        for changed in (1, 1, 2, 3, 4):
            copy = list(base)
            for at in r.integers(0, words, changed):
                copy[at] = f"v{r.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    return [texts[i] for i in r.permutation(len(texts))]


def brute_similar(texts):
    """Least index of each text's component under links of resemblance 0.8 on five-word shingle sets."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    return comp


def test_every_pair_from_the_threshold_on_is_linked(spark):
    texts = edited_texts(3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = set(brute_similar(texts))
    assert len(want) < 0.8 * len(texts)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_similar_of_the_table_and_hostile(sample, hostile, empty):
    rows = sample.select("doc_id", "text").orderBy("doc_id").collect()
    comp = brute_similar([(r["text"] or "").lower() for r in rows])
    assert sorted(r["doc_id"] for r in simhash.one_of_each_similar(sample).collect()) == sorted(rows[c]["doc_id"] for c in set(comp))
    got = simhash.one_of_each_similar(hostile)
    assert got.columns == hostile.columns and simhash.one_of_each_similar(empty).count() == 0
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == [0, 2, 5, 6, 7, 8, 9]


# ---- bottom-k --------------------------------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f".split()), max_size=40), st.lists(st.sampled_from("a b c d e f".split()), max_size=40))
def test_small_sketches_are_exact(a, b):
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    x, y = fingerprints.sketch(" ".join(a)), fingerprints.sketch(" ".join(b))
    sa, sb = shingles(a), shingles(b)
    assert len(x) == len(sa)
    assert abs(fingerprints.resemblance(x, y) - (len(sa & sb) / len(sa | sb) if sa | sb else 1.0)) < 1e-9
    if sa:
        assert abs(fingerprints.containment(x, y) - len(sa & sb) / len(sa)) < 1e-9


def test_estimates_and_merge():
    r = np.random.default_rng(1)
    a = [f"w{x}" for x in r.integers(0, 10**6, 4000)]
    b = a[:2000] + [f"w{x}" for x in r.integers(0, 10**6, 2000)]
    x, y = fingerprints.sketch(" ".join(a)), fingerprints.sketch(" ".join(b))
    assert abs(fingerprints.resemblance(x, y) - 1 / 3) < 0.2 and abs(fingerprints.distinct(x) / 3996 - 1) < 0.4
    parts = fingerprints.merge(fingerprints.sketch(" ".join(a[:2004])), fingerprints.sketch(" ".join(a[2000:])))
    assert (parts == x).all() and (fingerprints.from_hex(fingerprints.to_hex(x)) == x).all()


@pytest.mark.parametrize("name", ["hostile", "sample"])
def test_edited_texts(name, request):
    docs = request.getfixturevalue(name)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want = []
    for i, r in enumerate(rows):
        t, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        half = len(t) // 2
        want.append((r["doc_id"], len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprints.fingerprint_with_edits(docs).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_edited_small_tables(spark, empty):
    assert fingerprints.fingerprint_with_edits(empty).count() == 0
    r = fingerprints.fingerprint_with_edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [x["edited_sha256"] for x in r] == [hashlib.sha256(b"abab").hexdigest()]


# ---- neighbours ------------------------------------------------------------------------------------------------------


def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, a in ok:
        if i % every == 0:
            s = sorted((-(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), j) for j, b in ok if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


def test_neighbours_recall(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.standard_normal(16)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in neighbours.nearest(df, every=20).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = x["vec_id"]
    want = brute_nearest(rows, 5, 20)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    assert np.mean([len(set(got[q].values()) & set(w)) / 5 for q, w in want.items()]) >= 0.95


def test_greedy_search_with_a_narrow_beam(spark):
    """The shipped beam compares a query with a small part of the table, and still finds nearly all neighbours."""
    r = np.random.default_rng(6)
    centres = r.standard_normal((100, 24))
    x = centres[r.integers(0, 100, 8000)] + 0.7 * r.standard_normal((8000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, every=50).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 8000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & {r["vec_id"] for r in rows if r["query_id"] == q})
    assert hit >= 0.95 * 5 * 160
    assert np.mean([r["compared"] for r in rows]) < 0.5 * 8000


def test_one_id_with_two_vectors(spark):
    r = np.random.default_rng(7)
    rows = [(i, r.standard_normal(6)) for i in range(60)]
    rows += [(0, r.standard_normal(6)), (7, r.standard_normal(6))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    want = {}
    for q, a in rows:
        if q % 50 == 0:
            for i, b in rows:
                if i != q:
                    s = float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
                    want[q, i] = max(want.get((q, i), -9), s)
    got = neighbours.nearest(df).collect()
    for q in (0, 50):
        best = sorted(((-s, i) for (p, i), s in want.items() if p == q))[:5]
        assert [(x["rank"], x["vec_id"], round(x["score"], 12)) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == [(n + 1, i, round(-s, 12)) for n, (s, i) in enumerate(best)]


def test_other_lengths_are_a_space_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 0.0, 1.0]), (100, [2.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(0, 1), (50, 51)]


def test_neighbours_hostile(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (8, [1.0, 0.0, 3.0]), (7, [0.5, 0.5]), *[(i, [1.0, 0.0]) for i in range(60, 90)]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id int, node int")
    got = {}
    for x in neighbours.nearest(df).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    assert [v for _, v in sorted(got[0])] == [1, 2, 50, 60, 61] and [v for _, v in sorted(got[50])] == [0, 1, 2, 60, 61]
    few = spark.createDataFrame(rows[:1] + rows[7:8], "vec_id long, embedding array<double>")
    assert [(x["query_id"], x["vec_id"]) for x in neighbours.nearest(few).collect()] == [(0, 7)]
    assert neighbours.nearest(few.limit(0)).count() == 0


# ---- mixing ----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: float(cap * sizes[s]) for s in over}
        rest -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "c", "é", "Z", "😀", None]), st.integers(0, 1000), min_size=1, max_size=7))
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix(sample):
    rows = mixing.mix(sample).collect()
    assert len(rows) == sample.count()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in target)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(sample.repartition(7)).collect()}
    assert all(again[r["doc_id"]] == r["taken"] for r in rows)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "planted"])
def test_mix_is_its_sql(spark, name):
    """DuckDB gives the same rows; the planted table has sources far below a thousand blocks."""
    import duckdb

    con = duckdb.connect()
    if name == "planted":
        rows = [(i, "a", "w " * 150) for i in range(1500)] + [(10_000 + i, "b", "w " * 3) for i in range(20)] + [(20_000 + i, None, "w " * (i % 40)) for i in range(50)] + [(30_000, "z", None)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        con.register("documents", docs.toPandas())
    else:
        docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
        con.execute(f"create view documents as select * from '/root/testdata/{name}/documents.parquet'")
    found = con.execute(mixing.OP6_SQL)
    columns = [c[0] for c in found.description]
    shaped = lambda rows: sorted((str(r[0]), str(r[1]), r[2], r[3], round(r[4], 3), r[5]) for r in rows)
    assert shaped(mixing.mix(docs).select(*columns).collect()) == shaped(found.fetchall())


def test_mix_hostile(hostile, empty):
    rows = mixing.mix(hostile).collect()
    assert len(rows) == hostile.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0
    assert mixing.repeated(hostile).columns == hostile.columns


def test_tiny_sources_beside_a_huge_one_meet_their_targets(spark):
    rows = [(i, "a", "w " * 2000) for i in range(1500)] + [(10_000 + i, "b", "w " * 10) for i in range(20)] + [(20_000 + i, "c", "w " * 20) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for slots in (mixing.SLOTS, 2000):  # blocks of 23 and 1,501 words, of which b and c have far too few
        taken, target = {}, {}
        for r in mixing.mix(docs, weights=(30_000, 1, 1), slots=slots).collect():
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
            target[r["source"]] = r["target"]
        assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in target), (taken, target)


# ---- pipeline --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["hostile", "empty", "sample"])
def test_stages(spark, name, request):
    docs = request.getfixturevalue(name)
    for step, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, ""))
        assert out.columns == docs.columns, step
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}
    if name == "sample":
        kept = {r["doc_id"] for r in request.getfixturevalue(name).collect()}
        assert {p["doc_id"] for p in pieces} <= kept and pieces


def test_a_crowd_of_near_copies_makes_no_pairs_as_rows(spark, monkeypatch):
    r = np.random.default_rng(8)
    base, texts = [f"w{x}" for x in range(80)], []
    for i in range(160):
        copy = list(base)
        for at in r.integers(0, 80, i % 5):
            copy[at] = f"v{r.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    texts = edited_texts(9, originals=6) + texts
    made, whole = [], simhash._may_be_similar

    def counted(pairs, least):
        made.append(pairs.count())
        return whole(pairs, least)

    monkeypatch.setattr(simhash, "_may_be_similar", counted)
    monkeypatch.setattr(simhash, "BLOCK", 32, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = set(brute_similar(texts))
    assert 10 < len(want) < len(texts) - 60
    assert {x["doc_id"] for x in simhash.one_of_each_similar(docs).collect()} == want
    assert sum(made) < 20 * len(texts)


def test_intersections_against_sets():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 6000, n)) for n in (1, 40, 3000, 5000, 5000)]
    assert simhash._intersections(sets).tolist() == [[len(np.intersect1d(a, b)) if a is not b else int(np.isin(a, np.concatenate([c for c in sets if c is not a])).sum()) for b in sets] for a in sets]
