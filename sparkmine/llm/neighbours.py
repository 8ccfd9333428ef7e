"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily from each query.

Equal vectors are one node, keyed by a hash of the vector, with its least ids, so copies of one vector make no large
groups. The graph starts from random blocks. In each round a node gathers its neighbours and those that have it as neighbour, compares them with each
other (neighbours of neighbours), and sends each one the closer ones it has found; pairs that met before aren't
compared again. Rounds end when few edges change. Vectors travel as 8-bit codes.

A query starts at its own node, opens the closest unopened nodes it knows, and keeps the closest BEAM, for a fixed number
of rounds; nodes are compared where their block is. The closest FINAL are then compared exactly, in double precision,
on the original vectors.

Vectors that are null, zero, or hold null or non-finite components take no part. Those of another length are a space of
their own. A null id takes no part. Repeated rows of one id are one vector if equal; else each takes part under that id,
and a query whose id has several vectors has one list, of the least distance to any of them.
Fewer candidates than asked for are all returned. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmine.lineage import drop
from sparkmine.llm.common import partitions, written

#: Neighbours kept per node, reverse neighbours joined per node, random blocks to start from, most rounds, and the share of changed edges that ends them.
DEGREE, REVERSE, START_BLOCK, STARTS, ROUNDS, SETTLED = 40, 40, 256, 2, 8, 0.01
#: Search: nodes known at once, opened per round, rounds, and nodes compared exactly at the end. Nodes of a block.
BEAM, OPENED, STEPS, FINAL, BLOCK = 224, 32, 5, 24, 1024

#: A round's codes are so many times as large as the table of nodes, about.
MEETINGS = 10

GRAPH = "node long, ids binary, sims binary, fresh binary"


# ---- packing ---------------------------------------------------------------------------------------------------------


def encode(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors as a float32 scale and 8-bit codes, one row of bytes each."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = (np.abs(unit).max(1, keepdims=True) / 127).astype("<f4")
    return np.concatenate([scale.view(np.uint8), np.rint(unit / scale).astype(np.int8).view(np.uint8)], axis=1)


def decode(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames that end where the key changes; rows come sorted by it."""
    rest: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        last = pdf[key].iloc[-1]
        at = int(np.searchsorted(pdf[key].to_numpy(), last))
        if at == 0 and rest and rest[-1][key].iloc[-1] == last:
            rest.append(pdf)
            continue
        yield pd.concat([*rest, pdf.iloc[:at]]) if rest else pdf.iloc[:at]
        rest = [pdf.iloc[at:]]
    if rest:
        yield pd.concat(rest)


def starts_of(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def closest(u: np.ndarray, w: np.ndarray, s: np.ndarray, old: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of rows (u, w, s, old) the k closest distinct w of each u, closest first; an old row wins over a new one of the same pair."""
    order = np.lexsort((~old, w, u))
    u, w, s, old = u[order], w[order], s[order], old[order]
    first = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]) if len(u) else np.zeros(0, bool)
    u, w, s, old = u[first], w[first], s[first], old[first]
    order = np.lexsort((w, -s, u))
    u, w, s, old = u[order], w[order], s[order], old[order]
    at = starts_of(u)
    keep = np.arange(len(u)) - np.repeat(at[:-1], np.diff(at)) < k
    return u[keep], w[keep], s[keep], old[keep]


def _packed(u: np.ndarray, w: np.ndarray, s: np.ndarray, old: np.ndarray) -> pd.DataFrame:
    at = starts_of(u)
    cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    w, s, fresh = w.astype("<i8"), s.astype("<f4"), (~old).astype(np.uint8)
    return pd.DataFrame({"node": u[at[:-1]], "ids": [w[a:b].tobytes() for a, b in cut], "sims": [s[a:b].tobytes() for a, b in cut], "fresh": [fresh[a:b].tobytes() for a, b in cut]})


# ---- nodes -----------------------------------------------------------------------------------------------------------


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (array<double>) of the rows that take part."""
    v = F.col("vector")
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """node (a hash of the vector), vector, code, members (the keep least ids, ascending): one row per distinct vector."""
    # rank within equal vectors: each task passes on only the least ids of a vector
    least = Window.partitionBy("h", "vector").orderBy("id")
    ranked = rows.distinct().withColumn("h", F.xxhash64("vector")).withColumn("r", F.row_number().over(least)).where(F.col("r") <= keep)
    groups = ranked.groupBy("h", "vector").agg(F.array_sort(F.collect_set("id")).alias("members"))

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["vector"].tolist())
                yield pd.DataFrame({"node": pdf["h"], "vector": [r.tobytes() for r in x.astype("<f8")], "code": [r.tobytes() for r in encode(x)], "members": pdf["members"].tolist()})

    nodes = written(groups.mapInPandas(code, "node long, vector binary, code binary, members array<long>"))
    twice = nodes.groupBy("node").count().where("count > 1").select(F.col("node").alias("n"))
    if twice.isEmpty():
        return nodes
    # different vectors of one hash (a handful in billions): they are keyed by another hash
    again = F.when(F.col("n").isNull(), F.col("node")).otherwise(F.xxhash64(F.lit("again"), "vector"))
    return written(nodes.join(twice, F.col("node") == F.col("n"), "left").select(again.alias("node"), "vector", "code", "members"))


# ---- graph -----------------------------------------------------------------------------------------------------------


def start_graph(nodes: DataFrame, count: int, degree: int = DEGREE) -> DataFrame:
    """Each node's closest in STARTS random blocks of about START_BLOCK."""
    blocks = max(1, count // START_BLOCK)
    dealt = nodes.select("node", "code", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1 if blocks > 1 else 0))).alias("start"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "start"), F.lit(blocks)))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["node"].to_numpy(), decode(pdf["code"].tolist())
        k = min(degree, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"u": ids[:0], "w": ids[:0], "s": np.zeros(0, np.float32), "old": np.zeros(0, bool)})
        s = x @ x.T
        np.fill_diagonal(s, -9)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"u": np.repeat(ids, k), "w": ids[top].ravel(), "s": np.take_along_axis(s, top, 1).ravel(), "old": False})

    return dealt.groupBy("start", "block").applyInPandas(within, "u long, w long, s float, old boolean")


def merge_edges(edges: DataFrame, degree: int, parts: int) -> DataFrame:
    """GRAPH from rows (u, w, s, old), in so many partitions."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, "u"):
            if len(pdf):
                yield _packed(*closest(*(pdf[c].to_numpy() for c in ("u", "w", "s", "old")), degree))

    return edges.repartition(parts, "u").sortWithinPartitions("u").mapInPandas(merge, GRAPH)


def edge_rows(graph: DataFrame) -> DataFrame:
    """u, w, s, old; what the graph holds has met."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids = [np.frombuffer(b, "<i8") for b in pdf["ids"]]
            if ids:
                yield pd.DataFrame({"u": np.repeat(pdf["node"].to_numpy(), [len(x) for x in ids]), "w": np.concatenate(ids), "s": np.frombuffer(b"".join(pdf["sims"]), "<f4"), "fresh": np.frombuffer(b"".join(pdf["fresh"]), np.uint8).astype(bool)})

    return graph.mapInPandas(unpack, "u long, w long, s float, fresh boolean")


def both_ways(graph: DataFrame, limit: int = REVERSE) -> DataFrame:
    """v, member, fresh: a node's neighbours and up to limit of those that have it as neighbour, by a hash of the pair."""
    edges = edge_rows(graph)
    turn = Window.partitionBy("w").orderBy(F.xxhash64("u", "w"))
    back = edges.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= limit)
    return edges.select(F.col("u").alias("v"), F.col("w").alias("member"), "fresh").unionByName(back.select(F.col("w").alias("v"), F.col("u").alias("member"), "fresh"))


def descend(graph: DataFrame, nodes: DataFrame, degree: int = DEGREE) -> DataFrame:
    """One round: the graph after each node has introduced its neighbours to each other."""
    worst = graph.select("node", "sims")

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sims = [np.frombuffer(b, "<f4") for b in pdf["sims"]]
            yield pd.DataFrame({"m": pdf["node"], "least": [float(s[-1]) if len(s) >= degree else -9.0 for s in sims]})

    parts = partitions(nodes, MEETINGS)
    about = nodes.select(F.col("node").alias("member"), "code").join(worst.mapInPandas(bounds, "m long, least float"), F.col("member") == F.col("m"), "left").select("member", "code", F.coalesce("least", F.lit(-9.0).cast("float")).alias("least"))
    met = both_ways(graph).join(about, "member")

    def introduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, "v"):
            if not len(pdf):
                continue
            v, ids, fresh, least, x = pdf["v"].to_numpy(), pdf["member"].to_numpy(), pdf["fresh"].to_numpy(), pdf["least"].to_numpy(), decode(pdf["code"].tolist())
            at, out = starts_of(v), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a > 1 and fresh[a:b].any():
                    s = x[a:b] @ x[a:b].T
                    i, j = np.nonzero((s > least[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]))
                    differ = ids[a + i] != ids[a + j]
                    i, j = i[differ], j[differ]
                    out.append((ids[a + i], ids[a + j], s[i, j]))
            if out:
                u, w, s = map(np.concatenate, zip(*out, strict=True))
                u, w, s, _ = closest(u, w, s, np.zeros(len(u), bool), degree)  # of this batch; a smaller shuffle
                yield pd.DataFrame({"u": u, "w": w, "s": s, "old": False})

    found = met.repartition(parts, "v").sortWithinPartitions("v").mapInPandas(introduce, "u long, w long, s float, old boolean")
    return merge_edges(edge_rows(graph).select("u", "w", "s", F.lit(True).alias("old")).unionByName(found), degree, parts)


def build(nodes: DataFrame, count: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    graph = written(merge_edges(start_graph(nodes, count, degree), degree, partitions(nodes, MEETINGS)))
    for _ in range(rounds if count > START_BLOCK else 0):
        before, graph = graph, written(descend(graph, nodes, degree))
        drop(before)
        changed = edge_rows(graph).agg(F.avg(F.col("fresh").cast("double")).alias("x")).first()["x"]
        if (changed or 0) < SETTLED:
            break
    return graph


# ---- search ----------------------------------------------------------------------------------------------------------


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, count: int, beam: int = BEAM, opened: int = OPENED, steps: int = STEPS) -> DataFrame:
    """q, ids, sims, compared: each query node's closest nodes found, and with how many it was compared (a node that it met
    in several rounds counts in each). queries: q (a node), code."""
    blocks = max(1, count // BLOCK)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    where = nodes.select("node", "code", block("node").alias("block"))
    around = written(both_ways(graph).select("v", "member").distinct())
    # a query's beam: ids, sims, and whether each has been opened
    state = queries.select("q", "code", F.lit(b"").alias("ids"), F.lit(b"").alias("sims"), F.lit(b"").alias("done"), F.lit(0).cast("long").alias("compared"))
    beams = "q long, code binary, ids binary, sims binary, done binary, compared long"

    def to_open(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            q, x = [], []
            for r in pdf.itertuples(index=False):
                ids, done = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.done, np.uint8)
                new = ids[done == 0][:opened] if len(ids) else np.array([r.q])
                q.append(np.full(len(new), r.q))
                x.append(new)
            if q:
                yield pd.DataFrame({"q": np.concatenate(q), "x": np.concatenate(x)})

    def compare(_key, asked: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(here):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "ids": [], "sims": [], "compared": np.zeros(0, np.int64)})
        order = np.argsort(here["node"].to_numpy())
        ids, x = here["node"].to_numpy()[order], decode(here["code"].tolist())[order]
        out = []
        for q, code, wanted in zip(asked["q"], asked["code"], asked["wanted"], strict=True):
            w = np.unique(wanted)
            w = w[w != q]
            s = x[np.searchsorted(ids, w)] @ decode([code])[0]
            top = np.argsort(-s, kind="stable")[:beam]
            out.append((q, w[top].astype("<i8").tobytes(), s[top].astype("<f4").tobytes(), len(w)))
        return pd.DataFrame(out, columns=["q", "ids", "sims", "compared"])

    def renew(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, "q"):
            rows = []
            for q, g in pdf.groupby("q", sort=False):
                old = g[g["code"].notna()].iloc[0]
                ids, sims, done = np.frombuffer(old["ids"], "<i8"), np.frombuffer(old["sims"], "<f4"), np.frombuffer(old["done"], np.uint8).copy()
                done[np.flatnonzero(done == 0)[:opened]] = 1  # these have been opened by now
                new = g[g["code"].isna()]
                w, s = np.concatenate([ids, *(np.frombuffer(b, "<i8") for b in new["ids"])]), np.concatenate([sims, *(np.frombuffer(b, "<f4") for b in new["sims"])])
                opened_before = np.concatenate([done, np.zeros(len(w) - len(ids), np.uint8)]).astype(bool)
                _, w, s, o = closest(np.zeros(len(w), np.int64), w, s, opened_before, beam)
                rows.append((q, old["code"], w.astype("<i8").tobytes(), s.astype("<f4").tobytes(), o.astype(np.uint8).tobytes(), int(g["compared"].sum())))
            if rows:
                yield pd.DataFrame(rows, columns=["q", "code", "ids", "sims", "done", "compared"])

    for _ in range(steps):
        asked = state.mapInPandas(to_open, "q long, x long").join(around, F.col("x") == F.col("v")).select("q", F.col("member").alias("w"), block("member").alias("block"))
        asked = asked.groupBy("block", "q").agg(F.collect_set("w").alias("wanted")).join(state.select("q", "code"), "q")
        met = asked.groupBy("block").cogroup(where.groupBy("block")).applyInPandas(compare, "q long, ids binary, sims binary, compared long")
        both = state.unionByName(met.select("q", F.lit(None).cast("binary").alias("code"), "ids", "sims", F.lit(None).cast("binary").alias("done"), "compared"))
        state = written(both.repartition(partitions(nodes), "q").sortWithinPartitions("q").mapInPandas(renew, beams))
    return state.select("q", "ids", "sims", "compared")


def nearest(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, compared: the k nearest found for each row whose id is divisible by every, by cosine,
    and how many nodes the query was compared with."""
    rows = usable(table, id_col, vector_col)
    widths = sorted(r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().collect())  # one, unless tables are mixed
    found = [_nearest(rows.where(F.size("vector") == n), k, every) for n in widths or [0]]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, k: int, every: int) -> DataFrame:
    nodes = nodes_of(rows, k + 1)
    count = nodes.count()
    graph = build(nodes, count)
    # queries of one vector share a search; members beyond the least k + 1 are told apart below
    ids = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).distinct()

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"query_id": pdf["id"], "vector": [np.asarray(v, "<f8").tobytes() for v in pdf["vector"]]})

    asked = written(ids.mapInPandas(raw, "query_id long, vector binary").join(nodes.select("node", "vector"), "vector").select("query_id", "node"))
    starts = asked.select(F.col("node").alias("q")).distinct().join(nodes.select(F.col("node").alias("q"), "code"), "q")
    found = search(written(starts), graph, nodes, count)

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                w = np.append(np.frombuffer(r.ids, "<i8")[:FINAL], r.q)
                yield pd.DataFrame({"q": r.q, "compared": r.compared, "w": w})

    pairs = found.mapInPandas(heads, "q long, compared long, w long").join(nodes.select(F.col("node").alias("w"), F.col("vector").alias("wv"), "members"), "w").join(nodes.select(F.col("node").alias("q"), F.col("vector").alias("qv")), "q")

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), "<f8").reshape(len(pdf), -1) for c in ("qv", "wv"))
                s = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                yield pd.DataFrame({"q": pdf["q"], "compared": pdf["compared"], "members": pdf["members"], "score": s})

    scored = pairs.select("q", "compared", "qv", "wv", "members").mapInPandas(exact, "q long, compared long, members array<long>, score double").select("q", "compared", F.explode("members").alias("vec_id"), "score")
    # a vec_id of several vectors counts once, with its best; k + 1 per node: a query leaves itself out
    scored = scored.groupBy("q", "vec_id").agg(F.max("score").alias("score"), F.first("compared").alias("compared"))
    near = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    short = scored.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    own = asked.join(short, F.col("node") == F.col("q")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("compared").alias("compared"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
