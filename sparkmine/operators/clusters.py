"""k-means: seeding by squared distance, Lloyd rounds, sums of squared errors over k, and the elbow.

Centroids live on the driver (k vectors); points are read once per round, reduced to k sums per task, and only those
sums travel. Where many starts advance together, the points are written once as blocks of raw doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmine.functions.hashing import uniform
from sparkmine.lineage import cut, drop

#: Points of a block, and tasks whose sums the driver adds up by itself; of more tasks other tasks add them up first.
BLOCK, SUMS = 512, 32


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, d2: the nearest centroid (the first of ties) and the squared distance to it."""

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["x"].tolist())
                d = ((x[:, None, :] - centroids[None]) ** 2).sum(2) if len(centroids) * x.size < 1 << 24 else np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
                yield pd.DataFrame({"id": pdf["id"], "cluster": d.argmin(1).astype(np.int64), "d2": d.min(1)})

    return points.select("id", "x").mapInPandas(nearest, "id long, cluster long, d2 double")


def sums(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts, sums and the total squared error of the clusters, from one row per task and cluster."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, e = np.zeros(len(centroids), np.int64), np.zeros_like(centroids), np.zeros(len(centroids))
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["x"].tolist())
                d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
                at = d.argmin(1)
                np.add.at(n, at, 1)
                np.add.at(s, at, x)
                np.add.at(e, at, d.min(1))
        if n.any():
            yield pd.DataFrame({"cluster": np.arange(len(n)), "n": n, "s": list(s), "e": e})

    rows = points.select("x").mapInPandas(part, "cluster long, n long, s array<double>, e double")
    dims = [F.sum(F.element_at("s", i + 1)).alias(f"d{i}") for i in range(centroids.shape[1])]
    n, s, e = np.zeros(len(centroids), np.int64), np.zeros_like(centroids), 0.0
    for r in rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), *dims).collect():  # k rows
        n[r["cluster"]], s[r["cluster"]] = r["n"], [r[f"d{i}"] for i in range(s.shape[1])]
        e += r["e"]
    return n, s, e


def lloyd(points: DataFrame, start: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Centroids and squared error; an empty cluster keeps its centroid; ends when all moves are within tolerance."""
    centroids = start.astype(float)
    for _ in range(rounds):
        n, s, _ = sums(points, centroids)
        new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centroids)
        done = (np.abs(new - centroids) <= 1e-8 + 1e-5 * np.abs(centroids)).all()
        centroids = new
        if done:
            break
    return centroids, sums(points, centroids)[2]


def first_points(points: DataFrame, k: int) -> np.ndarray:
    return np.array([r["x"] for r in points.orderBy("id").limit(k).collect()])


def _products(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None], 0)


def _blocks(points: DataFrame) -> DataFrame:
    """n, x: the points as rows of up to BLOCK vectors each, raw doubles one after the other, dealt evenly and written."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), BLOCK):
                x = np.stack(pdf["x"].iloc[at : at + BLOCK].tolist()).astype("<f8")
                yield pd.DataFrame({"n": [len(x)], "x": [x.tobytes()]})

    parts = points.sparkSession.sparkContext.defaultParallelism
    return cut(points.select("x").mapInPandas(make, "n int, x binary").repartition(max(parts, points.rdd.getNumPartitions())))


def lloyd_many(points: DataFrame, starts: list[np.ndarray], rounds: int = 100) -> list[tuple[np.ndarray, float]]:
    """lloyd() of every start at once: a round is one pass over the points for all of them that still move.

    The squared errors come from a last pass over all final centroids.
    """
    state, moving = [np.asarray(s, float) for s in starts], list(range(len(starts)))
    if not state:
        return []
    blocks = _blocks(points)
    tasks = blocks.rdd.getNumPartitions()

    def reduced(sets: list[np.ndarray], errors: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and sums of each centroid's points, and if errors the squared error of each set."""
        every = np.concatenate(sets)
        cuts = np.cumsum([0, *map(len, sets)])

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, s, e = np.zeros(len(every)), np.zeros_like(every), np.zeros(len(every))
            for pdf in frames:
                for size, raw in zip(pdf["n"], pdf["x"], strict=True):
                    x = np.frombuffer(raw, "<f8").reshape(size, -1)
                    d = _products(x, every)
                    near = np.stack([a + d[:, a:b].argmin(1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], 1)
                    # a one for each point and its centroid of each set: the sums are one matrix product
                    ones = np.zeros_like(d)
                    ones[np.arange(size)[:, None], near] = 1
                    n += ones.sum(0)
                    s += ones.T @ x
                    if errors:
                        for j, a in enumerate(cuts[:-1]):
                            e[a] += ((x - every[near[:, j]]) ** 2).sum()
            yield pd.DataFrame({"sums": [np.column_stack([n, e, s]).tobytes()]})

        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(every), every.shape[1] + 2))
            for pdf in frames:
                for raw in pdf["sums"]:
                    total += np.frombuffer(raw).reshape(total.shape)
            yield pd.DataFrame({"sums": [total.tobytes()]})

        rows = blocks.mapInPandas(part, "sums binary")
        if tasks > SUMS:
            rows = rows.repartition(SUMS).mapInPandas(add, "sums binary")
        total = np.zeros((len(every), every.shape[1] + 2))
        for r in rows.collect():  # SUMS rows at most
            total += np.frombuffer(r["sums"]).reshape(total.shape)
        n, e, s = total[:, 0], total[:, 1], total[:, 2:]
        return n, s, e[cuts[:-1]]

    for _ in range(rounds):
        if not moving:
            break
        n, s, _ = reduced([state[i] for i in moving])
        at, still = 0, []
        for i in moving:
            k = len(state[i])
            new = np.where(n[at : at + k, None] > 0, s[at : at + k] / np.maximum(n[at : at + k, None], 1), state[i])
            if not (np.abs(new - state[i]) <= 1e-8 + 1e-5 * np.abs(state[i])).all():
                still.append(i)
            state[i] = new
            at += k
        moving = still
    errors = reduced(state, errors=True)[2]
    drop(blocks)
    return [(c, float(e)) for c, e in zip(state, errors, strict=True)]


def seed_plus_plus(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k-means++: each next point is drawn by its squared distance, by exponential races so that no prefix sum is needed.

    Fewer draws with the same seed are its first points.
    """
    return seeds_plus_plus(points, k, [seed])[0]


def seeds_plus_plus(points: DataFrame, k: int, seeds: list[int]) -> list[np.ndarray]:
    """seed_plus_plus() of several seeds: each round draws a point for all of them in one pass, and each task passes on its
    winners only."""
    found: list[list[list[float]]] = [[] for _ in seeds]
    for at in range(k):
        near = [np.array(f) if f else None for f in found]
        races = [F.when(F.lit(True), -F.log(F.greatest(uniform("seed", s, at, F.col("id")), F.lit(1e-12)))).alias(f"r{j}") for j, s in enumerate(seeds)]

        def winners(frames: Iterator[pd.DataFrame], near=near) -> Iterator[pd.DataFrame]:
            best: list = [None] * len(near)
            for pdf in frames:
                if not len(pdf):
                    continue
                x, ids = np.stack(pdf["x"].tolist()), pdf["id"].to_numpy()
                for j, c in enumerate(near):
                    race = pdf[f"r{j}"].to_numpy()
                    d = np.ones(len(x)) if c is None else _products(x, c).min(1)
                    d[d < 1e-12] = 0
                    with np.errstate(divide="ignore"):
                        key = np.where(d > 0, race / d, np.inf)
                    i = np.lexsort((ids, race, key))[0]  # all distances zero: any point, uniformly
                    mine = (float(key[i]), float(race[i]), int(ids[i]), x[i].tolist())
                    best[j] = mine if best[j] is None else min(best[j], mine)
            rows = [(j, *b) for j, b in enumerate(best) if b]
            if rows:
                yield pd.DataFrame(rows, columns=["j", "key", "race", "id", "x"])

        rows = points.select("id", "x", *races).mapInPandas(winners, "j int, key double, race double, id long, x array<double>")
        first = rows.groupBy("j").agg(F.min(F.struct("key", "race", "id", "x")).alias("w")).collect()  # a row per seed
        for r in first:
            found[r["j"]].append(r["w"]["x"])
        if len(first) < len(seeds):
            break
    return [np.array(f) for f in found]


def kmeans(points: DataFrame, k: int, restarts: int = 10, rounds: int = 100) -> tuple[np.ndarray, float]:
    """The restart of least squared error."""
    return min(lloyd_many(points, seeds_plus_plus(points, k, list(range(restarts))), rounds), key=lambda x: x[1])


def sweep(points: DataFrame, ks: range, restarts: int = 10, rounds: int = 100) -> list[tuple[int, float]]:
    """(k, the least squared error of the restarts), all k and restarts advancing together."""
    seeds = seeds_plus_plus(points, max(ks), list(range(restarts)))
    tasks = [(k, s[:k]) for k in ks for s in seeds if len(s) >= k]
    best: dict[int, float] = {}
    for (k, _), (_, error) in zip(tasks, lloyd_many(points, [s for _, s in tasks], rounds), strict=True):
        best[k] = min(best.get(k, float("inf")), error)
    return sorted(best.items())


def elbow(series: DataFrame) -> DataFrame:
    """k, distance of the point farthest from the chord between the first and last of (k, sse); the first of ties."""
    everything = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = series.select("k", "sse", *[f(c).over(everything).alias(f"{n}_{c}") for n, f in (("a", F.first), ("b", F.last)) for c in ("k", "sse")])
    dx, dy = F.col("b_k") - F.col("a_k"), F.col("b_sse") - F.col("a_sse")
    far = F.abs(dx * (F.col("a_sse") - F.col("sse")) - (F.col("a_k") - F.col("k")) * dy) / F.sqrt(dx * dx + dy * dy)
    return ends.select("k", far.alias("distance")).orderBy(F.desc("distance"), "k").limit(1)
