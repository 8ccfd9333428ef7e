"""Packing token ids into windows by non-negative least squares over length combinations.

A document's ids are cut into full windows and one remainder. The remainders' histogram has at most window - 1 bins,
whatever the number of documents. On the driver, shallow combinations (two to eight lengths that fill the window
exactly) are enumerated over the lengths that occur, repeat counts are solved against the histogram by non-negative
least squares, rounded down, and topped up greedily; then the same over what is left, a few times. The n-th remainder
of a length gets the n-th slot for that length. The remainders that no combination takes are packed greedily: laid end to end in order and cut at each window,
so that only the very last sequence can be short.

Numbering the remainders of a length needs no group of that length in one task: each task numbers its own, and only
the tasks' counts are added up.

Nulls and empty texts hold the end id alone. Repeated rows and null ids are documents of their own. An empty table
gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmine.llm.common import bounded, give_back, worker_cache, written
from sparkmine.llm.encode import KEPT, batches, encoder

WINDOW = 2048
#: Places of a combination, frequent lengths that are tried beside two free places, rounds of the solver, and how often it is
#: run, each time over what rounding has left.
PLACES, PARTNERS, ROUNDS, PASSES = 8, 64, 60, 6
#: Sequence ids of the three kinds: full windows by task, combinations, greedy residuals.
COMBINED, RESIDUAL = 1 << 61, 1 << 62
#: Up to so many residual remainders their keys are broadcast to the ids; beyond, both sides are shuffled.
BROADCAST_ROWS = 50_000

PARTS = "task int, nth long, doc_id long, doc_tokens long, windows array<long>, rest int, rest_crc32 long, rest_nth long, rest_ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def combinations(counts: np.ndarray, window: int, partners: int = PARTNERS) -> np.ndarray:
    """Rows of PLACES lengths (0: none) that sum to the window, over lengths with counts[length] > 0.

    Every length is tried with every one that fills the window, in three places with the partners that hold the most
    documents, and in more places with a few of those, up to PLACES - 2 times the same.
    """
    have = counts > 0
    lengths = np.flatnonzero(have)
    if not len(lengths):
        return np.zeros((0, PLACES), np.int64)
    common = lengths[np.argsort(-counts[lengths], kind="stable")[:partners]]
    few = common[: max(1, partners // 8)]
    # what stands beside two free places: nothing, one partner, two of the few, or the same one several times
    fixed = [(), *[(int(x),) for x in common], *[(int(x), int(y)) for i, x in enumerate(few) for y in few[i + 1 :]]]
    fixed += [(int(x),) * k for x in common for k in range(2, PLACES - 1) if counts[x] >= k]
    out = []
    for f in fixed:
        rest = window - sum(f)
        first = lengths[lengths <= rest // 2] if rest > 0 else lengths[:0]
        # one free place that fills the rest by itself, and two that do
        last = rest - first
        first = first[have[last]]
        rows = np.zeros((len(first) + bool(rest > 0 and have[min(rest, len(have) - 1)] and rest < window), PLACES), np.int64)
        rows[: len(first), 0], rows[: len(first), 1] = first, rest - first
        rows[len(first) :, 0] = rest
        rows[:, 2 : 2 + len(f)] = f
        out.append(rows)
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0)


def repeats(combos: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Whole repeat counts x >= 0 with A x near counts and never above: accelerated projected gradient, then rounding.

    A length's residual weighs as its tokens: the squares of length * (A x - counts) are minimised.
    """
    if not len(combos):
        return np.zeros(0, np.int64)
    target = counts.astype(float)
    target[0] = 0
    flat, width = combos.ravel(), combos.shape[1]
    # by the weight of its length each place counts; empty places weigh nothing
    weight = (np.arange(len(counts)) / len(counts)) ** 2

    def ax(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, weights=np.repeat(x, width), minlength=len(counts))
        out[0] = 0
        return out

    uses = ax(np.ones(len(combos))) * weight
    x = y = np.zeros(len(combos))
    t = 1.0
    # a diagonal step: for each combination, what moving all that share its lengths would do
    step = 1 / np.maximum(uses[flat].reshape(-1, width).sum(1) * width / 4, 1e-9)
    for _ in range(rounds):
        grad = ((ax(y) - target) * weight)[flat].reshape(-1, width).sum(1)
        z = np.maximum(0, y - step * grad)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = z + (last - 1) / t * (z - x), z
    left, out = counts.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    left[0] = np.iinfo(np.int64).max
    order = np.argsort(-x, kind="stable")
    for limit in (np.floor(x).astype(np.int64), None):  # rounded, then greedily what still fits
        able = (limit[order] > 0) if limit is not None else (left[combos[order]] > 0).all(1)
        for i in order[able]:
            lengths, uses_of = np.unique(combos[i][combos[i] > 0], return_counts=True)
            n = int((left[lengths] // uses_of).min())
            n = n if limit is None else min(n, int(limit[i]))
            out[i] += n
            left[lengths] -= n * uses_of
    return out


def solve(counts: np.ndarray, window: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often each is used: least squares over the histogram, then over what rounding left of it."""
    left, combos, times = counts.astype(np.int64).copy(), [np.zeros((0, PLACES), np.int64)], [np.zeros(0, np.int64)]
    for _ in range(passes):
        c = combinations(left, window)
        n = repeats(c, left)
        if not n.any():
            break
        combos.append(c[n > 0])
        times.append(n[n > 0])
        used = np.bincount(combos[-1].ravel(), weights=np.repeat(times[-1], PLACES), minlength=len(left)).astype(np.int64)
        used[0] = 0
        left -= used
    return np.concatenate(combos), np.concatenate(times)


def slots(combos: np.ndarray, times: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank of each stretch of slots, its first sequence, its offset); the last stretch's end closes it."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    cursor: dict[int, int] = {}
    sequence = 0
    for c, n in zip(combos.tolist(), times.tolist(), strict=True):
        if n:
            offset = 0
            for length in c:
                if length:
                    at = cursor.get(length, 0)
                    found.setdefault(length, []).append((at, sequence, offset))
                    cursor[length] = at + n
                    offset += length
            sequence += n
    return {k: (np.array([x[0] for x in v] + [cursor[k]]), np.array([x[1] for x in v]), np.array([x[2] for x in v])) for k, v in found.items()}


def cut(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", store: int = KEPT) -> DataFrame:
    """PARTS: each document's full windows (their checksums) and remainder, numbered within the task that made them."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, store)
        task, nth, seen = TaskContext.get().partitionId(), 0, np.zeros(window, np.int64)
        for pdf in frames:
            texts, keys = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for a, b in batches(texts):
                rows = []
                for key, raw in zip(keys[a:b], enc.ids(texts[a:b]), strict=True):
                    ids = np.append(np.frombuffer(raw, enc.dtype), enc.dtype.type(end_id))
                    full, rest = divmod(len(ids), window)
                    tail = ids[full * window :]
                    rows.append((task, nth, key, len(ids), [_crc(ids[i * window : (i + 1) * window]) for i in range(full)], rest, _crc(tail), seen[rest], tail.astype("<u4" if enc.dtype.itemsize == 4 else "<u2").tobytes()))
                    seen[rest] += 1
                    nth += full
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARTS.split(", ")]).astype({"doc_id": "Int64"})

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(make, PARTS)


def pack(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """PIECES from the written parts; every id lies in exactly one piece."""
    spark = parts.sparkSession
    counted = parts.where("rest > 0").groupBy("task", "rest").agg(F.count("*").alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for r in counted.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # a row per length: window - 1 at most
        counts[r["rest"]] = r["n"]
    plan = slots(*solve(counts, window))
    give_back()

    upto = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(F.col("task").alias("t"), F.col("rest").alias("r"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    narrow = parts.where("rest > 0").select("task", "rest_nth", "doc_id", "doc_tokens", "rest", "rest_crc32")
    ranked = narrow.join(base, (F.col("task") == F.col("t")) & (F.col("rest") == F.col("r"))).select("task", "rest_nth", "doc_id", "doc_tokens", "rest", "rest_crc32", (F.col("rest_nth") + F.col("base")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("place")  # lets the encoder's store go
        give_back()
        for pdf in frames:
            sequence, offset = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64)
            for length, index in pdf.groupby("rest").indices.items():
                if length in plan:
                    first, seq, off = plan[length]
                    rank = pdf["rank"].to_numpy()[index]
                    index = index[rank < first[-1]]
                    rank = rank[rank < first[-1]]
                    at = np.searchsorted(first, rank, side="right") - 1
                    sequence[index] = COMBINED + seq[at] + rank - first[at]
                    offset[index] = off[at]
            yield pdf.assign(sequence_id=sequence, offset=offset)

    placed = written(ranked.mapInPandas(place, ranked.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long"))
    full = parts.where(F.size("windows") > 0).select("task", "nth", "doc_id", "doc_tokens", F.posexplode("windows").alias("i", "crc"))
    full = full.select("doc_id", (F.col("i") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.shiftleft(F.col("task").cast("long"), 40) + F.col("nth") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    whole = placed.where("sequence_id >= 0").select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

    # residuals: their tokens before, by task and then within the task's lengths and numbers
    spare = placed.where("sequence_id < 0").select("task", "rest", "rest_nth")
    groups = spare.groupBy("task", "rest").agg(F.sum("rest").alias("n"), F.count("*").alias("rows"), F.min("rest_nth").alias("first"))
    tasks = groups.groupBy("task").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    by_task = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("task_base"), F.sum("rows").over(Window.partitionBy()).alias("all_rows"))
    in_task = Window.partitionBy("task").orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("base", F.coalesce(F.sum("n").over(in_task), F.lit(0))).join(tasks, "task").withColumn("base", F.col("base") + F.col("task_base"))
    # of one length and task the residuals are the last: numbers from first on without a gap
    groups = written(groups.select("task", "rest", "first", "base", "all_rows"))
    one = groups.agg(F.max("all_rows").alias("n"), F.count("*").alias("g")).first()
    keys = F.broadcast(groups) if one["g"] <= BROADCAST_ROWS else groups
    loose = parts.where("rest > 0").join(keys, ["task", "rest"]).where(F.col("rest_nth") >= F.col("first"))
    loose = loose.select("doc_id", "doc_tokens", "rest", "rest_ids", (F.col("base") + (F.col("rest_nth") - F.col("first")) * F.col("rest")).alias("at"))

    def slice_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.rest_ids, f"<u{len(r.rest_ids) // r.rest}")
                at = 0
                while at < r.rest:
                    sequence, offset = divmod(r.at + at, window)
                    n = min(window - offset, r.rest - at)
                    rows.append((r.doc_id, r.doc_tokens - r.rest + at, n, _crc(ids[at : at + n]), r.doc_tokens, RESIDUAL + sequence, offset))
                    at += n
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return full.unionByName(whole).unionByName(loose.mapInPandas(slice_up, PIECES))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", store: int = KEPT) -> DataFrame:
    """Cuts and packs every document; the ids of the remainders stay in the shared folder until the job's folder goes.
    store: bytes of a worker's store of encoded words."""
    return pack(written(cut(docs, tokenizer, end_id, window, id_col, text_col, store)), window)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
