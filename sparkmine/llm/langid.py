"""Language identification by string kernels.

Two texts are alike by the n-grams (1 to 4 characters) that both hold: the blended-spectrum presence kernel counts
them and divides by the root of both texts' numbers. The kernel is approximated by Nyström landmarks, and kernel ridge
regression is solved one language against the rest. As the presence kernel is linear in the presences, landmarks and
regression fold into one matrix of n-grams by languages, and whole texts are scored by batched matrix products.

The model is fitted on a bounded sample of labelled rows (TRAIN_DOCS in all, shared out over the languages, texts of up
to TRAIN_CHARS), taken by a hash of their ids. Everything is scored, by its whole text.

Nulls, empty texts and texts without a letter give ``und`` with score 0; so does everything if nothing is labelled. A
null id isn't learned from and counts as held out. Repeated rows keep their rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmine.llm.common import bounded, give_back, worker_cache

#: Every code point: chr(0x10FFFF) is the last.
POINTS = 0x110000
TRAIN_DOCS, PER_LANGUAGE, TRAIN_CHARS, LANDMARKS = 2400, 600, 20_000, 240
ORDERS, HASH_BITS, RIDGE = (1, 2, 3, 4), 18, 1e-3
UNKNOWN = "und"
#: Scores of labelled rows that a fit over the other FOLDS - 1 parts of the sample hasn't seen set the least score: all but
#: this share of the rows it gets right are above it. 0.5, where a language is as likely as not against the rest, is the most.
FOLDS, LOST = 3, 0.01


def _letters() -> np.ndarray:
    cache = worker_cache("langid")
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(c).isalpha() for c in range(POINTS)), bool, POINTS)
    return cache["letters"]


def presences(text: str | None, buffer: np.ndarray) -> np.ndarray | None:
    """Hashed n-grams that a text holds, ascending; None without a letter. Anything but letters counts as one blank."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = _letters()[points.astype(np.int64)]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint64(32))
    points = points[letter | np.concatenate([[True], letter[:-1]])]  # runs of blanks become one
    code = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(points) - n + 1] * np.uint64(0x100000001B3)) ^ points[n - 1 :]
        if n in ORDERS:
            buffer[(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - HASH_BITS)] = True
        if len(points) <= n:
            break
    found = np.flatnonzero(buffer).astype(np.int32)
    buffer[found] = False
    return found


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """The folded model: languages, n-gram -> row (or -1: the last, of zeros), and the matrix of rows by languages."""
    buffer = np.zeros(1 << HASH_BITS, bool)
    pairs = [(p, lang) for t, lang in zip(texts, langs, strict=True) if (p := presences(t, buffer)) is not None]
    names = sorted({lang for _, lang in pairs})
    if not names:
        return {"names": []}
    marks = [p for p, _ in pairs[:landmarks]]
    vocabulary = np.unique(np.concatenate(marks))
    row = np.full(1 << HASH_BITS, -1, np.int32)
    row[vocabulary] = np.arange(len(vocabulary))

    def dense(found: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(found), len(vocabulary)), np.float32)
        for i, p in enumerate(found):
            at = row[p]
            out[i, at[at >= 0]] = 1 / np.sqrt(len(p))
        return out

    base = dense(marks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(float))
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2), as far as it has full rank
    feats = np.concatenate([dense([p for p, _ in pairs[i : i + 32]]) @ base.T for i in range(0, len(pairs), 32)]).astype(float) @ root
    truth = np.where(np.array([[lang == x for x in names] for _, lang in pairs]), 1.0, -1.0)
    share = np.array([[lang == x for x in names] for _, lang in pairs]).mean(0)
    weight = 1 / share[[names.index(lang) for _, lang in pairs]]  # languages count alike
    bias = np.ones((len(feats), 1))
    z = np.concatenate([feats, bias], 1)
    solved = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * len(z) * np.eye(z.shape[1]), z.T @ (truth * weight[:, None]))
    matrix = (base.T @ (root @ solved[:-1])).astype(np.float32)
    del base, feats, z, pairs, marks
    give_back()
    return {"names": names, "row": row, "matrix": np.concatenate([matrix, np.zeros((1, len(names)), np.float32)]), "bias": solved[-1]}


def predict(texts: list[str | None], model: dict, buffer: np.ndarray, batch: int = 1 << 18) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. A batch's presences, batch of them or one text's, are a sparse matrix of equal
    values per row; its product with the model sums the model's rows of each text."""
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model["names"]:
        return names, score
    row, matrix = model["row"], model["matrix"]
    waiting: list[tuple[int, np.ndarray, float]] = []
    size = 0

    def product() -> None:
        at = np.concatenate([x for _, x, _ in waiting])
        starts = np.cumsum([0, *[len(x) for _, x, _ in waiting[:-1]]])
        f = np.add.reduceat(matrix[at], starts, axis=0) / np.array([[n] for _, _, n in waiting], np.float32) + model["bias"]
        for (i, _, _), best, values in zip(waiting, f.argmax(1).tolist(), f, strict=True):
            names[i], score[i] = model["names"][best], min(1.0, max(0.0, (1 + values[best]) / 2))

    for i, t in enumerate(texts):
        p = presences(t, buffer)
        if p is None:
            continue
        # the last row of the matrix is zero: what no landmark holds, and texts without any known n-gram
        waiting.append((i, row[p], np.sqrt(len(p))))
        size += len(p)
        if size >= batch:
            product()
            waiting, size = [], 0
    if waiting:
        product()
    return names, score


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """Up to TRAIN_DOCS (text, lang) for fitting, languages in turn, each in order of a hash of its ids."""
    docs = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(~held_out("i") & F.col("l").isNotNull() & (F.length("t") <= TRAIN_CHARS))
    # by a hash threshold per language first, so that a common language's rows don't gather to be ranked
    share = docs.groupBy("l").agg(F.least(F.lit(1.0), F.lit(2.0 * PER_LANGUAGE) / F.count("*")).alias("share")).withColumnRenamed("l", "k")
    some = docs.select("i", "l").join(F.broadcast(share) if share.count() <= 10_000 else share, F.col("l") == F.col("k")).where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    turn = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    narrow = some.select("i", "l", F.row_number().over(turn).alias("turn")).where(F.col("turn") <= PER_LANGUAGE)
    picked = narrow.orderBy("turn", "l", "i").limit(TRAIN_DOCS).select(F.col("i").alias("p"), "turn", F.col("l").alias("q"))
    rows = docs.join(F.broadcast(picked), (F.col("i") == F.col("p")) & (F.col("l") == F.col("q"))).select("t", "l", "turn", "i").orderBy("turn", "l", "i", "t").limit(TRAIN_DOCS).collect()
    return [r["t"] for r in rows], [r["l"] for r in rows]


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score for each row, beside its columns in keep (the id alone by default)."""
    keep = keep or [id_col]
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer = np.zeros(1 << HASH_BITS, bool)
        for pdf in frames:
            names, s = predict(pdf["_text"].tolist(), carried.value, buffer)
            yield pdf.drop(columns="_text").assign(lang_pred=names, score=s)

    rows = bounded(docs).select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    return rows.mapInPandas(score, f"{schema}, lang_pred string, score double")


def least_score(texts: list[str], langs: list[str]) -> float:
    """The score below which no learned language fits a text, from labelled rows."""
    buffer, scores = np.zeros(1 << HASH_BITS, bool), []
    for k in range(FOLDS):
        seen = [i for i in range(len(texts)) if i % FOLDS != k]
        rest = [i for i in range(len(texts)) if i % FOLDS == k]
        found, score = predict([texts[i] for i in rest], fit([texts[i] for i in seen], [langs[i] for i in seen]), buffer)
        scores += [s for i, name, s in zip(rest, found, score, strict=True) if name == langs[i]]
        give_back()
    return min(0.5, float(np.quantile(scores, LOST))) if scores else 0.0


def keep_known(docs: DataFrame, model: dict, least: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs whose language is recognised, with lang as predicted; texts without a letter, or that no language fits, go."""
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer = np.zeros(1 << HASH_BITS, bool)
        for pdf in frames:
            names, score = predict(pdf[text_col].tolist(), carried.value, buffer)
            pdf = pdf.assign(**{lang_col: names})
            yield pdf[(pdf[lang_col] != UNKNOWN) & (score >= least)]

    return bounded(docs).mapInPandas(keep, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*labelled_sample(docs))
    return identify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
