"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least 64-bit hashes of a text's shingles of five words (a shorter text's whole sequence of words;
none without words), ascending, as 16 hex digits each. Sketches of parts merge to the sketch of the whole; two give
estimates of resemblance and containment, one of the number of distinct shingles. All are exact below k shingles.

Nulls and empty texts have the empty sketch; two empty ones resemble fully, one empty not at all. Repeated rows keep
their rows, and rows of one id follow in order of their texts; a null id comes first. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmine.llm.common import bounded, partitions, range_bounds, range_shard

K, SHINGLE, SEED = 64, 5, 42


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketch(text: str | None, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    """The k least distinct shingle hashes, ascending. Words are parted by ASCII white space; A-Z count as a-z."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    w = np.array([h(x, SEED) for x in words], dtype=np.uint64)
    n = min(shingle, len(words))
    code = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        code = _mix(code ^ w[j : len(words) - n + 1 + j]) + np.uint64(j + 1)
    if len(code) > 8 * k:  # enough for k distinct ones, unless many repeat
        least = np.unique(np.partition(code, 4 * k)[: 4 * k])
        if len(least) >= k:
            return least[:k]
    return np.unique(code)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) + 1) * 2.0**64


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_hex(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_hex(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """doc_id, text, shard, guest; every shard holds a range of ids and, as guest, the first document after it.

    After the last comes the first. Bounds are values that occur, so a shard's first id is its bound; only ids are read
    to find them, and texts are shuffled once.
    """
    docs = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = docs.agg(F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    least = None if first["nulls"] else first["least"]
    bounds = [b for b in range_bounds(docs, "doc_id", partitions(docs)) if least is None or b > least]
    n = len(bounds) + 1
    starts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else None
    shard = range_shard(F.col("doc_id"), bounds)
    opens = F.when(F.col("shard") > 0, F.try_element_at(starts, F.col("shard")) == F.col("doc_id")).otherwise(F.col("doc_id").eqNullSafe(F.lit(least).cast("long"))) if bounds else F.col("doc_id").eqNullSafe(F.lit(least).cast("long"))
    home = F.struct(F.col("shard").alias("to"), F.lit(False).alias("guest"))
    guest = F.struct(F.when(F.col("shard") > 0, F.col("shard") - 1).otherwise(n - 1).cast("int").alias("to"), F.lit(True).alias("guest"))
    dealt = docs.withColumn("shard", shard.cast("int")).select("doc_id", "text", F.explode(F.when(F.coalesce(opens, F.lit(False)), F.array(home, guest)).otherwise(F.array(home))).alias("x"))
    return dealt.select("doc_id", "text", F.col("x.to").alias("shard"), F.col("x.guest").alias("guest")), n


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, next_containment double"


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's sketch beside that of its edited text: the second half replaced by the next document's start."""
    dealt, n = with_next(docs, id_col, text_col)

    def row(key, text: str, sk: np.ndarray, after: str, after_sk: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        esk = sk if edited == text else sketch(edited)
        return (key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(sk), to_hex(esk), resemblance(sk, esk), resemblance(sk, after_sk), distinct(sk), containment(sk, after_sk))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, done = None, False  # the document whose next one is yet to come
        at, rows = None, []
        for pdf in frames:
            rows = []
            for key, text, shard, guest in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["shard"].tolist(), pdf["guest"].tolist(), strict=True):
                text = text or ""
                if shard != at:
                    at, last, done = shard, None, False
                if done:
                    continue
                sk = sketch(text)
                if last is not None:
                    rows.append(row(*last, text, sk))
                last, done = (key, text, sk), guest
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"doc_id": "Int64"})

    return dealt.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "guest", "doc_id", "text").mapInPandas(make, OUT)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
