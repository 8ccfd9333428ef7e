"""Token-id files: every document its own zstandard frame, one dictionary for all, found by an offset index.

A file set is a folder with two Parquet tables, written by Spark's own committer:

- ``dictionary``: one row (hash, dictionary, dtype), the zstandard dictionary trained on serialized id arrays.
- ``blocks``: rows of documents in ascending id order. The index columns (shard, block, first and last id, doc_ids,
  n_tokens, offsets, start in the shard, dictionary hash) are columns of their own, so index reads don't touch the
  payload, and a document is read by decompressing only its own frame.

Nulls and empty texts hold the end id alone. A null id sorts first; repeated ids stay, as separate documents, in order
of their texts. Extra columns are ignored. An empty table gives an empty file set.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmine.llm.common import bounded, partitions, range_bounds, range_shard, shared_folder
from sparkmine.llm.encode import batches, encoder

#: Training sample: so many documents of least hash, of at most so many characters (only for the dictionary; all are encoded).
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1024, 20_000, 64 << 10
#: A block is closed once it has so many payload bytes or documents.
BLOCK_BYTES, BLOCK_DOCS, LEVEL = 256 << 10, 4096, 1
BLOCKS = "shard int, block int, first_id long, last_id long, dictionary_hash string, shard_start long, tokens long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


def train(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; too few to train on give a raw-content one, none an empty one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-size:]


def _zdict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id, and writes the file set."""
    spark = docs.sparkSession
    docs = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def serialize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in frames:
            yield pd.DataFrame({"ids": [x + np.array([end_id], enc.dtype).tobytes() for x in enc.ids(pdf["text"].tolist())], "dtype": enc.dtype.str})

    # by a hash of the ids, so that texts are read once more only where they are sampled
    least = [r["h"] for r in docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(SAMPLE_DOCS).collect()]
    sample = docs.where((F.xxhash64("doc_id") <= F.lit(least[-1] if least else 0)) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text").limit(2 * SAMPLE_DOCS)
    got = sample.select("text").mapInPandas(serialize, "ids binary, dtype string").collect()
    trained = train(sorted(bytes(r["ids"]) for r in got))
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(digest, bytearray(trained), end_id)], "hash string, dictionary binary, end_id long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        enc, zdict = encoder(tokenizer), _zdict(trained)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict) if zdict else zstandard.ZstdCompressor(level=LEVEL)
        end = np.array([end_id], enc.dtype).tobytes()
        shard, number, start, size, ids, counts, parts = 0, 0, 0, 0, [], [], []

        def close() -> pd.DataFrame:
            nonlocal number, start, size, ids, counts, parts
            known = [x for x in ids if x is not None]
            row = {"shard": shard, "block": number, "first_id": known[0] if known else None, "last_id": known[-1] if known else None, "dictionary_hash": digest, "shard_start": start, "tokens": sum(counts), "doc_ids": ids, "n_tokens": counts, "offsets": np.cumsum([0, *map(len, parts)]).tolist(), "payload": b"".join(parts)}
            number, start, size, ids, counts, parts = number + 1, start + row["tokens"], 0, [], [], []
            return pd.DataFrame([row]).astype({"first_id": "Int64", "last_id": "Int64"})

        for pdf in frames:
            texts, keys, shard_of = pdf["text"].tolist(), pdf["doc_id"].tolist(), pdf["shard"].tolist()
            for a, b in batches(texts):
                for i, raw in zip(range(a, b), enc.ids(texts[a:b]), strict=True):
                    if ids and (shard_of[i] != shard or size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                        yield close()
                    if shard_of[i] != shard:
                        shard, number, start = shard_of[i], 0, 0
                    ids.append(None if pd.isna(keys[i]) else int(keys[i]))
                    counts.append(len(raw) // enc.dtype.itemsize + 1)
                    parts.append(pack.compress(raw + end))
                    size += len(parts[-1])
        if ids:
            yield close()

    n = partitions(docs)
    shard = range_shard(F.col("doc_id"), range_bounds(docs, "doc_id", n))
    dealt = docs.withColumn("shard", shard.cast("int")).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")
    dealt.mapInPandas(blocks, BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")


def map_documents(spark: SparkSession, folder: str, make: Callable[[np.ndarray], dict], schema: str, only: list[int] | None = None) -> DataFrame:
    """One row per document of the file set: doc_id, start, n_tokens and what make() gives for its ids (uint32).

    only: these ids; blocks without them are skipped by their first and last id, and only their frames are decompressed.
    """
    meta = spark.read.parquet(f"{folder}/dictionary").first()
    trained, digest = bytes(meta["dictionary"]), meta["hash"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # one row per shard; the number of shards is fixed when the set is written
    totals = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens")).orderBy("shard").collect()
    before = {r["shard"]: int(x) for r, x in zip(totals, np.cumsum([0, *[r["tokens"] for r in totals]]), strict=False)}
    wanted = None if only is None else frozenset(only)
    if wanted is not None:
        blocks = blocks.where(F.col("last_id") >= min(wanted, default=0)).where(F.col("first_id") <= max(wanted, default=-1))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        zdict = _zdict(trained)
        unpack = zstandard.ZstdDecompressor(dict_data=zdict) if zdict else zstandard.ZstdDecompressor()
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.dictionary_hash != digest:
                    raise ValueError(f"block {r.shard}/{r.block} was written with dictionary {r.dictionary_hash}, not {digest}")
                start, rows = before[r.shard] + r.shard_start, []
                for doc, n, a, b in zip(r.doc_ids, r.n_tokens, r.offsets, r.offsets[1:], strict=False):
                    if wanted is None or doc in wanted:
                        raw = unpack.decompress(r.payload[a:b])
                        width = len(raw) // int(n)
                        rows.append({"doc_id": doc, "start": start, "n_tokens": n} | make(np.frombuffer(raw, f"<u{width}").astype("<u4")))
                    start += n
                if rows:
                    yield pd.DataFrame(rows).astype({"doc_id": "Int64"})

    return blocks.mapInPandas(read, f"doc_id long, start long, n_tokens long, {schema}")


def digest(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.tobytes())}


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark)
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return map_documents(spark, folder, digest, "ids_crc32 long")
