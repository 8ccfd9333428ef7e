"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``:

1. language ID: texts without a letter, or that no learned language fits, go; lang becomes the prediction.
2. near-dedup: texts whose five-word shingle sets resemble each other by 0.8 or more are linked, every such pair; of each
   group the row with the least id stays. Candidates come from SimHash tries and shared least shingles.
3. secret scans: secrets in the texts are replaced by a mark, n_chars follows.
4. mixing: rows are repeated or left out by the low-discrepancy schedule for weights 1, 2, 3, ... of the sources.
5. packing: pieces of at most 2048 tokens, packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmine.llm import langid, mixing, packing, secrets, simhash
from sparkmine.llm.common import written

#: Bytes of a worker's store of encoded words: the executors' heaps are full by the last stage.
STORE = 40 << 20
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go; with nothing labelled everything goes. Repeated rows and extra columns stay, an
    empty table gives an empty one. A null id isn't learned from but is judged like any other."""
    texts, langs = langid.labelled_sample(docs)
    return langid.keep_known(docs, langid.fit(texts, langs), langid.least_score(texts, langs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are one group, repeated rows another each; of ties in the id one row stays, and a null id is the
    greatest. Extra columns stay, whatever their names; an empty table gives an empty one."""
    return simhash.one_of_each_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; a null text stays null with a null n_chars. Long texts are scanned whole; extra columns stay."""
    return secrets.redact(docs, secrets.shipped(spark)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is a source of its own; null and empty texts have no words and go. Rows equal in id, text and source are
    repeated equally often. Extra columns stay; an empty table gives an empty one."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are their end id; repeated rows and null ids are documents of their own. Extra columns are ignored;
    an empty table gives no pieces."""
    return packing.pack_documents(docs, TOKENIZER, store=STORE)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]
#: Models, fingerprints and token ids: SQL can't express the rows of run(); tests/llm/test_pipeline.py holds each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
