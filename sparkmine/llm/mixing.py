"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The mix has as many words as all documents together. It is cut into equal slots; slot t belongs to the source in whose
stretch of the cumulative weights the golden-ratio point frac(t * phi) falls, so that any run of slots holds the sources
close to their shares. The slots of a source are ranked and joined, round after round, to the source's blocks: equal
cuts of its documents, shuffled by a hash of their ids. A document's share of the mix is its overlap with the blocks
taken, repeats counted. A source of fewer than FINE blocks is scheduled by single words instead, so that it meets its
target too, however large the corpus is; the slots that fall into its stretch stay empty. So at most SLOTS / FINE
sources have slots.

Nulls: a null text has size 0, a null source is a source of its own, ordered last, and a null id is hashed as such.
Empty texts take no part but keep their row. Repeated rows are documents of their own. An empty table gives an empty
result. Extra columns are ignored. A source whose share is over cap times its size stops there, and the excess goes to
the others by weight. The same table gives the same result however it is dealt.

Nothing is keyed by source alone but tables of one row per source or slot: a source's documents are ranked in buckets of
their hash, whose totals are added up first. There are more buckets in larger tables, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmine.llm.common import WORD, written

#: Slots of the whole schedule: the mix misses a target by a few of them at most, and a block has 1/SLOTS of all words.
SLOTS = 1 << 17
#: A source of fewer blocks is scheduled by single words: slots of that size would miss its target by percents.
FINE = 1_000
#: Weights of the sources by code point, null last, repeating; no source is taken more than CAP times its size.
WEIGHTS, CAP = (1, 2, 3), 3
GOLDEN = 0.6180339887498949
#: Rows that all sources' buckets of one number have about, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 1_000_000, 256
#: Shares of rows are broadcast up to so many.
BROADCAST_ROWS = 1_000_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, rank, target from the documents' (source, size); one row per source.

    Filling by weight under caps: in ascending order of cap / weight, a source stops at its cap if the rest, shared by
    weight from it on, would give it more. The order is by one number per source, so one task has only as many rows as
    there are sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    below, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sources.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        .withColumn("level", F.greatest(F.col("rest"), F.lit(0.0)) / F.sum("weight").over(onward))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
        # the level at the first source that isn't capped holds for all from there on
        .withColumn("level", F.coalesce(F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.col("level")))
        .select("source", "source_size", "rank", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"), "total")
    )


def _small(words) -> Column:
    """Whether a source has fewer than FINE blocks of so many words."""
    return F.col("source_size") < FINE * words


def schedule(sources: DataFrame, slots: int = SLOTS, cap: int = CAP) -> DataFrame:
    """rank (of the source), block, times: how often the schedule takes each block of the sources that aren't small; at
    most slots rows."""
    upto = Window.orderBy("rank")
    last = F.col("rank") == F.max("rank").over(Window.partitionBy())
    stretch = (
        sources.where("target > 0")
        .withColumn("high", F.sum("target").over(upto) / F.col("total"))
        .withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
        .withColumn("high", F.when(last, 2.0).otherwise(F.col("high")))
        .withColumn("block_words", F.greatest(F.lit(1), F.ceil(F.col("total") / slots)))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")))
        .withColumn("slots", F.ceil(F.col("total") / F.col("block_words")))
        .where(~_small(F.col("block_words")))
    )
    # the list of stretches, SLOTS / FINE at most, is one row of an array
    ends = stretch.agg(F.array_sort(F.collect_list(F.struct("high", "low", "rank", "blocks"))).alias("ends"), F.max("slots").alias("slots"))
    points = ends.select("ends", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("slots"), F.lit(1)) - 1)).alias("slot")).withColumn("u", (F.col("slot") * F.lit(GOLDEN)) % 1)
    owner = F.get(F.filter("ends", lambda e: (e["low"] <= F.col("u")) & (e["high"] > F.col("u"))), F.lit(0))
    drawn = points.select("slot", owner.alias("e")).where("e is not null").select("slot", "e.rank", "e.blocks")
    per_source = Window.partitionBy("rank").orderBy("slot")
    return drawn.withColumn("n", F.row_number().over(per_source) - 1).where(F.col("n") < cap * F.col("blocks")).groupBy("rank", (F.col("n") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, slots: int = SLOTS) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken: one row per document."""
    spark = docs.sparkSession
    narrow = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("shuffled"),
        )
    )
    sources = written(targets(narrow, weights, cap).coalesce(1))
    block_words = F.greatest(F.lit(1), F.ceil(F.col("total") / slots))
    buckets = max(BUCKETS, narrow.count() // BUCKET_ROWS)
    # leading digits of the hash, so that buckets follow each other in the order of the hash
    bucket = F.floor(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int")
    rows = narrow.withColumn("bucket", bucket)
    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("at", F.col("at") + F.col("base"))
        .drop("s", "b", "base", "bucket", "shuffled")
    )
    # one row per source: a catalogue, small against the data, checked before it is broadcast
    known = sources.withColumnRenamed("source", "s")
    known = F.broadcast(known) if sources.count() <= 100_000 else known
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("words", block_words)
    small = _small(F.col("words"))
    cut = placed.where("size > 0").where(~small).select(
        "row", "rank", "at", "size", "words", F.explode(F.sequence(F.floor(F.col("at") / F.col("words")), F.floor((F.col("at") + F.col("size") - 1) / F.col("words")))).alias("block")
    )
    overlap = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest(F.col("at"), F.col("block") * F.col("words"))
    taken = cut.join(schedule(sources, slots, cap), ["rank", "block"]).groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken"))
    # a small source by words: whole rounds take each word and the last round those in front
    draws = F.round("target").cast("long")
    last_round = F.least(F.greatest(draws % F.col("source_size") - F.col("at"), F.lit(0)), F.col("size"))
    by_word = F.when(F.col("size") > 0, F.floor(draws / F.col("source_size")) * F.col("size") + last_round)
    return placed.join(taken, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce(F.when(small, by_word).otherwise(F.col("taken")), F.lit(0)).cast("long").alias("taken")
    )


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, slots: int = SLOTS) -> DataFrame:
    """docs as the mix takes them: each row as often as its share rounds to, rows that it doesn't take left out.

    Rows that are equal in all of id, text and source are given their average share.
    """
    keyed = docs.withColumn("_mix_key", F.xxhash64(F.col(id_col).cast("string"), text_col, source_col))
    taken = mix(keyed, "_mix_key", text_col, source_col, weights, cap, slots).where("size > 0").groupBy("doc_id").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("_mix_times"))
    shares = written(taken.where("_mix_times > 0").withColumnRenamed("doc_id", "_mix_k"))
    # a key and a number per row; few are broadcast, many are joined by shuffle
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares
    return keyed.join(shares, F.col("_mix_key") == F.col("_mix_k")).withColumn("_mix_i", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).drop("_mix_key", "_mix_k", "_mix_times", "_mix_i")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


#: DuckDB's twin of op6_mixing().
OP6_SQL = rf"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source asc nulls last) - 1 as rank, cast(sum(source_size) over () as bigint) as total from s),
w as (select *, [{", ".join(f"{float(x)}e0" for x in WEIGHTS)}][rank % {len(WEIGHTS)} + 1] as weight, source_size * {float(CAP)}e0 as cap from r),
f as (select *, greatest(total - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0), 0) / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from w),
g as (select *, cap <= level * weight as capped from f),
t as (select *, coalesce(first_value(case when not capped then level end ignore nulls) over (order by cap / weight, rank rows between unbounded preceding and unbounded following), level) as final from g),
src as (select source, source_size, rank, total, case when capped then cap else final * weight end as target, greatest(1, cast(ceil(total / {float(SLOTS)}e0) as bigint)) as words from t),
high as (select *, sum(target) over (order by rank) / total as high, cast(ceil(source_size / cast(words as double)) as bigint) as blocks from src where target > 0),
stretch as (select *, coalesce(lag(high) over (order by rank), 0) as low, max(rank) over () as last from high),
points as (select slot, (slot * {GOLDEN}e0) % 1 as u from (select unnest(range(cast(greatest(max(ceil(total / cast(words as double))), 1) as bigint))) as slot from high)),
drawn as (select slot, rank, blocks, row_number() over (partition by rank order by slot) - 1 as n from points join stretch on u >= low and (u < high or rank = last)),
times as (select rank, n % blocks as block, count(*) as times from drawn where n < {CAP} * blocks group by 1, 2),
placed as (select d.doc_id, d.source, d.size, source_size, target, rank, words, cast(coalesce(sum(d.size) over (partition by d.source order by h, doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as bigint) as pos from d join src on d.source is not distinct from src.source),
cut as (select doc_id, rank, pos, size, words, unnest(range(pos // words, (pos + size - 1) // words + 1)) as block from placed where size > 0),
taken as (select doc_id, sum((least(pos + size, (block + 1) * words) - greatest(pos, block * words)) * times) as taken from cut join times using (rank, block) group by doc_id),
word as (select *, source_size < {FINE} * words as small, cast(round(target) as bigint) as draws from placed)
select word.doc_id, source, size, source_size, target,
cast(coalesce(case when size = 0 then 0 when small then draws // source_size * size + least(greatest(draws % source_size - pos, 0), size) else taken end, 0) as bigint) as taken from word left join taken using (doc_id)
"""
