"""What the operators share: tables, the shared folder, per-worker caches, range shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmine import lineage

#: One word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch of texts, at most; Spark's own limits, 10,000 rows and 64 MB, leave that to the texts.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only under a local master (tests) where that is unset."""
    return lineage.new_folder(spark)


def written(df: DataFrame, folder: str | None = None, codec: str = "snappy") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing. The driver's
    JVM returns what it has freed meanwhile."""
    table = lineage.cut(df, folder, codec)
    trim(df.sparkSession)
    return table


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker, across the tasks of one owner; another owner's is let go first."""
    import pyspark

    held = pyspark.__dict__.setdefault("_sparkmine_worker_cache", {})
    if held.get("owner") != owner:
        held.clear()
        held["owner"] = owner
    return held


def bounded(docs: DataFrame) -> DataFrame:
    """docs; the session's Arrow batches are held to BATCH_BYTES from now on, so that workers' memory doesn't depend on how long
    texts are. A lower limit of the session's own stays."""
    spark = docs.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def trim(spark: SparkSession) -> None:
    """Has the driver's JVM return the native memory that it has freed to the system, some hundredths of a second. The C library
    keeps such memory, in an arena for each few threads: hundreds of MB after a hundred queries, that neither Java's heap nor its
    limit shows. Nothing happens where the JVM can't (without glibc, or Java before 17.0.9)."""
    from py4j.protocol import Py4JJavaError

    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *values):
        out = new(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    # by the interface's method: the server's own class isn't open to callers
    java, kind = jvm.java.lang, jvm.java.lang.Class.forName
    types = [kind(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    try:
        invoke = kind("javax.management.MBeanServer").getMethod("invoke", array(java.Class, *types))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), array(java.Object, commands, "systemTrimNativeHeap", None, None))
    except Py4JJavaError:
        pass


def give_back() -> None:
    """Returns what this process and the driver's JVM have freed to the system, where their C library can, and has the JVM collect
    its garbage: only then does Spark delete the shuffles and broadcasts that nothing refers to."""
    import ctypes
    import gc

    gc.collect()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
        trim(spark)
    freed = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if freed:
        freed(0)


#: Bytes that a shuffle partition holds about, and partitions at most.
PARTITION_BYTES, MOST_PARTITIONS = 128 << 20, 100_000


def partitions(df: DataFrame, scale: int = 1) -> int:
    """The session's number of shuffle partitions, or more where the tables that df reads, times scale, are larger than
    PARTITION_BYTES for each of them. Tables of unknown size don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = scale * sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PARTITION_BYTES), MOST_PARTITIONS))


def range_bounds(df: DataFrame, column: str, shards: int) -> list[int]:
    """Values of a long column that split its rows into about equal ranges; at most shards - 1 of them, ascending.

    Only that column is read, and only the bounds come to the driver.
    """
    found = df.agg(F.percentile_approx(column, [i / shards for i in range(1, shards)], 20 * shards).alias("b")).first()["b"] if shards > 1 else None
    return sorted(set(found or []))


def range_shard(column: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at or below the column: a binary search that stays in the JVM. Null is in shard 0."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    values = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    found = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(values, at + step) <= column), at + step).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))
