"""Fixtures from the driver tables, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- baskets: the brands of an order ---------------------------------------------------------------------------------

BASKETS_SQL = "basket as (select distinct l_orderkey as txn_id, p_brand as item from lineitem join part on l_partkey = p_partkey)"


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn_id, item: distinct rows."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn_id"), "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("txn_id", "item").distinct()


# ---- graph database: an order's lines as a ring ----------------------------------------------------------------------

GRAPHS_SQL = """
numbered as (select l_orderkey as gid, l_returnflag, l_linestatus, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as nid, count(*) over (partition by l_orderkey) as n from lineitem),
node as (select gid, nid, l_returnflag as label from numbered),
edge as (select gid, least(nid, case when nid = n - 1 then 0 else nid + 1 end) as u, greatest(nid, case when nid = n - 1 then 0 else nid + 1 end) as v, l_linestatus as label from numbered where nid < n - 1 or n >= 3),
adj as (select a.gid, a.x as u, p.label as lu, a.label as el, a.y as v, q.label as lv from (select gid, u as x, v as y, label from edge union all select gid, v, u, label from edge) a join node p on p.gid = a.gid and p.nid = a.x join node q on q.gid = a.gid and q.nid = a.y)
"""


def graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (gid, nid, label) and edges (gid, u, v, label) with u <= v."""
    per = Window.partitionBy("l_orderkey")
    order = per.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gid"), "l_returnflag", "l_linestatus", (F.row_number().over(order) - 1).cast("long").alias("nid"), F.count("*").over(per).alias("n"))
    after = F.when(F.col("nid") == F.col("n") - 1, 0).otherwise(F.col("nid") + 1)
    nodes = rows.select("gid", "nid", F.col("l_returnflag").alias("label"))
    edges = rows.where((F.col("nid") < F.col("n") - 1) | (F.col("n") >= 3)).select("gid", F.least("nid", after).alias("u"), F.greatest("nid", after).alias("v"), F.col("l_linestatus").alias("label"))
    return nodes, edges


# ---- probabilistic digraph: suppliers and parts of returned lines -----------------------------------------------------

PROBABILITY, SAMPLES, MAX_SEED = 0.2, 8, 5
DIGRAPH_SQL = """
pair as (select distinct l_suppkey as s, l_partkey + 1000000 as p from lineitem where l_returnflag = 'R' and l_linestatus = 'F'),
digraph as (select s as u, p as v from pair union all select p, s from pair),
seed as (select distinct u as node from digraph where u <= 5)
"""


def digraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, p: distinct edges in both directions."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'")
    pairs = lines.select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000).alias("v")).distinct()
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("p", F.lit(PROBABILITY))


def seeds(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") <= MAX_SEED).select(F.col("u").alias("node")).distinct()


# ---- vectors and the attributed graph over them -----------------------------------------------------------------------

VECTORS_SQL = "vec as (select vec_id as id, cast(embedding as double[]) as x, label as y from embeddings)"
ATTRIBUTED_SQL = (
    VECTORS_SQL
    + """,
total as (select count(*) as n from vec),
link as (select id as src, (id * 7 + k * 13) % n as dst, k from vec, total, (select unnest([1, 2, 3]) as k) t),
split as (select id, case when id % 10 < 6 then 'train' when id % 10 < 8 then 'val' else 'test' end as split from vec)
"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x array<double>, y."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))


def links(nodes: DataFrame) -> DataFrame:
    """src, dst, k: three out-edges per node."""
    n = nodes.count()
    return nodes.select(F.col("id").alias("src"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")).select("src", ((F.col("src") * 7 + F.col("k") * 13) % n).alias("dst"), "k")


def split(id_="id"):
    m = F.col(id_) % 10 if isinstance(id_, str) else id_ % 10
    return F.when(m < 6, "train").when(m < 8, "val").otherwise("test")


LINKS_SQL = (
    VECTORS_SQL
    + """,
total as (select count(*) as n from vec),
pos as (select id as pid, id as u, (7 * id + 13) % n as v from vec, total),
neg as (select id as pid, j as k, id as u, (id + 1 + 37 * j) % n as v from vec, total, (select unnest(range(500)) as j) t)
"""
)


def link_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pos (pid, u, v), one of every node, and neg (pid, k, u, v), five hundred of each."""
    n = nodes.count()
    some = nodes.select("id")
    pos = some.select(F.col("id").alias("pid"), F.col("id").alias("u"), ((7 * F.col("id") + 13) % n).alias("v"))
    neg = some.select(F.col("id").alias("pid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(499).cast("long"))).alias("k"), F.col("id").alias("u")).select("pid", "k", "u", ((F.col("u") + 1 + 37 * F.col("k")) % n).alias("v"))
    return pos, neg
