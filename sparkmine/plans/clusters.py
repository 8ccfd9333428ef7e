"""k-means queries over the embeddings, from fixed first centroids."""

from pyspark.sql import functions as F

from sparkmine.operators import clusters
from sparkmine.plans.registry import query
from sparkmine.sources.tables import VECTORS_SQL, vectors

K, ROUNDS = 5, 3
_D2 = "list_sum(list_transform(list_zip(p.x, c.x), z -> (z[1] - z[2]) * (z[1] - z[2])))"


def _assign(n: int) -> str:
    return f"a{n} as (select id, k as cluster, d2 from (select p.id, c.k, list_distance(p.x, c.x) ** 2 as d2, row_number() over (partition by p.id order by list_distance(p.x, c.x), c.k) as r from vec p, c{n} c) where r = 1)"


def _means(n: int) -> str:
    return f"c{n + 1} as (select o.k, coalesce(m.x, o.x) as x from c{n} o left join (select k, list(v order by i) as x from (select a.cluster as k, i, avg(p.x[i]) as v from a{n} a join vec p on p.id = a.id, (select unnest(range(1, 65)) as i) t group by 1, 2) group by 1) m on m.k = o.k)"


def _lloyd(k: int, rounds: int) -> str:
    return ", ".join([VECTORS_SQL, f"c0 as (select row_number() over (order by id) - 1 as k, x from (select * from vec order by id limit {k}))", *[s for n in range(rounds) for s in (_assign(n), _means(n))], _assign(rounds)])


@query("kmeans_assign", f"with {_lloyd(K, 0)} select id, cluster, round(d2, 6) as d2 from a0")
def assign(spark, sf_dir):
    points = vectors(spark, sf_dir)
    return clusters.assign(points, clusters.first_points(points, K)).select("id", "cluster", F.round("d2", 6).alias("d2"))


@query("kmeans_lloyd3", f"with {_lloyd(K, ROUNDS)} select cluster, count(*) as n, round(sum(d2), 4) as sse from a{ROUNDS} group by cluster")
def lloyd(spark, sf_dir):
    points = vectors(spark, sf_dir)
    centroids, _ = clusters.lloyd(points, clusters.first_points(points, K), ROUNDS)
    return clusters.assign(points, centroids).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 4).alias("sse"))


KS, RESTARTS, MOST = range(1, 16), 10, 100


def _series(spark, sf_dir):
    return spark.createDataFrame(clusters.sweep(vectors(spark, sf_dir), KS, RESTARTS, MOST), "k int, sse double")


@query("kmeans_sse_sweep")
def sweep(spark, sf_dir):
    """k = 1 to 15, the best of ten restarts of at most a hundred rounds each."""
    return _series(spark, sf_dir).select("k", F.round("sse", 4).alias("sse"))


@query("kmeans_elbow")
def elbow(spark, sf_dir):
    return clusters.elbow(_series(spark, sf_dir)).select("k", F.round("distance", 4).alias("distance"))


_FIXED = ((1, 10.0), (2, 2.0), (3, 1.0), (4, 0.5), (5, 0.0))


@query("elbow_of_series", f"with s(k, sse) as (values {', '.join(f'({k}, {x}e0)' for k, x in _FIXED)}), e as (select arg_min(k, k) as ak, arg_min(sse, k) as a, arg_max(k, k) as bk, arg_max(sse, k) as b from s) select cast(k as int) as k, round(abs((bk - ak) * (a - sse) - (ak - k) * (b - a)) / sqrt((bk - ak) * (bk - ak) + (b - a) * (b - a)), 4) as distance from s, e order by 2 desc, 1 limit 1")
def elbow_of_series(spark, sf_dir):
    """The elbow of a given series, a fixture of five points."""
    return clusters.elbow(spark.createDataFrame(list(_FIXED), "k int, sse double")).select("k", F.round("distance", 4).alias("distance"))


@query("kmeans_lloyd_k1", f"with {VECTORS_SQL}, m as (select i, avg(x[i]) as m from vec, (select unnest(range(1, 65)) as i) t group by i) select round(sum((x[i] - m) * (x[i] - m)), 4) as sse from vec, m")
def lloyd_k1(spark, sf_dir):
    """The sweep's first point: with one cluster the error is the total variance about the mean."""
    points = vectors(spark, sf_dir)
    error = clusters.lloyd_many(points, [clusters.first_points(points, 1)])[0][1]
    return spark.createDataFrame([(error,)], "sse double").select(F.round("sse", 4).alias("sse"))


@query("kmeanspp_mind2", f"with {VECTORS_SQL}, c0 as (select id as k, x from vec where id < 3), {_assign(0)} select id, round(d2, 6) as d2 from a0")
def min_distances(spark, sf_dir):
    points = vectors(spark, sf_dir)
    return clusters.assign(points, clusters.first_points(points, 3)).select("id", F.round("d2", 6).alias("d2"))


@query("kmeans_best_of")
def best_of(spark, sf_dir):
    centroids, _ = clusters.kmeans(vectors(spark, sf_dir), K, RESTARTS, MOST)
    return clusters.assign(vectors(spark, sf_dir), centroids).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d2").alias("sse"))


@query("kmeans_mllib")
def mllib(spark, sf_dir):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors(spark, sf_dir).select("id", array_to_vector("x").alias("features"))
    model = KMeans(k=K, seed=42, maxIter=20).fit(rows)
    return model.transform(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))
