"""Neighbour and hub queries over the embeddings."""

from pyspark.sql import functions as F

from sparkmine.operators import hubs
from sparkmine.plans.registry import query
from sparkmine.sources.tables import VECTORS_SQL, vectors

K, TOP = 10, 20
# every pair once, in blocks; k rows per query are kept
_KNN = f"{VECTORS_SQL}, knn as (select * from (select q.id as qid, b.id as bid, list_distance(q.x, b.x) as d, row_number() over (partition by q.id order by list_distance(q.x, b.x), b.id) as rank from vec q, vec b where q.id % 5 = 0) where rank <= {K})"
_HITS = "hits as (select vec.id, count(knn.bid) as hits from vec left join knn on knn.bid = vec.id group by 1)"


def _knn(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return base, hubs.knn(base.where("id % 5 = 0"), base, K)


@query("knn_topk", f"with {_KNN} select qid, cast(rank as int) as rank, bid, round(d * d, 6) as d2 from knn")
def knn(spark, sf_dir):
    return _knn(spark, sf_dir)[1].select("qid", "rank", "bid", F.round("d2", 6).alias("d2"))


@query("hub_counts", f"with {_KNN}, {_HITS} select id, hits from hits")
def hub_counts(spark, sf_dir):
    base, near = _knn(spark, sf_dir)
    return hubs.hub_counts(near, base)


@query("hub_topk", f"with {_KNN}, {_HITS} select id, hits from hits order by hits desc, id limit {TOP}")
def hub_topk(spark, sf_dir):
    return hubs.top_hubs(hub_counts(spark, sf_dir), TOP)


@query("hub_topk_ivf")
def hub_topk_ivf(spark, sf_dir):
    base = vectors(spark, sf_dir)
    near = hubs.ivf(base.where("id % 5 = 0"), base, K, hubs.cells_for(base.count()), hubs.probes_for(60))
    return hubs.top_hubs(hubs.hub_counts(near, base), TOP)


@query("hub_within_budget")
def hub_within_budget(spark, sf_dir):
    """The approximate hubs, of as many queries as fit into two minutes."""
    base = vectors(spark, sf_dir)
    return hubs.hubs_within(base.where("id % 5 = 0"), base, K, TOP, 120.0)[0]
