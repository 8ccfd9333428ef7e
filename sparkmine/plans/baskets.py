"""Itemset queries over the baskets of orders, and synthetic baskets."""

from pyspark.sql import functions as F

from sparkmine.functions.hashing import uniform_sql
from sparkmine.operators import itemsets
from sparkmine.plans.registry import query
from sparkmine.sources.tables import BASKETS_SQL, baskets

FRACTION = 0.005
_MIN = f"need as (select cast(ceil(count(distinct txn_id) * {FRACTION} - 1e-9) as bigint) as m from basket)"
_THREE = f"""with {BASKETS_SQL}, {_MIN},
s1 as (select item as items, 1 as size, count(*) as support from basket group by item),
s2 as (select a.item || ',' || b.item as items, 2 as size, count(*) as support from basket a join basket b on a.txn_id = b.txn_id and a.item < b.item group by 1),
s3 as (select a.item || ',' || b.item || ',' || c.item as items, 3 as size, count(*) as support from basket a join basket b on a.txn_id = b.txn_id and a.item < b.item join basket c on c.txn_id = b.txn_id and b.item < c.item group by 1)
select items, size, support from (select * from s1 union all select * from s2 union all select * from s3), need where support >= m"""


#: Sets of any size: each grows by a larger item while it is frequent; supports are counted over whole baskets.
_EVERY = f"""with recursive {BASKETS_SQL}, {_MIN},
common as (select item, count(*) as support from basket group by item having count(*) >= (select m from need)),
kept as (select txn_id, item from basket semi join common using (item)),
grown as (select txn_id, item as last, item as items, 1 as size from kept
union all select k.txn_id, k.item, g.items || ',' || k.item, g.size + 1 from grown g join kept k on k.txn_id = g.txn_id and k.item > g.last where g.size < 13)
select items, size, count(*) as support from grown group by 1, 2 having count(*) >= (select m from need)"""


@query("basket_item_support", f"with {BASKETS_SQL} select item, count(*) as support from basket group by item")
def item_support(spark, sf_dir):
    return itemsets.item_support(baskets(spark, sf_dir))


@query("basket_frequent_pairs", f"with {BASKETS_SQL}, {_MIN} select * from (select a.item as a, b.item as b, count(*) as support from basket a join basket b on a.txn_id = b.txn_id and a.item < b.item group by 1, 2), need where support >= m".replace("select * from (", "select a, b, support from ("))
def frequent_pairs(spark, sf_dir):
    rows = baskets(spark, sf_dir)
    return itemsets.apriori(rows, itemsets.least_support(rows, FRACTION), 2).where("size = 2").select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "support")


def _named(found):
    return found.select(F.array_join("items", ",").alias("items"), F.col("size").cast("int").alias("size"), "support")


@query("basket_frequent_itemsets3", _THREE)
def frequent_itemsets(spark, sf_dir):
    rows = baskets(spark, sf_dir)
    return _named(itemsets.apriori(rows, itemsets.least_support(rows, FRACTION), 3))


@query("fpgrowth_itemsets", _EVERY)
def fp_growth(spark, sf_dir):
    rows = baskets(spark, sf_dir)
    return _named(itemsets.fp_growth(rows, itemsets.least_support(rows, FRACTION)))


UNIVERSE, TRANSACTIONS = 60, 400
_CORE = f"core as (select i as item, row_number() over (order by {uniform_sql(chr(39) + 'core' + chr(39), 'i')}, i) <= {max(1, int(0.1 * UNIVERSE))} as core from (select unnest(range({UNIVERSE})) as i) t)"


@query("core_rare_items", f"with {_CORE} select item, core from core")
def core_items(spark, sf_dir):
    return itemsets.core_items(spark, UNIVERSE)


@query(
    "synthetic_baskets",
    f"""with {_CORE},
txn as (select unnest(range({TRANSACTIONS})) as txn_id),
coin as (select txn_id, item from txn, core where {uniform_sql("'basket'", "txn_id", "item")} < case when core then 0.9e0 else 0.05e0 end),
full_txn as (select txn_id, item from coin union all select txn_id, cast(floor({uniform_sql("'lone'", "txn_id")} * {UNIVERSE}) as bigint) from txn where txn_id not in (select txn_id from coin))
select txn_id, string_agg(cast(item as varchar), ' ' order by md5('order:' || txn_id || ':' || item)) as line from full_txn group by txn_id""",
)
def synthetic(spark, sf_dir):
    return itemsets.synthetic_baskets(spark, UNIVERSE, TRANSACTIONS)


PERCENTS = (90, 50, 25, 10, 5)


@query("support_sweep", f"with recursive {BASKETS_SQL}, total as (select count(distinct txn_id) as n from basket), pct as (select unnest([{', '.join(map(str, PERCENTS))}]) as percent), common as (select item from basket group by item having count(*) * 100 >= 5 * (select n from total)), kept as (select txn_id, item from basket semi join common using (item)), grown as (select txn_id, item as last, item as items, 1 as size from kept union all select k.txn_id, k.item, g.items || ',' || k.item, g.size + 1 from grown g join kept k on k.txn_id = g.txn_id and k.item > g.last where g.size < 13), sup as (select items, count(*) as c from grown group by 1) select cast(percent as int) as percent, count(items) as itemsets from pct cross join total left join sup on c * 100 >= percent * n group by 1")
def support_sweep(spark, sf_dir):
    """How many itemsets are frequent at each support of the protocol."""
    rows = [(p, n) for p, n, _ in itemsets.support_sweep(baskets(spark, sf_dir).cache(), PERCENTS)]
    return spark.createDataFrame(rows, "percent int, itemsets long")
