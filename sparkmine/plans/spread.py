"""Spread queries over the digraph of suppliers and parts."""

from pyspark.sql import functions as F

from sparkmine.functions.hashing import uniform_sql
from sparkmine.lineage import cut
from sparkmine.operators import diffusion
from sparkmine.plans.registry import query
from sparkmine.sources.tables import DIGRAPH_SQL, PROBABILITY, SAMPLES, digraph, seeds

HOPS, PAD = 3, 12
_LIVE = f"{DIGRAPH_SQL}, live as (select s as sample, u, v from digraph, (select unnest(range({SAMPLES})) as s) t where {uniform_sql(chr(39) + 'live' + chr(39), 's', 'u', 'v')} < {PROBABILITY}e0)"
_R0 = f"r0 as (select sample, node from seed, (select unnest(range({SAMPLES})) as sample) t)"


def _reach(hops: int) -> str:
    return ", ".join([_R0, *[f"r{h} as (select sample, node from r{h - 1} union select l.sample, l.v from r{h - 1} r join live l on l.sample = r.sample and l.u = r.node)" for h in range(1, hops + 1)]])


_SPREAD = f"{_LIVE}, {_reach(HOPS)}, spread as (select sample, count(*) as reached from r{HOPS} group by sample)"
_CAND = f"cand as (select l.sample, l.u, l.v from live l join r{HOPS} r on r.sample = l.sample and r.node = l.u)"


def _live(spark, sf_dir):
    edges = digraph(spark, sf_dir)
    return edges, cut(diffusion.live_edges(edges, SAMPLES)), cut(seeds(edges))


@query("live_edges", f"with {_LIVE} select sample, u, v from live")
def live(spark, sf_dir):
    return diffusion.live_edges(digraph(spark, sf_dir), SAMPLES)


_PRUNE = f"{DIGRAPH_SQL}, q0 as (select node from seed), q1 as (select node from q0 union select v from q0 join digraph on u = node), pruned as (select u, v from digraph join q1 on u = node)"


@query("prune_hops2", f"with {_PRUNE} select u, v from pruned")
def prune(spark, sf_dir):
    edges = digraph(spark, sf_dir)
    return diffusion.prune(edges, seeds(edges), 2).select("u", "v")


@query("spread_per_sample", f"with {_SPREAD} select sample, reached from spread")
def per_sample(spark, sf_dir):
    _, lv, s = _live(spark, sf_dir)
    return diffusion.spread(lv, s, SAMPLES, HOPS)


@query("expected_spread", f"with {_SPREAD} select round(avg(reached), 6) as spread from spread")
def expected(spark, sf_dir):
    _, lv, s = _live(spark, sf_dir)
    return diffusion.spread(lv, s, SAMPLES, HOPS).agg(F.round(F.avg("reached"), 6).alias("spread"))


def _candidates(spark, sf_dir):
    _, lv, s = _live(spark, sf_dir)
    return lv, s, diffusion.candidates(lv, diffusion.reach(lv, diffusion.in_samples(s, SAMPLES), HOPS))


@query("candidate_edges", f"with {_SPREAD}, {_CAND} select sample, u, v from cand")
def candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)[2]


_SHORT = "short as (select u, v, count(*) as samples from cand group by 1, 2 order by samples desc, u, v limit 5)"


@query("proxy_shortlist", f"with {_SPREAD}, {_CAND}, {_SHORT} select u, v, samples from short")
def shortlist(spark, sf_dir):
    return diffusion.shortlist(_candidates(spark, sf_dir)[2], 5)


def _blocked() -> str:
    steps = ["b0 as (select sample, bu, bv, node from (select c.sample, c.u as bu, c.v as bv from cand c join short s on s.u = c.u and s.v = c.v), seed)"]
    steps += [f"b{h} as (select * from b{h - 1} union select r.sample, r.bu, r.bv, l.v from b{h - 1} r join live l on l.sample = r.sample and l.u = r.node where not (l.u = r.bu and l.v = r.bv))" for h in range(1, HOPS + 1)]
    return ", ".join(steps)


@query(
    "block_gain_top1",
    f"""with {_SPREAD}, {_CAND}, {_SHORT}, {_blocked()}, w as (select sample, bu, bv, count(*) as without from b{HOPS} group by 1, 2, 3)
select bu as u, bv as v, round(sum(reached - without) / {SAMPLES}e0, 6) as gain from w join spread using (sample) group by 1, 2 order by sum(reached - without) desc, 1, 2 limit 1""",
)
def block_gain(spark, sf_dir):
    lv, s, cands = _candidates(spark, sf_dir)
    found = diffusion.gains(lv, s, diffusion.shortlist(cands, 5), SAMPLES, HOPS)
    return found.orderBy(F.desc("gain"), "u", "v").limit(1).select("u", "v", F.round("gain", 6).alias("gain"))


_HOP = "hop as (select node from seed union select v from digraph join seed on u = node)"


@query("one_hop_sources", f"with {DIGRAPH_SQL}, {_HOP} select node from hop")
def one_hop(spark, sf_dir):
    edges = digraph(spark, sf_dir)
    return diffusion.one_hop_sources(edges, seeds(edges))


@query(
    "pad_edges",
    f"""with {_PRUNE}, {_HOP}, few as (select u, v, row_number() over (order by u desc, v desc) as r from digraph order by u desc, v desc limit 2),
tier as (select 0 as tier, r, u, v from few union all select 1, 0, u, v from pruned join seed on u = node union all select 2, 0, u, v from digraph join seed on u = node union all select 3, 0, u, v from pruned join hop on u = node
union all select 4, 0, u, v from digraph join hop on u = node union all select 5, 0, u, v from pruned union all select 6, 0, u, v from digraph),
one as (select u, v, min(tier) as tier, arg_min(r, tier) as r from tier group by 1, 2)
select row_number() over (order by tier, r, u, v) as rank, u, v from one order by rank limit {PAD}""",
)
def pad(spark, sf_dir):
    edges = digraph(spark, sf_dir)
    s = seeds(edges)
    chosen = edges.select("u", "v").orderBy(F.desc("u"), F.desc("v")).limit(2)
    from pyspark.sql import Window

    chosen = chosen.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("u"), F.desc("v"))))
    return diffusion.pad(chosen, edges, s, diffusion.prune(edges, s, 2), PAD)


@query("greedy_block_k")
def greedy(spark, sf_dir):
    edges = digraph(spark, sf_dir)
    return diffusion.greedy_block(edges, seeds(edges), 6, 4, HOPS)
