"""Queries over literal text in the formats that the readers take."""

from pyspark.sql import functions as F

from sparkmine.plans.registry import query
from sparkmine.sources import text

LOG = """alpha runtime at 95% support: 12 seconds
beta runtime at 95% support: 7 seconds
building index
gamma runtime at 95% support: 3 seconds
alpha runtime at 50% support: 140 seconds
beta runtime at x% support: 9 seconds
gamma runtime at 50% support: n/a seconds"""
GRAPH_TEXT = """# a
v 0 A
v 1 B
v 2 02
e 1 0 x
e 0 1 y
e 2 1 x

t 1
v 0 A
v 0 C"""


def _values(sql_text: str) -> str:
    return ", ".join(f"({i}, '{line}')" for i, line in enumerate(sql_text.split("\n")))


_BLOCKS = f"""raw(line_no, value) as (values {_values(GRAPH_TEXT)}),
block as (select line_no, value, sum(case when value[1] in ('#', 't') then 1 else 0 end) over (order by line_no) - 1 as gid, string_split(value, ' ') as w from raw where trim(value) <> '')"""


@query(
    "run_log_parse",
    f"""with raw(line_no, value) as (values {_values(LOG)}), w as (select string_split(value, ' ') as w from raw where contains(value, 'runtime at'))
select w[1] as alg, try_cast(replace(w[4], '%', '') as int) as support, coalesce(try_cast(w[6] as int), 0) as seconds from w where try_cast(replace(w[4], '%', '') as int) is not null""",
)
def run_log(spark, sf_dir):
    return text.read_run_log(text.literal_lines(spark, LOG))


@query("graph_parse_nodes", f"with {_BLOCKS} select gid::bigint as gid, w[2]::bigint as nid, arg_max(w[3], line_no) as label from block where value[1] = 'v' group by 1, 2")
def graph_nodes(spark, sf_dir):
    return text.read_graphs(text.literal_lines(spark, GRAPH_TEXT))[0].select(F.col("gid").cast("long").alias("gid"), "nid", "label")


@query("graph_parse_edges", f"with {_BLOCKS} select gid::bigint as gid, least(w[2]::bigint, w[3]::bigint) as u, greatest(w[2]::bigint, w[3]::bigint) as v, arg_min(w[4], line_no) as label from block where value[1] = 'e' group by 1, 2, 3")
def graph_edges(spark, sf_dir):
    return text.read_graphs(text.literal_lines(spark, GRAPH_TEXT))[1].select(F.col("gid").cast("long").alias("gid"), "u", "v", "label")


@query(
    "label_map",
    f"""with {_BLOCKS}, l as (select distinct coalesce(cast(try_cast(w[3] as bigint) as varchar), w[3]) as label from block where value[1] = 'v')
select label, case when try_cast(label as bigint) is not null then try_cast(label as bigint) else row_number() over (partition by try_cast(label as bigint) is null order by label) end as code from l""",
)
def label_codes(spark, sf_dir):
    return text.label_map(text.read_graphs(text.literal_lines(spark, GRAPH_TEXT))[0])
