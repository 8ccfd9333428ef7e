"""URL filters: host and path rules, then a template tree per host, in DataFrame operations only.

Each host's paths form a tree of segments. Digits in a segment are a slot at once; a level whose distinct segments are
many for its urls becomes a wildcard. Of other siblings the labelled ones are agglomerated: in order of their share of
bad labels (smoothed towards their parent's, in BINS steps), each joins the cluster before it unless a test of two
proportions tells them apart. A cluster of all siblings is a wildcard, one of several is named by its least segment and
the number of others (``?news+2``), which no path can hold. Siblings without labels stay by themselves. What remains are
templates, and a template whose smoothed share of bad labels is over the limit is rejected. The share is smoothed
towards its host's, and the host's towards that of all labelled urls.

Pages are first added up by host and path with slots, so the tree is built on far fewer rows than there are pages, and a
hot host's rows are summed before they are shuffled. Siblings meet as at most BINS sums per parent, whatever their
number. The tree is as deep as its paths: a row takes part as long as others share its template so far, and levels that
all rows of a parent share are passed over at once.

A null url, or one without ``://``, has an empty host and path; so it fits no rule and falls to the template of the
empty host. Repeated rows keep their rows. An empty table gives an empty result; without labels nothing is rejected by
the tree. Extra columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmine.llm.common import written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A level is a wildcard from so many distinct segments on, if they are at least this share of its urls.
VARIABLE, VARIETY = 8, 0.2
#: Normal quantile of the test that keeps siblings apart, steps and weight of their smoothed shares.
QUANTILE, BINS, WEIGHT = 1.645, 64, 4.0
#: Weight of the smoothing of a template's share, and the limit to reject.
SMOOTHING, LIMIT = 10.0, 0.5
#: Verdicts of templates are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """The path's segments, digits as slots."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#"), "/")


def _small(df: DataFrame) -> DataFrame:
    """df, written; broadcast up to BROADCAST_ROWS rows."""
    df = written(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])


_CLUSTER = "array<struct<high: int, labelled: double, bad: double, kinds: bigint, first: string>>"


def agglomerated(bins: Column) -> Column:
    """Clusters of adjacent bins, ascending; bins: array of structs as in _CLUSTER, high being a bin's own number."""

    def join(clusters: Column, x: Column) -> Column:
        last = F.element_at(clusters, -1)
        every = last["labelled"] + x["labelled"]
        rate = (last["bad"] + x["bad"]) / every
        apart = last["bad"] / last["labelled"] - x["bad"] / x["labelled"]
        alike = apart * apart <= QUANTILE * QUANTILE * rate * (1 - rate) * (1 / last["labelled"] + 1 / x["labelled"])
        both = F.struct(x["high"].alias("high"), every.alias("labelled"), (last["bad"] + x["bad"]).alias("bad"), (last["kinds"] + x["kinds"]).alias("kinds"), F.least(last["first"], x["first"]).alias("first"))
        return F.when(F.size(clusters) == 0, F.array(x)).when(alike, F.concat(F.slice(clusters, 1, F.size(clusters) - 1), F.array(both))).otherwise(F.concat(clusters, F.array(x)))

    return F.aggregate(bins, F.array().cast(_CLUSTER), join)


def renamed(children: DataFrame) -> DataFrame:
    """host, parent, segment, name: what a level's segments become, those that change.

    children: host, parent, segment, n, labelled, bad, one row each.
    """
    nodes = children.groupBy("host", "parent").agg(F.count("*").alias("all_kinds"), F.sum("n").alias("total"), F.try_divide(F.sum("bad"), F.sum("labelled")).alias("rate"))
    nodes = nodes.withColumn("variable", (F.col("all_kinds") >= VARIABLE) & (F.col("all_kinds") >= VARIETY * F.col("total"))).where("all_kinds > 1")
    at = children.join(nodes, ["host", "parent"])
    smooth = (F.col("bad") + WEIGHT * F.col("rate")) / (F.col("labelled") + WEIGHT)
    at = at.withColumn("bin", F.when((F.col("labelled") > 0) & ~F.col("variable"), F.least(F.floor(smooth * BINS), F.lit(BINS - 1)).cast("int")))
    sums = at.where("bin is not null").groupBy("host", "parent", "all_kinds", "bin").agg(F.sum("labelled").cast("double").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("kinds"), F.min("segment").alias("first"))
    each = F.struct(F.col("bin").alias("high"), "labelled", "bad", "kinds", "first")
    merged = sums.groupBy("host", "parent", "all_kinds").agg(agglomerated(F.array_sort(F.collect_list(each)).cast(_CLUSTER)).alias("clusters"))
    name = lambda x: F.when(x["kinds"] == F.col("all_kinds"), F.lit("*")).otherwise(F.concat(F.lit("?"), x["first"], F.lit("+"), (x["kinds"] - 1).cast("string")))
    merged = merged.select("host", "parent", F.transform("clusters", lambda x: F.struct(x["high"].alias("high"), F.when(x["kinds"] > 1, name(x)).alias("name"))).alias("clusters"))
    found = at.join(merged, ["host", "parent"], "left").withColumn("cluster", F.get(F.filter("clusters", lambda x: x["high"] >= F.col("bin")), F.lit(0)))
    return found.select("host", "parent", "segment", F.when(F.col("variable"), F.lit("*")).otherwise(F.col("cluster.name")).alias("name")).where("name is not null")


def templates(urls: DataFrame) -> DataFrame:
    """host, path_key, template, n, labelled, bad, share, rejected: one row per host and path with slots.

    urls: host, path_key (array of segments), n, labelled, bad: one row per host and path key.
    """
    columns = ("host", "path_key", "template", "n", "labelled", "bad")
    rows = urls.withColumn("template", F.col("path_key")).withColumn("at", F.lit(0)).select(*columns, "at")
    done = []
    while True:  # a round per branching on a path: what all rows of a parent share is passed over at once
        groups = rows.groupBy("host", F.slice("template", 1, F.col("at")).alias("head")).agg(F.min("template").alias("low"), F.max("template").alias("high"), F.count("*").alias("rows"))
        upto = F.least(F.size("low"), F.size("high"))
        differ = F.filter(F.sequence(F.lit(0), upto), lambda i: ~F.get("low", i).eqNullSafe(F.get("high", i)))
        groups = _small(groups.where("rows > 1").select(F.col("host").alias("h"), "head", F.coalesce(F.get(differ, F.lit(0)), upto).alias("same")))
        here = rows.join(groups, (F.col("host") == F.col("h")) & (F.slice("template", 1, F.col("at")) == F.col("head")), "left")
        here = written(here.withColumn("branches", F.coalesce(F.size("template") > F.col("same"), F.lit(False))).select(*columns, "same", "branches"))
        done.append(here.where("not branches").select(*columns))
        at = here.where("branches").select(*columns, "same", F.slice("template", 1, F.col("same")).alias("parent"), F.get("template", F.col("same")).alias("segment"))
        if at.isEmpty():
            break
        # a row per segment that changes; joined by segments and not by hosts alone
        names = _small(renamed(_summed(at, "host", "parent", "segment")).withColumnsRenamed({"host": "h", "parent": "p", "segment": "s"}))
        joined = at.join(names, (F.col("host") == F.col("h")) & (F.col("parent") == F.col("p")) & (F.col("segment") == F.col("s")), "left")
        new = F.concat(F.col("parent"), F.array("name"), F.slice("template", F.col("same") + 2, F.size("template")))
        rows = written(joined.withColumn("template", F.when(F.col("name").isNotNull(), new).otherwise(F.col("template"))).select(*columns, (F.col("same") + 1).alias("at")))
    tree = written(reduce(DataFrame.unionByName, done))
    overall = tree.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("r")).first()["r"]
    hosts = _summed(tree, "host").select("host", ((F.col("bad") + SMOOTHING * F.lit(overall)) / (F.col("labelled") + SMOOTHING)).alias("host_share"))
    each = _summed(tree, "host", "template").withColumnsRenamed({"n": "t_n", "labelled": "t_labelled", "bad": "t_bad"}).join(hosts, "host")
    each = each.withColumn("share", (F.col("t_bad") + SMOOTHING * F.col("host_share")) / (F.col("t_labelled") + SMOOTHING))
    return tree.join(each, ["host", "template"]).select("host", "path_key", "template", F.col("t_n").alias("n"), F.col("t_labelled").alias("labelled"), F.col("t_bad").alias("bad"), "share", (F.col("share") > LIMIT).alias("rejected"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, share: one row per page.

    labels: page_id, bad (0 or 1); a page's labels are averaged, and pages without one count as unlabelled.
    """
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("path_key", segments(F.col("path")))
    one = labels.groupBy("page_id").agg(F.avg("bad").cast("double").alias("bad"))
    known = parsed.join(one, "page_id", "left")
    urls = written(known.groupBy("host", "path_key").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")))
    found = _small(templates(urls).select("host", "path_key", F.array_join("template", "/").alias("template"), "share", "rejected"))
    ruled = parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.join(found, ["host", "path_key"], "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "share"
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labels are those of the document that its path numbers: bad if toxic or of low quality."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    numbered = pages.select("page_id", F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).alias("d")).where("d <> ''").select("page_id", F.col("d").cast("long").alias("doc_id"))
    bad = labels.select("doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0).alias("bad"))
    return judge(pages, numbered.join(bad, "doc_id").select("page_id", "bad"))
