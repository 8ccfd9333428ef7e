"""Queries over the attributed graph of the embeddings: statistics, propagation, layers with fixed weights, links, metrics."""

from pyspark.sql import functions as F

from sparkmine.functions.hashing import uniform_sql
from sparkmine.functions.vectors import batch_norm, l2_normalize, layer_norm, softmax
from sparkmine.operators import layers, metrics
from sparkmine.plans.registry import query
from sparkmine.sources import datasets
from sparkmine.sources.tables import ATTRIBUTED_SQL, LINKS_SQL, VECTORS_SQL, link_pairs, links, split, table, vectors

WIDTH, CLASSES, OUT = 64, 10, 4
ALPHA = 0.45
_DIM = f"(select unnest(range(1, {WIDTH + 1})) as i) dims"
_STATS = f"stats as (select i - 1 as dim, avg(x[i]) as mean, greatest(coalesce(stddev_samp(x[i]), 0), 1e-6) as std from vec, {_DIM} where id % 10 < 6 group by i)"


def _nodes(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    return nodes, links(nodes)


def _train_stats(nodes):
    return layers.feature_stats(nodes.where(F.col("id") % 10 < 6), WIDTH)


@query("feature_mean_std", f"with {ATTRIBUTED_SQL}, {_STATS} select cast(dim as int) as dim, round(mean, 6) as mean, round(std, 6) as std from stats")
def mean_std(spark, sf_dir):
    return _train_stats(vectors(spark, sf_dir)).select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _long(rows, column="x"):
    return rows.select("id", F.posexplode(column).alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


@query("standardize_clip", f"with {ATTRIBUTED_SQL}, {_STATS} select id, cast(dim as int) as dim, round(least(greatest((x[dim + 1] - mean) / std, -10), 10), 6) as x from vec, stats")
def standardized(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    stats = [(r["mean"], r["std"]) for r in _train_stats(nodes).orderBy("dim").collect()]
    return _long(layers.standardize(nodes, stats))


@query("l2_normalize", f"with {ATTRIBUTED_SQL}, n as (select id, x, greatest(sqrt(list_inner_product(x, x)), 1e-12) as n from vec) select id, cast(i - 1 as int) as dim, round(x[i] / n, 6) as x from n, {_DIM}")
def normalized(spark, sf_dir):
    return _long(vectors(spark, sf_dir).select("id", l2_normalize(F.col("x")).alias("x")))


@query(
    "class_weights",
    f"""with {ATTRIBUTED_SQL}, c as (select y, count(*) as n from vec where id % 10 < 6 group by y), e as (select k as y, coalesce(n, 0) as n from (select unnest(range({CLASSES})) as k) t left join c on c.y = k),
raw as (select y, n, cast(sum(n) over () as double) / greatest(n, 1) as raw from e) select cast(y as int) as y, cast(n as bigint) as n, round(raw / avg(raw) over (), 6) as weight from raw""",
)
def class_weights(spark, sf_dir):
    return layers.class_weights(vectors(spark, sf_dir).where(F.col("id") % 10 < 6), CLASSES).select("y", "n", F.round("weight", 6).alias("weight"))


_SCORED = "scored as (select l.quality as y, cast(d.n_chars as double) as score from labels l join documents d on d.doc_id = l.doc_id)"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id").select("y", "score")


@query("pos_weight", f"with {_SCORED} select round(greatest(count(*) filter (where y = 0), 1) / cast(greatest(count(*) filter (where y = 1), 1) as double), 6) as pos_weight from scored")
def pos_weight(spark, sf_dir):
    return layers.positive_weight(_scored(spark, sf_dir)).select(F.round("pos_weight", 6).alias("pos_weight"))


_SYM = "sym as (select src, dst from link union all select dst, src from link)"


@query("degree_log1p", f"with {ATTRIBUTED_SQL}, {_SYM} select vec.id, count(sym.src) as degree, round(ln(1 + cast(count(sym.src) as double)), 6) as log_degree from vec left join sym on sym.src = vec.id group by 1")
def degree(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    return layers.degrees(nodes, layers.symmetrized(es)).select("id", "degree", F.round("log_degree", 6).alias("log_degree"))


@query("symmetrized_edges", f"with {ATTRIBUTED_SQL}, {_SYM} select src, dst, count(*) as copies from sym group by 1, 2")
def symmetrized(spark, sf_dir):
    return layers.symmetrized(_nodes(spark, sf_dir)[1]).groupBy("src", "dst").agg(F.count("*").alias("copies"))


@query("node_count", f"with {ATTRIBUTED_SQL} select count(distinct n) as nodes from (select src as n from link union all select dst from link)")
def node_count(spark, sf_dir):
    es = _nodes(spark, sf_dir)[1]
    return es.select(F.col("src").alias("n")).unionByName(es.select(F.col("dst").alias("n"))).agg(F.countDistinct("n").alias("nodes"))


@query("num_classes", f"with {ATTRIBUTED_SQL} select max(y) + 1 as classes from vec")
def num_classes(spark, sf_dir):
    return vectors(spark, sf_dir).agg((F.max("y") + 1).alias("classes"))


@query("split_stats", f"with {ATTRIBUTED_SQL} select split, count(*) as n, count(distinct y) as classes from vec join split using (id) group by split")
def split_stats(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy(split().alias("split")).agg(F.count("*").alias("n"), F.countDistinct("y").alias("classes"))


_BASE = f"base as (select id, i - 1 as dim, x[i] as x from vec, (select unnest(range(1, {CLASSES + 1})) as i) t)"


def _base(nodes):
    return nodes.select("id", F.slice("x", 1, CLASSES).alias("x"))


@query("neighbor_mean", f"with {ATTRIBUTED_SQL}, {_BASE}, m as (select dst as id, dim, avg(x) as h from link join base on base.id = src group by 1, 2) select base.id, cast(base.dim as int) as dim, round(coalesce(h, 0), 6) as x from base left join m on m.id = base.id and m.dim = base.dim")
def neighbor_mean(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    return _long(layers.in_mean(_base(nodes), es, CLASSES), "h")


def _steps(alpha: float, steps: int, low: float, high: float, anchors: bool, tag: str = "p") -> str:
    parts = [f"{tag}0 as (select id, dim, x from base)"]
    for s in range(1, steps + 1):
        value = f"least(greatest((1e0 - {alpha}) * b.x + {alpha} * coalesce(m.h, 0), {low}), {high})"
        value = f"case when b.id % 10 < 6 then cast(v.y = b.dim as int)::double else {value} end" if anchors else value
        parts.append(f"{tag}{s} as (select b.id, b.dim, {value} as x from base b join vec v on v.id = b.id left join (select dst as id, dim, avg(x) as h from link join {tag}{s - 1} on {tag}{s - 1}.id = src group by 1, 2) m on m.id = b.id and m.dim = b.dim)")
    return ", ".join(parts)


def _anchors(nodes):
    return nodes.where(F.col("id") % 10 < 6).select("id", F.array(*[(F.col("y") == c).cast("double") for c in range(CLASSES)]).alias("a"))


@query("propagate_1", f"with {ATTRIBUTED_SQL}, {_BASE}, {_steps(ALPHA, 1, -10, 10, False)} select id, cast(dim as int) as dim, round(x, 6) as x from p1")
def propagate_1(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    return _long(layers.propagate(_base(nodes), es, CLASSES, ALPHA, 1, limits=(-10.0, 10.0))[-1])


@query("propagate_3", f"with {ATTRIBUTED_SQL}, {_BASE}, {_steps(ALPHA, 3, 0, 1, True)} select id, cast(dim as int) as dim, round(x, 6) as x from p3")
def propagate_3(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    return _long(layers.propagate(_base(nodes), es, CLASSES, ALPHA, 3, _anchors(nodes))[-1])


GRID = [0.2, 0.5]


def _grid() -> str:
    tags = {a: f"g{i}_" for i, a in enumerate(GRID)}
    ctes = ", ".join(_steps(a, 2, 0, 1, True, t) for a, t in tags.items())
    rows = " union all ".join(f"select {a}e0 as alpha, {s} as steps, (select avg(cast(p = y as int)) from (select id, arg_max(dim, x * 1000 - dim * 1e-9) as p from {t}{s} group by id) join vec using (id) where id % 10 in (6, 7)) as accuracy" for a, t in tags.items() for s in (1, 2))
    return f"with {ATTRIBUTED_SQL}, {_BASE}, {ctes} select alpha, steps, round(accuracy, 6) as accuracy from ({rows})"


@query("propagate_grid", _grid())
def propagate_grid(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    truth = nodes.where((F.col("id") % 10).isin(6, 7)).select("id", "y")
    rows = layers.tune(_base(nodes), es, CLASSES, truth, GRID, [1, 2], _anchors(nodes))
    return spark.createDataFrame(rows, "alpha double, steps int, accuracy double").withColumn("accuracy", F.round("accuracy", 6))


_W = "((31 * o + 17 * j) % 13 - 6) / 13e0"


def _z(name: str, source: str, width: int, out: int) -> str:
    """name(id, o, z): a dense map with the fixed weights."""
    return f"{name} as (select id, o, sum(({_W}) * x[j + 1]) as z from {source}, (select unnest(range({out})) as o) a, (select unnest(range({width})) as j) b group by 1, 2)"


_LOOPS = "every as (select src, dst from link union all select id, id from vec), deg as (select dst as id, cast(count(*) as double) as d from every group by 1)"


@query("gcn_layer", f"with {ATTRIBUTED_SQL}, {_LOOPS}, {_z('z', 'vec', WIDTH, OUT)} select e.dst as id, cast(o as int) as dim, round(sum(z / sqrt(a.d)) / sqrt(b.d), 6) as x from every e join z on z.id = e.src join deg a on a.id = e.src join deg b on b.id = e.dst group by e.dst, o, b.d")
def gcn(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    return _long(layers.gcn(nodes, es, layers.weights(OUT, WIDTH)), "h")


@query("sage_layer", f"with {ATTRIBUTED_SQL}, {_z('z', 'vec', WIDTH, OUT)}, m as (select dst as id, o, avg(z) as h from link join z on z.id = src group by 1, 2) select z.id, cast(z.o as int) as dim, round(z.z + coalesce(m.h, 0), 6) as x from z left join m on m.id = z.id and m.o = z.o")
def sage(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    w = layers.weights(OUT, WIDTH)
    return _long(layers.sage(nodes, es, w, w, WIDTH), "h")


@query(
    "gat_attention",
    f"""with {ATTRIBUTED_SQL}, {_LOOPS}, {_z('z', 'vec', WIDTH, OUT)}, s as (select e.src, e.dst, row_number() over (order by e.src, e.dst) as n from every e),
e as (select s.n, s.src, s.dst, sum(((17 * a.o) % 13 - 6) / 13e0 * case when a.z + b.z > 0 then a.z + b.z else 0.2e0 * (a.z + b.z) end) as e from s join z a on a.id = s.dst join z b on b.id = s.src and b.o = a.o group by 1, 2, 3),
t as (select *, exp(e - max(e) over (partition by dst)) as w from e)
select t.dst as id, cast(o as int) as dim, round(sum(w * z) / sum(w), 6) as x from t join z on z.id = t.src group by 1, 2""",
)
def gat(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    w = layers.weights(OUT, WIDTH)
    return _long(layers.gat(nodes, es, w, w, layers.weights(1, OUT)[0]), "h")


_MLP = f"{_z('z', 'vec', WIDTH, 8)}, hid as (select id, list(greatest(z, 0) order by o) as x from z group by id), {_z('logit', 'hid', 8, CLASSES)}"


def _logits(nodes):
    return nodes.select("id", "y", layers.mlp(F.col("x"), [layers.weights(8, WIDTH), layers.weights(CLASSES, 8)]).alias("x"))


@query("mlp_forward", f"with {ATTRIBUTED_SQL}, {_MLP} select id, cast(o as int) as dim, round(z, 6) as x from logit")
def mlp_forward(spark, sf_dir):
    return _long(_logits(vectors(spark, sf_dir)))


@query("softmax_argmax", f"with {ATTRIBUTED_SQL}, {_MLP}, e as (select id, o, z, exp(z - max(z) over (partition by id)) as e from logit) select id, cast(arg_max(o, z) as int) as label, round(max(e) / sum(e), 6) as p from e group by id")
def softmax_argmax(spark, sf_dir):
    soft = _logits(vectors(spark, sf_dir)).select("id", layers.argmax("x").alias("label"), softmax(F.col("x")).alias("s"))
    return soft.select("id", "label", F.round(F.array_max("s"), 6).alias("p"))


@query("accuracy", f"with {ATTRIBUTED_SQL}, {_MLP}, p as (select id, arg_max(o, z) as p from logit group by id) select round(avg(cast(p = y as int)), 6) as accuracy from p join vec using (id)")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_logits(vectors(spark, sf_dir)).select("y", layers.argmax("x").alias("p"))).select(F.round("accuracy", 6).alias("accuracy"))


@query("cross_entropy", f"with {ATTRIBUTED_SQL}, {_MLP}, l as (select id, max(z) as m from logit group by id), s as (select logit.id, m + ln(sum(exp(z - m))) - max(case when o = y then z end) as loss from logit join l using (id) join vec using (id) group by logit.id, m) select round(avg(loss), 6) as loss from s")
def cross_entropy(spark, sf_dir):
    rows = _logits(vectors(spark, sf_dir)).select(F.col("x").alias("logits"), "y", F.lit(1.0).alias("weight"))
    return metrics.cross_entropy(rows).select(F.round("loss", 6).alias("loss"))


@query("auc_roc", f"with {_SCORED} select round(sum(case when a.score > b.score then 1e0 when a.score = b.score then 0.5e0 else 0e0 end) / count(*), 6) as auc from scored a, scored b where a.y = 1 and b.y = 0")
def auc(spark, sf_dir):
    return metrics.auc(_scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


_COS = "list_inner_product(a.x, b.x) / greatest(sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x)), 1e-8)"
_SCORES = f"ps as (select pid, {_COS} as s from pos join vec a on a.id = u join vec b on b.id = v), ns as (select pid, k, {_COS} as s from neg join vec a on a.id = u join vec b on b.id = v)"


def _scores(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    pos, neg = link_pairs(nodes)
    side = nodes.select("id", "x")
    return layers.cosine_scores(pos, side, side), layers.cosine_scores(neg, side, side)


@query("hits_at_50", f"with {LINKS_SQL}, {_SCORES}, h as (select ps.pid, count(*) filter (where ns.s > ps.s + 1e-12) as c from ps join ns on ns.pid = ps.pid group by 1) select round(avg(cast(c < 10 as int)), 6) as hits10, round(avg(cast(c < 50 as int)), 6) as hits50 from h")
def hits(spark, sf_dir):
    pos, neg = _scores(spark, sf_dir)
    neg = neg.withColumn("score", F.col("score") - 1e-12)  # equal pairs in another order don't count as higher
    return metrics.hits_at(pos, neg, 10).select(F.round("hits", 6).alias("hits10")).join(metrics.hits_at(pos, neg, 50).select(F.round("hits", 6).alias("hits50")))


@query("cosine_link_score", f"with {LINKS_SQL}, {_SCORES} select pid, round(s, 6) as score from ps")
def cosine_score(spark, sf_dir):
    return _scores(spark, sf_dir)[0].select("pid", F.round("score", 6).alias("score"))


@query("bpr_loss", f"with {LINKS_SQL}, {_SCORES} select round(avg(ln(1 + exp(-(ps.s - ns.s - 0.5e0)))), 6) as loss from ps join ns using (pid)")
def bpr(spark, sf_dir):
    return layers.bpr_loss(*_scores(spark, sf_dir)).select(F.round("loss", 6).alias("loss"))


@query(
    "pair_features",
    f"""with {LINKS_SQL}, deg as (select id, ln(1 + 3e0) as d from vec), f as (select pid, list_concat(list_concat(a.x, b.x), list_concat(list_concat(list_transform(range(1, 65), lambda i: a.x[i] * b.x[i]), list_transform(range(1, 65), lambda i: abs(a.x[i] - b.x[i]))), [p.d, q.d])) as f
from pos join vec a on a.id = u join vec b on b.id = v join deg p on p.id = u join deg q on q.id = v)
select pid, cast(i - 1 as int) as dim, round(f[i], 6) + 0e0 as x from f, (select unnest(range(1, 259)) as i) t""",
)
def pair_features(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    found = layers.pair_features(link_pairs(nodes)[0], nodes.select("id", "x"), layers.degrees(nodes, es))
    return _long(found.select(F.col("pid").alias("id"), "f"), "f").withColumnRenamed("id", "pid")


@query(
    "negative_edges",
    f"""with {ATTRIBUTED_SQL}, {_SYM}, t as (select id as pid, id as u, t, cast(floor({uniform_sql("'neg'", 'id', 't')} * n) as bigint) as v from vec, total, (select unnest(range(8)) as t) a)
select pid, u, arg_min(v, t) as v from t where u <> v and not exists (select 1 from sym where src = u and dst = v) group by 1, 2""",
)
def negative_edges(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    return layers.negative_edges(link_pairs(nodes)[0].select("pid", "u"), es, nodes.count())


@query("truncated_svd")
def truncated_svd(spark, sf_dir):
    rows = layers.singular_values(vectors(spark, sf_dir), WIDTH, 16)
    return spark.createDataFrame(rows, "component int, value double")


@query("mlp_train")
def mlp_train(spark, sf_dir):
    """A perceptron on the training split; its accuracy on the rest."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = vectors(spark, sf_dir).select("id", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    model = MultilayerPerceptronClassifier(layers=[WIDTH, 16, CLASSES], maxIter=30, seed=42).fit(rows.where("id % 10 < 6"))
    return metrics.accuracy(model.transform(rows.where("id % 10 >= 6")).select(F.col("prediction").alias("p"), F.col("label").alias("y")))


# ---- normalisation, pair scores, training rows, batches, fallbacks ---------------------------------------------------

_MEAN, _VAR = [(i % 7 - 3) / 10 for i in range(WIDTH)], [1 + (i % 5) / 10 for i in range(WIDTH)]
_GAMMA, _BETA = [1 + (i % 3) / 10 for i in range(WIDTH)], [(i % 4) / 10 for i in range(WIDTH)]
_PARAMS = "par as (select i, ((i - 1) % 7 - 3) / 10e0 as mean, 1 + ((i - 1) % 5) / 10e0 as variance, 1 + ((i - 1) % 3) / 10e0 as gamma, ((i - 1) % 4) / 10e0 as beta from " + _DIM + ")"


@query("batch_norm", f"with {ATTRIBUTED_SQL}, {_PARAMS} select id, cast(i - 1 as int) as dim, round((x[i] - mean) / sqrt(variance + 1e-5) * gamma + beta, 6) as x from vec, par")
def batch_normalized(spark, sf_dir):
    return _long(vectors(spark, sf_dir).select("id", batch_norm(F.col("x"), _MEAN, _VAR, _GAMMA, _BETA).alias("x")))


@query("layer_norm", f"with {ATTRIBUTED_SQL}, {_PARAMS}, s as (select id, avg(x[i]) as m, var_pop(x[i]) as v from vec, {_DIM} group by 1) select vec.id, cast(i - 1 as int) as dim, round((x[i] - m) / sqrt(v + 1e-5) * gamma + beta, 6) as x from vec join s on s.id = vec.id, par")
def layer_normalized(spark, sf_dir):
    return _long(vectors(spark, sf_dir).select("id", layer_norm(F.col("x"), _GAMMA, _BETA).alias("x")))


_PAIRS = f"""deg as (select id, ln(1 + 3e0) as d from vec), f as (select pid as id, list_concat(list_concat(a.x, b.x), list_concat(list_concat(list_transform(range(1, 65), lambda i: a.x[i] * b.x[i]), list_transform(range(1, 65), lambda i: abs(a.x[i] - b.x[i]))), [p.d, q.d])) as x
from pos join vec a on a.id = u join vec b on b.id = v join deg p on p.id = u join deg q on q.id = v)"""


@query("pair_mlp_score", f"with {LINKS_SQL}, {_PAIRS}, {_z('z', 'f', 258, 8)} select id as pid, round(sum(greatest(z, 0) * ((17 * o) % 13 - 6) / 13e0), 6) as score from z group by 1")
def pair_mlp_score(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    found = layers.pair_scores(link_pairs(nodes)[0], nodes.select("id", "x"), layers.degrees(nodes, es), layers.weights(8, 258), layers.weights(1, 8)[0])
    return found.select("pid", F.round("score", 6).alias("score"))


@query("training_rows", f"with {LINKS_SQL}, r as (select u, v, 1e0 as label from pos union all select u, v, 0e0 from neg) select label, count(*) as n, cast(sum(u) as bigint) as us, cast(sum(v) as bigint) as vs from r group by 1")
def training_rows(spark, sf_dir):
    rows = datasets.training_rows(*link_pairs(vectors(spark, sf_dir)))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("u").alias("us"), F.sum("v").alias("vs"))


@query("minibatch_sizes", f"with {VECTORS_SQL}, total as (select cast(ceil(count(*) / 64e0) as bigint) as b from vec) select cast(floor({uniform_sql(chr(39) + 'batch' + chr(39), '0', 'id')} * b) as int) as batch, count(*) as n from vec, total group by 1")
def minibatch_sizes(spark, sf_dir):
    return datasets.minibatches(vectors(spark, sf_dir), ["id"], 64).groupBy("batch").agg(F.count("*").alias("n"))


@query("random_classes", f"with {VECTORS_SQL} select id, cast(floor({uniform_sql(chr(39) + 'random' + chr(39), '0', 'id')} * {CLASSES}) as bigint) as y_pred from vec")
def random_classes(spark, sf_dir):
    return datasets.random_predictions("A", vectors(spark, sf_dir), CLASSES)


@query("ema_per_user", "with o as (select user_id, list(value order by ts, event_id) as v from events where value is not null group by 1) select user_id, round(list_reduce(v, lambda a, x: x * 0.5e0 + a * 0.5e0), 6) as ema from o")
def ema_per_user(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    return rows.select("user_id", F.round(metrics.ema(F.transform("v", lambda x: x["value"])), 6).alias("ema"))


@query("running_loss", "select event_id, floor(avg(value) over (partition by user_id order by ts, event_id rows unbounded preceding) * 1e4 + 0.50001e0) / 1e4 as mean, floor(avg(value) over (partition by user_id order by ts, event_id rows between 19 preceding and current row) * 1e4 + 0.50001e0) / 1e4 as recent from events")
def running_loss(spark, sf_dir):
    rows = metrics.running_mean(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    four = lambda c: (F.floor(F.col(c) * 1e4 + 0.50001) / 1e4).alias(c)  # noqa: E731 (halves go up on any engine)
    return rows.select("event_id", four("mean"), four("recent"))


@query("dataset_stats", f"with {ATTRIBUTED_SQL} select (select count(*) from vec) as nodes, (select max(len(x)) from vec) as features, (select count(*) from link) as edges, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as valid, count(*) filter (where split = 'test') as test, count(distinct y) as classes from vec join split using (id)")
def dataset_stats(spark, sf_dir):
    nodes, es = _nodes(spark, sf_dir)
    name = F.replace(split(), F.lit("val"), F.lit("valid"))
    return datasets.NodeDataset(nodes, es, nodes.select("id", "y", name.alias("split"))).stats().withColumn("features", F.col("features").cast("long"))


@query("reduced_vectors")
def reduced_vectors(spark, sf_dir):
    return _long(layers.reduced(vectors(spark, sf_dir), WIDTH, 16))
