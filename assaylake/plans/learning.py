"""Queries: preprocessing, selection, heuristic and trained models, metrics, explanation, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from assaylake.functions import content
from assaylake.operators import estimators, explain, heuristics, metric, metrics, models, preprocess, selection, shapley
from assaylake.plans.content import per_sample
from assaylake.plans.quality import gaps
from assaylake.plans.registry import register
from assaylake.sources import io, views
from assaylake.sources.scratch import new_folder, written
from assaylake.sources.views import FEATURES, blobs, features, preds, samples, sql, table
from assaylake.streaming import updates

COLUMNS = list(FEATURES)


def _rows(spark, d):
    return features(spark, d).select("hash", "price", "label")


@register(sql("SELECT hash, round(price / max(abs(price)) OVER (), 6) AS price FROM features", "features"))
def maxabs_scale(spark, d):
    return preprocess.maxabs_scale(features(spark, d).select("hash", "price"), "price")


@register(sql("SELECT hash, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS price FROM features", "features"))
def minmax_scale(spark, d):
    return preprocess.minmax_scale(features(spark, d).select("hash", "price"), "price")


@register(sql("SELECT hash, round(quantity / sqrt(quantity * quantity + tax * tax), 6) AS quantity, round(tax / sqrt(quantity * quantity + tax * tax), 6) AS tax FROM features", "features"))
def normalize_rows(spark, d):
    return preprocess.normalize_rows(features(spark, d).select("hash", "quantity", "tax"), ["quantity", "tax"])


@register(sql("SELECT hash, CAST(label = 'A' AS INTEGER) AS label_A, CAST(label = 'N' AS INTEGER) AS label_N, CAST(label = 'R' AS INTEGER) AS label_R, CAST(dataset = 'O' AS INTEGER) AS dataset_O FROM features", "features"))
def onehot(spark, d):
    rows = preprocess.onehot(preprocess.onehot(features(spark, d), "label", ["A", "N", "R"]), "dataset", ["F", "O"])
    return rows.select("hash", "label_A", "label_N", "label_R", "dataset_O")


@register("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer")
def ordinal(spark, d):
    return preprocess.ordinal(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


def _power_sql(key: str, column: str, of: str, value: str, slope: str) -> str:
    """The likeliest lambda of the grid, and the column transformed with it and standardised."""
    return f"""WITH l AS (SELECT round(-2 + 0.1 * i, 1)::DOUBLE AS lam FROM range(41) r(i)), src AS (SELECT {key}, CAST({column} AS DOUBLE) AS x FROM {of}),
        y AS (SELECT lam, {value} AS y, {slope} AS s FROM src, l), ll AS (SELECT lam, -count(y) / 2 * ln(greatest(var_pop(y), 1e-300)) + sum(s) AS l FROM y GROUP BY 1), b AS (SELECT arg_max(lam, l) AS lam FROM ll), t AS (SELECT {key}, {value} AS y FROM src, b)
        SELECT {key}, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS {column} FROM t"""


_BOXCOX = _power_sql("hash", "price", "features", "CASE WHEN abs(lam) < 1e-9 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END", "(lam - 1) * ln(x)")
_YEOJOHNSON = _power_sql(
    "c_custkey",
    "c_acctbal",
    "customer",
    "CASE WHEN x >= 0 THEN CASE WHEN abs(lam) < 1e-9 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END ELSE CASE WHEN abs(lam - 2) < 1e-9 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END END",
    "(lam - 1) * sign(x) * ln(1 + abs(x))",
)


@register(sql(_BOXCOX, "features"))
def boxcox(spark, d):
    return preprocess.power_transform(features(spark, d).select("hash", "price"), "price", "boxcox")


@register(_YEOJOHNSON)
def yeojohnson(spark, d):
    return preprocess.power_transform(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


_KNOTS = "k AS (SELECT quantile_cont(price, list_transform(range(101), lambda i: i / 100)) AS q FROM features), r AS (SELECT hash, price, q, len(list_filter(q, lambda x: x <= price)) AS place FROM features, k)"


@register(sql(f"WITH {_KNOTS} SELECT hash, round(least(1, (place - 1 + coalesce((price - q[place]) / nullif(q[least(place + 1, 101)] - q[place], 0), 0)) / 100), 6) AS price FROM r", "features"))
def quantile_uniform(spark, d):
    return preprocess.quantile_uniform(features(spark, d).select("hash", "price"), "price")


def _normal_sql(p: str) -> str:
    poly = lambda parts, x: reduce(lambda a, b: f"({a} * {x} + {b!r})", parts[1:], repr(parts[0]))
    tail = lambda q: f"{poly(preprocess.TAIL, f'sqrt(-2 * ln({q}))')} / {poly(preprocess.TAIL_BELOW, f'sqrt(-2 * ln({q}))')}"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 1 - 0.02425 THEN -({tail(f'(1 - {p})')}) ELSE ({p} - 0.5) * {poly(preprocess.MIDDLE, r)} / {poly(preprocess.MIDDLE_BELOW, r)} END"


@register(sql(f"WITH {_KNOTS}, u AS (SELECT hash, greatest(1e-7, least(1 - 1e-7, round(least(1, (place - 1 + coalesce((price - q[place]) / nullif(q[least(place + 1, 101)] - q[place], 0), 0)) / 100), 6)))::DOUBLE AS p FROM r) SELECT hash, round({_normal_sql('p')}, 6) AS price FROM u", "features"))
def quantile_normal(spark, d):
    ranks = preprocess.quantile_uniform(features(spark, d).select("hash", "price"), "price")
    return ranks.select("hash", F.round(preprocess.normal_quantile(F.col("price")), 6).alias("price"))


@register(sql("WITH q AS (SELECT quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM features) SELECT hash, round((price - q[2]) / (q[3] - q[1]), 6) AS price FROM features, q", "features"))
def robust_scale(spark, d):
    return preprocess.robust_scale(features(spark, d).select("hash", "price"), "price")


@register()
def pca2(spark, d):
    return preprocess.pca(features(spark, d).select("hash", *COLUMNS), COLUMNS)


@register(sql("SELECT hash, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price FROM features", "features"))
def standard_scale(spark, d):
    return preprocess.standard_scale(features(spark, d).select("hash", "price"), "price")


@register(sql("WITH g AS (SELECT hash, doc_id, CASE WHEN doc_id % 11 <> 0 THEN size END AS size FROM samples) SELECT doc_id, round(coalesce(size, avg(size) OVER ()), 6) AS size FROM g", "samples"))
def impute(spark, d):
    return preprocess.impute(gaps(spark, d).select("doc_id", F.col("size").cast("double").alias("size")), "size")


@register()
def reduce_data(spark, d):
    rows = features(spark, d).select("hash", *(F.when(F.col("hash") % 17 != 0, F.col(c)).alias(c) for c in COLUMNS))
    # Written, as what comes next goes through the rows several times, and each time would impute and scale them anew.
    rows = written(preprocess.minmax_scale(written(preprocess.impute(rows, COLUMNS), "imputed"), COLUMNS), "scaled")
    return preprocess.pca(rows, COLUMNS).select("hash", "pc1", "pc2")


@register(sql("SELECT hash, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price, price AS \"*price\" FROM features WHERE label = 'R'", "features"))
def preprocess_preview(spark, d):
    rows = features(spark, d).where("label = 'R'").select("hash", "price", F.col("price").alias("*price"))
    return preprocess.standard_scale(rows, "price")


@register(sql("SELECT hash, label, row_number() OVER (PARTITION BY label ORDER BY md5(hash || '42'), hash) <= round(0.8 * count(*) OVER (PARTITION BY label)) AS train FROM features", "features"))
def stratified_split(spark, d):
    return preprocess.stratified_split(features(spark, d).select("hash", "label"))


# ---------------------------------------------------------------- selection


def _each(expr: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {expr.format(c=c)}" for c in COLUMNS)


@register(sql(_each("round(var_pop({c}), 6) AS variance, round(var_pop({c}), 6) > 0.001 AS kept FROM features"), "features"))
def variance_filter(spark, d):
    return selection.variance_filter(features(spark, d), COLUMNS, 0.001)


_DECILES = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
_BINNED = "b AS (" + _each("label, y, dataset, CAST(len(list_filter((SELECT quantile_cont({c}, " + _DECILES + ") FROM features), lambda x: x <= {c})) AS INTEGER) AS bin FROM features") + ")"
_MI = f"{_BINNED}, j AS (SELECT feature, bin, label, count(*) AS n FROM b GROUP BY 1, 2, 3), s AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, bin) AS x, sum(n) OVER (PARTITION BY feature, label) AS l FROM j), mi AS (SELECT feature, round(sum(n / a * ln(n * a / (x * l))), 6) AS mi FROM s GROUP BY 1)"


@register(sql(f"WITH {_MI} SELECT * FROM mi", "features"))
def mutual_information(spark, d):
    return selection.mutual_information(features(spark, d), COLUMNS, "label")


@register(sql(f"WITH {_MI} SELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank FROM mi QUALIFY rank <= 2", "features"))
def mi_kbest(spark, d):
    return selection.best(selection.mutual_information(features(spark, d), COLUMNS, "label"), 2)


@register()
def mrmr(spark, d):
    return selection.mrmr(features(spark, d), COLUMNS, "label", 3)


@register()
def rfecv(spark, d):
    return selection.rfecv(features(spark, d), COLUMNS, "y", 1)


@register()
def feature_filter_pipeline(spark, d):
    return selection.filter_pipeline(features(spark, d), COLUMNS, "y", 0.0001, 3)


@register(sql(f"WITH {_MI} SELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank FROM mi QUALIFY rank <= 3", "features"))
def infogain_ranking(spark, d):
    return selection.best(selection.mutual_information(features(spark, d).where("label <> '?'"), COLUMNS, "label"), 3)


@register(sql(f"""
    WITH {_BINNED}, j AS (SELECT dataset, feature, bin, label, count(*) AS n FROM b GROUP BY 1, 2, 3, 4),
    s AS (SELECT *, sum(n) OVER (PARTITION BY dataset, feature) AS a, sum(n) OVER (PARTITION BY dataset, feature, bin) AS x, sum(n) OVER (PARTITION BY dataset, feature, label) AS l FROM j),
    mi AS (SELECT dataset, feature, round(sum(n / a * ln(n * a / (x * l))), 6) AS mi FROM s GROUP BY 1, 2),
    g AS (SELECT dataset, CASE WHEN feature IN ('discount', 'tax') THEN 'rates' ELSE feature END AS grp, avg(mi) AS mi FROM mi GROUP BY 1, 2)
    SELECT g.dataset, grp, round(g.mi + 1e-9, 6) AS mi, round(abs(g.mi - r.mi) + 1e-9, 6) AS diff FROM g JOIN (SELECT grp, mi FROM g WHERE dataset = 'O') r USING (grp)""", "features"))
def infogain_comparison(spark, d):
    return selection.compared(features(spark, d), COLUMNS, "label", "dataset", "O", {"discount|tax": "rates"})


@register(sql("""
    WITH m AS (SELECT dataset, part, avg(quantity) AS quantity, avg(price) AS price, avg(discount) AS discount, avg(tax) AS tax FROM features GROUP BY 1, 2), r AS (SELECT * FROM m WHERE dataset = 'O'), f AS (SELECT * FROM m WHERE dataset = 'F'),
    c AS (SELECT 'quantity' AS c, avg(f.quantity - r.quantity) AS diff, avg(f.quantity - r.quantity) / (SELECT stddev_pop(quantity) FROM r) AS z FROM f JOIN r USING (part)
    UNION ALL SELECT 'price', avg(f.price - r.price), avg(f.price - r.price) / (SELECT stddev_pop(price) FROM r) FROM f JOIN r USING (part)
    UNION ALL SELECT 'rates', avg(f.discount - r.discount), avg(f.discount - r.discount) / (SELECT stddev_pop(discount) FROM r) FROM f JOIN r USING (part)
    UNION ALL SELECT 'rates', avg(f.tax - r.tax), avg(f.tax - r.tax) / (SELECT stddev_pop(tax) FROM r) FROM f JOIN r USING (part)), g AS (SELECT c AS feature, avg(diff) AS diff, avg(z) AS z FROM c GROUP BY 1)
    SELECT feature, round(diff, 6) AS diff, round(z, 6) AS standardised FROM g ORDER BY abs(z) DESC LIMIT 2""", "features"))
def feature_diff_heatmap(spark, d):
    means = features(spark, d).groupBy("dataset", "part").agg(*(F.avg(c).alias(c) for c in COLUMNS))
    return selection.mean_differences(means.where("dataset = 'F'"), means.where("dataset = 'O'"), "part", COLUMNS, {"discount|tax": "rates"}, 2)


# ---------------------------------------------------------------- trained models


def _split(spark, d):
    """The feature rows with train, as a table: a fit goes through its rows many times, and each time would shuffle and sort them anew."""
    cls = F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2)
    return written(preprocess.stratified_split(features(spark, d).select("hash", *COLUMNS, "label", "y", cls.alias("cls"))), "split")


def _trained(name: str, algorithm: str, label: str = "y", classes: int = 2):
    def query(spark, d):
        rows = _split(spark, d)
        model = models.train(rows.where("train"), algorithm, COLUMNS, label, classes)
        return models.predict(model, rows.where("not train")).select("hash", label, "prediction")

    query.__name__ = name
    return register()(query)


train_dt = _trained("train_dt", "dt", "cls", 3)
train_rf = _trained("train_rf", "rf", "cls", 3)
train_gb = _trained("train_gb", "gb")
train_nb = _trained("train_nb", "nb", "cls", 3)
train_lr = _trained("train_lr", "lr", "cls", 3)
train_lsvc = _trained("train_lsvc", "lsvc")
train_bnb = _trained("train_bnb", "bnb")
train_mnb = _trained("train_mnb", "mnb", "cls", 3)
train_lsvc_multiclass = _trained("train_lsvc_multiclass", "lsvc", "cls", 3)
train_mlp = _trained("train_mlp", "mlp", "cls", 3)
train_j48 = _trained("train_j48", "j48", "cls", 3)


def _knn_sql(p: int, weight: str) -> str:
    return f"""
    WITH v AS (SELECT vec_id AS hash, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT * FROM v WHERE hash % 100 = 0),
    n AS (SELECT q.hash AS q, v.hash, v.label, round(list_sum(list_transform(range(1, 65), lambda i: pow(abs(v.e[i] - q.e[i]), {p}))), 9) AS d FROM q JOIN v ON q.hash <> v.hash),
    t AS (SELECT q, label, sum({weight}) AS n FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, hash, label) AS k FROM n) WHERE k <= 5 GROUP BY 1, 2)
    SELECT q AS hash, CAST(label AS INTEGER) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, label DESC) AS k FROM t) WHERE k = 1"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("hash"), F.col("embedding").alias("e"), "label")


@register(_knn_sql(2, "1"))
def knn_predict(spark, d):
    return models.knn(_vectors(spark, d), _vectors(spark, d).where("hash % 100 = 0"), ["e"], "label")


@register(_knn_sql(1, "CASE WHEN d = 0 THEN 1e300 ELSE 1 / d END"))
def knn_weighted(spark, d):
    return models.knn(_vectors(spark, d), _vectors(spark, d).where("hash % 100 = 0"), ["e"], "label", p=1, weights="distance")


@register()
def kmeans(spark, d):
    return models.cluster(features(spark, d).select("hash", *COLUMNS), COLUMNS, 3).select("hash", "cluster")


@register()
def hierarchical(spark, d):
    return models.cluster(features(spark, d).select("hash", *COLUMNS), COLUMNS, 3, "bisecting").select("hash", "cluster")


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("hash"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))


@register("""
    WITH RECURSIVE p AS (SELECT vec_id AS hash, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), n AS (SELECT a.hash AS a, b.hash AS b FROM p a JOIN p b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.05 * 0.05),
    core AS (SELECT a FROM n GROUP BY 1 HAVING count(*) >= 8), e AS (SELECT n.a, n.b FROM n JOIN core c ON n.a = c.a JOIN core k ON n.b = k.a), r AS (SELECT a, a AS b FROM core UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    l AS (SELECT a, min(b) AS c FROM r GROUP BY 1), o AS (SELECT n.a, min(l.c) AS c FROM n JOIN l ON n.b = l.a GROUP BY 1)
    SELECT hash, l.a IS NOT NULL AS core, coalesce(l.c, o.c, -1) AS cluster FROM p LEFT JOIN l ON hash = l.a LEFT JOIN o ON hash = o.a""")
def dbscan(spark, d):
    return metric.dbscan(_points(spark, d), ["x", "y"], 0.05, 8)


@register("""
    WITH RECURSIVE p AS (SELECT vec_id AS hash, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    n AS (SELECT a.hash AS a, b.hash AS b FROM p a JOIN p b ON list_sum(list_transform(range(1, 65), lambda i: pow(a.e[i] - b.e[i], 2))) <= 1.16 * 1.16),
    core AS (SELECT a FROM n GROUP BY 1 HAVING count(*) >= 5), e AS (SELECT n.a, n.b FROM n JOIN core c ON n.a = c.a JOIN core k ON n.b = k.a), r AS (SELECT a, a AS b FROM core UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    l AS (SELECT a, min(b) AS c FROM r GROUP BY 1), o AS (SELECT n.a, min(l.c) AS c FROM n JOIN l ON n.b = l.a GROUP BY 1)
    SELECT hash, l.a IS NOT NULL AS core, coalesce(l.c, o.c, -1) AS cluster FROM p LEFT JOIN l ON hash = l.a LEFT JOIN o ON hash = o.a""")
def dbscan_all_dimensions(spark, d):
    return metric.dbscan(_vectors(spark, d), ["e"], 1.16, 5)


@register("""
    WITH v AS (SELECT vec_id AS hash, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    n AS (SELECT a.hash AS src, b.hash AS dst, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.e[i] - b.e[i], 2)))), 9) AS distance FROM v a JOIN v b ON a.hash <> b.hash)
    SELECT src, dst, CAST(rank AS INTEGER) AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM n) WHERE rank <= 10""")
def knn_graph(spark, d):
    return metric.knn_graph(_vectors(spark, d), "hash", ["e"], 10)


@register()
def spectral(spark, d):
    return models.spectral(_vectors(spark, d), "hash", ["e"], 3)


@register(sql("SELECT CAST(greatest(2, count(DISTINCT label) FILTER (label <> '?')) AS BIGINT) AS k FROM samples", "samples"))
def auto_k(spark, d):
    return models.auto_k(samples(spark, d), "label")


@register()
def grid_search(spark, d):
    return models.grid_search(_split(spark, d).where("train"), COLUMNS, "y")[0]


@register()
def grid_search_forest(spark, d):
    return models.grid_search(_split(spark, d).where("train"), COLUMNS, "y", "rf", {"maxDepth": [3, 5], "numTrees": [5]})[0]


@register(sql("SELECT count(*) FILTER (label = '?') = 0 AS supervised, count(*) FILTER (label <> '?') > 0 AS semi_supervised FROM samples", "samples"))
def label_requirement(spark, d):
    return models.label_requirement(samples(spark, d))


@register()
def predict_table(spark, d):
    rows = features(spark, d)
    return models.predict(models.train(rows, "dt", COLUMNS, "y"), rows)


@register()
def performance_log(spark, d):
    """Each model's scores are appended to a table as they come."""
    rows, folder = _split(spark, d), new_folder(spark, "performance")
    for name in ("dt", "lr"):
        scored = models.predict(models.train(rows.where("train"), name, COLUMNS, "y"), rows.where("not train"))
        log = io.append_log(metrics.binary_metrics(scored, "y", "prediction").withColumn("model", F.lit(name)), folder)
    return log


@register()
def importance_ranking(spark, d):
    return models.importances(models.train(features(spark, d), "rf", COLUMNS, "y"), COLUMNS, spark)


@register("SELECT vec_id AS hash FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN 0 AND 0.2")
def cluster_region_select(spark, d):
    return models.box(_points(spark, d), "x", "y", (-0.1, 0.1, 0.0, 0.2)).select("hash")


@register()
def characteristic_points(spark, d):
    points = preprocess.pca(features(spark, d).select("hash", *COLUMNS, "label"), COLUMNS)
    kinds = points.agg((F.count_distinct("label") > 6).alias("continuous"))
    return points.select("hash", "pc1", "pc2", F.col("label").alias("characteristic")).join(F.broadcast(kinds))  # one row


@register()
def cluster_points(spark, d):
    names = [f"e{i}" for i in range(64)]
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("hash"), *(F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate(names)))
    points = written(preprocess.pca(rows, names).select("hash", "pc1", "pc2"), "points")
    return points.join(metric.dbscan(points, ["pc1", "pc2"], 0.3, 6), "hash")


@register()
def knn_boundary(spark, d):
    """The vote of the nearest rows at each point of a grid over two principal components of all dimensions."""
    names = [f"e{i}" for i in range(64)]
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("hash"), *(F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate(names)), "label")
    points = written(preprocess.pca(rows, names).select("hash", "pc1", "pc2", "label"), "points")
    ends = points.agg(*(f(c).alias(f"{n}_{c}") for c in ("pc1", "pc2") for n, f in (("a", F.min), ("b", F.max))))
    steps = F.explode(F.sequence(F.lit(0), F.lit(10)))
    cells = ends.select("*", steps.alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("j"))
    cells = cells.select((-1 - F.col("i") * 11 - F.col("j")).cast("long").alias("hash"), *((F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col(k) / 10).alias(c) for c, k in (("pc1", "i"), ("pc2", "j"))))
    cells = written(cells, "grid")
    return models.knn(points, cells, ["pc1", "pc2"], "label").join(cells, "hash")


# ---------------------------------------------------------------- heuristic models

_PER = "p AS (SELECT hash, count(*) AS n, CAST(sum(raw_size) AS BIGINT) AS raw, CAST(sum(virtual_size) AS BIGINT) AS virtual, round(avg(entropy), 6) AS entropy, count(*) FILTER (x) AS n_x FROM sections GROUP BY 1)"


@register(sql(f"WITH {_PER}, s AS (SELECT hash, CAST(n_x > 2 AS INTEGER) AS y, round(sqrt(pow(n * 0.5, 2.0) + pow(entropy * 20, 1.0)) + 1e-9, 6) AS score FROM p) SELECT hash, score, CAST(score >= (SELECT quantile_cont(score, 0.99) FROM s WHERE y = 0) AS INTEGER) AS prediction, round(1 / (1 + exp(-score)), 6) AS probability FROM s", "sections"))
def arora_risk(spark, d):
    rows = per_sample(spark, d).withColumn("y", (F.col("n_x") > 2).cast("int"))
    estimator = estimators.RiskEstimator(heuristics.power_risk({"n": (0.5, 2.0), "entropy": (20.0, 1.0)}), "y")
    return Pipeline(stages=[estimator]).fit(rows).transform(rows).select("hash", "score", "prediction", "probability")


@register(sql(f"WITH {_PER}, s AS (SELECT hash, round((n * 2 * 0.5 + entropy * 1 * 10 + n_x * 1 * 2) / 4 + 1e-9, 6) AS score FROM p) SELECT hash, score, CAST(score >= 3 AS INTEGER) AS prediction, round(1 / (1 + exp(-score)), 6) AS probability FROM s", "sections"))
def treadwell_risk(spark, d):
    score = heuristics.linear_risk({"n": (2.0, 0.5), "entropy": (1.0, 10.0), "n_x": (1.0, 2.0)})
    rows = per_sample(spark, d)
    return estimators.RiskEstimator(score, threshold=3.0).fit(rows).transform(rows).select("hash", "score", "prediction", "probability")


@register(sql("WITH s AS (SELECT y, round(sqrt(tax * tax + discount * discount), 6) AS norm FROM features), t AS (SELECT norm AS t FROM (SELECT norm, row_number() OVER (ORDER BY norm) AS k, count(*) OVER () AS c FROM s WHERE y = 1) WHERE k = greatest(1, CAST(floor(0.05 * c) AS BIGINT))) SELECT any_value(t) AS threshold, round(avg(CAST(norm < t AS INTEGER)), 6) AS below FROM s, t WHERE y = 0", "features"))
def phad_distance(spark, d):
    return heuristics.norm_distance(features(spark, d), ["tax", "discount"], "y")


@register(sql("WITH f AS (SELECT avg(quantity) - 0.5 * stddev_pop(quantity) AS a, avg(tax) - 0.5 * stddev_pop(tax) AS b FROM features WHERE y = 1) SELECT hash, CAST(quantity >= a AND tax >= b AS INTEGER) AS prediction FROM features, f", "features"))
def bintropy_rule(spark, d):
    rows = features(spark, d)
    return estimators.MarginEstimator(["quantity", "tax"], "y", 0.5).fit(rows).transform(rows).select("hash", "prediction")


@register(sql("WITH f AS (SELECT avg(quantity) - stddev_pop(quantity) AS a FROM features WHERE y = 1 AND dataset = 'F') SELECT hash, CAST(dataset = 'F' AND quantity >= a AS INTEGER) AS prediction FROM features, f", "features"))
def reminder_rule(spark, d):
    rows = features(spark, d).withColumn("flag", F.col("dataset") == "F")
    return estimators.MarginEstimator(["quantity"], "y", 1.0, "flag").fit(rows).transform(rows).select("hash", "prediction")


@register(sql("""
    WITH l AS (SELECT y, 'quantity' AS feature, quantity AS x FROM features UNION ALL SELECT y, 'tax', tax FROM features), c AS (SELECT feature, x, count(*) AS n, sum(y) AS k FROM l GROUP BY 1, 2),
    s AS (SELECT feature, x, sum(n) OVER r AS ln, sum(k) OVER r AS lk, sum(n) OVER w AS an, sum(k) OVER w AS ak FROM c WINDOW r AS (PARTITION BY feature ORDER BY x), w AS (PARTITION BY feature)),
    g AS (SELECT feature, x, round(2 * (ak / an) * (1 - ak / an) - ln / an * 2 * (lk / ln) * (1 - lk / ln) - (an - ln) / an * 2 * ((ak - lk) / (an - ln)) * (1 - (ak - lk) / (an - ln)), 6) AS gain FROM s WHERE ln < an)
    SELECT feature, x AS threshold, gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, x) AS k FROM g) WHERE k = 1""", "features"))
def oner_stump(spark, d):
    return heuristics.stump(features(spark, d), ["quantity", "tax"], "y")


@register()
def perdisci_mlp(spark, d):
    rows = features(spark, d)
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    vec = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(rows)
    return MultilayerPerceptronClassifier(labelCol="y", layers=[len(COLUMNS), 5, 2], maxIter=30, seed=42).fit(vec).transform(vec).select("hash", F.col("prediction").cast("int").alias("prediction"))


def _labelled(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))


@register()
def burgess_topk(spark, d):
    rows = heuristics.topk_feature(blobs(spark, d)).join(_labelled(spark, d), "doc_id")
    return models.predict(models.train(rows, "lsvc", ["entropy"], "y"), rows).select("doc_id", "prediction")


@register()
def nataraj_bigram(spark, d):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.linalg import SparseVector, VectorUDT

    sparse = F.udf(lambda bins, shares: SparseVector(5000, bins, shares), VectorUDT())
    vec = content.bigram_bins(blobs(spark, d)).join(_labelled(spark, d), "doc_id").select("doc_id", "y", sparse("bins", "shares").alias("features"))
    vec = written(vec, "bigrams")  # the fit goes through it many times
    return LinearSVC(labelCol="y", maxIter=20, regParam=0.01).fit(vec).transform(vec).select("doc_id", F.col("prediction").cast("int").alias("prediction"))


def _profiles(spark, d):
    """(doc_id, y, p0 to p49): the values of the randomness profile of each labelled text."""
    rows = content.profile_vector(blobs(spark, d)).join(_labelled(spark, d), "doc_id")
    return written(rows.select("doc_id", "y", *(F.col("profile")[i].alias(f"p{i}") for i in range(50))), "profiles")


_PLACES = [f"p{i}" for i in range(50)]


def _on_profile(name: str, algorithm: str):
    def query(spark, d):
        rows = _profiles(spark, d)
        return models.predict(models.train(rows, algorithm, _PLACES, "y"), rows).select("doc_id", "prediction")

    query.__name__ = name
    return register()(query)


sun_profile = _on_profile("sun_profile", "nb")
sun_profile_margin = _on_profile("sun_profile_margin", "lsvc")
sun_profile_tree = _on_profile("sun_profile_tree", "j48")


@register()
def sun_profile_nearest(spark, d):
    """The class of the nearest other profile."""
    rows = _profiles(spark, d)
    near = metric.knn_graph(rows, "doc_id", _PLACES, 1).select(F.col("src").alias("doc_id"), "dst")
    return near.join(rows.select(F.col("doc_id").alias("dst"), F.col("y").alias("prediction")), "dst").select("doc_id", "prediction")


# ---------------------------------------------------------------- metrics

_R = "round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 6)"


@register(sql(f"""
    WITH c AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS tp, count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS fn FROM preds),
    s AS (SELECT y_pred AS s, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM preds GROUP BY 1), r AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM s)
    SELECT {_R.format(a="tp + tn", b="tp + tn + fp + fn")} AS accuracy, {_R.format(a="tp", b="tp + fp")} AS precision, {_R.format(a="tp", b="tp + fn")} AS recall, {_R.format(a="2 * tp", b="2 * tp + fp + fn")} AS f,
           {_R.format(a="tp * tn - fp * fn", b="sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))")} AS mcc, (SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) FROM r) AS auc FROM c""", "preds"))
def classification_metrics(spark, d):
    return metrics.binary_metrics(preds(spark, d), "y_true", "y_pred", "y_pred")


@register(sql(f"""
    WITH o AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS a, count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS b, count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS c, count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS d FROM preds),
    c AS (SELECT if(a * b < c * d, c, a) AS tp, if(a * b < c * d, d, b) AS tn, if(a * b < c * d, a, c) AS fp, if(a * b < c * d, b, d) AS fn FROM o)
    SELECT {_R.format(a="tp + tn", b="tp + tn + fp + fn")} AS accuracy, {_R.format(a="tp", b="tp + fp")} AS precision, {_R.format(a="tp", b="tp + fn")} AS recall, {_R.format(a="2 * tp", b="2 * tp + fp + fn")} AS f,
           {_R.format(a="tp * tn - fp * fn", b="sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))")} AS mcc FROM c""", "preds"))
def classification_flipped(spark, d):
    return metrics.binary_metrics(preds(spark, d), "y_true", "y_pred", flip=True)


_GUESS = "CASE WHEN quantity > 30 THEN 'N' WHEN tax > 0.04 THEN 'A' ELSE 'R' END"


@register(sql(f"""
    WITH p AS (SELECT label AS t, {_GUESS} AS p FROM features), l AS (SELECT t AS label FROM p UNION SELECT p FROM p),
    e AS (SELECT label, count(*) FILTER (t = label AND p = label)::DOUBLE AS tp, count(*) FILTER (t <> label AND p = label)::DOUBLE AS fp, count(*) FILTER (t = label AND p <> label)::DOUBLE AS fn FROM p, l GROUP BY 1)
    SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(sum(coalesce(tp / nullif(tp + fp, 0), 0) * (tp + fn)) / sum(tp + fn), 6) AS precision, round(sum(coalesce(tp / nullif(tp + fn, 0), 0) * (tp + fn)) / sum(tp + fn), 6) AS recall,
           round(sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn)) / sum(tp + fn), 6) AS f FROM e""", "features"))
def classification_weighted(spark, d):
    guess = F.when(F.col("quantity") > 30, "N").when(F.col("tax") > 0.04, "A").otherwise("R")
    return metrics.weighted_metrics(features(spark, d).withColumn("guess", guess), "label", "guess")


@register(sql("""
    WITH c AS (SELECT label AS t, dataset AS p, count(*)::DOUBLE AS m FROM features GROUP BY 1, 2), w AS (SELECT *, sum(m) OVER (PARTITION BY t) AS a, sum(m) OVER (PARTITION BY p) AS b, sum(m) OVER () AS n FROM c),
    t AS (SELECT DISTINCT t, a, n FROM w), p AS (SELECT DISTINCT p, b FROM w), k AS (SELECT a, b, n, unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1))::DOUBLE AS k FROM t, p),
    e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS e FROM k),
    i AS (SELECT sum(m / n * ln(n * m / (a * b))) AS i FROM w), h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM t) AS ht, (SELECT -sum(b / n * ln(b / n)) FROM p, (SELECT max(n) AS n FROM t)) AS hp)
    SELECT round(i, 6) AS information, round(e, 6) AS expected, round((i - e) / ((ht + hp) / 2 - e), 6) AS adjusted FROM i, e, h""", "features"))
def adjusted_mutual_information(spark, d):
    return metrics.adjusted_information(features(spark, d), "label", "dataset")


@register(sql("""
    WITH l AS (SELECT label FROM features UNION SELECT CASE WHEN quantity > 30 THEN 'N' WHEN tax > 0.04 THEN 'A' ELSE 'R' END FROM features), p AS (SELECT label AS t, CASE WHEN quantity > 30 THEN 'N' WHEN tax > 0.04 THEN 'A' ELSE 'R' END AS p FROM features)
    SELECT label, count(*) FILTER (t <> label AND p <> label) AS tn, count(*) FILTER (t <> label AND p = label) AS fp, count(*) FILTER (t = label AND p <> label) AS fn, count(*) FILTER (t = label AND p = label) AS tp FROM p, l GROUP BY 1""", "features"))
def confusion_matrix(spark, d):
    guess = F.when(F.col("quantity") > 30, "N").when(F.col("tax") > 0.04, "A").otherwise("R")
    return metrics.per_label(features(spark, d).withColumn("guess", guess), "label", "guess")


@register(sql("SELECT doc_id, label, CAST(CASE label WHEN '?' THEN -1 WHEN '-' THEN 0 WHEN 'fam0' THEN 1 ELSE 2 END AS INTEGER) AS code FROM samples", "samples"))
def label_encoding(spark, d):
    return metrics.encode_labels(samples(spark, d)).select("doc_id", "label", "code")


@register(sql("""
    WITH c AS (SELECT label AS t, dataset AS p, count(*) AS n FROM features GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY t) AS a, sum(n) OVER (PARTITION BY p) AS b, sum(n) OVER () AS al FROM c),
    x AS (SELECT max(al) AS n, sum(n * (n - 1) / 2) AS same, sum(-n / al * ln(n / b)) AS htc, sum(-n / al * ln(n / a)) AS hct FROM w),
    t AS (SELECT sum(m * (m - 1) / 2) AS pt, sum(-m / al * ln(m / al)) AS ht FROM (SELECT *, sum(m) OVER () AS al FROM (SELECT t, sum(n) AS m FROM c GROUP BY 1))), p AS (SELECT sum(m * (m - 1) / 2) AS pp, sum(-m / al * ln(m / al)) AS hp FROM (SELECT *, sum(m) OVER () AS al FROM (SELECT p, sum(n) AS m FROM c GROUP BY 1))),
    f AS (SELECT (n * (n - 1) / 2 + 2 * same - pt - pp) / (n * (n - 1) / 2) AS rand, 1 - htc / ht AS h, 1 - hct / hp AS c FROM x, t, p)
    SELECT round(rand, 6) AS rand, round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v FROM f""", "features"))
def clustering_label_metrics(spark, d):
    return metrics.clustering_label_metrics(features(spark, d), "label", "dataset")


@register(sql("""
    WITH m AS (SELECT label, count(*) AS n, avg(quantity) AS q, avg(tax) AS t FROM features GROUP BY 1), g AS (SELECT avg(quantity) AS q, avg(tax) AS t FROM features),
    i AS (SELECT f.label, sum(pow(quantity - m.q, 2) + pow(tax - m.t, 2)) AS w, avg(sqrt(pow(quantity - m.q, 2) + pow(tax - m.t, 2))) AS s FROM features f JOIN m ON f.label = m.label GROUP BY 1),
    x AS (SELECT m.*, w, s, n * (pow(m.q - g.q, 2) + pow(m.t - g.t, 2)) AS b FROM m JOIN i USING (label), g),
    r AS (SELECT a.label, max((a.s + b.s) / sqrt(pow(a.q - b.q, 2) + pow(a.t - b.t, 2))) AS r FROM x a JOIN x b ON a.label <> b.label GROUP BY 1),
    k AS (SELECT label, count(*) AS n, avg(quantity * quantity + tax * tax) AS s, avg(quantity) AS q, avg(tax) AS t FROM features GROUP BY 1),
    d AS (SELECT f.rid, f.label = k.label AS own, k.n, greatest(0, quantity * quantity + tax * tax + k.s - 2 * (quantity * k.q + tax * k.t)) AS d FROM (SELECT *, row_number() OVER () AS rid FROM features) f, k),
    ab AS (SELECT rid, max(n) FILTER (own) AS n, max(d * n / greatest(n - 1, 1)) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM d GROUP BY 1),
    sil AS (SELECT CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM ab)
    SELECT round((sum(b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 4) AS calinski_harabasz, (SELECT round(avg(r), 6) FROM r) AS davies_bouldin, (SELECT round(avg(s), 6) FROM sil) AS silhouette FROM x""", "features"))
def clustering_internal_metrics(spark, d):
    return metrics.clustering_internal_metrics(features(spark, d), ["quantity", "tax"], "label")


@register(sql("SELECT round(avg(pow(price - quantity * 1000, 2)), 3) AS mse, round(avg(abs(price - quantity * 1000)), 6) AS mae FROM features", "features"))
def regression_metrics(spark, d):
    return metrics.regression_metrics(features(spark, d).withColumn("guess", F.col("quantity") * 1000), "price", "guess").withColumn("mse", F.round("mse", 3))


@register(sql("SELECT hash, CASE WHEN y = 1 THEN '-' ELSE printf('%.2f%%', tax * 100) END AS percent, CASE WHEN y = 1 THEN '-' ELSE printf('%.3f', tax) END AS number FROM features", "features"))
def metric_format(spark, d):
    value = F.when(F.col("y") == 1, -1.0).otherwise(F.col("tax"))
    return features(spark, d).select("hash", metrics.shown(value).alias("percent"), metrics.shown(value, "number").alias("number"))


# ---------------------------------------------------------------- explanation


def risk(x):
    """A model for the explanation queries: a logistic of quantity, discount and tax."""
    return 1 / (1 + F.exp(-(x["quantity"] * 0.05 + x["discount"] * 20.0 - x["tax"] * 10.0 - 2.0)))


X = ["quantity", "discount", "tax"]
_M = "1 / (1 + exp(-(({q}) * 0.05 + ({d}) * 20.0 - ({t}) * 10.0 - 2.0)))"
_BASE = _M.format(q="quantity", d="discount", t="tax")


def _moved(name: str, sign: int, delta: float = 0.1) -> str:
    step = f"CASE WHEN {name} = 0 THEN {delta} ELSE abs({name}) * {delta} END"
    value = f"{name} {'+' if sign > 0 else '-'} {step}"
    return f"greatest(0, least(1, {value}))" if name != "quantity" else f"greatest(0, {value})"


def _changed(**over: str) -> str:
    names = {"q": "quantity", "d": "discount", "t": "tax"}
    return _M.format(**{k: over.get(v, v) for k, v in names.items()})


def _fuzz_sql(delta: float = 0.1) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({_BASE} >= 0.5 AS INTEGER) AS class, round(avg({_changed(**{c: _moved(c, -1, delta)})} - {_BASE}), 6) AS down, round(avg({_changed(**{c: _moved(c, 1, delta)})} - {_BASE}), 6) AS up FROM features GROUP BY 2" for c in X)


@register()
def shapley_sampling(spark, d):
    rows = features(spark, d)
    mean = rows.agg(*(F.avg(c).alias(c) for c in X)).first().asDict()
    return explain.shapley(rows, risk, X, mean)


@register(sql("WITH v AS (SELECT 'quantity' AS feature, quantity / 50 AS value FROM features UNION ALL SELECT 'discount', discount FROM features UNION ALL SELECT 'tax', -tax FROM features UNION ALL SELECT 'price', price / 1000000 FROM features), m AS (SELECT feature, avg(abs(value)) AS i FROM v GROUP BY 1) SELECT feature, round(i, 6) AS importance, i >= avg(i) OVER () + stddev_pop(i) OVER () AS significant FROM m", "features"))
def importance_threshold(spark, d):
    cells = [F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in (("quantity", F.col("quantity") / 50), ("discount", F.col("discount")), ("tax", -F.col("tax")), ("price", F.col("price") / 1_000_000))]
    return explain.importance_threshold(features(spark, d).select(F.explode(F.array(*cells)).alias("c")).select("c.*"))


@register(sql("WITH i AS (SELECT 'quantity' AS feature, avg(quantity) / 50 AS i FROM features UNION ALL SELECT 'discount', avg(discount) FROM features UNION ALL SELECT 'tax', avg(tax) FROM features UNION ALL SELECT 'price', avg(price) / 10000000 FROM features), c AS (SELECT CASE feature WHEN 'quantity' THEN 'size' WHEN 'price' THEN 'money' ELSE 'rates' END AS category, sum(i) AS s FROM i GROUP BY 1), h AS (SELECT category, s / sum(s) OVER () AS share FROM c) SELECT CASE WHEN share < 0.02 THEN 'Other' ELSE category END AS category, round(sum(share), 6) AS share FROM h GROUP BY 1", "features"))
def category_profile(spark, d):
    row = features(spark, d).agg(*(F.avg(c).alias(c) for c in COLUMNS))
    cells = [F.struct(F.lit(n).alias("feature"), v.alias("importance")) for n, v in (("quantity", F.col("quantity") / 50), ("discount", F.col("discount")), ("tax", F.col("tax")), ("price", F.col("price") / 10_000_000))]
    known = spark.createDataFrame([("quantity", "size"), ("price", "money"), ("discount", "rates"), ("tax", "rates")], "feature string, category string")
    return explain.category_profile(row.select(F.explode(F.array(*cells)).alias("c")).select("c.*"), known)


@register(sql(f"SELECT hash, round({_moved('quantity', 1)}, 6) AS quantity, round({_moved('discount', -1)}, 6) AS discount, CAST(round(part + greatest(1, abs(part) * 0.1)) AS DOUBLE) AS part FROM features WHERE part > 0", "features"))
def perturb_feature(spark, d):
    rows = features(spark, d).where("part > 0")
    return rows.select("hash", F.round(explain.perturbed(F.col("quantity"), 0.1, True, name="quantity"), 6).alias("quantity"), F.round(explain.perturbed(F.col("discount"), 0.1, False, name="discount"), 6).alias("discount"), explain.perturbed(F.col("part"), 0.1, True, "bigint").alias("part"))


@register(sql("WITH s AS (SELECT stddev_pop(quantity) AS q, stddev_pop(discount) AS d FROM features) SELECT hash, round(greatest(0, quantity - 2 * q), 6) AS quantity, round(greatest(0, least(1, discount + 2 * d)), 6) AS discount FROM features, s", "features"))
def perturb_sigma(spark, d):
    """Moves by two standard deviations."""
    rows = features(spark, d)
    spread = rows.agg(F.stddev_pop("quantity").alias("q"), F.stddev_pop("discount").alias("d"))
    moved = rows.join(F.broadcast(spread))  # one row
    return moved.select("hash", F.round(explain.perturbed(F.col("quantity"), 2, False, name="quantity", sigma=F.col("q")), 6).alias("quantity"), F.round(explain.perturbed(F.col("discount"), 2, True, name="discount", sigma=F.col("d")), 6).alias("discount"))


@register(sql(_fuzz_sql(), "features"))
def fuzz_features(spark, d):
    return explain.fuzz(features(spark, d), risk, X)


@register()
def bootstrap_ci(spark, d):
    return explain.bootstrap(features(spark, d), risk, X, runs=50)


@register(sql("WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({dl} AS DOUBLE) AS delta, round(greatest(abs(avg({_changed(**{c: _moved(c, -1, dl)})} - {_BASE})), abs(avg({_changed(**{c: _moved(c, 1, dl)})} - {_BASE}))), 6) AS impact FROM features" for c in X for dl in (0.1, 0.25, 0.5, 1.0)) + ") SELECT *, CAST(row_number() OVER (PARTITION BY delta ORDER BY impact DESC, feature) AS INTEGER) AS rank FROM m", "features"))
def multi_delta_stability(spark, d):
    return explain.stability(features(spark, d), risk, X)


@register(sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(greatest(" + ", ".join(f"avg(abs(({_changed(**{a: _moved(a, sa), b: _moved(b, sb)})} - {_BASE}) - ({_changed(**{a: _moved(a, sa)})} - {_BASE}) - ({_changed(**{b: _moved(b, sb)})} - {_BASE})))" for sa in (-1, 1) for sb in (-1, 1)) + "), 6) AS interaction FROM features" for a, b in (("discount", "quantity"), ("discount", "tax"), ("quantity", "tax"))), "features"))
def pairwise_interactions(spark, d):
    return explain.interactions(features(spark, d), risk, X)


@register(sql(f"SELECT round(avg(CAST(m < 0.01 AS INTEGER)), 6) AS no_impact FROM (SELECT feature, max(greatest(abs(down), abs(up))) AS m FROM ({_fuzz_sql()}) GROUP BY 1)", "features"))
def no_impact_share(spark, d):
    return explain.no_impact_share(explain.fuzz(features(spark, d), risk, X))


@register()
def shapley_trees(spark, d):
    rows = features(spark, d)
    return shapley.tree_values(models.train(rows, "rf", COLUMNS, "y", search=False), rows, COLUMNS)  # what a row costs grows with the leaves


@register()
def shapley_linear(spark, d):
    rows = features(spark, d)
    return shapley.linear_values(models.train(rows, "lr", COLUMNS, "y"), rows, COLUMNS)


# ---------------------------------------------------------------- streams


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    # A table may be one file or a folder of files; both match.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@register("SELECT hash, event_id, label FROM (SELECT user_id AS hash, event_id, if(event_type = 'click', '?', event_type) AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'click', event_id) AS k FROM events) WHERE k = 1")
def stream_update(spark, d):
    label = F.when(F.col("event_type") == "click", "?").otherwise(F.col("event_type"))
    rows = _event_stream(spark, d).select(F.col("user_id").alias("hash"), "event_id", label.alias("label"))
    return updates.upsert_batches(spark, rows, "event_id")


def _vote_stream(spark, d):
    return _event_stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("hash"), F.col("event_type").alias("label"), "event_id")


_STREAM_COUNTS = "SELECT date_trunc('day', ts) AS start, user_id AS hash, event_type AS label, count(*) AS n, min(event_id) AS first_rank FROM events WHERE ts IS NOT NULL GROUP BY ALL"


@register(f"SELECT CAST(start AS VARCHAR) AS start, hash, label, n FROM ({_STREAM_COUNTS})")
def stream_votes(spark, d):
    counts, _ = updates.windowed_votes(spark, _vote_stream(spark, d), "ts", "1 day", "event_id")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "hash", "label", "n")


@register(f"""
    WITH c AS ({_STREAM_COUNTS}), k AS (SELECT *, sum(n) OVER (PARTITION BY start, hash) AS voters FROM c), b AS (SELECT *, max(n) OVER (PARTITION BY start, hash) AS best FROM k),
    g AS (SELECT start, hash, any_value(best) AS best, any_value(voters) AS voters, list(label ORDER BY first_rank) FILTER (n = best) AS fs FROM b GROUP BY 1, 2),
    l AS (SELECT *, list_filter(fs, lambda x: length(x) = list_max(list_transform(fs, lambda y: length(y))))[1] AS long FROM g)
    SELECT CAST(start AS VARCHAR) AS start, hash, CASE WHEN best < voters // 2 + 1 THEN '-' WHEN len(fs) = 1 THEN fs[1] WHEN len(list_filter(fs, lambda x: NOT contains(long, x))) = 0 THEN long ELSE '?' END AS label, CAST(best AS BIGINT) AS best FROM l""")
def stream_decisions(spark, d):
    _, decided = updates.windowed_votes(spark, _vote_stream(spark, d), "ts", "1 day", "event_id")
    return decided.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "hash", "label", "best")
