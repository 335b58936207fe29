"""Named queries over the test tables, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import clustering as C
from vicinal.operators import knn as K
from vicinal.operators import mixtures as M
from vicinal.operators import outliers as O
from vicinal.operators import statistics as S
from vicinal.operators import subspaces as U

Query = Callable[[SparkSession, str], DataFrame]

#: Digits to which both sides round: engines add in different orders.
DIGITS = 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def queries_of(spark: SparkSession, sf_dir: str, every: int = 10) -> DataFrame:
    """The query side of the joins of two tables: the points whose id is divisible by ``every``."""
    return embeddings(spark, sf_dir).where(F.col("id") % every == 0)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("v"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), DIGITS) for c in columns})


def _scores(find: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: rounded(find(embeddings(spark, d)).select("id", "score"), "score")


def _join(metric: str) -> Query:
    return lambda spark, d: rounded(K.knn_join(queries_of(spark, d), embeddings(spark, d), 5, metric).select("q", "s", "rank", "d"), "d")


def _whole_join(metric: str) -> Query:
    return lambda spark, d: rounded(K.knn_join(embeddings(spark, d), embeddings(spark, d), 5, metric).select("q", "s", "rank", "d"), "d")


def _metric(name: str, f: V.Metric) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = embeddings(spark, d)
        # Each point with the next by id: an equi-join.
        other = e.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
        return e.join(other, "id").select("id", F.round(f(F.col("v"), F.col("w")), DIGITS).alias(name))

    return run


E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
D = f"{E}, d AS (SELECT a.id AS q, b.id AS s, {DIST} AS d FROM e a, e b)"
R = f"{D}, r AS (SELECT q, s, d, row_number() OVER (PARTITION BY q ORDER BY d, s) AS rank, rank() OVER (PARTITION BY q ORDER BY d) AS tie FROM d)"
RX = f"{D}, r AS (SELECT q, s, d, row_number() OVER (PARTITION BY q ORDER BY d, s) AS rank, rank() OVER (PARTITION BY q ORDER BY d) AS tie FROM d WHERE q <> s)"
#: By its power series: the functions of the queries are made of other terms.
ERF = "(exp(-({x}) * ({x})) * list_sum(list_transform(range(90), lambda n: pow({x}, 2 * n + 1) / gamma(n + 1.5))))"
AUC = "t AS (SELECT q, a.label, d, a.label = b.label AS p FROM d JOIN e a ON a.id = q JOIN e b ON b.id = s), auc AS (SELECT q, label, sum(CASE WHEN p THEN 0 ELSE bp + gp / 2.0 END) / (max(tp) * (count(*) - max(tp)))::DOUBLE AS auc FROM (SELECT *, count(*) FILTER (p) OVER (PARTITION BY q ORDER BY d) - count(*) FILTER (p) OVER (PARTITION BY q, d) AS bp, count(*) FILTER (p) OVER (PARTITION BY q, d) AS gp, count(*) FILTER (p) OVER (PARTITION BY q) AS tp FROM t) GROUP BY 1, 2)"
X = "x AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
P = "p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part)"


def _lof(neighbours: str, skip: str) -> str:
    return f"""WITH {D}, t AS (SELECT q, s, d, rank() OVER (PARTITION BY q ORDER BY d) AS tie FROM d),
n AS (SELECT q, s, d FROM t WHERE tie <= {neighbours}), kd AS (SELECT q, max(d) AS kd FROM n GROUP BY q),
m AS (SELECT n.q, n.s, greatest(n.d, kd.kd) AS reach FROM n JOIN kd ON n.s = kd.q WHERE {skip}),
lrd AS (SELECT q, count(*) / sum(reach) AS lrd FROM m GROUP BY q)
SELECT m.q AS id, round(avg(b.lrd) / min(a.lrd), {DIGITS}) AS score FROM m JOIN lrd a ON m.q = a.q JOIN lrd b ON m.s = b.q GROUP BY m.q"""


def _knn_sql(dist: str) -> str:
    return f"""WITH {E}, d AS (SELECT a.id AS q, b.id AS s, {dist} AS d FROM e a, e b WHERE a.id % 10 = 0)
SELECT q, s, rank, round(d, {DIGITS}) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, s) AS rank FROM d) WHERE rank <= 5"""


def _agg(inner: str) -> str:
    return f"list_transform(list_zip(a.v, b.v), lambda z: {inner})"


COS = f"(list_sum({_agg('z[1] * z[2]')}) / (sqrt(list_sum(list_transform(a.v, lambda z: z * z))) * sqrt(list_sum(list_transform(b.v, lambda z: z * z)))))"
MEASURES = {
    "euclidean": DIST,
    "squared_euclidean": f"list_sum({_agg('(z[1] - z[2]) * (z[1] - z[2])')})",
    "manhattan": f"list_sum({_agg('abs(z[1] - z[2])')})",
    "maximum": f"list_max({_agg('abs(z[1] - z[2])')})",
    "minimum": f"list_min({_agg('abs(z[1] - z[2])')})",
    "cosine": f"greatest(0, 1 - {COS})",
    "arc_cosine": f"acos(least(1, greatest(-1, {COS})))",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact 5-nearest-neighbour self-join of the embeddings."""
    e = embeddings(spark, sf_dir)
    return rounded(K.knn_join(e, e, 5).select("q", "s", "rank", "d"), "d")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the plane of size and price over 25."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 25).alias("v"))


def dbscan_query(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of parts in the plane of size and price over 25."""
    return C.dbscan(plane(spark, d), 1.0, 4)


def value_scalings(spark: SparkSession, d: str) -> DataFrame:
    """The scalings of single values, of parts' sizes."""
    x = F.col("p_size").cast("double")
    forms = {"linear": V.scale_linear(x, 0.5, 3.0), "clipped": V.scale_clip(x, 10.0, 40.0), "power": V.scale_gamma(x, 1.5), "minus_log": V.scale_minus_log(x), "from_similarity": V.minus_log_similarity(x / 50)}
    return _table(spark, d, "part").select("p_partkey", *[F.round(c, DIGITS).alias(n) for n, c in forms.items()])


def zorder_recall(spark: SparkSession, d: str, every: int = 10) -> DataFrame:
    """The share of the exact neighbours that the join along z-curves finds in the plane of size and price, for ids divisible by ``every``."""
    p = parts(spark, d)
    q = p if every == 1 else p.where(F.col("id") % every == 0)
    exact = K.knn_join(q, p, 5).select("q", "s")
    near = K.zorder_knn_join(q, p, 5, shifts=4).select("q", "s")
    return exact.join(near.withColumn("hit", F.lit(1)), ["q", "s"], "left").agg(F.round(F.count("hit") / F.count(F.lit(1)), 3).alias("recall"))


def queries() -> dict[str, Query]:
    part_price = lambda spark, d: _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))

    def toxic(spark: SparkSession, d: str) -> DataFrame:
        docs, labels = _table(spark, d, "documents"), _table(spark, d, "labels")
        return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), (F.col("toxic") == 1).alias("positive"))

    def baskets(spark: SparkSession, d: str) -> DataFrame:
        lines, part = _table(spark, d, "lineitem"), _table(spark, d, "part")
        return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item"))

    return {
        "knn_self_join": flagship,
        **{f"knn_join_{m}": _join(m) for m in ("euclidean", "squared_euclidean", "manhattan", "maximum", "cosine")},
        # Whole tables; the queries that their SQL holds to a part of the ids stay beside them.
        **{f"knn_join_{m}_all": _whole_join(m) for m in ("squared_euclidean", "manhattan", "maximum", "cosine")},
        "knn_join_ties_all": lambda s, d: rounded(K.knn_join(parts(s, d), parts(s, d), 5, "maximum", ties=True).select("q", "s", "d"), "d"),
        "reverse_knn_all": lambda s, d: rounded(K.reverse_knn(embeddings(s, d), embeddings(s, d).select("id"), 5).select("q", "s", "d"), "d"),
        "zorder_recall_all": lambda s, d: zorder_recall(s, d, 1),
        "knn_join_ties": lambda s, d: rounded(K.knn_join(parts(s, d).where("id % 20 = 0"), parts(s, d), 5, "maximum", ties=True).select("q", "s", "d"), "d"),
        "knn_query": lambda s, d: rounded(K.knn_query(embeddings(s, d), [0.0] * 64, 10).select("s", "d"), "d"),
        "range_join": lambda s, d: rounded(K.range_join(embeddings(s, d), embeddings(s, d), 1.1).select("q", "s", "d"), "d"),
        "reverse_knn": lambda s, d: rounded(K.reverse_knn(embeddings(s, d), queries_of(s, d).select("id"), 5).select("q", "s", "d"), "d"),
        "pairwise_distances": lambda s, d: K.pairwise_total(embeddings(s, d)).select("pairs", F.round("total", 3).alias("total")),
        "zorder_recall": zorder_recall,
        "z_values": lambda s, d: _table(s, d, "part").select("p_partkey", V.z_order_2d(F.col("p_size"), F.floor("p_retailprice")).alias("z")),
        "quantize": lambda s, d: _table(s, d, "part").select("p_partkey", V.quantize(F.col("p_retailprice")).alias("price")),
        **{f"metric_{m}": _metric(m, f) for m, f in V.METRICS.items()},
        "knn_outlier": _scores(lambda e: O.knn_outlier(e, 10)),
        "knn_weight_outlier": _scores(lambda e: O.knn_weight_outlier(e, 10)),
        "lof": _scores(lambda e: O.lof(e, 10)),
        "optics_of": _scores(lambda e: O.optics_of(e, 10)),
        "ldof": _scores(lambda e: O.ldof(e, 8)),
        "loop": _scores(lambda e: O.loop(e, 10)),
        "db_score": _scores(lambda e: O.db_score(e, 1.2)),
        "db_outliers": _scores(lambda e: O.db_outliers(e, 1.2, 0.9)),
        "gaussian_model": lambda s, d: O.gaussian_model(parts(s, d)).select("id", F.round(F.col("score") * 1e6, 4).alias("score")),
        "reference_based": lambda s, d: rounded(O.reference_based(parts(s, d), [[0.0, 0.0], [50.0, 0.0]], 5), "score"),
        "centroid": lambda s, d: rounded(S.centroid(embeddings(s, d)), "mean"),
        "attribute_ranges": lambda s, d: rounded(S.attribute_ranges(embeddings(s, d)), "low", "high"),
        "attribute_moments": lambda s, d: rounded(S.attribute_moments(embeddings(s, d)), "mean", "variance", "running_variance"),
        "covariance": lambda s, d: S.covariance(parts(s, d)).select("i", "j", F.round("c", 3).alias("c")),
        "normalize_range": lambda s, d: rounded(S.normalize_range(parts(s, d)), "x"),
        "normalize_variance": lambda s, d: rounded(S.normalize_variance(parts(s, d)), "x"),
        "histogram": lambda s, d: S.histogram(_table(s, d, "part"), "p_retailprice", 20, 0.0, 2500.0),
        "linear_regression": lambda s, d: rounded(S.linear_regression(_table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), "slope", "intercept", "r2"),
        "linear_scaling": lambda s, d: rounded(S.linear_scaling(part_price(s, d)), "score"),
        "sqrt_scaling": lambda s, d: rounded(S.sqrt_scaling(part_price(s, d)), "score"),
        "deviation_scaling": lambda s, d: rounded(S.deviation_scaling(part_price(s, d)), "score"),
        "top_k_scaling": lambda s, d: S.top_k_scaling(part_price(s, d), 10),
        "frequent_itemsets": lambda s, d: S.apriori(baskets(s, d), 20, 2),  # its SQL stops at pairs
        "frequent_itemsets_all": lambda s, d: S.apriori(baskets(s, d), 20),
        "roc_auc": lambda s, d: rounded(S.roc_auc(toxic(s, d)), "auc"),
        "pair_counting": lambda s, d: rounded(S.pair_counting(embeddings(s, d).select("id", F.col("label").alias("cluster")), embeddings(s, d).select("id", (F.col("id") % 7).alias("cluster"))), "f_measure"),
        "cluster_by_label": lambda s, d: C.by_label(embeddings(s, d), "id", "label"),
        "label_hierarchy": lambda s, d: C.by_label_hierarchy(_table(s, d, "documents"), "source"),
        "kmeans": lambda s, d: C.kmeans(parts(s, d), 3, 1, start=[[10.0, 950.0], [25.0, 1300.0], [40.0, 1700.0]]),
        "kmeans_converged": lambda s, d: C.kmeans(parts(s, d), 3, start=[[10.0, 950.0], [25.0, 1300.0], [40.0, 1700.0]]),  # the SQL of kmeans stops after one round
        "dbscan": dbscan_query,
        "single_link": lambda s, d: C.single_link(embeddings(s, d), 0.8),
        "snn_similarity": lambda s, d: C.snn_similarity(embeddings(s, d), 10),
        "snn_clustering": lambda s, d: C.snn_clustering(embeddings(s, d), 10, 4, 4),
        "single_link_merges": lambda s, d: rounded(C.single_link_merges(embeddings(s, d), 1.1), "w"),
        "optics_merges": lambda s, d: rounded(C.optics_merges(embeddings(s, d), 1.2, 4), "w"),
        "inflo": _scores(lambda e: O.inflo(e, 10, 0.7)),
        "loci": lambda s, d: rounded(O.loci(plane(s, d), 3.0, 10), "score"),
        "abod": _scores(lambda e: O.abod(e, 8)),
        "sod": _scores(lambda e: O.sod(e, 10, 8)),
        "knn_preferences": lambda s, d: U.knn_preferences(embeddings(s, d), 0.02, 10).select("id", F.concat_ws(",", "dims").alias("dims")),
        "predecon": lambda s, d: U.predecon(plane(s, d), 2.0, 3, 1.2, 1, 4.0),
        "four_c": lambda s, d: U.four_c(plane(s, d), 2.0, 3, 0.5, 1, 4.0),
        "local_pca": lambda s, d: rounded(U.local_pca(plane(s, d), K.knn_join(plane(s, d), plane(s, d), 8)).select("id", F.col("eigenvalues")[0].alias("first"), F.col("eigenvalues")[1].alias("second")), "first", "second"),
        "dense_units": lambda s, d: U.dense_units(parts(s, d), 10, 0.012),
        "clique": lambda s, d: U.clique(parts(s, d), 10, 0.012),
        "em": lambda s, d: rounded(M.em(plane(s, d), 3, start=[[10.0, 40.0], [25.0, 55.0], [40.0, 70.0]]), "p"),
        "em_outlier": lambda s, d: rounded(M.em_outlier(plane(s, d), 3, start=[[10.0, 40.0], [25.0, 55.0], [40.0, 70.0]]), "score"),
        "gamma_scaling": lambda s, d: rounded(S.gamma_scaling(part_price(s, d)), "score"),
        "distance_statistics": lambda s, d: rounded(S.distance_statistics(embeddings(s, d), "label", 20, 2.0), "low", "high", "total"),
        "outlier_histogram": lambda s, d: S.outlier_histogram(toxic(s, d), 20, 0.0, 4000.0),
        "sqrt_deviation_scaling": lambda s, d: rounded(S.sqrt_deviation_scaling(part_price(s, d)), "score"),
        "minus_log_scaling": lambda s, d: rounded(S.minus_log_scaling(part_price(s, d)), "score"),
        "minus_log_gamma_scaling": lambda s, d: rounded(S.minus_log_gamma_scaling(part_price(s, d)), "score"),
        "multiplicative_inverse_scaling": lambda s, d: rounded(S.multiplicative_inverse_scaling(part_price(s, d)), "score"),
        "value_scalings": value_scalings,
        "error_function": lambda s, d: _table(s, d, "part").select("p_partkey", F.round(V.erf(F.col("p_size") / 12.0 - 2), DIGITS).alias("erf"), F.round(V.erfc(F.col("p_size") / 12.0 - 2), DIGITS).alias("erfc"), F.round(V.normal_share(F.col("p_size").cast("double"), 25.0, 10.0), DIGITS).alias("share"), F.round(V.normal_density(F.col("p_size").cast("double"), 25.0, 10.0), DIGITS).alias("density")),
        "multiple_regression": lambda s, d: rounded(S.multiple_regression(_table(s, d, "lineitem").withColumn("one", F.lit(1.0)), ["one", "l_quantity", "l_discount"], "l_extendedprice").select(*[F.round(F.col("coefficients")[i], 3).alias(f"b{i}") for i in range(3)], F.round("r2", DIGITS).alias("r2")), "r2"),
        "kernel_density": lambda s, d: rounded(S.kernel_density(part_price(s, d), "score", "epanechnikov").select("id", (F.col("density") * 1e3).alias("density"), "variance"), "density", "variance"),
        "knn_distance_order": lambda s, d: rounded(S.knn_distance_order(embeddings(s, d), 5), "d"),
        "ranking_quality": lambda s, d: rounded(S.ranking_quality(embeddings(s, d), "label"), "auc"),
        "ranking_quality_histogram": lambda s, d: S.histogram(S.ranking_quality(embeddings(s, d), "label"), "auc", 100, 0.0, 1.0),
        "gaussian_uniform_mixture": lambda s, d: rounded(O.gaussian_uniform_mixture(plane(s, d), 0.0001), "score"),
        "reference_points_star": lambda s, d: s.createDataFrame([(n, *p) for n, p in enumerate(S.reference_points(parts(s, d), "star"))], "n int, x double, y double").select("n", F.round("x", DIGITS).alias("x"), F.round("y", DIGITS).alias("y")),
    }


def oracle_sql() -> dict[str, str]:
    r6 = lambda c: f"round({c}, {DIGITS}) AS score"
    z = "(score - m) / (3.0 * sd * sqrt(2.0))"
    pl = "(plof - 1) / (nplof * sqrt(2.0))"
    nearest_mean = lambda: "CASE WHEN " + " AND ".join(f"d0 <= d{i}" for i in (1, 2)) + " THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
    dist3 = lambda cs: ", ".join(f"(x - {a}) * (x - {a}) + (y - {b}) * (y - {b}) AS d{i}" for i, (a, b) in enumerate(cs))
    return {
        "knn_self_join": f"WITH {R} SELECT q, s, rank, round(d, {DIGITS}) AS d FROM r WHERE rank <= 5",
        **{f"knn_join_{m}": _knn_sql(MEASURES[m]) for m in ("euclidean", "squared_euclidean", "manhattan", "maximum", "cosine")},
        "knn_join_ties": f"WITH {P}, d AS (SELECT a.id AS q, b.id AS s, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d FROM p a, p b WHERE a.id % 20 = 0) SELECT q, s, round(d, {DIGITS}) AS d FROM (SELECT *, rank() OVER (PARTITION BY q ORDER BY d) AS tie FROM d) WHERE tie <= 5",
        "knn_query": f"WITH {E} SELECT s, round(d, {DIGITS}) AS d FROM (SELECT id AS s, sqrt(list_sum(list_transform(v, lambda z: z * z))) AS d, rank() OVER (ORDER BY sqrt(list_sum(list_transform(v, lambda z: z * z)))) AS tie FROM e) WHERE tie <= 10",
        "range_join": f"WITH {D} SELECT q, s, round(d, {DIGITS}) AS d FROM d WHERE d <= 1.1",
        "reverse_knn": f"WITH {R} SELECT s AS q, q AS s, round(d, {DIGITS}) AS d FROM r WHERE tie <= 5 AND s % 10 = 0",
        "pairwise_distances": f"WITH {D} SELECT count(*) AS pairs, round(sum(d), 3) AS total FROM d WHERE q <= s",
        "quantize": "SELECT p_partkey, trunc((trunc(p_retailprice::FLOAT)::INT * 1000)::FLOAT + (p_retailprice::FLOAT - trunc(p_retailprice::FLOAT)::INT::FLOAT) * 1000::FLOAT)::INT AS price FROM part",
        "z_values": "SELECT p_partkey, list_sum(list_transform(range(31), lambda i: (((p_size::BIGINT >> i) & 1) << (2 * i + 1)) + (((floor(p_retailprice)::BIGINT >> i) & 1) << (2 * i))))::BIGINT AS z FROM part",
        **{f"metric_{m}": f"WITH {E} SELECT a.id, round({f}, {DIGITS}) AS {m} FROM e a JOIN e b ON b.id = a.id + 1" for m, f in MEASURES.items()},
        "knn_outlier": f"WITH {R} SELECT q AS id, {r6('d')} FROM r WHERE rank = 10",
        "knn_weight_outlier": f"WITH {R} SELECT q AS id, {r6('sum(d)')} FROM r WHERE rank <= 10 GROUP BY q",
        "lof": _lof("11", "n.q <> n.s"),
        "optics_of": _lof("10", "true"),
        "ldof": f"WITH {RX}, n AS (SELECT q, s, d FROM r WHERE rank <= 8), own AS (SELECT q, avg(d) AS own FROM n GROUP BY q), bt AS (SELECT a.q, avg(d.d) AS bt FROM n a JOIN n b ON a.q = b.q AND a.s < b.s JOIN d ON d.q = a.s AND d.s = b.s GROUP BY a.q) SELECT own.q AS id, {r6('own / bt')} FROM own JOIN bt USING (q)",
        "loop": f"WITH {RX}, n AS (SELECT q, s, d FROM r WHERE rank <= 10), pd AS (SELECT q, 2.0 * sqrt(avg(d * d)) AS pd FROM n GROUP BY q), pl AS (SELECT n.q, greatest(min(a.pd) / avg(b.pd), 1.0) AS plof FROM n JOIN pd a ON n.q = a.q JOIN pd b ON n.s = b.q GROUP BY n.q), sc AS (SELECT *, 2.0 * sqrt(avg((plof - 1) * (plof - 1)) OVER ()) AS nplof FROM pl) SELECT q AS id, {r6('CASE WHEN nplof > 0 THEN greatest(0.0, ' + ERF.format(x=pl) + ') ELSE 0.0 END')} FROM sc",
        "db_score": f"WITH {D} SELECT q AS id, {r6('1 - count(*) / (SELECT count(*) FROM e)::DOUBLE')} FROM d WHERE d <= 1.2 GROUP BY q",
        "db_outliers": f"WITH {D} SELECT q AS id, CASE WHEN count(*) < floor((SELECT count(*) FROM e) * (1 - 0.9)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM d WHERE d <= 1.2 GROUP BY q",
        "gaussian_model": f"WITH {P}, m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS c FROM p) SELECT id, round(1e6 / sqrt(4 * pi() * pi() * (a * c - b * b)) * exp(-0.5 * ((x - mx) * (x - mx) * c - 2 * (x - mx) * (y - my) * b + (y - my) * (y - my) * a) / (a * c - b * b)), 4) AS score FROM p, m",
        "centroid": f"WITH {X} SELECT dim, round(avg(x), {DIGITS}) AS mean FROM x GROUP BY dim",
        "attribute_ranges": f"WITH {X} SELECT dim, round(min(x), {DIGITS}) AS low, round(max(x), {DIGITS}) AS high FROM x GROUP BY dim",
        "attribute_moments": f"WITH {X} SELECT dim, round(avg(x), {DIGITS}) AS mean, round(var_pop(x), {DIGITS}) AS variance, round(sum(x * x) / (count(*) - 1) - avg(x) * avg(x), {DIGITS}) AS running_variance FROM x GROUP BY dim",
        "covariance": f"WITH {P}, m AS (SELECT covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS c FROM p) SELECT 0 AS i, 0 AS j, round(a, 3) AS c FROM m UNION ALL SELECT 0, 1, round(b, 3) FROM m UNION ALL SELECT 1, 1, round(c, 3) FROM m",
        "normalize_range": f"WITH {P}, l AS (SELECT id, 0 AS dim, x FROM p UNION ALL SELECT id, 1, y FROM p) SELECT id, dim, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), {DIGITS}) AS x FROM l WINDOW w AS (PARTITION BY dim)",
        "normalize_variance": f"WITH {P}, l AS (SELECT id, 0 AS dim, x FROM p UNION ALL SELECT id, 1, y FROM p) SELECT id, dim, round((x - avg(x) OVER w) / sqrt(sum(x * x) OVER w / (count(*) OVER w - 1) - avg(x) OVER w * avg(x) OVER w), {DIGITS}) AS x FROM l WINDOW w AS (PARTITION BY dim)",
        "histogram": "SELECT (CASE WHEN p_retailprice = 2500.0 THEN 19 ELSE floor(p_retailprice / 125.0) END)::INT AS bin, count(*) AS n FROM part WHERE p_retailprice BETWEEN 0 AND 2500 GROUP BY 1",
        "linear_regression": f"SELECT round(regr_slope(l_extendedprice, l_quantity), {DIGITS}) AS slope, round(regr_intercept(l_extendedprice, l_quantity), {DIGITS}) AS intercept, round(regr_r2(l_extendedprice, l_quantity), {DIGITS}) AS r2 FROM lineitem",
        "linear_scaling": f"SELECT p_partkey AS id, {r6('least(1.0, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()))')} FROM part",
        "sqrt_scaling": f"SELECT p_partkey AS id, {r6('least(1.0, sqrt(p_retailprice - min(p_retailprice) OVER ()) / sqrt(max(p_retailprice) OVER () - min(p_retailprice) OVER ()))')} FROM part",
        "deviation_scaling": f"WITH s AS (SELECT p_partkey AS id, p_retailprice AS score, avg(p_retailprice) OVER () AS m, stddev_pop(p_retailprice) OVER () AS sd FROM part) SELECT id, {r6('CASE WHEN score <= m THEN 0.0 ELSE greatest(0.0, ' + ERF.format(x=z) + ') END')} FROM s",
        "top_k_scaling": "SELECT p_partkey AS id, CASE WHEN p_retailprice >= (SELECT min(p_retailprice) FROM (SELECT p_retailprice FROM part ORDER BY p_retailprice DESC LIMIT 10)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part",
        "frequent_itemsets": "WITH b AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT item AS items, count(*) AS support FROM b GROUP BY 1 HAVING count(*) >= 20 UNION ALL SELECT a.item || ',' || c.item, count(*) FROM b a JOIN b c ON a.basket = c.basket AND a.item < c.item GROUP BY 1 HAVING count(*) >= 20",
        "roc_auc": f"WITH t AS (SELECT n_chars AS s, toxic = 1 AS p FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, count(*) FILTER (p) AS gp, count(*) FILTER (NOT p) AS gn FROM t GROUP BY s), c AS (SELECT *, coalesce(sum(gp) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp FROM g) SELECT round(sum(gn * (bp + gp / 2.0)) / (sum(gp) * sum(gn)), {DIGITS}) AS auc FROM c",
        "pair_counting": f"WITH c AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), t AS (SELECT (SELECT sum(n * (n + 1) / 2) FROM c) AS bo, (SELECT sum(n * (n + 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS f, (SELECT sum(n * (n + 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS s) SELECT round(2.0 * bo / (2.0 * bo + (f - bo) + (s - bo)), {DIGITS}) AS f_measure FROM t",
        "cluster_by_label": "SELECT vec_id AS id, label::VARCHAR AS cluster FROM embeddings",
        "label_hierarchy": "WITH l AS (SELECT DISTINCT source AS x FROM documents WHERE source IS NOT NULL) SELECT a.x AS parent, b.x AS child FROM l a JOIN l b ON a.x <> b.x AND starts_with(b.x, a.x)",
        "kmeans": f"WITH {P}, a AS (SELECT *, {dist3([(10.0, 950.0), (25.0, 1300.0), (40.0, 1700.0)])} FROM p), m AS (SELECT {nearest_mean()} AS c, avg(x) AS mx, avg(y) AS my FROM a GROUP BY 1), b AS (SELECT id, c, (x - mx) * (x - mx) + (y - my) * (y - my) AS d FROM p, m) SELECT id, c AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, c) AS r FROM b) WHERE r = 1",
        "inflo": f"WITH {RX}, n AS (SELECT q, s, d FROM r WHERE rank <= 10), den AS (SELECT q, 1 / max(d) AS den FROM n GROUP BY q), mu AS (SELECT a.q, count(*) AS c FROM n a JOIN n b ON a.q = b.s AND a.s = b.q GROUP BY a.q), i AS (SELECT q, s FROM n UNION SELECT s, q FROM n), m AS (SELECT i.q, avg(den) AS mean FROM i JOIN den ON i.s = den.q GROUP BY i.q) SELECT q AS id, {r6('CASE WHEN coalesce(c, 0) >= 0.7 * 10 THEN 1.0 ELSE mean / den END')} FROM den JOIN m USING (q) LEFT JOIN mu USING (q)",
        "loci": f"WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 25 AS y FROM part), near AS (SELECT a.id AS p, b.id AS s, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3), n AS (SELECT * FROM near WHERE d <= 3), rad AS (SELECT DISTINCT p, r FROM (SELECT p, d AS r FROM n UNION ALL SELECT p, d / 0.5 FROM n) WHERE r <= 3), c AS (SELECT rad.p, rad.r, a.s, count(*) AS c FROM rad JOIN n a ON a.p = rad.p AND a.d <= rad.r JOIN n b ON b.p = a.s AND b.d <= 0.5 * rad.r GROUP BY 1, 2, 3), g AS (SELECT p, r, count(*) AS n, avg(c) AS mean, stddev_pop(c) AS sd, max(c) FILTER (s = p) AS own FROM c GROUP BY 1, 2) SELECT p AS id, {r6('coalesce(max((mean - own) / sd) FILTER (n >= 10 AND sd > 1e-12), 0.0)')} FROM g GROUP BY p",
        "abod": f"WITH {RX}, n AS (SELECT q, s, list_transform(list_zip(b.v, a.v), lambda z: z[1] - z[2]) AS v FROM r JOIN e a ON a.id = q JOIN e b ON b.id = s WHERE rank <= 8 AND d > 0), g AS (SELECT a.q, list_dot_product(a.v, b.v) AS num, list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v) AS den FROM n a JOIN n b ON a.q = b.q AND a.s <> b.s), h AS (SELECT q, num / den AS x, 1 / sqrt(den) AS w FROM g) SELECT q AS id, {r6('sum(w * x * x) / (sum(w) - 1) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w))')} FROM h GROUP BY q",
        "sod": f"WITH {RX}, {X}, n AS (SELECT q, s FROM r WHERE rank <= 10), sim AS (SELECT a.q, b.q AS s, count(*) AS c FROM n a JOIN n b ON a.s = b.s AND a.q <> b.q GROUP BY 1, 2), top AS (SELECT q, s FROM (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY c DESC, s) AS k FROM sim) WHERE k <= 8), sp AS (SELECT q, dim, avg(x) AS mean, var_pop(x) AS var FROM top JOIN x ON x.id = top.s GROUP BY 1, 2), bar AS (SELECT q, 1.1 * avg(var) AS bar FROM sp GROUP BY q), k AS (SELECT sp.q, sqrt(sum((x - mean) * (x - mean))) / count(*) AS score FROM sp JOIN bar ON bar.q = sp.q AND var < bar JOIN x ON x.id = sp.q AND x.dim = sp.dim GROUP BY sp.q) SELECT id, {r6('coalesce(score, 0.0)')} FROM e LEFT JOIN k ON k.q = e.id",
        "knn_preferences": f"WITH {R}, {X}, n AS (SELECT q, s FROM r WHERE rank <= 10), v AS (SELECT n.q, a.dim, avg((b.x - a.x) * (b.x - a.x)) AS var FROM n JOIN x b ON b.id = n.s JOIN x a ON a.id = n.q AND a.dim = b.dim GROUP BY 1, 2) SELECT q AS id, coalesce(string_agg(dim::VARCHAR, ',' ORDER BY dim) FILTER (var < 0.02), '') AS dims FROM v GROUP BY q",
        "local_pca": f"WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 25 AS y FROM part), r AS (SELECT a.id AS q, b.x, b.y, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS k FROM p a, p b), m AS (SELECT q, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS c FROM r WHERE k <= 8 GROUP BY q) SELECT q AS id, round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), {DIGITS}) AS first, round((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), {DIGITS}) AS second FROM m",
        "dense_units": f"WITH {P}, l AS (SELECT id, '0:' || floor((x - min(x) OVER ()) / ((max(x) OVER () + 0.0001 - min(x) OVER ()) / 10))::BIGINT AS a, '1:' || floor((y - min(y) OVER ()) / ((max(y) OVER () + 0.0001 - min(y) OVER ()) / 10))::BIGINT AS b FROM p), u AS (SELECT a AS unit, count(*) AS support FROM l GROUP BY 1 UNION ALL SELECT b, count(*) FROM l GROUP BY 1 UNION ALL SELECT a || ',' || b, count(*) FROM l GROUP BY 1) SELECT * FROM u WHERE support >= ceil(0.012 * (SELECT count(*) FROM p) - 1e-9)",
        "distance_statistics": f"WITH {D}, t AS (SELECT a.label = b.label AS same, least(floor(d / 0.1), 20)::INT AS bin, d FROM d JOIN e a ON a.id = q JOIN e b ON b.id = s WHERE q <> s) SELECT same, bin, count(*) AS n, round(min(d), {DIGITS}) AS low, round(max(d), {DIGITS}) AS high, round(sum(d), {DIGITS}) AS total FROM t GROUP BY 1, 2",
        "outlier_histogram": "SELECT (CASE WHEN n_chars = 4000 THEN 19 ELSE floor(n_chars / 200.0) END)::INT AS bin, count(*) AS n, sum(toxic = 1)::BIGINT AS positive FROM documents JOIN labels USING (doc_id) WHERE n_chars BETWEEN 0 AND 4000 GROUP BY 1",
        "sqrt_deviation_scaling": f"WITH a AS (SELECT p_partkey AS id, sqrt(p_retailprice - min(p_retailprice) OVER ()) AS score FROM part), s AS (SELECT id, score, avg(score) OVER () AS m, stddev_pop(score) OVER () AS sd FROM a) SELECT id, {r6('CASE WHEN score <= m THEN 0.0 ELSE greatest(0.0, ' + ERF.format(x=z) + ') END')} FROM s",
        "minus_log_scaling": f"WITH s AS (SELECT p_partkey AS id, -ln(p_retailprice / max(p_retailprice) OVER ()) AS x FROM part) SELECT id, {r6('x / max(x) OVER ()')} FROM s",
        "multiplicative_inverse_scaling": f"SELECT p_partkey AS id, {r6('min(p_retailprice) OVER () / p_retailprice')} FROM part",
        "value_scalings": f"SELECT p_partkey, round(p_size * 0.5 + 3, {DIGITS})::DOUBLE AS linear, least(40, greatest(10, p_size))::DOUBLE AS clipped, round(p_size * sqrt(p_size), {DIGITS}) AS power, round(-ln(p_size), {DIGITS}) AS minus_log, round(ln(50) - ln(p_size), {DIGITS}) AS from_similarity FROM part",
        "error_function": f"WITH p AS (SELECT p_partkey, p_size / 12.0::DOUBLE - 2 AS x, (p_size - 25) / (10 * sqrt(2.0)) AS z FROM part), e AS (SELECT p_partkey, z, {ERF.format(x='x')} AS e, {ERF.format(x='z')} AS s FROM p) SELECT p_partkey, round(e, {DIGITS}) AS erf, round(1 - e, {DIGITS}) AS erfc, round((1 + s) / 2, {DIGITS}) AS share, round(exp(-z * z) / (10 * sqrt(2 * pi())), {DIGITS}) AS density FROM e",
        "kernel_density": f"WITH p AS (SELECT p_partkey AS id, p_retailprice AS x FROM part), m AS (SELECT count(*) AS n, min(x) AS low, max(x) AS high, (max(x) - min(x)) / (1 + floor(ln(count(*)))) / 2 AS h FROM p), k AS (SELECT a.id, a.x, sum(0.75 * (1 - (b.x - a.x) * (b.x - a.x) / (h * h))) AS v FROM p a, p b, m WHERE abs(b.x - a.x) < h GROUP BY 1, 2), w AS (SELECT id, v, n, h, least(x + h, high) - greatest(x - h, low) AS w FROM k, m) SELECT id, round(v / (n * w / 2) * 1e3, {DIGITS}) AS density, round(2 * h / w, {DIGITS}) AS variance FROM w",
        "knn_distance_order": f"WITH {R} SELECT q AS id, round(d, {DIGITS}) AS d FROM r WHERE rank = 5",
        "ranking_quality": f"WITH {D}, {AUC} SELECT q AS id, label, round(auc, {DIGITS}) AS auc FROM auc",
        "ranking_quality_histogram": f"WITH {D}, {AUC} SELECT least(floor(auc / 0.01), 99)::INT AS bin, count(*) AS n FROM auc GROUP BY 1",
        "gaussian_uniform_mixture": f"WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 25 AS y FROM part), m AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS c FROM p), g AS (SELECT id, n, ln(a * c - b * b) AS det, ((x - mx) * (x - mx) * c - 2 * (x - mx) * (y - my) * b + (y - my) * (y - my) * a) / (a * c - b * b) AS m FROM p, m) SELECT id, {r6('ln(2 * pi()) + 1 + n / 2 * det - (n - 1) / 2 * (2 * ln(n / (n - 1)) + det + ln(1 - m / (n - 1))) + ln(0.0001 / 0.9999)')} FROM g",
        "multiple_regression": f"WITH m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS q, avg(l_discount) AS d, var_pop(l_extendedprice) AS yy, var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, covar_pop(l_quantity, l_discount) AS qd, covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy FROM lineitem), b AS (SELECT *, (qy * dd - dy * qd) / (qq * dd - qd * qd) AS b1, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS b2 FROM m) SELECT round(y - b1 * q - b2 * d, 3) AS b0, round(b1, 3) AS b1, round(b2, 3) AS b2, round((b1 * qy + b2 * dy) / yy, {DIGITS}) AS r2 FROM b",
        "reference_based": f"WITH {P}, o AS (SELECT id, ref, sqrt((x - ref) * (x - ref) + y * y) AS d FROM p, (VALUES (0), (50)) t(ref)), g AS (SELECT id, d, list(d) OVER (PARTITION BY ref ORDER BY d, id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM o), s AS (SELECT id, min(5 / list_sum(list_slice(list_sort(list_transform(near, lambda z: abs(z - d))), 2, 6))) AS den FROM g GROUP BY id) SELECT id, {r6('1 - den / max(den) OVER ()')} FROM s",
        "reference_points_star": f"WITH {P}, m AS (SELECT avg(x) AS x, avg(y) AS y, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p), o AS (SELECT 0 AS n, x, y FROM m UNION ALL SELECT 1, lx, y FROM m UNION ALL SELECT 2, hx, y FROM m UNION ALL SELECT 3, x, ly FROM m UNION ALL SELECT 4, x, hy FROM m) SELECT n, round(x, {DIGITS}) AS x, round(y, {DIGITS}) AS y FROM o",
        "snn_similarity": f"WITH {RX}, n AS (SELECT q, s FROM r WHERE rank <= 10) SELECT a.q, b.q AS s, count(*) AS common FROM n a JOIN n b ON a.s = b.s AND a.q < b.q GROUP BY 1, 2",
    }
