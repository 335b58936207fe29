"""Preferences of attributes, local principal components, and clusterings in subspaces."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.clustering import components, density_clusters, of_copies
from vicinal.operators.knn import knn_join, located, range_join
from vicinal.operators.statistics import apriori, attribute_ranges, components_of, strong_components
from vicinal.plans.lineage import cut


#: Dimensions up to which expressions are written out for each.
WRITTEN_OUT = 128


def _ends(points: DataFrame, near: DataFrame, counted: bool) -> tuple[DataFrame, int]:
    """The pairs (q, s) with both vectors, a and b, and how many the second stands for; and the dimension."""
    v = points.select("id", F.col("v").cast("array<double>").alias("v"), (F.col("n") if counted else F.lit(1)).alias("n"))
    dim = (v.select(F.size("v")).first() or [0])[0]
    pairs = near.select("q", "s").join(v.select(F.col("id").alias("s"), F.col("v").alias("b"), "n"), "s")
    return pairs.join(v.select(F.col("id").alias("q"), F.col("v").alias("a")), "q"), dim


def _variances(points: DataFrame, near: DataFrame, counted: bool = False) -> DataFrame:
    """q, dim and the mean squared difference of the neighbours (q, s) from the point itself."""
    pairs, dim = _ends(points, near, counted)
    if dim <= WRITTEN_OUT:
        diffs = [F.col("b")[i] - F.col("a")[i] for i in range(dim)]
        means = [(F.sum(F.col("n") * x * x) / F.sum("n")).alias(f"v{i}") for i, x in enumerate(diffs)]
        return pairs.groupBy("q").agg(F.array(*means).alias("vars")).select("q", F.posexplode("vars").alias("dim", "var"))
    cells = components_of(points)
    other = near.select("q", F.col("s").alias("id")).join(cells, "id").select("q", "id", "dim", F.col("x").alias("y"))
    n = points.select("id", (F.col("n") if counted else F.lit(1)).alias("n"))
    both = other.join(n, "id").drop("id").join(cells.withColumnRenamed("id", "q"), ["q", "dim"])
    return both.groupBy("q", "dim").agg((F.sum(F.col("n") * F.pow(F.col("y") - F.col("x"), 2)) / F.sum("n")).alias("var"))


def preferences(points: DataFrame, near: DataFrame, most: float, strict: bool = False, counted: bool = False) -> DataFrame:
    """id and dims, the sorted attributes whose variance about the point is at most (or ``strict``: below) ``most``; ``counted`` points stand for ``n``."""
    var = _variances(points, near, counted)
    held = F.col("var") < most if strict else F.col("var") <= most
    return var.groupBy(F.col("q").alias("id")).agg(F.sort_array(F.collect_list(F.when(held, F.col("dim")))).alias("dims"))


def knn_preferences(points: DataFrame, alpha: float, k: int | None = None) -> DataFrame:
    """``preferences`` among the ``k`` nearest (3 times the dimension if not given), the point itself included."""
    k = k or 3 * points.select(F.size("v")).first()[0]
    return preferences(points, knn_join(points, points, k), alpha, strict=True)


def predecon(points: DataFrame, radius: float, min_points: int, delta: float, most_dims: int, kappa: float = 100.0) -> DataFrame:
    """Density clusters under distances that weigh attributes of low variance by ``kappa``.

    Preferences are taken within ``radius``; a pair's distance is the greater
    of those by both points' weights, and a core point prefers at most
    ``most_dims`` attributes.  Weights are 1 at least, so that pairs beyond
    ``radius`` need not be looked at.
    """
    rows, places, copies = located(points)
    near = cut(range_join(places, places, radius).select("q", "s"))
    prefer = cut(preferences(places, near, delta, counted=True))
    pairs, dim = _ends(places, near.where("q <= s"), True)
    for end, dims in (("q", "pa"), ("s", "pb")):
        pairs = pairs.join(prefer.select(F.col("id").alias(end), F.col("dims").alias(dims)), end)

    def squared(dims: str):
        if dim <= WRITTEN_OUT:
            return reduce(add, [(F.col("a")[i] - F.col("b")[i]) * (F.col("a")[i] - F.col("b")[i]) * F.when(F.array_contains(dims, i), kappa).otherwise(1.0) for i in range(dim)], F.lit(0.0))
        parts = F.transform(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), lambda d, i: d * F.when(F.array_contains(dims, i), kappa).otherwise(1.0))
        return F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)

    kept = pairs.where(F.greatest(squared("pa"), squared("pb")) <= radius * radius).select("q", "s")
    return of_copies(rows, density_clusters(places, _both_ways(kept), min_points, prefer.where(F.size("dims") <= most_dims), places), copies)


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs q <= s in both orders."""
    pairs = cut(pairs)
    return pairs.unionByName(pairs.where("q < s").select(F.col("s").alias("q"), F.col("q").alias("s")))


def local_pca(points: DataFrame, near: DataFrame, counted: bool = False) -> DataFrame:
    """id, eigenvalues (largest first) and eigenvectors (rows in that order) of the covariance of each point's neighbours (q, s).

    Moments are summed by combining aggregates over the neighbours, so that no
    task holds a neighbourhood, only its matrix.  ``counted`` points stand for
    ``n``; their moments are taken about the point.
    """
    if counted:
        pairs, dim = _ends(points, near, True)
        x = [F.col("b")[i] - F.col("a")[i] for i in range(dim)]
        n = F.sum("n")
        mean = [F.sum(F.col("n") * x[i]) / n for i in range(dim)]
        cov = [F.sum(F.col("n") * x[min(i, j)] * x[max(i, j)]) / n - mean[i] * mean[j] for i in range(dim) for j in range(dim)]
        moments = pairs.groupBy("q").agg(F.array(*cov).alias("c"))
    else:
        cells = points.select(F.col("id").alias("s"), F.col("v").cast("array<double>").alias("v"))
        dim = points.select(F.size("v")).first()[0]
        x = [F.col("v")[i] for i in range(dim)]
        cov = [F.covar_pop(x[min(i, j)], x[max(i, j)]) for i in range(dim) for j in range(dim)]
        moments = near.select("q", "s").join(cells, "s").groupBy("q").agg(F.array(*cov).alias("c"))

    def decompose(batches):
        for rows in batches:
            if len(rows):
                values, vectors = np.linalg.eigh(np.array([np.asarray(c, float) for c in rows["c"]]).reshape(-1, dim, dim))
                yield pd.DataFrame({"id": rows["q"], "eigenvalues": list(values[:, ::-1]), "eigenvectors": [m[:, ::-1].T.tolist() for m in vectors]})

    return moments.mapInPandas(decompose, "id long, eigenvalues array<double>, eigenvectors array<array<double>>")


def correlation_dimension(pca: DataFrame, alpha: float = 0.85) -> DataFrame:
    """id and dim: how many eigenvalues reach a share of ``alpha`` of their sum."""

    @F.pandas_udf("int")
    def count(values: pd.Series) -> pd.Series:
        return pd.Series([strong_components(np.asarray(v), alpha) if np.sum(v) > 0 else 0 for v in values], dtype="int32")

    return pca.select("id", count("eigenvalues").alias("dim"))


def four_c(points: DataFrame, radius: float, min_points: int, delta: float, most_dims: int, kappa: float = 50.0) -> DataFrame:
    """Density clusters under distances that weigh directions of little local variance by ``kappa``.

    Directions are the local principal components within ``radius``; those
    whose eigenvalue is at most ``delta`` times the largest are weak.  A core
    point has at most ``most_dims`` strong ones.
    """
    rows, places, copies = located(points)
    near = cut(range_join(places, places, radius).select("q", "s"))
    pca = cut(local_pca(places, near, True))
    strong = F.size(F.filter("eigenvalues", lambda e: e > delta * F.element_at("eigenvalues", 1)))
    pairs, dim = _ends(places, near.where("q <= s"), True)
    # The matrix of weights along each direction, once for each point.
    weigh = F.transform("eigenvalues", lambda e: F.when(e > delta * F.element_at("eigenvalues", 1), 1.0).otherwise(kappa))
    weighed = pca.select("id", "eigenvectors", weigh.alias("w"))
    for end in ("q", "s"):
        pairs = pairs.join(weighed.select(F.col("id").alias(end), F.col("eigenvectors").alias(f"e_{end}"), F.col("w").alias(f"w_{end}")), end)

    def squared(end: str):
        along = [reduce(add, [(F.col("a")[i] - F.col("b")[i]) * F.col(f"e_{end}")[k][i] for i in range(dim)]) for k in range(dim)]
        return reduce(add, [p * p * F.col(f"w_{end}")[k] for k, p in enumerate(along)])

    # A direction's weights sum back to the plain distance: rounding must not lose a pair at the bound.
    kept = pairs.where(F.greatest(squared("q"), squared("s")) <= radius * radius * (1 + 1e-12)).select("q", "s")
    return of_copies(rows, density_clusters(places, _both_ways(kept), min_points, pca.where(strong <= most_dims), places), copies)


def dense_units(points: DataFrame, cells: int, share: float, max_dims: int | None = None) -> DataFrame:
    """unit (``dim:cell`` joined by commas) and support: cells of subspaces, level by level, with at least a ``share`` of all points.

    Each attribute's range, its end widened by 0.0001, is cut into ``cells``.
    Subspaces have up to ``max_dims`` attributes, or any number.
    """
    r = attribute_ranges(points)
    at = F.floor((F.col("x") - F.col("low")) / ((F.col("high") + 0.0001 - F.col("low")) / cells))
    items = components_of(points).join(F.broadcast(r), "dim").select(F.col("id").alias("basket"), F.concat_ws(":", "dim", at).alias("item"))
    least = int(np.ceil(share * points.count() - 1e-9))
    return apriori(items, max(1, least), max_dims).withColumnRenamed("items", "unit")


def clique(points: DataFrame, cells: int, share: float, max_dims: int | None = None) -> DataFrame:
    """unit, support and cluster, the least unit of those of the same subspace linked by neighbouring cells."""
    units = cut(dense_units(points, cells, share, max_dims))
    parts = units.select("unit", F.posexplode(F.split("unit", ",")).alias("pos", "part"), F.split("unit", ",").alias("all"))
    # The unit with one cell left open, and that cell: neighbours meet on the first and the second plus one.
    rest = F.concat_ws(",", F.transform("all", lambda x, i: F.when(i == F.col("pos"), F.concat(F.split_part(x, F.lit(":"), F.lit(1)), F.lit(":*"))).otherwise(x)))
    open_ = parts.select("unit", rest.alias("rest"), F.split_part("part", F.lit(":"), F.lit(2)).cast("int").alias("cell"))
    links = open_.join(open_.select(F.col("unit").alias("other"), "rest", (F.col("cell") - 1).alias("cell")), ["rest", "cell"]).select(F.col("unit").alias("a"), F.col("other").alias("b"))
    comp = components(links.unionByName(units.select(F.col("unit").alias("a"), F.col("unit").alias("b"))))
    return units.join(comp.select(F.col("id").alias("unit"), F.col("comp").alias("cluster")), "unit")
