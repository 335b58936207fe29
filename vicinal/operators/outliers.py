"""Outlier scores over neighbour tables: each returns id and score."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions.vectors import erf
from vicinal.operators.clustering import snn_similarity
from vicinal.operators.knn import _cells_fit, _matrix, knn_join, located, range_counts, range_join
from vicinal.operators.ranges import with_beside
from vicinal.plans.lineage import cut


def knn_outlier(points: DataFrame, k: int) -> DataFrame:
    """The distance of the k-th neighbour; the point itself is the first."""
    return knn_join(points, points, k).where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("d").alias("score"))


def knn_weight_outlier(points: DataFrame, k: int) -> DataFrame:
    """The sum of the distances of the first ``k`` neighbours, the point itself included."""
    return knn_join(points, points, k).groupBy("q").agg(F.sum("d").alias("score")).withColumnRenamed("q", "id")


def _neighbours(points: DataFrame, k: int) -> DataFrame:
    """The neighbours of each point without itself, ties of the k-th kept, with the k-distance of both ends."""
    near = knn_join(points, points, k + 1, ties=True)
    far = near.groupBy("q").agg(F.max("d").alias("kd"))
    return near.where("q <> s").join(far.select(F.col("q").alias("s"), F.col("kd").alias("s_kd")), "s")


def lof(points: DataFrame, k: int) -> DataFrame:
    """The local outlier factor: the mean of the neighbours' local reachability densities over the point's own."""
    near = _neighbours(points, k)
    density = near.groupBy("q").agg((F.count(F.lit(1)) / F.sum(F.greatest("d", "s_kd"))).alias("lrd"))
    other = density.select(F.col("q").alias("s"), F.col("lrd").alias("s_lrd"))
    return near.join(other, "s").groupBy("q").agg(F.avg("s_lrd").alias("m")).join(density, "q").select(F.col("q").alias("id"), (F.col("m") / F.col("lrd")).alias("score"))


def optics_of(points: DataFrame, min_points: int) -> DataFrame:
    """As ``lof``, with the point itself among its ``min_points`` neighbours and core distances for k-distances."""
    near = knn_join(points, points, min_points, ties=True)
    core = near.groupBy("q").agg(F.max("d").alias("kd"))
    near = near.join(core.select(F.col("q").alias("s"), F.col("kd").alias("s_kd")), "s")
    density = near.groupBy("q").agg((F.count(F.lit(1)) / F.sum(F.greatest("d", "s_kd"))).alias("lrd"))
    other = density.select(F.col("q").alias("s"), F.col("lrd").alias("s_lrd"))
    return near.join(other, "s").groupBy("q").agg(F.avg("s_lrd").alias("m")).join(density, "q").select(F.col("q").alias("id"), (F.col("m") / F.col("lrd")).alias("score"))


def ldof(points: DataFrame, k: int) -> DataFrame:
    """The mean distance to the neighbours over the mean distance between them."""
    from vicinal.functions.vectors import euclidean

    near = knn_join(points, points, k, exclude_self=True).select("q", "s", "d")
    own = near.groupBy("q").agg(F.avg("d").alias("own"))
    v = points.select(F.col("id").alias("s"), F.col("v").cast("array<double>").alias("v"))
    a = near.join(v, "s").select("q", "s", "v")
    b = a.select("q", F.col("s").alias("t"), F.col("v").alias("w"))
    between = a.join(b, "q").where("s < t").groupBy("q").agg(F.avg(euclidean(F.col("v"), F.col("w"))).alias("between"))
    return own.join(between, "q").select(F.col("q").alias("id"), (F.col("own") / F.col("between")).alias("score"))


def loop(points: DataFrame, k: int, lam: float = 2.0) -> DataFrame:
    """The probability of being a local outlier."""
    near = knn_join(points, points, k, exclude_self=True)
    reach = near.groupBy("q").agg((lam * F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("pdist"))
    other = near.join(reach.select(F.col("q").alias("s"), F.col("pdist").alias("s_pdist")), "s").groupBy("q").agg(F.avg("s_pdist").alias("mean"))
    plof = reach.join(other, "q").select("q", F.greatest(F.col("pdist") / F.col("mean"), F.lit(1.0)).alias("plof"))
    scale = plof.agg((lam * F.sqrt(F.avg(F.pow(F.col("plof") - 1, 2)))).alias("nplof"))
    score = F.when(F.col("nplof") > 0, F.greatest(F.lit(0.0), erf((F.col("plof") - 1) / (F.col("nplof") * F.sqrt(F.lit(2.0)))))).otherwise(0.0)
    return plof.join(F.broadcast(scale)).select(F.col("q").alias("id"), score.alias("score"))


def db_score(points: DataFrame, radius: float) -> DataFrame:
    """1 minus the share of points within ``radius``, the point itself included."""
    n = points.count()
    return range_counts(points, radius).select("id", (1 - F.col("n") / F.lit(float(n))).alias("score"))


def db_outliers(points: DataFrame, radius: float, share: float) -> DataFrame:
    """1 if fewer than floor(n (1 - share)) points lie within ``radius``, else 0."""
    n = points.count()
    least = int(np.floor(n * (1 - share)))
    return range_counts(points, radius).select("id", F.when(F.col("n") < least, 1.0).otherwise(0.0).alias("score"))


def gaussian_model(points: DataFrame, invert: bool = False) -> DataFrame:
    """The density of a normal distribution with the points' mean and covariance; inverted: (max - density) / max.

    Only the moments, of the size of the dimension squared, come to the driver.
    """
    dim = points.select(F.size("v")).first()[0]
    x = [F.col("v")[i].cast("double") for i in range(dim)]
    row = points.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(dim) for j in range(i, dim)]).first()
    mean = [row[f"m{i}"] for i in range(dim)]
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(dim)] for i in range(dim)])
    inverse, scale = np.linalg.pinv(cov), 1 / np.sqrt((2 * np.pi) ** dim * max(np.linalg.det(cov), 1e-300))
    delta = [c - F.lit(float(m)) for c, m in zip(x, mean, strict=True)]
    q = sum((delta[i] * delta[j] * F.lit(float(inverse[i, j])) for i in range(dim) for j in range(dim)), F.lit(0.0))
    out = points.select("id", (F.lit(float(scale)) * F.exp(-0.5 * q)).alias("score"))
    if not invert:
        return out
    most = out.agg(F.max("score").alias("m"))
    return out.join(F.broadcast(most)).select("id", ((F.col("m") - F.col("score")) / F.col("m")).alias("score"))


def gaussian_uniform_mixture(points: DataFrame, share: float, gain: float = 1e-7) -> DataFrame:
    """How much the likelihood gains where a point goes from a normal distribution to a uniform one, as the score.

    ``share`` is the expected share of outliers.  In each round the points
    whose move alone would gain more than ``gain``, and at least half as much
    as the best move, go together and keep that score; it ends when none does,
    and the others have the score of the last round.  So the result does not
    depend on an order of visits, and few far points that widen the
    distribution do not take the rest with them; where no point goes in the
    first round it is that of one visit after the other.  Rounds read the
    points again; the driver holds moments.  A covariance
    without an inverse is mended by 1e-9 on its diagonal.
    """
    dim = points.select(F.size("v")).first()[0]
    x = [F.col("v")[i].cast("double") for i in range(dim)]
    live, gone, out = points.select("id", "v"), 0, None
    while True:
        row = live.agg(F.count(F.lit(1)), *[F.avg(c) for c in x], *[F.covar_pop(x[i], x[j]) for i in range(dim) for j in range(i, dim)]).first()
        n = row[0]
        if n < 3:
            rest = live.select("id", F.lit(0.0).alias("score"))
            return rest if out is None else out.unionByName(rest)
        cov = np.zeros((dim, dim))
        cov[np.triu_indices(dim)] = row[1 + dim :]
        cov = cov + np.triu(cov, 1).T + (np.eye(dim) * 1e-9 if np.linalg.matrix_rank(cov + np.triu(cov, 1).T) < dim else 0.0)
        inverse, logdet = np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])
        delta = [c - F.lit(float(m)) for c, m in zip(x, row[1 : 1 + dim], strict=True)]
        m = sum((delta[i] * delta[j] * F.lit(float(inverse[i, j])) for i in range(dim) for j in range(dim)), F.lit(0.0))
        # Scatter without a point: its determinant falls by the factor 1 - m / (n - 1).
        without = dim * float(np.log(n / (n - 1))) + logdet + F.ln(F.greatest(F.lit(1e-300), 1 - m / (n - 1)))
        uniform = float(np.log(share / (1 - share)) - (gone + 1) * np.log(gone + 1) + (gone * np.log(gone) if gone else 0.0))
        score = (dim * np.log(2 * np.pi) + dim) / 2 + n / 2 * logdet - (n - 1) / 2 * without + uniform
        scored = cut(live.select("id", "v", score.alias("score")))
        best = scored.agg(F.max("score")).first()[0]
        goes = (F.col("score") > gain) & (F.col("score") >= best / 2)
        moved = scored.where(goes).count()
        done = (scored.where(goes) if moved else scored).select("id", "score")
        out = done if out is None else out.unionByName(done)
        if not moved:
            return out
        live, gone = scored.where(~goes).select("id", "v"), gone + moved


def reference_based(points: DataFrame, references: list[list[float]], k: int) -> DataFrame:
    """1 minus the least density over the largest: density by a reference is 1 over the mean gap to the ``k`` points next in distance to it."""
    from vicinal.functions.vectors import euclidean

    out = None
    for n, ref in enumerate(references):
        d = euclidean(F.col("v").cast("array<double>"), F.array(*[F.lit(float(x)) for x in ref]))
        part = points.select("id", F.lit(n).alias("ref"), d.alias("d"))
        out = part if out is None else out.unionByName(part)
    gaps = F.array_sort(F.transform("beside", lambda x: F.abs(x - F.col("d"))))
    out = with_beside(out, [F.col("d"), F.col("id")], "ref", "d", k)
    gap = out.withColumn("gaps", gaps).withColumn("gap", F.aggregate(F.slice("gaps", 2, k), F.lit(0.0), lambda a, x: a + x) / k)
    # A gap of 0, between copies, is an infinite density.
    least = gap.groupBy("id").agg(F.min(F.when(F.col("gap") > 0, F.try_divide(F.lit(1.0), "gap")).otherwise(F.lit(float("inf")))).alias("density"))
    most = least.agg(F.max("density").alias("m"))
    return least.join(F.broadcast(most)).select("id", (1 - F.col("density") / F.col("m")).alias("score"))


def inflo(points: DataFrame, k: int, mutual: float = 1.0) -> DataFrame:
    """The mean density (1 over the k-distance) of the influence space over the point's own.

    The influence space is the set of the ``k`` nearest and of the points whose
    ``k`` nearest the point is among.  Where at least a share of ``mutual`` of
    the nearest are mutual, the score is 1.
    """
    near = cut(knn_join(points, points, k, exclude_self=True).select("q", "s", "d"))
    density = cut(near.groupBy("q").agg((1 / F.max("d")).alias("den"), F.count(F.lit(1)).alias("n")))
    back = near.select(F.col("s").alias("q"), F.col("q").alias("s"))
    both = near.join(back, ["q", "s"], "left_semi").groupBy("q").agg(F.count(F.lit(1)).alias("both"))
    space = near.select("q", "s").unionByName(back).distinct().join(density.select(F.col("q").alias("s"), F.col("den").alias("s_den")), "s")
    around = space.groupBy("q").agg(F.avg("s_den").alias("mean"))
    score = F.when(F.coalesce("both", F.lit(0)) >= mutual * F.col("n"), 1.0).otherwise(F.col("mean") / F.col("den"))
    return density.join(around, "q").join(both, "q", "left").select(F.col("q").alias("id"), score.alias("score"))


def loci(points: DataFrame, radius: float, least: int = 20, alpha: float = 0.5) -> DataFrame:
    """The largest ratio, over radii up to ``radius``, of the deviation from the mean count to its standard deviation.

    Counts are of points within ``alpha`` times the radius, for each point
    within the radius (itself included); radii are the distances to neighbours
    and these over ``alpha``; radii with fewer than ``least`` points do not
    count.  0 where there is none.  A task holds the neighbourhood of one point
    at a time, or in few dimensions that of a cell of a grid, which ``radius``
    bounds; copies of a point are one with their number.
    """
    rows, places, copies = located(points)
    dim = _cells_fit(places, places, radius, "euclidean")
    if dim:
        side, reach = radius * (1 + alpha) / 2 * (1 + 1e-6), (-2, -1, 0, 1, 2)
        cells = [F.floor(F.col("v")[i] / F.lit(side)) for i in range(dim)]
        around = F.array(*[F.array(*[c + F.lit(step) for c, step in zip(cells, steps, strict=True)]) for steps in product(reach, repeat=dim)])
        home, near = places.withColumn("cell", F.array(*cells)), places.withColumn("cell", F.explode(around))

        def scores(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a):
                return pd.DataFrame({"loc": np.zeros(0, np.int64), "score": np.zeros(0)})
            return pd.DataFrame({"loc": a["id"], "score": loci_scores(_matrix(a["v"]), _matrix(b["v"]), b["n"].to_numpy(), radius, least, alpha)})

        found = home.groupBy("cell").cogroup(near.groupBy("cell")).applyInPandas(scores, "loc long, score double")
        return rows.join(found, "loc").select("id", "score")
    near = cut(range_join(points, points, radius))
    lists = near.where(F.col("d") <= alpha * radius).groupBy("q").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    joined = near.join(lists.withColumnRenamed("q", "s"), "s").select("q", "s", "d", "ds")

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        d, q = rows["d"].to_numpy(), rows["q"].iloc[0]
        radii = np.unique(np.concatenate([d, d / alpha]))
        radii = radii[radii <= radius]
        inside = d[:, None] <= radii[None, :]
        counts = np.array([np.searchsorted(np.asarray(ds), alpha * radii, side="right") for ds in rows["ds"]], float)
        n = inside.sum(axis=0)
        mean = (counts * inside).sum(axis=0) / n
        deviation = np.sqrt(((counts - mean) ** 2 * inside).sum(axis=0) / n)
        own = counts[np.flatnonzero(rows["s"].to_numpy() == q)[0]]
        use = (n >= least) & (deviation > 0)
        return pd.DataFrame({"id": [q], "score": [float(((mean - own)[use] / deviation[use]).max()) if use.any() else 0.0]})

    return joined.groupBy("q").applyInPandas(score, "id long, score double")


def loci_scores(q: np.ndarray, s: np.ndarray, n: np.ndarray, radius: float, least: int, alpha: float) -> np.ndarray:
    """``loci`` of points ``q`` among ``s``, each ``n`` times, that holds them and all within ``radius`` times 1 + ``alpha``.

    A count about a point changes only at a distance of one of its neighbours;
    what each change adds to the sums of counts and of their squares is put at
    the least radius that sees it, and running sums give all radii at once.
    """
    step = max(1, (1 << 21) // max(1, s.size))
    owner, at, totals = [], [], []
    asked = np.flatnonzero(np.all((s >= q.min(axis=0) - radius * (1 + 1e-6)) & (s <= q.max(axis=0) + radius * (1 + 1e-6)), axis=1)) if len(q) else np.arange(0)
    for top in range(0, len(asked), step):
        some = asked[top : top + step]
        d = np.sqrt(sum((s[some, None, i] - s[None, :, i]) ** 2 for i in range(s.shape[1])))
        r, c = np.nonzero(d <= alpha * radius)
        e = d[r, c]
        order = np.lexsort((e, r))
        r, e, w = r[order], e[order], n[c[order]].astype(float)
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (e[1:] != e[:-1])])
        r, e, w = r[first], e[first], np.add.reduceat(w, first)
        total = np.cumsum(w)
        total -= (total - w)[np.searchsorted(r, r)]
        owner.append(some[r])
        at.append(e)
        totals.append(total)
    if not len(q):
        return np.zeros(0)
    owner, at, totals = (np.concatenate(x) for x in (owner, at, totals))
    values, code = np.unique(at, return_inverse=True)
    key = owner * (len(values) + 1) + code
    start = np.searchsorted(owner, np.arange(len(s) + 1))
    by = totals - np.where(np.r_[True, owner[1:] != owner[:-1]], 0.0, np.r_[0.0, totals[:-1]])
    squares = by * (2 * totals - by)
    out = np.zeros(len(q))
    for k, point in enumerate(q):
        d = np.sqrt(((point - s) ** 2).sum(axis=1))
        inside = d <= radius
        near = d[inside]
        radii = np.unique(np.concatenate([near, near / alpha]))
        radii = radii[radii <= radius]
        size = len(radii)
        # For each distance of a change, the first radius whose alpha-fold reaches it.
        seen = np.cumsum(np.bincount(np.searchsorted(values, alpha * radii, side="right"), minlength=len(values) + 1))[: len(values)]
        whose = np.flatnonzero(inside)
        enters, times = np.searchsorted(radii, near), n[whose].astype(float)
        # A neighbour enters with what it has counted by then; changes after that follow.
        late = np.searchsorted(key, whose * (len(values) + 1) + np.searchsorted(values, alpha * near, side="right"))
        met = totals[late - 1]
        rest = start[whose + 1] - late
        use = np.repeat(late - (np.cumsum(rest) - rest), rest) + np.arange(rest.sum())
        place, more = seen[code[use]], np.repeat(times, rest)
        count = np.cumsum(np.bincount(enters, times, size + 1)[:size])
        one = np.cumsum((np.bincount(enters, times * met, size + 1) + np.bincount(place, more * by[use], size + 1))[:size])
        two = np.cumsum((np.bincount(enters, times * met * met, size + 1) + np.bincount(place, more * squares[use], size + 1))[:size])
        me = int(np.argmin(d))
        mine = slice(start[me], start[me + 1])
        own = np.cumsum(np.bincount(seen[code[mine]], by[mine], size + 1)[:size])
        # Whole numbers: where all counts are equal the difference is 0.
        spread = np.asarray(count.astype(np.longdouble) * two - one.astype(np.longdouble) ** 2, float)
        held = (count >= least) & (spread > 0)
        if held.any():
            out[k] = ((one - own * count)[held] / np.sqrt(spread[held])).max()
    return out


def abod(points: DataFrame, k: int) -> DataFrame:
    """The weighted variance of the angles at a point between pairs of its ``k`` nearest; low scores are outliers.

    An angle counts as the scalar product over the product of the squared
    lengths, with 1 over the product of the lengths as its weight; variance as
    in ``attribute_moments``' running form, each pair taken in both orders.
    Neighbours at distance 0 make no angle.
    """
    from vicinal.functions.vectors import dot

    near = knn_join(points, points, k, exclude_self=True).where("d > 0").select("q", "s", "d")
    v = points.select("id", F.col("v").cast("array<double>").alias("v"))
    rays = near.join(v.select(F.col("id").alias("q"), F.col("v").alias("o")), "q").join(v.withColumnRenamed("id", "s"), "s")
    rays = cut(rays.select("q", "s", F.zip_with("v", "o", lambda x, y: x - y).alias("ray")))
    pairs = rays.join(rays.select("q", F.col("s").alias("t"), F.col("ray").alias("other")), "q").where("s < t")
    scale = dot(F.col("ray"), F.col("ray")) * dot(F.col("other"), F.col("other"))
    angles = pairs.select("q", (dot(F.col("ray"), F.col("other")) / scale).alias("x"), (2 / F.sqrt(scale)).alias("w"))
    x, w = F.col("x"), F.col("w")
    variance = F.sum(w * x * x) / (F.sum(w) - 1) - F.pow(F.sum(w * x) / F.sum(w), 2)
    return angles.groupBy(F.col("q").alias("id")).agg(variance.alias("score"))


def sod(points: DataFrame, k: int, references: int, alpha: float = 1.1) -> DataFrame:
    """The distance to the centre of the ``references`` points with most common neighbours, in the attributes where these vary little, over their number.

    Little is below ``alpha`` times the mean variance over all attributes.
    Equal counts go to the smaller id; 0 where no attribute is left.
    """
    from vicinal.operators.statistics import components_of

    shared = snn_similarity(points, k)
    both = shared.unionByName(shared.select(F.col("s").alias("q"), F.col("q").alias("s"), "common"))
    chosen = both.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("common").desc(), "s"))).where(F.col("rank") <= references)
    cells = components_of(points)
    spread = cut(chosen.select("q", F.col("s").alias("id")).join(cells, "id").groupBy("q", "dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var")))
    bar = spread.groupBy("q").agg((alpha * F.avg("var")).alias("bar"))
    kept = spread.join(bar, "q").where(F.col("var") < F.col("bar")).withColumnRenamed("q", "id").join(cells, ["id", "dim"])
    found = kept.groupBy("id").agg((F.sqrt(F.sum(F.pow(F.col("x") - F.col("mean"), 2))) / F.count(F.lit(1))).alias("score"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
