"""Mixtures of normal distributions with full covariances."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.plans.lineage import cut

#: What is added to a covariance's diagonal where it cannot be inverted.
RIDGE = 1e-9
#: Changes of the log density, as a share of it, that the order of adding up may cause.
ROUNDING = 1e-12


def posteriors(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The probability of each component given each row of ``x``, and the sum of the rows' log densities, each ``counts`` times."""
    logs = np.empty((len(x), len(weights)))
    for c, (w, m, s) in enumerate(zip(weights, means, covs, strict=True)):
        sign, det = np.linalg.slogdet(s)
        if sign <= 0:
            s = s + RIDGE * np.eye(len(m))
            det = np.linalg.slogdet(s)[1]
        diff = x - m
        logs[:, c] = np.log(max(w, 1e-300)) - 0.5 * (len(m) * np.log(2 * np.pi) + det + (diff * np.linalg.solve(s, diff.T).T).sum(axis=1))
    most = logs.max(axis=1, keepdims=True)
    total = most[:, 0] + np.log(np.exp(logs - most).sum(axis=1))
    return np.exp(logs - total[:, None]), float((total if counts is None else total * counts).sum())


def fit_mixture(points: DataFrame, k: int, max_iter: int = 0, delta: float = 0.0, seed: int = 1, start: list[list[float]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances by expectation and maximisation, from identity covariances and equal weights.

    Means are drawn in the bounding box unless ``start`` gives them.  It ends
    when the mean log density changes by at most ``delta`` beyond rounding, or
    after ``max_iter`` rounds if that is not 0.  Equal points are added up once,
    before the rounds, and packed; if the packs are few enough for one task, it
    runs all rounds.  Else tasks sum their moments, of a size that depends on
    ``k`` and the dimension alone; a shuffle adds them, and one number for each
    moment comes to the driver.
    """
    points = points.select(F.col("v").cast("array<double>").alias("v"))
    dim = points.select(F.size("v")).first()[0]
    if start is None:
        v = [F.col("v")[i] for i in range(dim)]
        box = points.agg(*[F.min(c) for c in v], *[F.max(c) for c in v]).first()
        start = np.random.default_rng(seed).uniform(box[:dim], box[dim:], (k, dim)).tolist()
    packs = cut(points_packed(points))
    model = np.full(k, 1 / k), np.array(start, float), np.array([np.eye(dim)] * k)
    unpack = lambda row: np.frombuffer(row, float).reshape(-1, dim + 1)
    if (packs.agg(F.sum("n")).first()[0] or 0) * (dim + 1) * 8 > ONE_TASK_BYTES:

        def sums_of(now: tuple) -> np.ndarray:
            def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = sum((_moments(unpack(x), now) for rows in batches for x in rows["x"]), np.zeros(k * (1 + dim + dim * dim) + 2))
                yield pd.DataFrame({"at": np.arange(len(total)), "x": total})

            sums = np.zeros(k * (1 + dim + dim * dim) + 2)
            for at, x in packs.mapInPandas(moments, "at int, x double").groupBy("at").agg(F.sum("x")).collect():
                sums[at] = x
            return sums

        return _rounds(sums_of, model, max_iter, delta)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [unpack(x) for rows in batches for x in rows["x"]]
        if held:
            x = np.concatenate(held)
            # In one order, so that reruns agree.
            x = x[np.lexsort(x.T)]
            out = _rounds(lambda now: sum((_moments(x[at : at + PACK], now) for at in range(0, len(x), PACK)), 0.0), model, max_iter, delta)
            yield pd.DataFrame({"model": [np.concatenate([p.ravel() for p in out]).tobytes()]})

    row = packs.select("x").repartition(1).mapInPandas(fit, "model binary").first()
    if row is None:
        return model
    flat = np.frombuffer(row[0], float)
    return flat[:k].copy(), flat[k : k + k * dim].reshape(k, dim).copy(), flat[k + k * dim :].reshape(k, dim, dim).copy()


#: Points of a pack, and bytes of packs up to which one task runs all rounds.
PACK, ONE_TASK_BYTES = 16384, 8 << 20


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Points and how often each occurs, as rows of numbers in packs."""
    for rows in batches:
        for at in range(0, len(rows), PACK):
            some = rows.iloc[at : at + PACK]
            x = np.column_stack([np.array([np.asarray(v, float) for v in some["v"]]), some["n"].to_numpy(float)])
            yield pd.DataFrame({"n": [len(x)], "x": [x.tobytes()]})


def points_packed(points: DataFrame) -> DataFrame:
    """n (different points) and x (these, each with its number) of packs."""
    return points.groupBy("v").agg(F.count(F.lit(1)).alias("n")).mapInPandas(_packed, "n long, x binary")


def _moments(rows: np.ndarray, now: tuple) -> np.ndarray:
    """For each component the sums of its shares, of points and of their products, about the old mean; then of log densities and counts."""
    x, n = np.ascontiguousarray(rows[:, :-1]), rows[:, -1]
    p, log = posteriors(x, *now, n)
    p, out = p * n[:, None], []
    for c in range(p.shape[1]):
        diff = x - now[1][c]  # sums of squares stay small
        out += [[p[:, c].sum()], p[:, c] @ diff, (diff.T @ (p[:, c, None] * diff)).ravel()]
    return np.concatenate([*out, [log, n.sum()]])


def _rounds(sums_of: Callable[[tuple], np.ndarray], model: tuple, max_iter: int, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, dim = model[1].shape
    size, before = 1 + dim + dim * dim, None
    weights, means, covs = model
    for _ in range(max_iter) if max_iter else itertools.count():
        now = (weights, means, covs)
        sums = sums_of(now)
        n, log = sums[-1], sums[-2]
        if n == 0 or (before is not None and abs(log / n - before) <= max(delta, ROUNDING * abs(before))):
            break
        before = log / n
        weights, means, covs = weights.copy(), means.copy(), covs.copy()
        for c in range(k):
            part = sums[c * size : (c + 1) * size]
            weights[c] = part[0] / n
            if part[0] > 1e-12:  # a component without points keeps its place
                shift = part[1 : 1 + dim] / part[0]
                means[c] = now[1][c] + shift
                covs[c] = part[1 + dim :].reshape(dim, dim) / part[0] - np.outer(shift, shift) + RIDGE * np.eye(dim)
    return weights, means, covs


def em(points: DataFrame, k: int, max_iter: int = 0, delta: float = 0.0, seed: int = 1, start: list[list[float]] | None = None) -> DataFrame:
    """id, cluster (the likeliest component, ties to the lower number) and p, its probability."""
    model = fit_mixture(points, k, max_iter, delta, seed, start)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                p, _ = posteriors(np.array([np.asarray(v, float) for v in rows["v"]]), *model)
                yield pd.DataFrame({"id": rows["id"], "cluster": p.argmax(axis=1).astype("int32"), "p": p.max(axis=1)})

    return points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInPandas(assign, "id long, cluster int, p double")


def em_outlier(points: DataFrame, k: int, **settings) -> DataFrame:
    """1 minus the probability of the likeliest component."""
    return em(points, k, **settings).select("id", (1 - F.col("p")).alias("score"))
