"""Ranking, counts and sums of all pairs that are added up in tasks, on copies and near copies."""

import math

import numpy as np
import pytest

from vicinal.operators import knn, mixtures, outliers, statistics


def cloud():
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(0, 1, (120, 8)), draw.normal(3, 1e-7, (40, 8))])
    return np.concatenate([x, x[:30], x[-20:]])


@pytest.fixture(scope="module")
def points(spark):
    x = cloud()
    return spark.createDataFrame([(i, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)], "id long, v array<double>, label int").coalesce(1).cache()


def test_ranking_of_copies(spark, points, monkeypatch):
    x = cloud()
    d = knn.KERNELS["euclidean"](x, x)
    labels = np.array([i % 3 if i % 7 else -1 for i in range(len(x))])
    got = {r["id"]: r["auc"] for r in statistics.ranking_quality(points, "label").collect()}
    for i in range(len(x)):
        same = labels == labels[i]
        want = ((d[i][~same][:, None] > d[i][same]) + 0.5 * (d[i][~same][:, None] == d[i][same])).mean()
        assert abs(got[i] - want) < 1e-12
    assert all(r["auc"] is None for r in statistics.ranking_quality(points.withColumn("label", points["id"] * 0), "label").collect())


def test_no_pair_leaves_a_task(points, monkeypatch):
    made = []
    monkeypatch.setattr(knn, "_candidates", lambda *rest: made.append(rest))
    x = cloud()
    d = knn.KERNELS["euclidean"](x, x)
    n, total = knn.pairwise_total(points).first()
    assert n == len(x) * (len(x) + 1) // 2 and abs(total - np.triu(d).sum()) < 1e-6
    assert {r["id"]: r["n"] for r in knn.range_counts(points, 2.0).collect()} == dict(enumerate((d <= 2.0).sum(axis=1)))
    assert len(outliers.db_score(points, 2.0).collect()) == len(x) and not made


def test_gap_of_zero_is_an_infinite_density(spark):
    points = spark.createDataFrame([(i, [0.0]) for i in range(8)] + [(9, [5.0]), (10, [6.0])], "id long, v array<double>")
    got = {r["id"]: r["score"] for r in outliers.reference_based(points, [[0.0]], 3).collect()}
    assert math.isnan(got[0]) and got[9] == got[10] == 1.0


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_mixture_of_copies_reads_each_point_once(spark, monkeypatch, most):
    seen = []
    plain = mixtures._moments
    monkeypatch.setattr(mixtures, "ONE_TASK_BYTES", most)
    x = np.random.default_rng(4).normal(0, 1, (60, 2)) + np.arange(60)[:, None] // 30 * 4
    rows = [(i, v.tolist()) for i, v in enumerate(np.repeat(x, 7, axis=0))]
    got = mixtures.fit_mixture(spark.createDataFrame(rows, "id long, v array<double>"), 2, 4, start=[[0.0, 0.0], [4.0, 4.0]])
    now = np.full(2, 0.5), np.array([[0.0, 0.0], [4.0, 4.0]]), np.array([np.eye(2)] * 2)
    want = mixtures._rounds(lambda m: seen.append(m) or plain(np.column_stack([np.repeat(x, 7, axis=0), np.ones(420)]), m), now, 4, 0.0)
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)
    frame = mixtures.points_packed(spark.createDataFrame(rows, "id long, v array<double>"))
    assert frame.agg({"n": "sum"}).first()[0] == 60 and len(seen) == 4
