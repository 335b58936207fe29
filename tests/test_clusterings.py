import math
from itertools import combinations

import numpy as np
import pytest

from vicinal.operators import clustering, mixtures, outliers, statistics, subspaces
from vicinal.operators.knn import range_join


@pytest.fixture(scope="module")
def cloud(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(0, 0.6, (30, 2)), draw.normal((6, 0), (1.5, 0.1), (30, 2)), draw.uniform(-3, 9, (8, 2))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()


def density(near: np.ndarray, least: int, eligible: np.ndarray) -> list:
    """Clusters by walking from core point to core point."""
    core = (near.sum(axis=1) >= least) & eligible
    label = {}
    for i in np.flatnonzero(core):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [k for k in np.flatnonzero(near[j] & core)]
    return [label.get(i, min((label[j] for j in np.flatnonzero(near[i] & core)), default=None)) for i in range(len(near))]


def assigned(df) -> list:
    return [r["cluster"] for r in df.orderBy("id").collect()]


def test_dbscan_walks(cloud):
    x, points = cloud
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert assigned(clustering.dbscan(points, 0.7, 4)) == density(d <= 0.7, 4, np.ones(len(x), bool))


def test_snn_clustering(cloud):
    x, points = cloud
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = [set(np.argsort(row, kind="stable")[:6]) for row in d]
    shared = np.array([[len(a & b) for b in near] for a in near])
    assert assigned(clustering.snn_clustering(points, 6, 3, 4)) == density((shared >= 3) | np.eye(len(x), dtype=bool), 4, np.ones(len(x), bool))


def test_predecon(cloud):
    x, points = cloud
    diff = x[:, None] - x[None]
    near = (diff**2).sum(axis=2) <= 1
    low = np.array([(diff[i, near[i]] ** 2).mean(axis=0) <= 0.1 for i in range(len(x))])
    w = np.where(low, 9.0, 1.0)
    both = np.maximum((diff**2 * w[:, None]).sum(axis=2), (diff**2 * w[None]).sum(axis=2)) <= 1
    got = assigned(subspaces.predecon(points, 1.0, 4, 0.1, 1, 9.0))
    assert got == density(both, 4, low.sum(axis=1) <= 1) and len(set(got)) > 2


def test_four_c(cloud):
    x, points = cloud
    diff = x[:, None] - x[None]
    near = (diff**2).sum(axis=2) <= 1
    m, strong = [], []
    for i in range(len(x)):
        values, vectors = np.linalg.eigh(np.cov(x[near[i]].T, bias=True))
        weak = values <= 0.2 * values[-1]
        m.append(vectors @ np.diag(np.where(weak, 9.0, 1.0)) @ vectors.T)
        strong.append((~weak).sum())
    own = np.einsum("abi,aij,abj->ab", diff, np.array(m), diff)
    got = assigned(subspaces.four_c(points, 1.0, 3, 0.2, 1, 9.0))
    assert got == density((np.maximum(own, own.T) <= 1 + 1e-12) & near, 3, np.array(strong) <= 1)


def forest(edges: list) -> set:
    root, out = {}, set()
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for w, a, b in sorted(edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b))
    return out


def test_merges_are_the_least_forest(spark, cloud):
    x, points = cloud
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 2]
    got = {(r["a"], r["b"]) for r in clustering.single_link_merges(points, 2.0).collect()}
    assert got == forest([(d[i, j], i, j) for i, j in pairs])
    core = np.sort(d, axis=1)[:, 3]
    reach = [(max(d[i, j], core[i], core[j]), i, j) for i, j in pairs if max(core[i], core[j]) <= 2]
    got = clustering.optics_merges(points, 2.0, 4).collect()
    assert {(r["a"], r["b"]) for r in got} == forest(reach)
    ties = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(i, 6)], "a long, b long, w double")
    assert {tuple(r) for r in clustering.spanning_forest(ties).collect()} == {(0, j, 1.0) for j in range(1, 6)}
    assert clustering.spanning_forest(ties.where("a = b")).count() == 0


def test_em_equals_plain_iteration(cloud):
    x, points = cloud
    start = [[0.0, 0.0], [5.0, 1.0]]
    w, m, s = np.full(2, 0.5), np.array(start), np.array([np.eye(2)] * 2)
    for _ in range(6):
        dens = np.array([w[c] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m[c], np.linalg.inv(s[c]), x - m[c])) / (2 * np.pi * np.sqrt(np.linalg.det(s[c]))) for c in range(2)]).T
        p = dens / dens.sum(axis=1, keepdims=True)
        w, m = p.mean(axis=0), (p.T @ x) / p.sum(axis=0)[:, None]
        s = np.array([np.cov(x.T, aweights=p[:, c], bias=True) + 1e-9 * np.eye(2) for c in range(2)])
    got = mixtures.fit_mixture(points, 2, 6, start=start)
    for a, b in zip(got, (w, m, s), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-7)
    rows = mixtures.em(points, 2, 6, start=start).orderBy("id").collect()
    assert len(rows) == len(x) and {r["cluster"] for r in rows} == {0, 1}


def test_clique_links_neighbouring_cells(spark):
    rows = [(i, [float(i % 10), 0.0 if i % 10 < 4 else 5.0]) for i in range(40)]
    got = {r["unit"]: r["cluster"] for r in subspaces.clique(spark.createDataFrame(rows, "id long, v array<double>"), 10, 0.1).collect()}
    assert {u for u, c in got.items() if c == "0:0"} == {f"0:{k}" for k in range(10)}
    assert got["0:3,1:0"] == "0:0,1:0" and got["0:9,1:9"] == "0:4,1:9" and got["1:0"] == "1:0" and got["1:9"] == "1:9"


def test_kmeans_and_em_go_on_until_nothing_changes(spark):
    x = np.arange(300.0) ** 1.3
    points = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1).cache()
    means, old, rounds = x[:5], None, 0
    while True:
        new = ((x[:, None] - means) ** 2).argmin(axis=1)
        if old is not None and (new == old).all():
            break
        old, means, rounds = new, np.array([x[new == c].mean() for c in range(5)]), rounds + 1
    assert rounds > 20
    assert assigned(clustering.kmeans(points, 5, start=[[float(v)] for v in x[:5]])) == old.tolist()
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(0, 1, 100), draw.normal(2.5, 1, 100)])
    points = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1).cache()
    w, m, s, before, rounds = np.full(2, 0.5), np.array([[-1.0], [4.0]]), np.ones((2, 1, 1)), None, 0
    while True:
        p, log = mixtures.posteriors(x[:, None], w, m, s)
        if before is not None and abs(log - before) <= 1e-12 * abs(before):
            break
        before, rounds = log, rounds + 1
        w, m = p.mean(axis=0), (p.T @ x / p.sum(axis=0))[:, None]
        s = np.array([[[(p[:, c] * (x - m[c]) ** 2).sum() / p[:, c].sum() + 1e-9]] for c in range(2)])
    assert rounds > 50
    for a, b in zip(mixtures.fit_mixture(points, 2, start=[[-1.0], [4.0]]), (w, m, s), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-3)


def test_itemsets_of_all_sizes(spark):
    draw = np.random.default_rng(8)
    baskets = [set("abcde"[: 3 + k % 3]) | set(draw.choice(list("fghij"), 3)) for k in range(30)]
    frame = spark.createDataFrame([(k, i) for k, b in enumerate(baskets) for i in b for _ in range(2)], "basket long, item string")
    want = {}
    for n in range(1, 11):
        for c in combinations("abcdefghij", n):
            support = sum(set(c) <= b for b in baskets)
            if support >= 5:
                want[",".join(c)] = support
    assert max(map(len, want)) >= 9  # five items
    assert {r["items"]: r["support"] for r in statistics.apriori(frame, 5).collect()} == want
    assert {r["items"] for r in statistics.apriori(frame, 5, 2).collect()} == {w for w in want if len(w) <= 3}


def test_dense_units_of_all_subspaces(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(20)]
    got = {r["unit"]: r["support"] for r in subspaces.dense_units(spark.createDataFrame(rows, "id long, v array<double>"), 2, 0.5).collect()}
    assert len(got) == 2 * 15 and got["0:1,1:1,2:1,3:1"] == 10


def test_eigenpair_filters():
    values = np.array([8.0, 4.0, 0.5, 0.4, 0.1])
    count = lambda kind, x: int(statistics.eigenpair_filter(values, kind, x).sum())
    assert [count("first", 3), count("share", 0.9), count("weak", 1.0), count("absolute", 0.45), count("limit", 0.05)] == [3, 2, 2, 3, 4]
    assert count("significant", 0.0) == 2 and count("relative", 2.0) == 2
    # Shares 0.615 and 0.923 against bars of 0.6 and 0.7 (x = 0.5), of 0.76 and 0.82 (x = 0.7).
    assert count("progressive", 0.5) == 1 and count("progressive", 0.7) == 2 and count("weak", 99.0) == 5


def test_gamma_scaling(spark):
    np.testing.assert_allclose(statistics.regularized_gamma(1.0, np.array([0.0, 0.5, 3.0, 900.0])), [0, 1 - math.exp(-0.5), 1 - math.exp(-3), 1], atol=1e-12)
    np.testing.assert_allclose(statistics.regularized_gamma(2.0, np.array([1.5])), [1 - 2.5 * math.exp(-1.5)], atol=1e-12)
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id long, score double")
    assert [r["score"] for r in statistics.gamma_scaling(flat.limit(0)).collect()] == []
    got = [r["score"] for r in statistics.gamma_scaling(spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, score double")).orderBy("id").collect()]
    assert got[:5] == [0.0] * 5 and got == sorted(got) and 0 < got[-1] < 1


def test_reference_points(cloud):
    x, points = cloud
    lo, hi = x.min(axis=0), x.max(axis=0)
    np.testing.assert_allclose(statistics.reference_points(points, "axis"), [lo, hi, [hi[0], lo[1]], [lo[0], hi[1]]])
    assert len(statistics.reference_points(points, "grid", 2)) == 9
    np.testing.assert_allclose(statistics.reference_points(points, "grid", 0), [(lo + hi) / 2])


def test_outliers_stand_out(spark):
    rows = [(i, [float(i % 5), float(i // 5)]) for i in range(25)] + [(99, [40.0, 40.0])]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    score = lambda df: {r["id"]: r["score"] for r in df.collect()}
    far = score(outliers.inflo(points, 4))
    assert max(far, key=far.get) == 99
    angles = score(outliers.abod(points, 6))
    assert len(angles) == 26
    assert score(outliers.loci(points, 60.0, 5))[99] >= 0
    assert range_join(points, points, 0.0).count() == 26
