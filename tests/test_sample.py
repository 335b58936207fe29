"""The whole way from text to written neighbours, on a sample with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import clustering as C
from vicinal.operators import knn as K
from vicinal.operators import outliers as O
from vicinal.operators import ranges, statistics as S
from vicinal.sources import points as P

# A sample of 10 and 16 points, and the two nearest of the second for each of the first.
OUTER = """39886296 12356.6276 27642.1062 Hawaii,?HI
39908094 12354.8875 27653.6944 Hawaii,?HI
39915666 12373.0142 27626.968 Hawaii,?HI
39808348 12376.3358 27627.3194 Hawaii,?HI
39896032 12374.0776 27629.0036 Hawaii,?HI
39937197 12379.779 27639.8459 Hawaii,?HI
39845549 12392.7593 27539.1968 Hawaii,?HI
39845578 12393.3643 27540.3579 Hawaii,?HI
39886944 12402.3331 27579.5288 Hawaii,?HI
39849040 12407.4679 27558.8346 Hawaii,?HI"""
INNER = """39934529 11919.1475 26704.5112 Hawaii,?HI
39901573 11908.444 26734.3979 Hawaii,?HI
39901552 11914.6695 26708.3382 Hawaii,?HI
39887433 12014.1662 26559.1106 Hawaii,?HI
39792190 12046.3857 26547.9068 Hawaii,?HI
39854350 11958.7255 26650.8522 Hawaii,?HI
39891107 11938.3856 26687.5769 Hawaii,?HI
39909686 11949.1111 26714.7557 Hawaii,?HI
39815702 11910.7234 27217.8154 Hawaii,?HI
39835530 11908.9766 27224.9118 Hawaii,?HI
39812946 11906.736 27233.7615 Hawaii,?HI
39880654 11906.151 27241.0297 Hawaii,?HI
39870782 11909.6286 27244.2001 Hawaii,?HI
39916064 11909.0563 27262.1329 Hawaii,?HI
39828365 11914.678 27231.8299 Hawaii,?HI
39833903 11911.2894 27255.3781 Hawaii,?HI"""
RESULT = """39915666 39833903 592680.4
39915666 39916064 590222.25
39849040 39833903 581617.7
39849040 39916064 580039.3
39845549 39833903 558899.0
39845549 39916064 557435.3
39937197 39833903 606051.56
39937197 39916064 603528.9
39845578 39833903 560008.9
39845578 39916064 558536.44
39896032 39833903 594784.94
39896032 39916064 592316.4
39886296 39833903 589818.06
39886296 39916064 587111.6
39886944 39833903 588386.56
39886944 39916064 586568.56
39908094 39833903 596185.6
39908094 39916064 593369.75
39808348 39833903 595491.0
39808348 39916064 593053.06"""


def text(tmp_path, name: str, content: str) -> str:
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


@pytest.mark.parametrize("limit", [K.BROADCAST_BYTES, 0])
def test_sample_from_text_to_text(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(K, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(K, "BLOCK", 4)
    r, s = (P.read_join_points(spark, text(tmp_path, n, c), 2).withColumn("v", F.transform("v", lambda x: V.quantize(x))) for n, c in (("r", OUTER), ("s", INNER)))
    found = K.knn_join(r, s, 2)
    got = {(row["q"], row["s"]): row["d"] for row in found.collect()}
    want = {(int(q), int(s)): float(d) for q, s, d in (line.split() for line in RESULT.split("\n"))}
    assert got.keys() == want.keys()
    assert all(np.float32(got[k]) == np.float32(want[k]) for k in want)  # the results are 32-bit floats
    P.write_join(found.select("q", "s", "d"), str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split("\n") if x]
    places = [tuple(map(float, x.split())) for x in lines]
    assert len(places) == 20
    for a, b in zip(places, places[1:]):
        assert a[0] != b[0] or a[2] >= b[2]  # farthest first


def test_readers(spark, tmp_path):
    dense = P.read_dense(spark, text(tmp_path, "d", "# a remark\n1 2.5 red\n\n3 -4 dark blue\n")).collect()
    assert sorted((r["v"], r["labels"]) for r in dense) == [([1.0, 2.5], "red"), ([3.0, -4.0], "dark blue")]
    with pytest.raises(ValueError, match="from 1 to 2"):
        P.read_dense(spark, text(tmp_path, "e", "1 2\n3\n"))
    assert sorted(r["bits"] for r in P.read_bits(spark, text(tmp_path, "b", "0 1 1\n1 0 0\n")).collect()) == [[0], [1, 2]]
    sparse = P.read_sparse(spark, text(tmp_path, "s", "2 0 1.5 7 2 x y\n")).collect()
    assert (sparse[0]["v"], sparse[0]["labels"]) == ({0: 1.5, 7: 2.0}, "x y")
    bits = P.read_sparse_bits(spark, text(tmp_path, "sb", "5 2 2 red\n7\n")).collect()
    assert sorted((r["bits"], r["labels"]) for r in bits) == [([2, 5], "red"), ([7], "")]
    turned = P.read_transposed(spark, text(tmp_path, "t", "1 2 3\n# remark\n4 5 6\n")).orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in turned] == [(0, [1.0, 4.0]), (1, [2.0, 5.0]), (2, [3.0, 6.0])]
    with pytest.raises(Exception, match="different numbers"):
        P.read_transposed(spark, text(tmp_path, "u", "1 2 3\n4 5\n")).collect()
    pairs = P.read_distances(spark, text(tmp_path, "p", "1 1 0\n2 1 3.5\n2 2 0\n")).collect()
    assert {(r["q"], r["s"], r["d"]) for r in pairs} == {(1, 1, 0.0), (1, 2, 3.5), (2, 2, 0.0)}
    with pytest.raises(ValueError, match="need 3 pairs"):
        P.read_distances(spark, text(tmp_path, "m", "1 1 0\n2 2 0\n"))
    kept = P.random_attributes(10, 3, 5)
    assert kept == P.random_attributes(10, 3, 5) and len(set(kept)) == 3 and max(kept) < 10
    assert P.project(spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>"), [2, 0]).first()["v"] == [3.0, 1.0]
    made = P.uniform_points(spark, 50).collect()
    assert len(made) == 50 and all(0 <= x <= 100_000 for r in made for x in r["v"])


def test_error_function_and_weights(spark):
    xs = [i / 50 for i in range(-400, 401)] + [60.0, -60.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", V.erf(F.col("x")).alias("e"))
    assert max(abs(r["e"] - math.erf(r["x"])) for r in rows.collect()) < 1e-14
    at, most = F.col("x"), F.lit(1.0)
    forms = {"constant": V.constant_weight(at, most), "erfc": V.erfc_weight(at, most), "gauss": V.gauss_weight(at, most), "linear": V.linear_weight(at, most), "quadratic": V.quadratic_weight(at, most)}
    got = spark.createDataFrame([(0.0,), (1.0,)], "x double").select("x", *[c.alias(n) for n, c in forms.items()]).orderBy("x").collect()
    for name in forms:
        assert got[0][name] == pytest.approx(1.0)
        assert got[1][name] == pytest.approx(1.0 if name == "constant" else 0.1, abs=1e-3)


def test_metrics_without_a_query(spark):
    row = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<double>")
    got = row.select(V.lp_norm(3)(F.col("a"), F.col("b")).alias("lp"), V.weighted([[2.0, 0.0], [0.0, 1.0]])(F.col("a"), F.col("b")).alias("w")).first()
    assert got["lp"] == pytest.approx((27 + 64) ** (1 / 3)) and got["w"] == pytest.approx(math.sqrt(2 * 9 + 16))


def test_roc_with_ties(spark):
    # Fixed values: (score, id), the five ids below are positive.
    rows = [(0, 1), (1, 2), (2, 6), (3, 7), (3, 3), (4, 8), (4, 4), (5, 9), (6, 5)]
    df = spark.createDataFrame([(n, float(-s), i <= 5) for n, (s, i) in enumerate(rows)], "id long, score double, positive boolean")
    assert S.roc_auc(df, "reference").first()["auc"] == pytest.approx(0.5, abs=1e-4)
    assert S.roc_auc(df).first()["auc"] == pytest.approx(0.6)


def test_regressions_and_density(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(60, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.1 * draw.normal(size=60)
    df = spark.createDataFrame([(n, 1.0, *map(float, x[n]), float(y[n])) for n in range(60)], "id long, one double, a double, b double, y double")
    full = np.column_stack([np.ones(60), x])
    b, ssr = np.linalg.lstsq(full, y, rcond=None)[:2]
    got = S.multiple_regression(df, ["one", "a", "b"], "y").first()
    assert got["coefficients"] == pytest.approx(b.tolist()) and got["ssr"] == pytest.approx(ssr[0]) and got["variance"] == pytest.approx(ssr[0] / 56)
    assert S.polynomial_regression(df, "a", "y", 2) == pytest.approx(np.polyfit(x[:, 0], y, 2)[::-1].tolist())
    half = np.ptp(y) / 5 / 2
    for name, form in S.KERNEL_FORMS.items():
        dens = {r["id"]: r["density"] for r in S.kernel_density(df, "y", name).collect()}
        width = np.minimum(y + half, y.max()) - np.maximum(y - half, y.min())
        want = form(np.abs(y[:, None] - y[None, :]) / half).sum(axis=1) / (60 * width / 2)
        assert [dens[n] for n in range(60)] == pytest.approx(want.tolist())


def test_sums_and_neighbours_along_an_order(spark):
    draw = random.Random(1)
    rows = [(n, n % 3 % 2, float(draw.randint(0, 40)), draw.randint(1, 9)) for n in range(300)]
    df = spark.createDataFrame(rows, "id long, ref int, d double, w long")
    order = [F.col("d"), F.col("id")]
    got = {r["id"]: r["before"] for r in ranges.sums_before(df, order, {"before": "w"}, "ref").collect()}
    near = {r["id"]: r["beside"] for r in ranges.with_beside(df, order, "ref", "d", 4, block=16).collect()}
    assert len(near) == 300
    for ref in (0, 1):
        line = sorted((r for r in rows if r[1] == ref), key=lambda r: (r[2], r[0]))
        for n, r in enumerate(line):
            assert got[r[0]] == sum(x[3] for x in line[:n])
            assert sorted(near[r[0]]) == [x[2] for x in line[max(0, n - 4) : n + 5]]


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(2)
    names = draw.sample(range(1000), 400)
    edges = [(names[n], names[n + 1]) for n in range(200)] + [(names[250], x) for x in names[251:300]] + [(names[301], names[301])]
    got = {r["id"]: r["comp"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(names[:201]) for x in names[:201]} | {x: min(names[250:300]) for x in names[250:300]} | {names[301]: names[301]}
    assert got == want
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gaussian_uniform_mixture_moves_outliers(spark):
    draw = np.random.default_rng(5)
    x = np.vstack([draw.normal(size=(80, 2)), [[30.0, 30.0], [-40.0, 25.0]]])
    df = spark.createDataFrame([(n, list(map(float, p))) for n, p in enumerate(x)], "id long, v array<double>")

    def plain(keep, gone):
        p = x[keep]
        n, cov = len(p), np.cov(p.T, bias=True)
        normal = -n / 2 * (2 * np.log(2 * np.pi) + np.log(np.linalg.det(cov)) + 2)
        return n * np.log(0.95) + normal + (gone * np.log(0.05) + gone * np.log(1 / gone) if gone else 0.0)

    got = {r["id"]: r["score"] for r in O.gaussian_uniform_mixture(df, 0.05).collect()}
    keep, gone, want = list(range(82)), 0, {}
    while True:
        base = plain(keep, gone)
        gain = {i: plain([j for j in keep if j != i], gone + 1) - base for i in keep}
        moved = [i for i in keep if gain[i] > 1e-7 and gain[i] >= max(gain.values()) / 2]
        want |= {i: gain[i] for i in (moved or keep)}
        if not moved:
            break
        keep, gone = [i for i in keep if i not in moved], gone + len(moved)
    assert {80, 81} <= {i for i in got if got[i] > 0} and sum(x > 0 for x in got.values()) < 10
    assert [got[i] for i in range(82)] == pytest.approx([want[i] for i in range(82)], rel=1e-6, abs=1e-6)
