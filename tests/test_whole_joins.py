"""Joins of whole tables against brute force on the smallest tables."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from vicinal.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def vectors():
    t = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"])
    return t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)


def nearest(d, k):
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("metric", ["squared_euclidean", "manhattan", "maximum", "cosine"])
def test_knn_join_of_all_points(spark, metric):
    ids, x = vectors()
    diff = np.abs(x[:, None] - x[None])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = {"squared_euclidean": (diff**2).sum(axis=2), "manhattan": diff.sum(axis=2), "maximum": diff.max(axis=2), "cosine": np.maximum(0, 1 - unit @ unit.T)}[metric]
    got = core.queries()[f"knn_join_{metric}_all"](spark, SF).toPandas().sort_values(["q", "rank"])
    order = np.argsort(ids)
    assert got["q"].tolist() == np.repeat(ids[order], 5).tolist()
    np.testing.assert_allclose(got["d"].to_numpy().reshape(-1, 5), nearest(d, 5)[order], atol=1e-5)
    at = {v: n for n, v in enumerate(ids)}
    np.testing.assert_allclose(got["d"], [d[at[q], at[s]] for q, s in zip(got["q"], got["s"], strict=True)], atol=1e-5)


def test_reverse_neighbours_of_all_points(spark):
    ids, x = vectors()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(ids[j], ids[i]) for i, j in zip(*np.nonzero(d <= nearest(d, 5)[:, -1:]), strict=True)}
    assert {(r["q"], r["s"]) for r in core.queries()["reverse_knn_all"](spark, SF).collect()} == want


def test_ties_of_all_points(spark):
    t = pq.read_table(f"{SF}/part.parquet", columns=["p_partkey", "p_size", "p_retailprice"])
    ids, x = t["p_partkey"].to_numpy(), np.c_[t["p_size"].to_numpy(), t["p_retailprice"].to_numpy()]
    d = np.abs(x[:, None] - x[None]).max(axis=2)
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(d <= nearest(d, 5)[:, -1:]), strict=True)}
    assert {(r["q"], r["s"]) for r in core.queries()["knn_join_ties_all"](spark, SF).collect()} == want
    assert 0 < core.queries()["zorder_recall_all"](spark, SF).first()[0] <= 1
