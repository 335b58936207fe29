"""Nearest neighbours against brute force."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from vicinal.llm import neighbours, queries

SF = "/root/testdata/sf0.1"


def brute(ids, x, every, k=5):
    """The nearest of each query by cosine, ties to the smaller id."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        out[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_all_probed_equals_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(120, 12)).round(3)
    x[7] = x[8]
    data = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(500, [0.0] * 12, "c"), (550, None, "c"), (600, [float("nan")] * 12, "c"), (3, x[3].tolist(), "d"), (None, [1.0] * 12, "c"), (650, [None] * 12, "c"), (700, [], "c")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, query_id string")
    got = found(neighbours.nearest_neighbours(frame, every=10, probed=1.0, least=None, block=16))
    assert got == brute(np.arange(120), x, 10)
    assert neighbours.nearest_neighbours(frame.where("false")).count() == 0


def test_few_vectors_are_all_found(spark):
    data = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.1])]
    assert found(neighbours.nearest_neighbours(spark.createDataFrame(data, "vec_id long, embedding array<double>"))) == {0: [1, 2]}


def test_lengths_beyond_squares_and_dimensions_apart(spark):
    data = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3e300, 2e300]), (50, [1.0, 0.0, 0.0]), (51, [0.0, 1.0, 1.0])]
    rows = neighbours.nearest_neighbours(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in rows}
    assert got == {(0, 2): pytest.approx(5 / np.sqrt(26), abs=1e-15), (0, 1): pytest.approx(np.sqrt(0.5), abs=1e-15), (50, 51): 0.0}


def test_equal_vectors_are_cut_into_blocks(spark):
    data = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    got = found(neighbours.nearest_neighbours(spark.createDataFrame(data, "vec_id long, embedding array<float>"), every=3, block=32))
    assert got == {q: [i for i in range(6) if i != q][:5] for q in range(0, 300, 3)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_recall_and_candidates(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    want, got = brute(ids, x, 50), found(queries.op5_cross_polytope(spark, SF))
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    unit, ask = neighbours.unit_rows(x), np.flatnonzero(ids % 50 == 0)
    met = np.zeros((len(ask), len(x)), bool)
    for t in range(neighbours.TABLES):
        at, probed = neighbours.axes(unit, t, 5), neighbours.probes(unit[ask], t, 5, neighbours.PROBED)
        met |= (at[None, :, None] == probed[:, None, :]).any(axis=2)
    met &= neighbours.estimates(unit[ask], neighbours.row_codes(unit, neighbours.CODES, 5), 5) >= neighbours.LEAST
    assert met.mean() <= 0.1
