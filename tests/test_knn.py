import numpy as np
from pyspark.sql import functions as F

from vicinal.functions.vectors import quantize
from vicinal.operators import clustering, knn


def test_quantize_cuts_after_32_bit_addition(spark):
    got = spark.createDataFrame([(12356.6276,), (-1.2345,), (0.0,)], "x double").select(quantize(F.col("x"))).collect()
    assert [r[0] for r in got] == [12356628, -1234, 0]  # 32-bit floats near 12 million are whole numbers


def test_blocks_equal_broadcast(spark, monkeypatch):
    x = np.random.default_rng(0).integers(0, 20, (150, 2)).astype(float)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    one = sorted(map(tuple, knn.knn_join(points, points, 4).select("q", "s", "rank").collect()))
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK", 40)
    assert one == sorted(map(tuple, knn.knn_join(points, points, 4).select("q", "s", "rank").collect()))


def test_z_values_keep_order():
    z = knn.z_values(np.array([[-5, -5], [0, 0], [1, 0], [0, 1], [7, 7]]))
    assert z[0] < z[1] < min(z[2], z[3]) and max(z[:4]) < z[4]


def test_dbscan_noise_and_border(spark):
    data = [(i, [float(i), 0.0]) for i in range(5)] + [(9, [50.0, 0.0])]
    got = dict(map(tuple, clustering.dbscan(spark.createDataFrame(data, "id long, v array<double>"), 1.0, 3).collect()))
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 9: None}
