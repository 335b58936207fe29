"""Readers of point files and writers of results."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).select(F.split("line", r"\s+").alias("t"))


def read_join_points(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``id x1 .. xd ...`` lines: id and v (floats); what follows the coordinates is ignored."""
    return _tokens(spark, path).select(F.col("t")[0].cast("long").alias("id"), F.slice("t", 2, dim).cast("array<float>").alias("v"))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of each line as v (doubles), other words as labels joined by a blank.  Lines of different dimensions are an error."""
    rows = _tokens(spark, path).select(F.filter(F.transform("t", lambda x: x.try_cast("double")), lambda x: x.isNotNull()).alias("v"), F.concat_ws(" ", F.filter("t", lambda x: x.try_cast("double").isNull())).alias("labels"))
    dims = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if dims[0] != dims[1]:
        raise ValueError(f"lines have from {dims[0]} to {dims[1]} numbers")
    return rows


def read_bits(spark: SparkSession, path: str) -> DataFrame:
    """Lines of 0 and 1: the positions of the ones."""
    return _tokens(spark, path).select(F.filter(F.transform("t", lambda x, i: F.when(x == "1", i)), lambda i: i.isNotNull()).alias("bits"))


def read_sparse_bits(spark: SparkSession, path: str) -> DataFrame:
    """Lines of positions of ones, other words as labels: bits (ascending, each once) and labels."""
    number = lambda x: x.try_cast("int")
    return _tokens(spark, path).select(F.array_sort(F.array_distinct(F.filter(F.transform("t", number), lambda i: i.isNotNull()))).alias("bits"), F.concat_ws(" ", F.filter("t", lambda x: number(x).isNull())).alias("labels"))


def read_transposed(spark: SparkSession, path: str) -> DataFrame:
    """The n-th line holds the n-th attribute of all points: id (from 0, the place in the line) and v.

    The file is read as one text, as its lines have no other order; lines of
    different lengths are an error when the points are read.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))).alias("dim", "line"))
    cells = rows.select("dim", F.posexplode(F.split("line", r"\s+")).alias("id", "x"))
    points = cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", F.col("x").cast("double").alias("x")))), lambda c: c["x"]).alias("v"))
    points = points.join(F.broadcast(rows.agg((F.max("dim") + 1).alias("dims"))))
    whole = F.size("v") == F.col("dims")
    return points.select(F.col("id").cast("long").alias("id"), F.when(whole, F.col("v")).otherwise(F.raise_error(F.lit("attributes have different numbers of points"))).alias("v"))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """``n i1 x1 i2 x2 ... label`` lines: a map from index to value, and the rest as labels."""
    n = F.col("t")[0].cast("int")
    index = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("t", 1 + 2 * i).cast("int"))
    value = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("t", 2 + 2 * i).cast("float"))
    return _tokens(spark, path).select(F.map_from_arrays(index, value).alias("v"), F.concat_ws(" ", F.slice("t", 2 + 2 * n, F.size("t"))).alias("labels"))


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """``id1 id2 d`` lines of a symmetric distance, each pair once; a missing or repeated pair is an error."""
    rows = _tokens(spark, path).select(F.least(F.col("t")[0].cast("long"), F.col("t")[1].cast("long")).alias("q"), F.greatest(F.col("t")[0].cast("long"), F.col("t")[1].cast("long")).alias("s"), F.col("t")[2].cast("double").alias("d"))
    n = rows.select(F.explode(F.array("q", "s")).alias("id")).agg(F.countDistinct("id")).first()[0]
    total, different = rows.agg(F.count(F.lit(1)), F.countDistinct("q", "s")).first()
    if total != different or total != n * (n + 1) // 2:
        raise ValueError(f"{n} ids need {n * (n + 1) // 2} pairs; there are {total}, {different} of them different")
    return rows


def project(points: DataFrame, attributes: list[int]) -> DataFrame:
    """Keep the attributes given, by position from 0."""
    return points.withColumn("v", F.array(*[F.col("v")[i] for i in attributes]))


def random_attributes(dim: int, n: int, seed: int = 0) -> list[int]:
    """``n`` of ``dim`` attributes, for ``project``; the same for the same seed."""
    return sorted(random.Random(seed).sample(range(dim), n))


def uniform_points(spark: SparkSession, n: int, dim: int = 2, high: float = 100_000.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.array(*[F.round(F.rand(seed + i) * high, 4) for i in range(dim)]).alias("v"))


def write_join(result: DataFrame, path: str) -> None:
    """``q s d`` lines, farthest first within a query."""
    rows = result.repartition("q").sortWithinPartitions("q", F.col("d").desc(), F.col("s").desc())
    rows.select(F.concat_ws(" ", "q", "s", F.col("d").cast("string"))).write.text(path)


def write_clusters(result: DataFrame, path: str, compress: bool = False) -> None:
    result.write.option("compression", "gzip" if compress else "none").partitionBy("cluster").csv(path)
