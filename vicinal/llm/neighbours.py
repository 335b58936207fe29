"""Approximate nearest neighbours by cross-polytope hashing, reranked exactly.

Tables of one hash each bring vectors and queries together.  There, further
hashes of the same kind, which are made inside the task and never sent, decide
which of the vectors are a query's candidates: a vector's code in a table is
its nearest signed axis, and the sum over the tables of the query's coordinates
on these axes estimates how near the two are.  Only candidates are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import checkpointed, lean

#: Hash tables, axes that a query probes in each (as a share of all), and vectors, or queries, of a bucket in one task.
TABLES, PROBED, BLOCK = 8, 0.125, 16_384
#: Hashes that choose candidates, and what their estimate must reach, in standard deviations of that of unrelated vectors.
CODES, LEAST = 16, 2.1

def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows of ``x``, whose length is a power of two, as a rotation."""
    n = x.shape[1]
    out, h = x.copy(), 1
    while h < n:
        parts = out.reshape(len(out), n // (2 * h), 2, h)
        out = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(len(out), n)
        h *= 2
    return out / np.sqrt(n)


def rotated(x: np.ndarray, tab: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform: close to a random rotation of the padded rows."""
    size = 1 << max(1, int(np.ceil(np.log2(x.shape[1]))))
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    draw = np.random.default_rng([seed, abs(tab), int(tab < 0), size])
    for _ in range(3):
        out = hadamard(out * draw.choice([-1.0, 1.0], size))
    return out


def axes(x: np.ndarray, tab: int, seed: int) -> np.ndarray:
    """The nearest signed axis of each row: twice its number, one more if negative."""
    r = rotated(x, tab, seed)
    at = np.abs(r).argmax(axis=1)
    return 2 * at + (r[np.arange(len(r)), at] < 0)


def probes(x: np.ndarray, tab: int, seed: int, share: float) -> np.ndarray:
    """The signed axes of each row that are nearest to it, nearest first."""
    r = rotated(x, tab, seed)
    signed = np.stack([r, -r], axis=2).reshape(len(r), -1)
    n = max(1, int(np.ceil(share * signed.shape[1])))
    return np.argsort(-signed, axis=1, kind="stable")[:, :n]


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (floats stay floats, all else is doubles) and dim; null, empty and zero vectors and those with null or non-finite components are left out."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = "float" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where("vec_id is not null and v is not null")
    return rows.where((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; of length itself neither overflows nor vanishes."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the greatest component is between 1/2 and 1: cosines are the same bits."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def hashed(rows: DataFrame, tables: int, share: float | None, seed: int, with_vectors: bool = True) -> DataFrame:
    """tab, dim, bucket, vec_id and packed components; a row for each table, or for each probe if ``share`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = part.column(1).flatten().to_numpy().reshape(-1, dim)
                ids, packed = part.column(0).to_numpy(), [r.tobytes() if with_vectors else b"" for r in x]
                unit = unit_rows(x.astype(float))
                for tab in range(tables):
                    found = axes(unit, tab, seed)[:, None] if share is None else probes(unit, tab, seed, share)
                    for lo in range(0, len(x), 512):
                        b = found[lo : lo + 512]
                        k = np.repeat(np.arange(lo, lo + len(b)), b.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), tab, np.int32)), pa.array(np.full(len(k), dim, np.int32)), pa.array(b.ravel().astype(np.int32)), pa.array(ids[k]), pa.array([packed[i] for i in k], pa.binary())], names=["tab", "dim", "bucket", "vec_id", "packed"])

    return rows.select("vec_id", "v", "dim").mapInArrow(lean(run), "tab int, dim int, bucket int, vec_id long, packed binary")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows that are ``scaled``, in double precision; equal pairs give equal bits wherever they stand."""
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def estimates(q: np.ndarray, codes: np.ndarray, seed: int) -> np.ndarray:
    """For each of some unit queries and each row of ``codes``, the sum of the query's coordinates on the row's axes, over its deviation for unrelated vectors."""
    out, size = np.zeros((len(q), len(codes)), np.float32), 0
    for j in range(codes.shape[1]):
        r = rotated(q, -1 - j, seed)
        size = r.shape[1]
        out += np.take(np.stack([r, -r], axis=2).reshape(len(r), -1).astype(np.float32), codes[:, j], axis=1)
    return out / np.float32(np.sqrt(codes.shape[1] / size))


def row_codes(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The nearest signed axes of unit rows in the ``n`` hashes that choose candidates."""
    return np.stack([axes(x, -1 - j, seed) for j in range(n)], axis=1)


def nearest_in_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, kind: type = np.float64, seed: int = 0, codes: int = CODES, least: float | None = LEAST) -> pd.DataFrame:
    """The ``k`` nearest candidates of each query, by exact cosines, ties to the smaller id; without ``least`` all rows are candidates."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(rows):
        rows = rows.drop_duplicates("vec_id")
        q, x = (scaled(np.stack([np.frombuffer(b, kind) for b in side["packed"]]).astype(float)) for side in (queries, rows))
        ids, own = rows["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        unit_q, unit = unit_rows(q), unit_rows(x)
        kept = None if least is None else row_codes(unit, codes, seed)
        for lo in range(0, len(q), 64):
            near = None if kept is None else estimates(unit_q[lo : lo + 64], kept, seed) >= least
            for i in range(lo, min(len(q), lo + 64)):
                at = np.flatnonzero(ids != own[i] if near is None else near[i - lo] & (ids != own[i]))
                if not len(at):
                    continue
                rough = unit[at] @ unit_q[i]
                if len(at) > k:  # all that may be among the nearest once rounding is set right, ties included
                    at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9]
                score = cosines(np.broadcast_to(q[i], (len(at), q.shape[1])), x[at])
                best = np.lexsort((ids[at], -score))[:k]
                out["query_id"] += [int(own[i])] * len(best)
                out["vec_id"] += ids[at][best].tolist()
                out["score"] += score[best].tolist()
    return pd.DataFrame({"query_id": pd.Series(out["query_id"], dtype="int64"), "vec_id": pd.Series(out["vec_id"], dtype="int64"), "score": pd.Series(out["score"], dtype="float64")})


def _search(base: DataFrame, queries: DataFrame, k: int, tables: int, share: float, seed: int, block: int, codes: int, least: float | None) -> DataFrame:
    """query_id, vec_id, score: the nearest of each query in each block of each bucket that it probes."""
    keys = ["tab", "dim", "bucket"]

    def blocks(rows: DataFrame, share: float | None, name: str) -> DataFrame:
        # One row for each bucket: twice the dimension times the tables.
        sizes = hashed(rows, tables, share, seed, False).groupBy(*keys)
        return checkpointed(sizes.agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)))

    # Both sides of a bucket are cut, so that neither a bucket that holds most vectors nor one that most queries probe is one task's.
    sizes = F.broadcast(blocks(base, None, "rows").join(blocks(queries, share, "asks"), keys))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = hashed(queries, tables, share, seed).join(sizes, keys).withColumn("a", own("asks")).withColumn("b", every("rows"))
    right = hashed(base, tables, None, seed).join(sizes, keys).withColumn("b", own("rows")).withColumn("a", every("asks"))
    keys += ["a", "b"]
    kind = np.float32 if base.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    pairs = left.select(*keys, "vec_id", "packed").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "packed").groupBy(*keys))
    return pairs.applyInPandas(lambda q, x: nearest_in_block(q, x, k, kind, seed, codes, least), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int, copies: int) -> DataFrame:
    # A neighbour comes once from each table at most: k times the tables hold k different ones.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    some = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k * copies).select("query_id", "vec_id", "score").dropDuplicates(["query_id", "vec_id"])
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probed: float = PROBED, seed: int = 5, block: int = BLOCK, codes: int = CODES, least: float | None = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest of each vector whose id is divisible by ``every``.

    A vector stands in one bucket of each table; a query looks into the buckets
    of the axes nearest to it, and those vectors there whose estimate reaches
    ``least`` are ranked by exact cosines.  Vectors and queries of large
    buckets are cut into blocks that meet apart, so none is skipped.  A query
    that finds fewer than ``k`` is compared with all vectors.  Vectors of other
    dimensions are not compared; vectors that ``valid_vectors`` leaves out take
    no part.  Rows with the same id count once.  Other columns of ``vectors``
    are left out; an empty table gives an empty result.
    """
    base = valid_vectors(vectors, id_col, vector_col)
    queries = base.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    found = checkpointed(_best(_search(base, queries, k, tables, probed, seed, block, codes, least), k, tables))
    few = checkpointed(queries.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"))
    if few.isEmpty():
        return found
    rest = _best(_search(base, few, k, 1, 1.0, seed, block, codes, None), k, 1)
    return found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(rest)
