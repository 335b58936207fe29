"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder: ``spark.checkpoint.dir``.

    One of our own is made only in local mode, as in tests, where the setting
    may be absent; on a cluster a folder of one machine would lose data, so
    there its absence is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="vicinal-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, in Parquet: for wide rows, of which each reader takes the columns that it needs."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few hundred bytes that fit every executor many times over.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small, else as it is.

    Count only what is checkpointed already: the count is a job of its own.
    """
    return F.broadcast(df) if df.count() <= rows else df


def unit_hash(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(rows: DataFrame, group: str, per_group: int | dict, key: str, seed: int = 0) -> DataFrame:
    """About ``per_group`` rows of each value of ``group`` (a number, or one for each value), chosen by the hash of ``key``.

    The share of each group follows from its count over all rows, so that the
    sample's size is bounded by ``per_group`` times the number of groups (in
    expectation) however large the table is.  Only the counts of the groups,
    one row each, come to the driver.
    """
    wanted = per_group if isinstance(per_group, dict) else {}
    shares = {r[0]: min(1.0, wanted.get(r[0], 0 if wanted else per_group) / r[1]) for r in rows.groupBy(group).count().collect()}
    keep = F.lit(False)
    for value, share in shares.items():
        keep = F.when(F.col(group).eqNullSafe(F.lit(value)), unit_hash(F.col(key), seed=seed) < share).otherwise(keep)
    return rows.where(keep)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with the memory that it leaves given back to the system at its end.

    Python workers live on from stage to stage, beside the heap of their
    executor; what the allocators keep of one stage would stay on top of the
    next one's needs.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


class Recent(dict):
    """A dictionary that fills itself and forgets: what was not asked for lately goes once ``most`` entries are held twice."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
