"""Mixing sources to target weights by exact cuts in a hash-random order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import WORD, checkpointed, small_side

#: Hexadecimal digits of the key that number a range of it: 4096 ranges a source.
RANGE_DIGITS = 3


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size in words (null text: 0) and the hash-random key of each row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """source, source_size and target of each source.

    Sources in code point order, null last, have the ``weights`` in turn and
    split ``share`` times all words.  A target stops at ``epochs`` times its
    source; what is left over goes to the others by weight.  That ends where
    every target is the lesser of its limit and one common level times its
    weight, so the level is found from running sums in the order in which
    sources reach their limits.  The windows see one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    limit = F.col("source_size") * F.lit(float(epochs))
    ranked = per.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1).alias("weight")).withColumn("ratio", limit / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.lit(float(epochs)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    # The levels fall after the first that is within its source's limit.
    first = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return leveled.withColumn("level", first).select("source", "source_size", F.least(limit, F.coalesce(F.col("level") * F.col("weight"), limit)).alias("target"))


def source_cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, full epochs, and the (key, doc_id) at which the last epoch ends.

    Each source lies in the order of its hash-random keys.  Prefix sums are
    taken over the 4096 key ranges of a source first; only the range in which
    the budget ends is then sorted by row.  The cut is after the last document
    whose middle lies within the budget: the taken words differ from the target
    by half a document at most.
    """
    targets = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    ranges = sizes.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = targets.select(F.col("source").alias("t_source"), "rest")
    ends = ranges.withColumn("before", before).join(t, F.col("source").eqNullSafe(F.col("t_source"))).where("before <= rest")
    # The last range that begins within the budget.
    ends = checkpointed(ends.groupBy("source").agg(F.max(F.struct("range", "before", "rest")).alias("e")).select(F.col("source").alias("e_source"), "e.*"))
    inside = sizes.join(small_side(ends), F.col("source").eqNullSafe(F.col("e_source")) & (F.substring("key", 1, RANGE_DIGITS) == F.col("range")))
    along = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(along), F.lit(0))).where(F.col("at") + F.col("size") / 2.0 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("cut")).select(F.col("source").alias("c_source"), "cut")
    out = targets.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left")
    # Without a document inside, the cut is at the range's first possible key.
    return checkpointed(out.select(F.col("source").alias("of_source"), "source_size", "target", "full", F.coalesce("cut.key", "range").alias("cut_key"), F.col("cut.doc_id").alias("cut_id")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The rows of ``docs`` with how often the mix takes each: ``mix_copies``, and ``mix_size``, ``mix_source_size``, ``mix_target``.

    Null text and text without a word have size 0; null is a source of its own.
    Rows with the same id stand together in the order, so they are taken or
    left alike.  A source without words has target 0 and nothing of it is
    taken.  An empty table gives an empty result.  Columns of ``docs`` whose
    names begin with ``mix_`` are replaced.
    """
    sizes = checkpointed(document_sizes(docs, id_col, text_col, source_col))
    cuts = small_side(source_cuts(sizes, source_targets(sizes, weights, share, epochs)).select(F.struct("*").alias("mix_cut")))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = docs.join(cuts, F.col(source_col).eqNullSafe(F.col("mix_cut.of_source")))
    last = (key < F.col("mix_cut.cut_key")) | ((key == F.col("mix_cut.cut_key")) & F.coalesce(F.col(id_col) <= F.col("mix_cut.cut_id"), F.lit(False)))
    copies = F.col("mix_cut.full") + F.coalesce(last, F.lit(False)).cast("long")
    return rows.withColumns({"mix_size": size, "mix_source_size": F.col("mix_cut.source_size"), "mix_target": F.col("mix_cut.target"), "mix_copies": F.least(copies, F.lit(epochs)).cast("long")}).drop("mix_cut")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken, read from a table of sizes so that texts are read once."""
    sizes = checkpointed(document_sizes(docs, **{k: v for k, v in options.items() if k.endswith("_col")}))
    budget = {k: v for k, v in options.items() if not k.endswith("_col")}
    cuts = small_side(source_cuts(sizes, source_targets(sizes, **budget)))
    last = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & F.coalesce(F.col("doc_id") <= F.col("cut_id"), F.lit(False)))
    copies = F.least(F.col("full") + F.coalesce(last, F.lit(False)).cast("long"), F.lit(budget.get("epochs", 2)))
    return sizes.join(cuts, F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents, with their columns: a document taken twice stands in two rows.

    Null texts have no words and, like all others, go by the key of their id;
    rows without an id or with a shared one are each a document; a null source
    is a source.  An empty table gives an empty mix.
    """
    out = mix_sources(docs)
    return out.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select(*docs.columns)


ORACLE_OP6 = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM per),
ratios AS (SELECT *, (source_size * 2.0::DOUBLE) / weight AS ratio FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios),
targets AS (
  SELECT source, source_size,
         least(source_size * 2.0::DOUBLE, coalesce((SELECT max(level) FROM levels WHERE level <= ratio) * weight, source_size * 2.0::DOUBLE)) AS target
  FROM levels),
cuts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_epochs FROM targets),
placed AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.full_epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       (size * least(2, full_epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - full_epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
