"""Running sums and neighbours along an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.plans.lineage import cut


def sums_before(rows: DataFrame, order: list[Column], sums: dict[str, str], per: str | None = None) -> DataFrame:
    """``rows`` and, for each name of ``sums``, the sum of its column over all rows that come before (of the same ``per``).

    Ranges of the order are written once; sums within a range follow from a
    window over it, those of earlier ranges from one row a range.
    """
    keys = [F.col(per)] if per else []
    placed = cut(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    by = ["_part", per] if per else ["_part"]
    totals = placed.groupBy(*by).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = (Window.partitionBy(per) if per else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    # A row for each range (and key): the partitions of a shuffle, not the data, bound them.
    out = out.join(starts, by)
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums])


def with_beside(rows: DataFrame, order: list[Column], per: str, value: str, k: int, block: int = 65_536) -> DataFrame:
    """``rows`` and ``beside``: the values of up to ``k`` rows before and after each, and its own, within ``per``.

    Blocks of positions overlap by ``k`` rows, so that each is a window of its own.
    """
    block = max(block, k + 1)
    at = sums_before(rows.withColumn("_one", F.lit(1).cast("long")), order, {"_pos": "_one"}, per).drop("_one")
    home, place = F.floor(F.col("_pos") / block), F.col("_pos") % block
    homes = F.array_compact(F.array(home, F.when(place < k, home - 1), F.when(place >= block - k, home + 1)))
    spread = at.withColumns({"_home": home, "_block": F.explode(homes)})
    near = Window.partitionBy(per, "_block").orderBy("_pos").rowsBetween(-k, k)
    return spread.withColumn("beside", F.collect_list(value).over(near)).where("_block = _home").drop("_pos", "_home", "_block")
