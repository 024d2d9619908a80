"""Running sums and row numbers over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattika.llm.common import durable

#: Rows that one range of the order is meant to hold, and the most ranges.
RANGE_ROWS, MOST_RANGES = 50_000, 4096


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], rows: int, within: list[str] | None = None) -> DataFrame:
    """Adds, for each name in sums, the sum of its column over all rows before this one in the order (by group of within).

    Ranges of the order are numbered, summed, and the sums of the ranges before
    are added: two shuffles of the rows, and a table of as many rows as there are
    ranges (and groups). Rows that tie in the order get different places in some
    fixed order. rows: about how many rows there are.
    """
    n = max(1, min(MOST_RANGES, -(-rows // RANGE_ROWS)))
    by = within or []
    ranged = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).withColumn("__tie", F.monotonically_increasing_id())
    ranged = durable(ranged)
    totals = ranged.groupBy("__range", *by).agg(*[F.sum(c).alias(f"__all_{k}") for k, c in sums.items()])
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__range", *by, *[F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__off_{k}") for k in sums])
    inner = W.partitionBy("__range", *by).orderBy(*order, "__tie").rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"__in_{k}") for k, c in sums.items()])
    # at most MOST_RANGES rows for each group
    joined = summed.join(F.broadcast(offsets), ["__range", *by])
    return joined.select(*df.columns, *[(F.col(f"__in_{k}") + F.col(f"__off_{k}")).alias(k) for k in sums])
