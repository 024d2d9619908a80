"""Numbers of rows in a total order, without one task that holds them all."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: those without maps."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()] or [F.lit(0)])


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Adds the place of each row in the order, from 0.

    Rows are partitioned by ranges of the order; each range numbers its own and adds
    the rows of those before, a table with a row for each range. Rows that tie in the
    order are told apart by a hash of all their columns, so that a task that runs again
    numbers them alike. The ranges are kept while the session has room, so that both
    steps see the same ones.
    """
    tie = row_hash(df)
    ranged = df.withColumn("__tie", tie).repartitionByRange(*order, F.col("__tie")).withColumn("__range", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = F.row_number().over(W.partitionBy("__range").orderBy(*order, "__tie")) - 1
    return ranged.withColumn("__at", inner).join(F.broadcast(offsets), "__range").select(*df.columns, (F.col("__at") + F.col("__off")).alias(name))
