"""Dense numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import materialize


def ranked(df: DataFrame, *order: Column | str, name: str = "_rank") -> DataFrame:
    """``df`` with ``name``: 1.. in the given order, whose keys are unique.

    Rows are dealt out by ranges of the order and written once, so that a range's number stays with its rows.
    A rank is the place within the range plus the rows of the ranges before it; those sums are as many as
    there are shuffle partitions, which bounds the broadcast.
    """
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_place", place).join(starts, "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
