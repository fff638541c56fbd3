"""Ranks and running sums in two levels: within buckets that the order begins with, and of the buckets.

No task holds all rows; one holds a row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, order: list[Column], buckets: list[tuple[Column, bool]], by: tuple[str, ...] = (), alias: str = "r") -> DataFrame:
    """rows with their number in an order, from 1, within each value of `by`.

    buckets: columns without nulls, and whether each falls, such that sorting by them is a coarser form of the order.
    """
    names = [f"_bucket{i}" for i in range(len(buckets))]
    rows = rows.withColumns(dict(zip(names, (c for c, _ in buckets), strict=True)))
    keys = [*by, *names]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    falling = [F.desc(n) if down else F.asc(n) for n, (_, down) in zip(names, buckets, strict=True)]
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(*falling).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    offsets = sizes.select(*keys, before.alias("_before"))
    here = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = rows.withColumn("_here", here).join(offsets, keys)
    return out.withColumn(alias, (F.col("_before") + F.col("_here")).cast("long")).drop(*names, "_here", "_before")


def running(rows: DataFrame, value: str, order: list[Column], bucket: Column, alias: str = "before") -> DataFrame:
    """rows with the sum of a value over the rows before them; bucket: rises with the order."""
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    offsets = sizes.select("_bucket", (F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    here = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order)) - F.col(value)
    return rows.withColumn("_here", here).join(offsets, "_bucket").withColumn(alias, F.col("_here") + F.col("_before")).drop("_bucket", "_here", "_before")
