"""Splitting a crowded group over the cells of a grid.

A group of n rows, each filed and asking, is cut into parts; a cell holds the rows
filed in one part and those asking in another, so that each filed row meets each
asking row in exactly one cell and no cell grows with the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_cells(rows: DataFrame, key: str, parts: str, filed: str) -> DataFrame:
    """The rows, repeated for their cells, with ``cell`` and ``asks`` added and the
    flag ``filed`` set for the cell. A row asks in each part of the filed; one with
    the flag is filed in its own part, once for each part of the asking."""
    n, i = F.col("_parts"), F.col("_i")
    own = F.pmod(F.col(key), n)
    rows = rows.withColumn("_parts", F.col(parts).cast("long")).withColumn("_filed", F.col(filed)).drop(parts, filed)
    last = F.when(F.col("_filed"), 2 * n - 2).otherwise(n - 1)
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    other = i - n + (i - n >= own).cast("long")
    asks = i < n
    cell = F.when(asks, F.shiftleft(i, 32) + own).otherwise(F.shiftleft(own, 32) + other)
    return rows.withColumn("cell", cell).withColumn("asks", asks).withColumn(filed, F.col("_filed") & (~asks | (i == own))).drop("_parts", "_filed", "_i")
