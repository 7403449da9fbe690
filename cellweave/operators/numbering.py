"""Row numbers over tables and large groups without bringing either to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

_ROW_BITS = 33  # of ``monotonically_increasing_id``


def numbered(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "nth") -> DataFrame:
    """``df`` with the number of each row, from 0, in ``order`` within its ``group``, or within the table.

    Rows are range-partitioned and sorted once; a row's number is its place in its
    partition less that of its group's first row there, plus the group's rows in the
    partitions before. Only these counts, one for each partition and group, are joined.
    """
    group = group or []
    keys = [*(F.asc(g) for g in group), *order]
    parts = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id()))
    parts = parts.withColumns({"__p": F.shiftright("__m", _ROW_BITS), "__g": F.xxhash64(*group) if group else F.lit(0).cast("bigint")})
    sizes = parts.groupBy("__p", "__g").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = F.sum("__n").over(W.partitionBy("__g").orderBy("__p")) - F.col("__n")
    moved = sizes.select("__p", "__g", (before - F.col("__first")).alias("__by"))
    return parts.join(moved, ["__p", "__g"]).withColumn(name, F.col("__m") + F.col("__by")).drop("__m", "__p", "__g", "__by")
