"""An index of a grid's order: sorted files with the places they hold, of which a page reads only those it needs.

It is made once for a snapshot and kept beside it. The files are the range partitions
of the order; the catalogue has each one's first place and number of rows, a line for a file.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Order

_FILE = "path string, first bigint, n_rows bigint"


@dataclass(frozen=True)
class RankIndex:
    spark: SparkSession
    path: str
    order: Order

    @classmethod
    def made(cls, grid: DataFrame, order: Order, path: str, files: int | None = None) -> RankIndex:
        """Sorts ``grid`` into files below ``path``, as many as Spark finds fit by default; equal keys are told apart by the row id."""
        keys = order.columns()
        parts = grid.repartitionByRange(files, *keys) if files else grid.repartitionByRange(*keys)
        parts.sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).write.parquet(f"{path}/rows")
        spark = grid.sparkSession
        rows = spark.read.parquet(f"{path}/rows")
        sizes = rows.groupBy(F.col("_metadata.file_path").alias("path"), "__part").agg(F.count("*").alias("n")).collect()  # a row for each file
        first, listed = 0, []
        for r in sorted(sizes, key=lambda r: (r["__part"], r.path)):
            listed.append((r.path, first, r.n))
            first += r.n
        spark.createDataFrame(listed, _FILE).coalesce(1).write.parquet(f"{path}/files")
        return cls(spark, path, order)

    def files(self) -> list[tuple[str, int, int]]:
        """``path, first, n_rows`` of the files, in order."""
        return [tuple(r) for r in self.spark.read.schema(_FILE).parquet(f"{self.path}/files").orderBy("first", "n_rows").collect()]

    def _rows(self, paths: list[str]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def files_of(self, skip: int, limit: int) -> list[tuple[str, int, int]]:
        """The files that hold places from ``skip`` on."""
        every = self.files()
        lo = max(0, bisect_right([f[1] for f in every], skip) - 1)
        return [f for f in every[lo:] if f[1] < skip + limit and f[1] + f[2] > skip]

    def page(self, skip: int = 0, limit: int = 500) -> DataFrame:
        """``limit`` rows from ``skip`` on with their ``position``; only the files that hold them are read."""
        own = self.files_of(skip, limit)
        at = own[0][1] if own else 0
        rows = self._rows([f[0] for f in own]).drop("__part").orderBy(*self.order.columns()).offset(skip - at if own else 0).limit(limit)
        # the rows of one page
        return rows.withColumn("position", F.row_number().over(W.orderBy(*self.order.columns())).cast("bigint") - 1 + skip)

    def position(self, row_id: str) -> int | None:
        """The place of a row: the first place of its file, and the rows before it there; none if it isn't there."""
        key = F.col(self.order.key) if self.order.key else F.lit(None).cast("string")
        found = self._rows([f[0] for f in self.files()]).where(F.col("row_id") == row_id).select(F.col("_metadata.file_path").alias("file"), key.alias("key")).first()
        if found is None:
            return None
        kind = dict(self._rows([found.file]).select(key.alias("key")).dtypes)["key"]
        first = next(f[1] for f in self.files() if f[0] == found.file)
        return first + self._rows([found.file]).where(self.order.before(F.lit(found.key).cast(kind), F.lit(row_id))).count()

    def page_around(self, row_id: str, limit: int = 500) -> DataFrame:
        """The page in whose middle a row stands; empty if it isn't there."""
        at = self.position(row_id)
        return self.page(max(0, at - limit // 2), limit) if at is not None else self.page(0, 0)
