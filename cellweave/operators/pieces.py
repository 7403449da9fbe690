"""Substring search by an index of three-letter pieces, which tells the files that can have a text.

A snapshot's rows lie in files; the index has, for each piece of three letters that
stands in some cell of a file, the piece and the file, sorted by piece. A text of three
letters or more can only stand in files that have all its pieces: these are read
and searched, the others are skipped. Shorter texts, and rows that have changed since,
are searched without the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import searched

LETTERS = 3


def pieces_of(text: str) -> list[str]:
    """The distinct pieces of a text, in lower case."""
    low = text.lower()
    return sorted({low[i : i + LETTERS] for i in range(len(low) - LETTERS + 1)})


@dataclass(frozen=True)
class PieceIndex:
    spark: SparkSession
    path: str
    columns: tuple[str, ...]

    @classmethod
    def made(cls, grid: DataFrame, columns: list[str], path: str, files: int | None = None) -> PieceIndex:
        """Writes ``grid`` by ranges of row ids below ``path``, and the pieces of its ``columns``."""
        parts = grid.repartitionByRange(files, "row_id") if files else grid.repartitionByRange("row_id")
        parts.write.parquet(f"{path}/rows")
        spark = grid.sparkSession

        def of(column: str) -> Column:
            low = F.lower(F.col(column).cast("string"))
            starts = F.sequence(F.lit(1), F.length(low) - (LETTERS - 1))
            return F.when(F.length(low) >= LETTERS, F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(LETTERS)))))

        each = [of(c) for c in columns]
        none = F.array().cast("array<string>")
        rows = spark.read.parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(e, none) for e in each))))).alias("piece"))
        # aggregated in each file's task before it is shuffled
        rows.distinct().repartitionByRange("piece", "file").sortWithinPartitions("piece").write.parquet(f"{path}/pieces")
        return cls(spark, path, tuple(columns))

    def files(self) -> list[str]:
        return sorted(self.spark.read.parquet(f"{self.path}/rows").inputFiles())

    def files_of(self, q: str) -> list[str] | None:
        """The files that have all pieces of ``q``; none said for texts too short for the index."""
        wanted = pieces_of(q)
        if not wanted:
            return None
        postings = self.spark.read.parquet(f"{self.path}/pieces").where(F.col("piece").isin(wanted))
        return sorted(r.file for r in postings.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).collect())

    def search(self, q: str, cols: list[str] | None = None, changed: DataFrame | None = None) -> DataFrame:
        """Rows in which ``q`` stands in one of ``cols``, or in any indexed column; ``changed`` rows stand for those of their ids."""
        cols = cols or list(self.columns)
        if not {*cols} <= {*self.columns}:
            raise ValueError("only indexed columns can be searched")
        whole = self.spark.read.parquet(f"{self.path}/rows")
        files = self.files_of(q)
        own = whole if files is None else self.spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
        found = searched(own, q, cols)
        if changed is None:
            return found
        return found.join(changed.select("row_id"), "row_id", "left_anti").unionByName(searched(changed, q, cols).select(*found.columns))
