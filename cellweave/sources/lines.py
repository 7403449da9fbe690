"""Lines and CSV records of files of any size, whose parts are read side by side.

Spark reads a text file in splits. A line knows its file and split and its place in
the split; how many lines the splits before have, and whether they leave a quoted field
open, is a sum over splits, of which each file has a few. So lines get their numbers
in the file, and records that go on over several lines are found, without a file ever
being in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import stripped
from ..storage import stored
from .rules import Rules

_SPLIT = ["file", "__split"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, __split, __m, line``; ``__m`` grows along a split."""
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__m"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str, quotes: bool = False) -> DataFrame:
    """``file, n, line`` of the files at ``path``, ``n`` from 0 in each; with ``quotes`` also ``open``, whether a quoted field goes on into the line.

    Lines end with LF, CRLF or CR.
    """
    lines = stored(_lines(spark, path))
    n_quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    sizes = lines.groupBy(*_SPLIT).agg(F.count("*").alias("size"), F.min("__m").alias("first"), F.sum(n_quotes).alias("quotes"))
    before = W.partitionBy("file").orderBy("__split").rowsBetween(W.unboundedPreceding, -1)
    # a row for each split
    moved = sizes.select(*_SPLIT, (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("by"), F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("carry"))
    out = lines.join(moved, _SPLIT).withColumn("n", F.col("__m") + F.col("by"))
    if not quotes:
        return out.select("file", "n", "line")
    upto = W.partitionBy(*_SPLIT).orderBy("__m").rowsBetween(W.unboundedPreceding, -1)
    seen = F.col("carry") + F.coalesce(F.sum(n_quotes).over(upto), F.lit(0))
    return out.select("file", "__split", "n", "line", (seen % 2 == 1).alias("open"))


def csv_records_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, y, line``: records of CSV files, ``y`` from 0, line breaks within quotes as LF; blank lines are left out.

    A quote that is never closed goes on to the end of its file.
    """
    lines = stored(numbered_lines(spark, path, quotes=True))
    begins = F.when(F.col("open"), 0).otherwise(1)
    sizes = lines.groupBy(*_SPLIT).agg(F.sum(begins).alias("size"))
    before = W.partitionBy("file").orderBy("__split").rowsBetween(W.unboundedPreceding, -1)
    moved = sizes.select(*_SPLIT, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("by"))
    upto = W.partitionBy(*_SPLIT).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    each = lines.join(moved, _SPLIT).withColumn("y", F.col("by") + F.sum(begins).over(upto) - 1)
    # the lines of one record
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return each.groupBy("file", "y").agg(whole.alias("line")).where("line <> ''")


def lines_of_files(spark: SparkSession, path: str, rules: Rules) -> DataFrame:
    """:func:`~cellweave.sources.rules.lines_of` for files of any size: ``file, n, line, part``."""
    raw = numbered_lines(spark, path).withColumnRenamed("line", "raw").withColumn("line", stripped(F.col("raw")))
    if not rules.start and not rules.end:
        marked = raw.withColumns({"first": F.lit(-1), "head": F.lit(None).cast("bigint"), "last": F.lit(None).cast("bigint")})
    else:
        least = lambda found: F.min(F.when(found, F.col("n")))
        never = F.lit(False)
        has = lambda c, mark: F.col(c).rlike(mark) if mark else never
        # a row for each file
        starts = raw.groupBy("file").agg(least(has("line", rules.start)).alias("first"), least(has("raw", rules.start)).alias("head"))
        begun = F.coalesce("first", F.lit((1 << 62) if rules.start else -1))
        starts = stored(starts.select("file", begun.alias("first"), "head"))
        ends = raw.join(starts, "file").where(F.col("n") > F.col("first")).where(has("line", rules.end)).groupBy("file").agg(F.min("n").alias("last"))
        marked = raw.join(stored(starts.join(ends, "file", "left")), "file")
    body = (F.col("n") > F.col("first")) & (F.col("last").isNull() | (F.col("n") < F.col("last"))) & (F.col("line") != "")
    part = lambda keep, c, name: F.when(keep, F.struct(F.col(c).alias("line"), F.lit(name).alias("part")))
    header = F.col("head").isNull() | (F.col("n") < F.col("head"))
    return marked.select("file", "n", F.inline(F.array_compact(F.array(part(body, "line", "body"), part(header, "raw", "header")))))
