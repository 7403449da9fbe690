"""A training corpus in five stages: quality rules, line dedup, near dedup, decontamination, packing.

Each stage works on all rows its predecessor kept; in between they are written as
Parquet to the folder that all executors share. All stages but the last return
the columns of ``documents``; the last returns a row for each packed piece.

Every stage takes null, empty and very long texts, null and repeated ids, ties,
repeated rows, an empty table, and extra columns of any name, which all stages but
the last carry along. What each does with them is stated with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.decontam import keep_clean
from cellweave.llm.linedup import drop_bitmaps, without_lines
from cellweave.llm.minhash import keep_one_of_each_class
from cellweave.llm.packing import packed
from cellweave.llm.quality import keep_good
from cellweave.llm.shared import fresh_folder, removed, table
from cellweave.storage import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject; null and empty texts are among them, repeated rows are judged each."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that many of the documents share; copies of a text count once, and ``near_dedup`` keeps one of them.

    No document goes. Null texts stay null; rows that share an id count as one document.
    """
    return without_lines(docs, drop_bitmaps(docs, copies_once=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the first by id, null ids last; of repeated rows one. Wordless texts all stay."""
    return keep_one_of_each_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a benchmark window occurs; null and empty texts are clean, repeated rows are treated alike."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its bucket, batch and slot; null and empty texts are one piece, the end token."""
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Signatures can't be stated in SQL; tests hold :func:`run` against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; a stage's table is deleted when the next one's is there, and what it kept on its way with it."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            removed(spark, before)
        before = f"{folder}/{name}"
    return docs
