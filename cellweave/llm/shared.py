"""Where intermediate results that several executors read are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import current_folder, removed, shared_folder

__all__ = ["checkpoint_dir", "fresh_folder", "keep", "removed", "stored", "table"]

#: Row groups of about 8 MB; their size, as that of pages, is looked at after each row.
_FEW_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

#: The folder all executors share, as the cluster names it.
checkpoint_dir = shared_folder


def keep(df: DataFrame) -> DataFrame:
    """``df``, computed once and stored in the shared folder, with its lineage cut.

    A lost executor takes nothing with it. Within :func:`~cellweave.storage.scratch` it
    is a table that goes with the others; else Spark removes the files when the
    result is no longer referenced and the session cleans checkpoints.
    """
    if current_folder(df.sparkSession) != shared_folder(df.sparkSession).rstrip("/"):
        return stored(df)[0]
    return df.checkpoint()


def stored(df: DataFrame, large_rows: bool = False) -> tuple[DataFrame, str]:
    """``df``, written as a table to the shared folder and read from there, and the table's path for :func:`removed`.

    With ``large_rows``, of megabytes each, a row group has few of them: by default
    Parquet looks at its size only after 100 rows, and readers of nested columns
    take up to a whole row group at once.
    """
    path = fresh_folder(df.sparkSession, "table")
    df.write.options(compression="zstd", **(_FEW_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path for files of one run below the shared folder."""
    return f"{current_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
