"""Parsers that users bring: a function from a file's name and bytes to rows, run by the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = Callable[[str, bytes], list[dict]]


def contents(spark: SparkSession, path: str) -> DataFrame:
    """``file, content`` of whole files, whatever their extension."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def parsed(files: DataFrame, parser: Parser, attempts: int = 3) -> DataFrame:
    """``file, n, row, error``: the parser's rows as maps of texts, numbered within a file.

    The parser is registered by passing it; nothing is loaded from folders. A file
    that can't be read (``PermissionError``) is tried ``attempts`` times. A file
    whose parser fails has one line with the error and no row; see :func:`good`
    and :func:`quarantined`.
    """

    def text(v: object) -> str | None:
        return None if v is None else str(v)

    def one(file: str, content: bytes) -> list[tuple]:
        for left in range(attempts - 1, -1, -1):
            try:
                rows = parser(file.rsplit("/", 1)[-1], bytes(content))
                return [(file, n, {str(k): text(v) for k, v in r.items()}, None) for n, r in enumerate(rows or [])]
            except PermissionError as e:
                if not left:
                    return [(file, None, None, f"{type(e).__name__}: {e}")]
            except Exception as e:  # noqa: BLE001 - whatever a user's parser raises is that file's error
                return [(file, None, None, f"{type(e).__name__}: {e}")]
        return []

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for file, content in zip(part["file"], part["content"], strict=True) for r in one(file, content)]
            yield pd.DataFrame(rows, columns=["file", "n", "row", "error"]).astype({"n": "Int32"})

    return files.mapInPandas(made, "file string, n int, row map<string,string>, error string")


def good(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NULL").drop("error")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").select("file", "error")


def told(files: DataFrame) -> DataFrame:
    """``file, text, error``: files' texts, and an error instead where a file isn't valid UTF-8."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select("file", F.when(valid, text).alias("text"), F.when(~valid, "not valid UTF-8").alias("error"))


def texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, text`` of files that are valid UTF-8, and ``file, error`` of the others."""
    every = told(files)
    return good(every), quarantined(every)
