"""Tables kept on the way: written once to the folder that all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; in local mode a temporary one if it names none."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tables-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder; nothing may read it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder below the shared one that takes all tables stored meanwhile, and goes with them at the end.

    What is computed from them has to be collected or written elsewhere before.
    """
    path = f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    _scratch.append(path)
    try:
        yield path
    finally:
        _scratch.remove(path)
        removed(spark, path)


def current_folder(spark: SparkSession) -> str:
    """Where tables go: the innermost scratch folder, else the shared one."""
    return _scratch[-1] if _scratch else shared_folder(spark).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table: computed once, safe from lost executors, and of known size to the planner."""
    path = f"{current_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
