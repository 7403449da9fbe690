"""Queries of what a client does around its pages and files: typing, scrolling, uploads, a store begun anew. With their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from ..sources.store import Store
from ..storage import shared_folder
from ..streaming.ingest import ingest_all
from . import bindings as b
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("searches_run", "SELECT p_partkey AS id, left(p_name, p_partkey % 6) AS q FROM part WHERE p_partkey % 6 = 0 OR length(left(p_name, p_partkey % 6)) >= 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts being typed, those that start a search."""
    typed = b.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("left(p_name, p_partkey % 6)").alias("q"))
    return typed.where(grid.searches(F.col("q")))


@query("viewport_chunk", """, r AS (SELECT row_id, row_number() OVER (ORDER BY updated_at DESC NULLS FIRST, row_id DESC) - 1 AS position FROM ords), n AS (SELECT (count(*) // 2) // 70 * 70 AS lo FROM ords)
SELECT row_id, position FROM r, n WHERE position >= lo AND position < lo + 70""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk that the middle row is in, when a viewport comes to it."""
    g = b.orders(spark, sf_dir)
    return grid.page(g, grid.Order("updated_at", True), grid.aligned_skip(g.count() // 2, 70), 70).select("row_id", "position")


@query("adapted_chunks", """, a AS (SELECT event_id AS id, 50 + event_id % 951 AS chunk, (user_id % 100) / 100 AS seconds, event_type = 'error' AS batch FROM events)
SELECT id, (CASE WHEN batch THEN chunk WHEN seconds < 0.5 THEN least(1000, floor(chunk * 1.1::DOUBLE)) WHEN seconds > 0.55 THEN greatest(50, floor(chunk * 0.9::DOUBLE)) ELSE chunk END)::BIGINT AS next_chunk FROM a""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a client asks for next, for every answer in a log of chunks and seconds."""
    log = b.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.expr("50 + event_id % 951").alias("chunk"), F.expr("(user_id % 100) / 100").alias("seconds"), F.expr("event_type = 'error'").alias("batch")
    )
    return log.select("id", grid.adapted_chunks(F.col("chunk"), F.col("seconds"), F.col("batch")).cast("bigint").alias("next_chunk"))


def _entries(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    data = F.create_map(F.lit("priority"), F.col("priority"))
    return rows.select(F.col("status").alias("table_name"), "row_id", "business_key", data.alias("data"), none.alias("created_at"), F.col("updated_at").cast("timestamp").alias("updated_at"))


@query("store_reset", "SELECT row_id, priority, 2::BIGINT AS version FROM ords WHERE status = 'O'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders are written and deleted, then those of one status written to the store begun anew."""
    store = Store(spark, _folder(spark, "store"), {"O": [], "F": [], "P": []})
    store.create()
    o = b.orders(spark, sf_dir)
    store.write(_entries(o))
    store.reset(sure=True)
    version = store.write(_entries(o.where("status = 'O'")))
    return store.read().select("row_id", F.col("data")["priority"].alias("priority"), F.lit(version).cast("bigint").alias("version"))


@query("workspace_files_ingested", """, f AS (SELECT p_partkey::VARCHAR AS key, p_name AS name, 'batch_ingester' AS source, 'batch_ingester' AS updated_by FROM part
UNION ALL SELECT 'n' || n_nationkey, n_name, 'user', 'ann' FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'user', 'bob' FROM region)
SELECT key, name, source, updated_by, 1::BIGINT AS n FROM f""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of all parts that a machine left in the table's folder, a user's upload and another's paste, each ingested once though the stream runs twice."""
    store = Store(spark, _folder(spark, "workspace"), {"parts": ["key", "name"]})
    at = store.workspace("parts")
    store.configure("parts", {"rules": [{"column": "key", "regex": r"key=(\S+)", "required": True}, {"column": "name", "regex": r"name=(.+)$"}]})
    lines = lambda t, key, name: b.read(spark, sf_dir, t).select(F.concat(F.lit("key="), key, F.lit(" name="), name).alias("line"))
    text = lambda df: "\n".join(r.line for r in df.collect())  # noqa: E731 - a file as a user sends it
    lines("part", F.col("p_partkey").cast("string"), "p_name").write.mode("append").text(f"{at}/raws")
    store.upload("parts", "nations.log", text(lines("nation", F.concat(F.lit("n"), "n_nationkey"), "n_name")).encode(), "ann")
    store.paste("parts", text(lines("region", F.concat(F.lit("r"), "r_regionkey"), "r_name")), "bob")
    out = f"{store.path}/rows"
    for _ in range(2):
        for q in ingest_all(store, lambda t, rows, i: rows.write.mode("append").parquet(out), keys={"parts": "key"}).values():
            q.awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("business_key").alias("key"), "name", "source", "updated_by").agg(F.count("*").alias("n"))
