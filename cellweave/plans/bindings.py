"""The driver's tables as grids, audit entries and cell events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), 8, "0"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        _id("part-", "p_partkey").alias("row_id"), F.col("p_partkey").cast("string").alias("business_key"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        _id("order-", "o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") != "P", F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("business_key"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("updated_at"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows: those of one segment are deleted."""
    return read(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("row_id"), F.col("c_name").alias("business_key")
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", "_BATCH_").otherwise(F.concat(F.lit("cust-"), F.col("user_id").cast("string"))).alias("row_id"),
        F.col("event_type").alias("column_name"), F.col("value").alias("new_value"), F.col("user_id").cast("string").alias("updated_by"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))).alias("transaction_id"),
    )


def cell_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to cells by several sources, two of them unlisted."""
    source = F.element_at(F.array(*map(F.lit, ("user", "parser_a", "parser_b", "feed_x", "feed_longer"))), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("tx-"), F.floor(F.col("event_id") / 7).cast("string")).alias("tx"), F.lit("t").alias("table_name"),
        F.concat(F.lit("row-"), (F.col("user_id") % 40).cast("string")).alias("row_id"), F.col("event_type").alias("col"), source.alias("source"),
        F.when(F.col("event_id") % 11 != 0, F.get_json_object("props", "$.k")).alias("value"), F.col("user_id").cast("string").alias("updated_by"),
    )
