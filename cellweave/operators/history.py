"""The audit log: groups by transaction, details, row and cell histories, the dashboard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import display_time

BATCH, NO_TX = "_BATCH_", "no_tid"


def newest() -> list[Column]:
    return [F.desc("timestamp"), F.desc("id")]


def alive_or_batch(audit: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries of rows that still exist, and of batches."""
    ids = rows.select(F.col("row_id").alias("live")).distinct()
    return audit.join(ids, F.col("row_id") == F.col("live"), "left").where((F.col("row_id") == BATCH) | F.col("live").isNotNull()).drop("live")


def first_seen(column: str, at: Column) -> Column:
    """Distinct non-empty values in the order of their first ``at``; an aggregate over pre-grouped rows."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col(column) != "", F.struct(at.alias("at"), F.col(column).alias("c"))))), lambda x: x["c"])


def transactions(audit: DataFrame, rows: DataFrame, limit: int = 100) -> DataFrame:
    """Recent transactions: ``tx, total_count, last_at, columns`` (joined) and the newest entry's ``id, column_name, row_id, updated_by``.

    Entries are first grouped by transaction and column, so that a transaction of
    any size sends one row for each of its columns.
    """
    a = alive_or_batch(audit, rows).withColumn("tx", F.coalesce("transaction_id", F.lit(NO_TX)))
    newest_entry = F.struct("timestamp", "id", "row_id", "updated_by", "column_name")
    by_column = a.groupBy("tx", "column_name").agg(F.count("*").alias("n"), F.max(newest_entry).alias("newest"))
    by_tx = by_column.groupBy("tx").agg(
        F.sum("n").alias("total_count"), F.max("newest").alias("newest"), F.array_join(first_seen("column_name", _age(F.col("newest"))), ",").alias("columns")
    )
    return by_tx.orderBy(F.desc("newest.timestamp"), F.desc("newest.id")).limit(limit).select(
        "tx", "total_count", F.col("newest.timestamp").alias("last_at"), "columns", "newest.id", "newest.column_name", "newest.row_id", "newest.updated_by"
    )


@dataclass(frozen=True)
class AuditLog:
    """An audit log in a folder for each day, sorted by transaction, with Bloom filters of the transactions.

    Recent transactions are found in the newest days alone; of the days before only
    the parts of files are read that may have entries of those transactions.
    """

    spark: SparkSession
    path: str

    def add(self, audit: DataFrame) -> None:
        """Appends entries (``id, timestamp, row_id, column_name, new_value, updated_by, transaction_id``); those without time are kept too."""
        day = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("none"))
        named = audit.withColumns({"day": day, "tx": F.coalesce("transaction_id", F.lit(NO_TX))})
        out = named.repartition("day").sortWithinPartitions("day", "tx").write.mode("append").partitionBy("day")
        out.option("parquet.bloom.filter.enabled#tx", "true").option("parquet.bloom.filter.expected.ndv#tx", "100000").parquet(self.path)

    def read(self, days: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).option("recursiveFileLookup", "false").parquet(self.path)
        rows = rows.withColumn("day", F.col("day").cast("string"))
        return rows if days is None else rows.where(F.col("day").isin(days))

    def days(self) -> list[str]:
        """The days there are, the newest first: the names of folders."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted((n[4:] for n in names if n.startswith("day=") and n != "day=none"), reverse=True) + [n[4:] for n in names if n == "day=none"]

    def newest(self, rows: DataFrame, limit: int = 100) -> tuple[list[str], int]:
        """The ``limit`` most recent transactions, and of how many days' entries they were found.

        Twice as many days are read each time, until they have enough transactions:
        all others' newest entries are older.
        """
        days, n = self.days(), 1
        while True:
            own = alive_or_batch(self.read(days[:n]), rows).groupBy("tx").agg(F.max(F.struct("timestamp", "id")).alias("newest"))
            found = own.orderBy(F.desc("newest.timestamp"), F.desc("newest.id")).limit(limit).collect()
            if len(found) >= limit or n >= len(days):
                return [r.tx for r in found], min(n, len(days))
            n *= 2

    def transactions(self, rows: DataFrame, limit: int = 100) -> DataFrame:
        """:func:`transactions` of the log."""
        found, _ = self.newest(rows, limit)
        # at most ``limit`` transactions
        return transactions(self.read().where(F.col("tx").isin(found)).drop("tx"), rows, limit)


def _age(entry: Column) -> Column:
    """Orders entries from the newest on."""
    return F.struct((-F.unix_micros(entry["timestamp"].cast("timestamp"))).alias("t"), (-entry["id"]).alias("i"))


def previews(audit: DataFrame, most: int = 500) -> DataFrame:
    """The ``most`` newest entries of each transaction with their ``nth``."""
    a = audit.withColumn("tx", F.coalesce("transaction_id", F.lit(NO_TX)))
    return a.withColumn("nth", F.row_number().over(W.partitionBy("tx").orderBy(*newest()))).where(F.col("nth") <= most)


def transaction_detail(audit: DataFrame, rows: DataFrame, tx: str, limit: int = 500) -> DataFrame:
    """The newest entries of one transaction with the rows' keys, of rows that are gone too."""
    keys = rows.select(F.col("row_id").alias("k_id"), "business_key")
    top = audit.where(F.col("transaction_id") == tx).orderBy(*newest()).limit(limit)
    return top.join(keys, F.col("row_id") == F.col("k_id"), "left").drop("k_id")


def transaction_summary(audit: DataFrame, tx: str, limit: int = 500) -> DataFrame:
    """``transaction_id, total_count, columns`` of one transaction: all its entries, and the columns of the newest; no row if it has none."""
    own = audit.where(F.col("transaction_id") == tx)
    top = own.orderBy(*newest()).limit(limit).groupBy("column_name").agg(F.max(F.struct("timestamp", "id")).alias("newest"))
    columns = top.agg(F.array_join(first_seen("column_name", _age(F.col("newest"))), ",").alias("columns"))
    total = own.agg(F.count("*").alias("total_count")).where("total_count > 0")
    # one row each
    return total.crossJoin(columns).select(F.lit(tx).alias("transaction_id"), "total_count", "columns")


def groups_after(groups: DataFrame, entries: DataFrame, most: int = 500) -> DataFrame:
    """Live groups ``tx, seq, total_count, n_logs`` after new entries (``seq, transaction_id``).

    A group counts every entry, keeps at most ``most``, and is as recent as its last one.
    """
    new = entries.groupBy(F.coalesce("transaction_id", F.lit(NO_TX)).alias("tx")).agg(F.max("seq").alias("new_seq"), F.count("*").alias("n"))
    both = groups.join(new, "tx", "full")
    n = F.coalesce("n", F.lit(0))
    return both.select(
        "tx", F.greatest("seq", "new_seq").alias("seq"), (F.coalesce("total_count", F.lit(0)) + n).alias("total_count"),
        F.least(F.lit(most), F.coalesce("n_logs", F.lit(0)) + n).alias("n_logs"),
    )


def groups_without(logs: DataFrame, totals: DataFrame, deleted: DataFrame) -> DataFrame:
    """Live groups ``tx, total_count, n_logs`` when the entries of deleted rows go; totals stay, groups without entries go."""
    left = logs.join(deleted.select("row_id").where(F.col("row_id") != BATCH), "row_id", "left_anti")
    return left.groupBy("tx").agg(F.count("*").alias("n_logs")).join(totals, "tx").select("tx", "total_count", "n_logs")


def todays(audit: DataFrame, now: Column) -> DataFrame:
    """Entries from the start of the day on."""
    return audit.where(F.col("timestamp") >= F.date_trunc("day", now))


def row_history(audit: DataFrame, row_id: str, column: str | None = None) -> DataFrame:
    """Entries of a row, or of one cell, newest first."""
    a = audit.where(F.col("row_id") == row_id)
    return (a if column is None else a.where(F.col("column_name") == column)).orderBy(*newest())


def dashboard(rows: DataFrame, tables: list[str], now: Column) -> DataFrame:
    """``table_name, n_rows, last_at, last_updated, status`` for each configured table, in one grouped scan; active ones first, then by name.

    ``last_updated`` is a text, ``No Activity`` for a table without rows.
    """
    return _board(rows.groupBy("table_name").agg(F.count("*").alias("n_rows"), F.max(F.coalesce("updated_at", "created_at")).alias("last_at")), tables, now)


def _board(counted: DataFrame, tables: list[str], now: Column) -> DataFrame:
    names = counted.sparkSession.createDataFrame([(t,) for t in tables], "table_name string")
    active = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("last_at") < 3600, F.lit(False))
    text = F.coalesce(F.nullif(display_time(F.col("last_at")), F.lit("")), F.lit("No Activity"))
    # as many rows as tables are configured
    return names.join(counted, "table_name", "left").select(
        "table_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "last_at", text.alias("last_updated"), F.when(active, "Active").otherwise("Idle").alias("status")
    ).orderBy(F.col("status") != "Active", "table_name")


def board_changes(changes: DataFrame) -> DataFrame:
    """Signed counts ``table_name, day, at, n`` of rows by their last time, from ``table_name, before, after`` (structs with times).

    Whatever batches did, upserts or deletes, adding up their counts gives those of the rows there are.
    """
    time = lambda c: F.coalesce(F.col(f"{c}.updated_at"), F.col(f"{c}.created_at"))
    sides = F.array(*(F.struct(F.col(c).isNotNull().alias("there"), time(c).alias("at"), F.lit(by).cast("bigint").alias("by")) for c, by in (("before", -1), ("after", 1))))
    each = changes.select("table_name", F.inline(sides)).where("there")
    return each.groupBy("table_name", F.to_date("at").alias("day"), "at").agg(F.sum("by").alias("n")).where("n <> 0")


def board_of(states: DataFrame, tables: list[str], now: Column) -> DataFrame:
    """:func:`dashboard` from added-up counts (:func:`board_changes`) instead of rows.

    Rows are counted by day; a table's last time is sought in the last of its days
    that still has rows, by the times that still have some.
    """
    by_day = states.groupBy("table_name", "day").agg(F.sum("n").alias("n"))
    totals = by_day.groupBy("table_name").agg(F.sum("n").alias("n_rows"), F.max(F.when(F.col("n") > 0, F.col("day"))).alias("day"))
    last = states.join(totals.select("table_name", "day"), ["table_name", "day"], "left_semi").groupBy("table_name", "at").agg(F.sum("n").alias("n"))
    last = last.where("n > 0").groupBy("table_name").agg(F.max("at").alias("last_at"))
    counted = totals.select("table_name", "n_rows").join(last, "table_name", "left")
    return _board(counted, tables, now)


def dashboard_totals(board: DataFrame, audit: DataFrame, now: Column) -> DataFrame:
    """``total_tables, total_rows, today_updates, system_health`` in one row."""
    total = board.agg(F.count("*").alias("total_tables"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"))
    return total.crossJoin(todays(audit, now).agg(F.count("*").alias("today_updates"))).withColumn("system_health", F.lit("Healthy"))
