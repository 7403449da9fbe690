"""Queries of what is kept between batches: versions, feeds, indexes, states and streams, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import exchange, grid, history
from ..operators.pieces import PieceIndex
from ..operators.ranked import RankIndex
from ..sources.ledger import Ledger
from ..sources.lines import csv_records_of, lines_of_files
from ..sources.merged import MergeStore
from ..sources.rules import Rule, Rules, rows_of_lines
from ..storage import shared_folder
from ..streaming.ingest import followed, live_groups
from . import bindings as b
from . import extended
from .registry import ORACLE_SQL, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- versions: all orders; then a tenth changed, some new, an eleventh deleted; then one table's rows touched

_VERSIONS = """, o AS (SELECT o_orderkey AS k, 'order-' || lpad(o_orderkey::VARCHAR, 8, '0') AS row_id, o_orderstatus AS table_name, o_orderpriority AS p, o_orderdate AS t FROM orders),
v1 AS (SELECT table_name, row_id, p, t FROM o),
v2 AS (SELECT table_name, row_id, CASE WHEN k % 10 = 0 THEN 'changed ' || p ELSE p END AS p, CASE WHEN k % 10 = 0 THEN t + INTERVAL 1 DAY ELSE t END AS t FROM o WHERE k % 10 = 0 OR k % 11 <> 0
  UNION ALL SELECT table_name, 'new-' || row_id, p, t FROM o WHERE k % 7 = 0),
v3 AS (SELECT * FROM v2 WHERE table_name <> 'P' OR row_id >= 'order')
"""


def _rows(o: DataFrame, row_id: F.Column, priority: F.Column, at: F.Column) -> DataFrame:
    return o.select(
        F.col("status").alias("table_name"), row_id.alias("row_id"), "business_key", F.create_map(F.lit("priority"), priority).alias("data"),
        F.col("updated_at").cast("timestamp").alias("created_at"), at.cast("timestamp").alias("updated_at"),
    )


def _store(spark: SparkSession, sf_dir: str, versions: int) -> MergeStore:
    o = b.orders(spark, sf_dir).withColumn("k", F.substring("row_id", 7, 8).cast("bigint"))
    store = MergeStore(spark, _folder(spark, "store"), files=8)
    p, t = F.col("priority"), F.col("updated_at")
    store.applied(_rows(o, F.col("row_id"), p, t))
    if versions > 1:
        changed = _rows(o.where("k % 10 = 0"), F.col("row_id"), F.concat(F.lit("changed "), p), t + F.expr("INTERVAL 1 DAY"))
        new = _rows(o.where("k % 7 = 0"), F.concat(F.lit("new-"), "row_id"), p, t)
        store.applied(changed.unionByName(new), o.where("k % 11 = 0").select(F.col("status").alias("table_name"), "row_id"), ("batches", 0))
    if versions > 2:
        gone = store.read("P").where("row_id < 'order'").select("table_name", "row_id")
        store.applied(deletes=gone, stream=("batches", 1))
    return store


@query("store_upsert", _VERSIONS + "SELECT table_name, row_id, p AS priority FROM v2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and delta files as a reader merges them."""
    return _store(spark, sf_dir, 2).read().select("table_name", "row_id", F.col("data")["priority"].alias("priority"))


@query("store_compacted", _VERSIONS + "SELECT table_name, row_id, p AS priority FROM v3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, 3)
    store.compacted()
    return store.read().select("table_name", "row_id", F.col("data")["priority"].alias("priority"))


@query("store_lookup", _VERSIONS + "SELECT table_name, row_id, p AS priority FROM v2 WHERE row_id = (SELECT max(row_id) FROM v1 WHERE row_id LIKE '%0') AND row_id IN (SELECT row_id FROM v1)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its key, from the files whose ranges hold it."""
    store = _store(spark, sf_dir, 2)
    last = b.orders(spark, sf_dir).where(F.col("row_id").endswith("0")).agg(F.max(F.struct("row_id", "status")).alias("r")).first().r
    return store.found(last.status, last.row_id).select("table_name", "row_id", F.col("data")["priority"].alias("priority"))


_BETWEEN = """SELECT table_name, row_id, CASE WHEN a.p IS NULL THEN 'create' WHEN z.p IS NULL THEN 'delete' ELSE 'update' END AS event, a.p AS old_priority, z.p AS new_priority
FROM v1 a FULL JOIN v3 z USING (table_name, row_id) WHERE a.p IS DISTINCT FROM z.p OR a.t IS DISTINCT FROM z.t"""


@query("feed_between_versions", _VERSIONS + _BETWEEN)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first version and the last, compacted one differ by; nobody hands over what changed."""
    store = _store(spark, sf_dir, 3)
    events = store.changes_between(1, store.compacted())
    return events.select("table_name", "row_id", "event", F.col("before.data")["priority"].alias("old_priority"), F.col("after.data")["priority"].alias("new_priority"))


@query("feed_chunks_between_versions", _VERSIONS + """, e AS (""" + _BETWEEN + """), d AS (SELECT table_name, row_id, row_number() OVER (PARTITION BY table_name ORDER BY row_id) AS nth FROM e WHERE event = 'delete')
SELECT table_name, 'batch_row_delete' AS event, ((nth - 1) // 500)::INTEGER AS chunk, string_agg(row_id, ',' ORDER BY row_id) AS row_ids FROM d GROUP BY ALL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _store(spark, sf_dir, 3).changes_between(1, 3).where("event = 'delete'")
    return exchange.feed(gone, "delete").withColumn("row_ids", F.array_join("row_ids", ","))


@query("dashboard_after_batches", _VERSIONS + """SELECT n.table_name, count(row_id) AS n_rows, coalesce(strftime(max(t), '%Y-%m-%d %H:%M:%S'), 'No Activity') AS last_updated, CASE WHEN epoch(TIMESTAMP '2001-08-02 00:30:00') - epoch(max(t)) < 3600 THEN 'Active' ELSE 'Idle' END AS status
FROM (SELECT unnest(['O', 'F', 'P', 'empty']) AS table_name) n LEFT JOIN v3 USING (table_name) GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the counts that every batch left, by table and time, not from rows."""
    store = _store(spark, sf_dir, 3)
    path = _folder(spark, "board")
    for v in (1, 2, 3):
        history.board_changes(store.changes_between(v - 1, v)).write.mode("append").parquet(path)
    return history.board_of(spark.read.parquet(path), ["O", "F", "P", "empty"], F.lit("2001-08-02 00:30:00").cast("timestamp")).select("table_name", "n_rows", "last_updated", "status")


# ---- places

_MIDDLE = """, r AS (SELECT row_id, row_number() OVER (ORDER BY updated_at DESC NULLS FIRST, row_id DESC) - 1 AS position FROM ords)
"""


def _ranks(spark: SparkSession, sf_dir: str) -> tuple[RankIndex, int]:
    g = b.orders(spark, sf_dir)
    return RankIndex.made(g, grid.Order("updated_at", True), _folder(spark, "ranks"), files=8), g.count()


@query("page_by_rank_index", _MIDDLE + "SELECT row_id, position FROM r WHERE position >= (SELECT count(*) // 2 FROM ords) AND position < (SELECT count(*) // 2 FROM ords) + 300")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from the middle, of which the files that hold it are read."""
    index, n = _ranks(spark, sf_dir)
    return index.page(n // 2, 300).select("row_id", "position")


@query("jump_by_rank_index", _MIDDLE + ", a AS (SELECT greatest(0, position - 20) AS lo FROM r WHERE row_id = 'order-00000777') SELECT row_id, position FROM r, a WHERE position >= lo AND position < lo + 40")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir)[0].page_around("order-00000777", 40).select("row_id", "position")


# ---- substrings

def _pieces(spark: SparkSession, sf_dir: str) -> PieceIndex:
    return PieceIndex.made(b.parts(spark, sf_dir), ["name", "brand", "type", "size"], _folder(spark, "pieces"), files=16)


_FOUND = "SELECT row_id, name, brand, type, size FROM parts WHERE contains(lower(name), '{0}') OR contains(lower(brand), '{0}') OR contains(lower(type), '{0}') OR contains(size::VARCHAR, '{0}')"


@query("search_by_pieces", _FOUND.format("nd#12"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only files that have all pieces of the text are read."""
    return _pieces(spark, sf_dir).search("ND#12").select("row_id", "name", "brand", "type", "size")


@query("search_by_pieces_short", _FOUND.format("7"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).search("7").select("row_id", "name", "brand", "type", "size")


# ---- the audit log

ORACLE_SQL["recent_transactions_early"] = ORACLE_SQL["recent_transactions"]


@query("recent_transactions_early")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found in the newest days; older days are only looked up for these transactions."""
    log = history.AuditLog(spark, _folder(spark, "audit"))
    log.add(b.audit(spark, sf_dir))
    return log.transactions(b.customers(spark, sf_dir)).withColumn("last_at", cells.display_time(F.col("last_at")))


@query("audit_groups_streamed", "SELECT tx, max(id) AS seq, count(*) AS total_count, least(5, count(*)) AS n_logs FROM (SELECT coalesce(transaction_id, 'no_tid') AS tx, id FROM audit) GROUP BY tx")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it comes in three files, a batch each; changed groups go to a table of a store."""
    at = _folder(spark, "entries")
    a = b.audit(spark, sf_dir).select(F.col("id").alias("seq"), "transaction_id")
    a.repartition(3, "seq").write.parquet(f"{at}/in")
    store = MergeStore(spark, f"{at}/store")
    entries = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    followed(live_groups(entries, 5), store, "groups", f"{at}/checkpoint").awaitTermination()
    number = lambda c: F.col("data")[c].cast("bigint").alias(c)
    return store.read("groups").select(F.col("row_id").alias("tx"), number("seq"), number("total_count"), number("n_logs"))


# ---- large files

@query("ingest_split_file", "SELECT p_name AS name, p_size::VARCHAR AS size, 'L1' AS lot, count(*) AS n FROM part GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as the lines of files with marks and headers, read in splits."""
    at = _folder(spark, "logs")
    p = b.read(spark, sf_dir, "part")
    body = p.select(F.concat(F.lit(" name="), "p_name", F.lit(" size="), F.col("p_size").cast("string"), F.lit(" \n"), F.lit("no row")).alias("line"))
    head, tail = (spark.createDataFrame([(x,)], "line string") for x in ("lot: L1\nname=early size=1\n== begin", "== end\nname=late size=2"))
    head.union(body).union(tail).coalesce(1).write.text(at)
    rules = Rules([Rule("name", r"name=(\S+ \S+)"), Rule("size", r"size=(\d+)", "int", required=True)], header=[Rule("lot", r"^lot: (\S+)")], start="^== begin$", end="^== end$")
    return rows_of_lines(lines_of_files(spark, at, rules), rules).groupBy("name", "size", "lot").agg(F.count("*").alias("n"))


@query("csv_split_file", "SELECT p_name || chr(10) || p_brand AS line, p_size::VARCHAR AS z, count(*) AS n FROM part GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two lines each, read in splits."""
    at = _folder(spark, "csv")
    p = b.read(spark, sf_dir, "part")
    p.select(F.concat(F.lit('"'), "p_name", F.lit("\n"), "p_brand", F.lit('",'), F.col("p_size").cast("string"))).write.text(at)
    fields = exchange.csv_fields(F.col("line"))
    return csv_records_of(spark, at).select(fields[0].alias("line"), fields[1].alias("z")).groupBy("line", "z").agg(F.count("*").alias("n"))


# ---- a batch committed whole

def _ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """A batch on a state of rows and past events, delivered twice."""
    ledger = Ledger(MergeStore(spark, _folder(spark, "ledger")))
    ledger.begun(*extended.state(spark, sf_dir))
    for _ in range(2):
        ledger.committed(extended.updates(spark, sf_dir), "tx-1", F.lit(extended.AT).cast("timestamp"), stream=("feed", 0))
    return ledger


@query("ledger_rows", extended.BATCH_SQL + """, said AS (SELECT k, col, source, value, row_number() OVER (PARTITION BY k, col, source ORDER BY seq DESC) AS r FROM every),
won AS (SELECT k, col, value, row_number() OVER (PARTITION BY k, col ORDER BY p, length(source), source) AS r2 FROM said JOIN prio USING (source) WHERE r = 1)
SELECT k AS business_key, col, value FROM won WHERE r2 = 1 AND value IS NOT NULL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all rows after a batch, as the store's rows have them."""
    return _ledger(spark, sf_dir).rows().select("business_key", F.explode("data").alias("col", "value")).where("value IS NOT NULL")


ORACLE_SQL["ledger_audit"] = ORACLE_SQL["upsert_audit"]


@query("ledger_audit")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that were committed with the rows, once."""
    return _ledger(spark, sf_dir).audit().groupBy("business_key", "column_name", "old_value", "new_value", "source_name", "transaction_id").agg(F.count("*").alias("n"))
