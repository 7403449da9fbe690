"""Queries of batches of writes, the client's views, texts and sources, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import exchange, grid, history, layering, writes
from ..sources import parsers
from ..sources.rules import Rule, Rules, keyed, rows_of
from ..sources.store import Store
from ..storage import shared_folder
from . import bindings as b
from .registry import query

AT = "2024-02-01 10:20:30"


def _at() -> F.Column:
    return F.lit(AT).cast("timestamp")


# ---- one batch of updates: by key, to known and new rows, by five sources

BATCH_SQL = """, nu AS (SELECT event_id + 1000000000 AS seq, CASE WHEN user_id % 60 < 40 THEN 'K' ELSE 'N' END || (user_id % 60) AS k, unnest([event_type, 'label', 'id']) AS col, unnest([CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k') END, user_id::VARCHAR, 'x']) AS value,
  ['user','parser_a','parser_b','feed_x','feed_longer'][event_id % 5 + 1] AS source, user_id::VARCHAR AS updated_by FROM events WHERE event_id % 4 = 0),
n AS (SELECT * FROM nu WHERE col <> 'id'),
known AS (SELECT 'K' || p_partkey AS k FROM part),
every AS (SELECT seq, 'K' || substr(row_id, 5) AS k, col, source, value FROM ev WHERE seq % 4 <> 0 UNION ALL SELECT seq, k, col, source, value FROM n),
look AS (SELECT e.seq, e.k, e.col, e.source, o.value, row_number() OVER (PARTITION BY e.seq, e.col ORDER BY p.p, length(o.source), o.source, o.seq DESC) AS r FROM every e JOIN every o ON o.k = e.k AND o.col = e.col AND o.seq <= e.seq JOIN prio p ON p.source = o.source),
lagged AS (SELECT *, lag(value) OVER (PARTITION BY k, col ORDER BY seq) AS old_value FROM look WHERE r = 1),
born AS (SELECT k, min(seq) AS born FROM n WHERE k NOT IN (SELECT k FROM known) GROUP BY k),
did AS (SELECT l.seq, l.k, l.col, l.source, l.old_value, l.value AS new_value, coalesce(l.seq = b.born, false) AS fresh FROM lagged l LEFT JOIN born b USING (k) WHERE l.seq >= 1000000000 AND (coalesce(l.seq = b.born, false) OR coalesce(l.old_value, 'None') <> coalesce(l.value, 'None')))
"""


def state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey").cast("string")
    rows = b.read(spark, sf_dir, "part").select(
        F.lit("t").alias("table_name"), F.concat(F.lit("row-"), key).alias("row_id"), F.concat(F.lit("K"), key).alias("business_key"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    return rows, b.cell_events(spark, sf_dir).where("seq % 4 <> 0")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.read(spark, sf_dir, "events").where("event_id % 4 = 0")
    source = F.element_at(F.array(*map(F.lit, ("user", "parser_a", "parser_b", "feed_x", "feed_longer"))), (F.col("event_id") % 5 + 1).cast("int"))
    value = F.when(F.col("event_id") % 11 != 0, F.get_json_object("props", "$.k"))
    user = F.col("user_id").cast("string")
    return e.select(
        (F.col("event_id") + 10**9).alias("seq"), F.lit("t").alias("table_name"), F.lit(None).cast("string").alias("row_id"),
        F.concat(F.lit(" "), F.when(F.col("user_id") % 60 < 40, "K").otherwise("N"), (F.col("user_id") % 60).cast("string"), F.lit("\t")).alias("business_key"),
        F.create_map(F.col("event_type"), value, F.lit("label"), user, F.lit("id"), F.lit("x")).alias("cells"), source.alias("source"), user.alias("updated_by"),
    )


def _batch(spark: SparkSession, sf_dir: str) -> writes.Batch:
    rows, events = state(spark, sf_dir)
    return writes.applied(rows, events, updates(spark, sf_dir), "tx-1", _at())


@query("upsert_changed_cells", BATCH_SQL + "SELECT seq, k AS business_key, col, old_value, new_value FROM did")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _batch(spark, sf_dir)
    return done.changed.join(done.rows.select("row_id", "business_key"), "row_id").select("seq", "business_key", "col", "old_value", "new_value")


@query("upsert_rows", BATCH_SQL + f"""SELECT n.k AS business_key, bool_or(b.born IS NOT NULL) AS is_new, count(DISTINCT d.col) AS n_changed, CASE WHEN bool_or(b.born IS NOT NULL) OR count(d.col) > 0 THEN '{AT}' ELSE '' END AS updated
FROM n LEFT JOIN born b USING (k) LEFT JOIN did d ON d.k = n.k AND d.seq = n.seq AND d.col = n.col GROUP BY n.k""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).rows.select("business_key", "is_new", "n_changed", cells.display_time(F.col("updated_at")).alias("updated"))


@query("upsert_audit", BATCH_SQL + """, a AS (SELECT k, col AS column_name, old_value, new_value, source AS source_name FROM did WHERE source = 'user'
UNION ALL SELECT k, 'ROW_UPDATE', NULL, CASE WHEN bool_or(fresh) THEN 'new data' ELSE count(*) || ' fields updated' END, source FROM did WHERE source <> 'user' GROUP BY k, seq, source)
SELECT k AS business_key, column_name, old_value, new_value, source_name, 'tx-1' AS transaction_id, count(*) AS n FROM a GROUP BY ALL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).audit.groupBy("business_key", "column_name", "old_value", "new_value", "source_name", "transaction_id").agg(F.count("*").alias("n"))


@query("rows_after_upsert", BATCH_SQL + "SELECT count(*) AS n_rows, count(DISTINCT k) AS n_keys FROM (SELECT k FROM known UNION SELECT k FROM n)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = state(spark, sf_dir)
    return writes.rows_after(rows, _batch(spark, sf_dir)).agg(F.count_distinct("row_id").alias("n_rows"), F.count_distinct("business_key").alias("n_keys"))


@query("rows_created", f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS n, 't' AS table_name, '{AT}' AS created, 'CREATE' AS column_name, '_BATCH_' AS audit_row, 't / ' || count(*) OVER () || ' rows created' AS new_value, true AS is_v7 FROM customer WHERE c_acctbal < 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty row for each customer in debt."""
    made, audit = writes.created(spark, "t", b.read(spark, sf_dir, "customer").where("c_acctbal < 0").count(), _at(), "tx-2", "ann")
    numbered = made.select(F.row_number().over(grid.W.orderBy("row_id")).cast("bigint").alias("nth"), "table_name", "created_at", "row_id").withColumn("n", F.col("nth") - 1)
    one = audit.select("column_name", F.col("row_id").alias("audit_row"), "new_value")
    is_v7 = F.col("row_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return numbered.crossJoin(one).select("n", "table_name", cells.display_time(F.col("created_at")).alias("created"), "column_name", "audit_row", "new_value", is_v7.alias("is_v7"))


@query("rows_deleted", """, gone AS (SELECT count(*) AS n FROM ords WHERE status = 'F' AND row_id IN (SELECT 'order-' || lpad((o_orderkey * 7)::VARCHAR, 8, '0') FROM orders))
SELECT status AS table_name, count(*) - CASE WHEN status = 'F' THEN (SELECT n FROM gone) ELSE 0 END AS n_left, CASE WHEN status = 'F' THEN 'F / ' || (SELECT n FROM gone) || ' rows deleted' END AS new_value FROM ords GROUP BY status""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.orders(spark, sf_dir)
    rows = o.select(F.col("status").alias("table_name"), "row_id", "business_key", F.lit(None).cast("timestamp").alias("created_at"), "updated_at")
    ids = b.read(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), F.lpad((F.col("o_orderkey") * 7).cast("string"), 8, "0")).alias("row_id"))
    left, audit = writes.deleted(rows, ids, "F", _at(), "tx-3")
    return left.groupBy("table_name").agg(F.count("*").alias("n_left")).join(audit.select("table_name", "new_value"), "table_name", "left")


@query("delete_of_nothing", "SELECT 0::BIGINT AS n_entries, (SELECT count(*) FROM parts) AS n_left")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.parts(spark, sf_dir).select(F.lit("parts").alias("table_name"), "row_id", "business_key")
    left, audit = writes.deleted(rows, spark.createDataFrame([("absent",)], "row_id string"), "parts", _at(), "tx-3")
    return audit.agg(F.count("*").alias("n_entries")).crossJoin(left.agg(F.count("*").alias("n_left")))


# ---- sources taken away and pinned

_CELLS = "table_name string, row_id string, col string, seq bigint, source string"


def _requests(events: DataFrame, row: str, source: str) -> DataFrame:
    asked = events.where(F.col("row_id") == row).select(*layering.CELL).distinct()
    return asked.select(*layering.CELL, F.lit(2 * 10**9).cast("bigint").alias("seq"), F.lit(source).alias("source"), F.lit("ann").alias("updated_by"), F.lit("K").alias("business_key"), F.lit("tx-4").alias("transaction_id"))


_RANKED = """, c AS (SELECT *, row_number() OVER (PARTITION BY row_id, col ORDER BY best) AS b2 FROM state),
had AS (SELECT row_id, col, value AS old_value FROM c WHERE b2 = 1)"""


@query("source_removed_audit", _RANKED + """, valid AS (SELECT row_id, col FROM state WHERE row_id = 'row-3' AND source = 'user'),
left_ AS (SELECT *, row_number() OVER (PARTITION BY row_id, col ORDER BY best) AS b3 FROM state WHERE row_id = 'row-3' AND source <> 'user')
SELECT col AS column_name, old_value, l.value AS new_value, 'delete_source:user' AS source_name, 'system' AS updated_by, 'K' AS business_key FROM valid JOIN had USING (row_id, col) LEFT JOIN (SELECT * FROM left_ WHERE b3 = 1) l USING (row_id, col) WHERE coalesce(old_value, 'None') <> coalesce(l.value, 'None')""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.cell_events(spark, sf_dir)
    none = spark.createDataFrame([], _CELLS)
    asked = _requests(e, "row-3", "user").unionByName(_requests(e, "row-4", "absent"))
    return writes.sources_removed(e, none, none, asked, _at())[2].select("column_name", "old_value", "new_value", "source_name", "updated_by", "business_key")


@query("source_removed_clears_pin", """, s AS (SELECT *, row_number() OVER (PARTITION BY row_id, col ORDER BY best) AS b2 FROM state WHERE row_id = 'row-3' AND source <> 'parser_b'),
pinned AS (SELECT count(*) AS n FROM state WHERE row_id = 'row-3' AND source = 'parser_b')
SELECT col, value, source AS priority_source, (SELECT n FROM pinned) AS n_cleared FROM s WHERE b2 = 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a row are pinned to a source, which is removed and then written again: its pin doesn't come back."""
    e = b.cell_events(spark, sf_dir)
    none = spark.createDataFrame([], _CELLS)
    pins = _requests(e, "row-3", "parser_b").withColumn("seq", F.lit(10**9).cast("bigint")).select(*none.columns)
    gone, cleared, _ = writes.sources_removed(e, pins, none, _requests(e, "row-3", "parser_b"), _at())
    state = layering.effective(e.where("row_id = 'row-3'"), pins.unionByName(cleared.select(*pins.columns)), gone.select(*none.columns))
    return state.select("col", "value", "priority_source").crossJoin(cleared.agg(F.count("*").alias("n_cleared")))


@query("source_pinned_audit", _RANKED + """SELECT s.col AS column_name, old_value, s.value AS new_value, 'set_priority:feed_longer' AS source_name, 'ann' AS updated_by
FROM state s JOIN had USING (row_id, col) WHERE s.row_id = 'row-5' AND s.source = 'feed_longer' AND coalesce(old_value, 'None') <> coalesce(s.value, 'None')""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.cell_events(spark, sf_dir)
    none = spark.createDataFrame([], _CELLS)
    asked = _requests(e, "row-5", "feed_longer").unionByName(_requests(e, "row-6", "absent"))
    return writes.sources_pinned(e, none, none, asked, _at())[1].select("column_name", "old_value", "new_value", "source_name", "updated_by")


@query("source_unpinned", "SELECT row_id, col, value, source AS priority_source FROM (SELECT *, row_number() OVER (PARTITION BY row_id, col ORDER BY best) AS b2 FROM state WHERE row_id = 'row-5') WHERE b2 = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.cell_events(spark, sf_dir).where("row_id = 'row-5'")
    none = spark.createDataFrame([], _CELLS)
    pins = _requests(e, "row-5", "feed_longer").withColumn("seq", F.lit(10**9).cast("bigint")).select(*none.columns)
    unpin = _requests(e, "row-5", "x").withColumn("source", F.lit(None).cast("string"))
    more, _ = writes.sources_pinned(e, pins, none, unpin, _at())
    return layering.effective(e, pins.unionByName(more.select(*pins.columns))).select("row_id", "col", "value", "priority_source")


@query("cells_with_source", "SELECT row_id, col, bool_or(source = 'feed_x') AS has FROM latest WHERE k = 1 GROUP BY row_id, col")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = layering.latest_by_source(b.cell_events(spark, sf_dir))
    maps = live.groupBy("row_id", "col").agg(F.map_from_entries(F.collect_list(F.struct("source", "value"))).alias("sources"))
    return maps.select("row_id", "col", cells.has_source(F.col("sources"), "feed_x").alias("has"))


@query("winning_source_of_maps", "SELECT row_id, col, max(source) FILTER (WHERE best = 1) AS source FROM state GROUP BY row_id, col")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = layering.latest_by_source(b.cell_events(spark, sf_dir))
    maps = live.groupBy("row_id", "col").agg(F.map_from_entries(F.collect_list(F.struct("source", "value"))).alias("sources"))
    return maps.select("row_id", "col", cells.winning_source(F.col("sources")).alias("source"))


@query("typed_value_texts", "SELECT p_partkey AS id, p_size::VARCHAR AS as_int, p_size || '.0' AS as_float, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS as_bool, 'None' AS as_null FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = lambda v, k: cells.value_text(v, F.lit(k))
    return b.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text(size, "int").alias("as_int"), text(size, "float").alias("as_float"),
        text((F.col("p_size") > 25).cast("string"), "bool").alias("as_bool"), text(F.lit(None).cast("string"), "str").alias("as_null"),
    )


# ---- pages

_LATEST = ", o AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC NULLS FIRST, row_id DESC) - 1 AS position FROM ords)"


@query("page_result_jump", _LATEST + """, s AS (SELECT greatest(0, position - 20) AS skip, position FROM o WHERE row_id = 'order-00000123')
SELECT o.position, row_id, 'orders' AS table_name, (SELECT count(*) FROM ords) AS total, 0 AS skip, 40 AS "limit", s.skip::INTEGER AS calculated_skip, s.position AS target_offset FROM o, s WHERE o.position >= s.skip AND o.position < s.skip + 40""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grid.page_result(b.orders(spark, sf_dir), "orders", grid.Order("updated_at", True), 0, 40, "order-00000123")
    out = r.select("table_name", "total", "skip", "limit", "calculated_skip", "target_offset", F.posexplode("data").alias("n", "row"))
    return out.select((F.col("n") + F.col("calculated_skip")).cast("bigint").alias("position"), "row.row_id", "table_name", "total", "skip", "limit", "calculated_skip", "target_offset")


@query("page_result_plain", """SELECT (SELECT count(*) FROM ords) AS total, 30 AS skip, NULL::INTEGER AS calculated_skip, NULL::BIGINT AS target_offset, (SELECT string_agg(row_id, ',' ORDER BY row_id) FROM (SELECT row_id FROM ords ORDER BY row_id OFFSET 30 LIMIT 20)) AS ids""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grid.page_result(b.orders(spark, sf_dir), "orders", grid.Order(), 30, 20)
    return r.select("total", "skip", "calculated_skip", "target_offset", F.array_join("data.row_id", ",").alias("ids"))


@query("page_result_miss", "SELECT NULL::VARCHAR AS table_name, 0::BIGINT AS total, 10 AS skip, NULL::INTEGER AS calculated_skip, -1::BIGINT AS target_offset, 0 AS n")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grid.page_result(b.orders(spark, sf_dir), "orders", grid.Order(), 10, 20, "absent")
    return r.select("table_name", "total", "skip", "calculated_skip", "target_offset", F.size("data").alias("n"))


@query("jump_clears_filter", "SELECT row_id, position FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM ords) WHERE position >= 123 - 10 AND position < 123 + 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = b.orders(spark, sf_dir)
    return grid.jump(g, grid.searched(g, "no such text"), grid.Order(), "order-00000123", 20).select("row_id", "position")


@query("scanner_order_desc", "SELECT row_id, row_number() OVER (ORDER BY business_key IS NULL, business_key DESC, row_id) - 1 AS position FROM ords")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.numbered(b.orders(spark, sf_dir), grid.Order("id", True, scanner=True))


@query("scanner_positions", "SELECT row_id, position FROM (SELECT row_id, row_number() OVER (ORDER BY business_key IS NULL, business_key DESC, row_id) - 1 AS position FROM ords) WHERE row_id IN ('order-00000000', 'order-00000123', 'order-00000777')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([("order-00000000",), ("order-00000123",), ("order-00000777",), ("absent",)], "row_id string")
    return grid.positions_of(b.orders(spark, sf_dir), grid.Order("id", True, scanner=True), targets)


@query("positions_of_many", "SELECT row_id, position FROM (SELECT row_id, row_number() OVER (ORDER BY updated_at DESC NULLS FIRST, row_id DESC) - 1 AS position FROM ords) WHERE row_id < 'order-00000300'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = b.orders(spark, sf_dir)
    return grid.positions_of(g, grid.Order("updated_at", True), g.where("row_id < 'order-00000300'"))


@query("any_row", "SELECT row_id FROM parts ORDER BY row_id LIMIT 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.any_row(b.parts(spark, sf_dir)).select("row_id")


@query("next_batch", "SELECT row_id, position FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM parts) WHERE position >= 100 AND position < 150")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.next_batch(b.parts(spark, sf_dir), grid.Order(), 100, 50).select("row_id", "position")


@query("search_visible_columns", "SELECT row_id FROM parts WHERE lower(brand) LIKE '%brand#2%'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.searched(b.parts(spark, sf_dir), "brand#2", visible=["brand", "size"]).select("row_id")


_MODES = {
    "search_page_mode_cols": ("page", "SELECT row_id FROM ords WHERE FALSE"),
    "search_scanner_mode_cols": ("scanner", "SELECT row_id FROM ords WHERE contains(row_id, '-0000001')"),
    "search_export_mode_cols": ("export", "SELECT row_id FROM ords WHERE contains(row_id, '-0000001')"),
}


def _mode(name: str, mode: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grid.searched(b.orders(spark, sf_dir), "-0000001", ["row_id"], mode=mode).select("row_id")


for _name, (_m, _sql) in _MODES.items():
    _mode(_name, _m, _sql)


@query("system_cells", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE '2024-01-01 00:00:00' END AS created, CASE WHEN p_partkey % 2 = 0 THEN '2024-02-01 10:20:30' ELSE '2024-01-01 00:00:00' END AS updated, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 3 END AS n FROM part""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.read(spark, sf_dir, "part")
    has = F.col("p_partkey") % 3 == 0
    data = F.when(has, F.create_map(F.lit("name"), F.col("p_name"), F.lit("created_at"), F.lit("own"))).otherwise(F.create_map(F.lit("name"), F.col("p_name"), F.lit("updated_at"), F.lit("stale")))
    made = p.select("p_partkey", grid.with_system_cells(data, F.lit("2024-01-01").cast("timestamp"), F.when(F.col("p_partkey") % 2 == 0, _at())).alias("d"))
    return made.select(F.col("p_partkey").alias("id"), F.col("d")["created_at"].alias("created"), F.col("d")["updated_at"].alias("updated"), F.size("d").alias("n"))


@query("lifted_times", f"SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '{AT}' ELSE '' END AS updated FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("updated_at"), F.lit(AT))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    made = grid.lifted_times(b.read(spark, sf_dir, "part").select("p_partkey", data.alias("data")))
    return made.select(F.col("p_partkey").alias("id"), cells.display_time(F.col("updated_at")).alias("updated"))


@query("null_times_backfilled", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_filled FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = b.read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3 == 0).alias("was_null"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("updated_at"), F.col("o_orderdate").alias("created_at"))
    return grid.backfilled(made).where("updated_at = created_at").agg(F.count("*").alias("n"), F.count_if("was_null").alias("n_filled"))


_PAGES = """, have AS (SELECT p_partkey AS slot, 'r' || p_partkey AS row_id, p_name AS value FROM part),
came AS (SELECT 50 + p_partkey AS slot, 'r' || (p_partkey + 48) AS row_id, 'new ' || p_partkey AS value FROM part),
merged AS (SELECT c.slot, c.row_id, CASE WHEN h.slot IS NULL OR h.slot = c.slot THEN c.value END AS value, h.slot IS NOT NULL AND h.slot <> c.slot AS is_duplicate FROM came c LEFT JOIN have h USING (row_id)
UNION ALL SELECT h.slot, h.row_id, coalesce(c.value, h.value), false FROM have h LEFT JOIN came c ON c.row_id = h.row_id AND c.slot <> h.slot WHERE h.slot NOT IN (SELECT slot FROM came))
"""


@query("merged_pages", _PAGES + "SELECT * FROM merged")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.merged_pages(*_pages(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """A page of as many rows as are loaded, most of which are loaded two slots before."""
    p, k = b.read(spark, sf_dir, "part"), F.col("p_partkey")
    loaded = p.select(k.alias("slot"), F.concat(F.lit("r"), k.cast("string")).alias("row_id"), F.col("p_name").alias("value"))
    came = p.select(k.alias("n"), F.concat(F.lit("r"), (k + 48).cast("string")).alias("row_id"), F.concat(F.lit("new "), k.cast("string")).alias("value"))
    return loaded, came, 50


@query("shown_slots", _PAGES + "SELECT count(*) AS n_slots, count(row_id) AS n_loaded FROM merged WHERE NOT is_duplicate")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.loaded_counts(grid.without_duplicates(grid.merged_pages(*_pages(spark, sf_dir))))


@query("known_ids", _PAGES + "SELECT row_id FROM have UNION SELECT row_id FROM came")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, came, _ = _pages(spark, sf_dir)
    return grid.known_ids(loaded, came)


# ---- the client's rows after feed events

_SHOWN = """, shown AS (SELECT p_partkey AS "at", 'r' || p_partkey AS row_id, p_name AS value FROM part)"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return b.read(spark, sf_dir, "part").select(k.alias("at"), F.concat(F.lit("r"), k.cast("string")).alias("row_id"), F.col("p_name").alias("value"))


@query("feed_create_on_top", _SHOWN + ' SELECT "at" + 3 AS "at", row_id FROM shown UNION ALL SELECT i, \'new\' || i FROM range(3) t(i)')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.range(3).select(F.col("id").alias("n"), F.concat(F.lit("new"), F.col("id").cast("string")).alias("row_id"))
    return exchange.shown_after_create(_shown(spark, sf_dir).select("at", "row_id"), new)


@query("feed_create_at_end", _SHOWN + ' SELECT "at", row_id FROM shown UNION ALL SELECT (SELECT max("at") + 1 FROM shown) + i, \'new\' || i FROM range(3) t(i)')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.range(3).select(F.col("id").alias("n"), F.concat(F.lit("new"), F.col("id").cast("string")).alias("row_id"))
    shown = _shown(spark, sf_dir).select("at", "row_id")
    return exchange.shown_after_create(exchange.shown_after_create(shown, new, filtered=True), new, latest_first=False)


_UPSERTED = _SHOWN + ", e AS (SELECT i AS n, 'r' || (i * 10) AS row_id, 'v' || i AS value FROM range(8) t(i))"


@query("feed_upsert_floats", _UPSERTED + """SELECT row_id, coalesce(e.value, s.value) AS value, row_number() OVER (ORDER BY CASE WHEN s.row_id = 'r0' THEN 8 WHEN e.n IS NOT NULL THEN e.n ELSE 8 + s."at" END) - 1 AS place FROM shown s FULL JOIN e USING (row_id)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.range(8).select(F.col("id").alias("n"), F.concat(F.lit("r"), (F.col("id") * 10).cast("string")).alias("row_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    after = exchange.shown_after_upsert(_shown(spark, sf_dir).withColumnRenamed("at", "rank"), e)
    return after.select("row_id", "value", (F.row_number().over(grid.W.orderBy("rank")) - 1).cast("bigint").alias("place"))


@query("feed_upsert_in_place", _UPSERTED + 'SELECT row_id, coalesce(e.value, s.value) AS value, s."at" AS rank FROM shown s LEFT JOIN e USING (row_id)')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a search known rows stay where they are and new ones don't come in."""
    e = spark.range(8).select(F.col("id").alias("n"), F.concat(F.lit("r"), (F.col("id") * 10).cast("string")).alias("row_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    return exchange.shown_after_upsert(_shown(spark, sf_dir).withColumnRenamed("at", "rank"), e, searching=True).select("row_id", "value", "rank")


@query("feed_delete_ranges", "SELECT * FROM (VALUES ('remove', 5::BIGINT, 7::BIGINT), ('remove', 20, 20), ('remove', 30, 31)) v(kind, first, last)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(f"r{i}",) for i in (5, 6, 7, 7, 20, 30, 31)], "row_id string")
    return exchange.deletion(_shown(spark, sf_dir), ids).select("kind", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


@query("feed_delete_reset", "SELECT 'reset' AS kind, NULL::BIGINT AS first, NULL::BIGINT AS last")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([("r5",), ("absent",)], "row_id string")
    return exchange.deletion(_shown(spark, sf_dir), ids).select("kind", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


_FEED = """, c AS (SELECT o_orderdate::DATE::VARCHAR AS table_name, row_id FROM (SELECT o_orderdate, 'order-' || lpad(o_orderkey::VARCHAR, 8, '0') AS row_id, o_orderkey FROM orders WHERE o_orderdate < DATE '1995-03-01' OR o_orderstatus = 'P') WHERE true),
z AS (SELECT CASE WHEN row_id < 'order-00000040' THEN 'few' ELSE 'many ' || status END AS table_name, row_id FROM ords)"""


@query("feed_upsert_refresh", _FEED + """, s AS (SELECT table_name, count(*) AS n FROM z GROUP BY 1) SELECT table_name, 'batch_refresh_required' AS event, 0 AS chunk, '' AS row_ids FROM s WHERE n > 100
UNION ALL SELECT table_name, 'batch_row_upsert', ((nth - 1) // 20)::INTEGER, string_agg(row_id, ',' ORDER BY row_id) FROM (SELECT table_name, row_id, row_number() OVER (PARTITION BY table_name ORDER BY row_id) AS nth FROM z JOIN s USING (table_name) WHERE n <= 100) GROUP BY ALL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = b.orders(spark, sf_dir).select(F.when(F.col("row_id") < "order-00000040", "few").otherwise(F.concat(F.lit("many "), "status")).alias("table_name"), "row_id")
    silent = exchange.feed(changed, "upsert", chunk=20, silent=True)
    return exchange.feed(changed, "upsert", chunk=20).unionByName(silent).withColumn("row_ids", F.array_join("row_ids", ","))


# ---- the audit log's live groups and texts

@query("tx_summary", f""", x AS (SELECT (SELECT min(transaction_id) FROM audit) AS tx), a AS (SELECT * FROM audit WHERE transaction_id = (SELECT tx FROM x)), t AS (SELECT * FROM a ORDER BY timestamp DESC, id DESC LIMIT 3), c AS (SELECT column_name, max(timestamp) AS m FROM t GROUP BY 1)
SELECT (SELECT tx FROM x) AS transaction_id, (SELECT count(*) FROM a) AS total_count, string_agg(column_name, ',' ORDER BY m DESC) AS columns FROM c""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = b.audit(spark, sf_dir)
    return history.transaction_summary(audit, audit.agg(F.min("transaction_id")).first()[0], 3)


@query("tx_summary_miss", "SELECT '' AS transaction_id, 0::BIGINT AS total_count, '' AS columns WHERE FALSE")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.transaction_summary(b.audit(spark, sf_dir), "no such transaction")


@query("audit_groups_live", """, a AS (SELECT coalesce(transaction_id, 'no_tid') AS tx, id FROM audit)
SELECT tx, max(id) AS seq, count(*) AS total_count, least(5, count(*)) AS n_logs FROM a GROUP BY tx""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the first half of the entries, brought up to date by the second."""
    a = b.audit(spark, sf_dir).select(F.col("id").alias("seq"), "transaction_id")
    none = spark.createDataFrame([], "tx string, seq bigint, total_count bigint, n_logs bigint")
    half = history.groups_after(none, a.where("seq % 2 = 0"), 5)
    return history.groups_after(half, a.where("seq % 2 = 1"), 5)


@query("audit_groups_after_delete", """, a AS (SELECT coalesce(transaction_id, 'no_tid') AS tx, row_id FROM audit), t AS (SELECT tx, count(*) AS total_count FROM a GROUP BY tx)
SELECT tx, total_count, count(*) AS n_logs FROM a JOIN t USING (tx) WHERE row_id = '_BATCH_' OR row_id NOT IN ('cust-7', 'cust-8') GROUP BY tx, total_count""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = b.audit(spark, sf_dir).select(F.coalesce("transaction_id", F.lit(history.NO_TX)).alias("tx"), "row_id")
    gone = spark.createDataFrame([("cust-7",), ("cust-8",), (history.BATCH,)], "row_id string")
    return history.groups_without(a, a.groupBy("tx").agg(F.count("*").alias("total_count")), gone)


@query("log_texts", """SELECT id, '[' || updated_by || '] ' || CASE column_name WHEN 'click' THEN 'created t (' || target || ')' WHEN 'error' THEN 'deleted t (' || target || ')' WHEN 'view' THEN 'updated by script t (' || target || ')' ELSE 'changed ' || column_name || ' of t (' || target || ')' END || ' [' || strftime(t, '%H:%M:%S') || ']' AS line FROM (
SELECT id, updated_by, column_name, a.timestamp AS t, CASE WHEN business_key IS NULL THEN left(a.row_id, 8) WHEN length(business_key) > 10 THEN left(business_key, 10) || '...' ELSE business_key END AS target FROM audit a LEFT JOIN live USING (row_id))""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = b.audit(spark, sf_dir).join(b.customers(spark, sf_dir), "row_id", "left")
    kind = F.expr("CASE column_name WHEN 'click' THEN 'CREATE' WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'ROW_UPDATE' ELSE column_name END")
    return a.select("id", cells.log_text(F.lit("t"), kind, F.col("updated_by"), cells.target_text(F.col("business_key"), F.col("row_id")), F.col("timestamp")).alias("line"))


@query("change_texts", """SELECT p_partkey AS id, '[name] ' || left(p_name || p_type || p_brand, 20) || ' -> ' || 'None' AS tip, '[2024-02-01 10:20:30] None -> ' || p_name || ' (user by None)' AS lineage, 'a, b, c, d, e and 2 more' AS many, 'a, b' AS few FROM part""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    names = lambda x: F.array(*map(F.lit, x))
    return b.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), cells.change_text(F.lit("name"), F.concat("p_name", "p_type", "p_brand"), none).alias("tip"),
        cells.lineage_text(_at(), none, F.col("p_name"), F.lit("user"), none).alias("lineage"),
        cells.columns_text(names("abcdefg")).alias("many"), cells.columns_text(names("ab")).alias("few"),
    )


@query("sanitised_texts", "SELECT p_partkey AS id, p_name AS clean FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.encode("p_name", "utf-8"), F.unhex(F.lit("FFC3"))).cast("string")
    return b.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cells.sanitised(F.when(F.col("p_partkey") % 2 == 0, broken).otherwise(F.col("p_name"))).alias("clean"))


# ---- export and copy

@query("export_header", "SELECT * FROM (VALUES (0, 'brand'), (1, 'name'), (2, 'size'), (3, 'type'), (4, 'created_at'), (5, 'updated_at')) s(n, name)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(exchange.export_header(b.parts(spark, sf_dir)))), "n int, name string")


@query("export_file_lines", """SELECT 'business_key,status,created_at,updated_at' AS line, 'EFBBBF' AS mark UNION ALL SELECT coalesce(business_key, '') || ',' || status || ',,' || strftime(updated_at, '%Y-%m-%d %H:%M:%S'), 'EFBBBF' FROM ords""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' lines, as they end in CRLF: a header, then every row; and the mark before the first."""
    path = f"{shared_folder(spark)}/export-{spark.sparkContext.startTime}-{next(_count)}"
    g = b.orders(spark, sf_dir).withColumn("updated_at", cells.display_time(F.col("updated_at")))
    exchange.export_csv(g, grid.Order("updated_at", True), path, ["business_key", "status", "created_at", "updated_at"])
    first = spark.read.format("binaryFile").load(path).where("length > 0").orderBy("path").limit(1).select(F.hex(F.substring("content", 1, 3)).alias("mark"))
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line")).crossJoin(first)


def _counter():  # noqa: ANN202
    n = 0
    while True:
        yield n
        n += 1


_count = _counter()


@query("tsv_header", "SELECT 0::BIGINT AS n, 'BUSINESS_KEY' || chr(9) || 'STATUS' AS line UNION ALL SELECT row_number() OVER (ORDER BY updated_at DESC NULLS FIRST, row_id DESC), coalesce(business_key, '') || chr(9) || status FROM ords")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.tsv_lines(b.orders(spark, sf_dir), ["business_key", "status"], grid.Order("updated_at", True))


# ---- sources

@query("parsed_by_plug_in", "SELECT CASE WHEN p_partkey % 5 <> 0 THEN 'f' || p_partkey END AS file, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name, count(*) FILTER (WHERE p_partkey % 5 = 0) AS n_bad FROM part GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser reads each file on the executors; those it fails for are set apart."""

    def parser(name: str, content: bytes) -> list[dict]:
        return [] if name == "none" else [{"name": content.decode(), "length": len(content)}] if int(name[1:]) % 5 else [{}["missing"]]

    p = b.read(spark, sf_dir, "part")
    files = p.select(F.concat(F.lit("/in/f"), F.col("p_partkey").cast("string")).alias("file"), F.encode("p_name", "utf-8").alias("content"))
    rows = parsers.parsed(files, parser)
    good = parsers.good(rows).select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("row")["name"].alias("name"), F.lit(0).cast("bigint").alias("n_bad"))
    bad = parsers.quarantined(rows).agg(F.count("*").alias("n_bad"))
    return good.unionByName(bad.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("name"), "n_bad"))


@query("rows_with_key_only", "SELECT p_brand AS business_key, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without the key column are left out, and the key is stripped."""
    line = F.when(F.col("p_size") > 10, F.concat(F.lit("key=<\t"), F.col("p_brand"), F.lit(" >"))).otherwise("other=<1>")
    text = b.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), line.alias("text"))
    rows = rows_of(text, Rules([Rule("Key", r"key=<([^>]*)>"), Rule("other", r"other=<(\d)>")]))
    return keyed(rows, "KEY").groupBy("business_key").agg(F.count("*").alias("n"))


@query("store_one_table", "SELECT row_id, business_key FROM ords WHERE status = 'O'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written to a snapshot of three tables and read from one of them."""
    store = _stored(spark, sf_dir)
    return store.read("O").select("row_id", "business_key")


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, f"{shared_folder(spark)}/store-{spark.sparkContext.startTime}-{next(_count)}", {"O": ["status"], "F": ["status"], "P": ["status"]})
    store.create()
    o = b.orders(spark, sf_dir)
    store.write(o.select(F.col("status").alias("table_name"), "row_id", "business_key", F.create_map(F.lit("priority"), F.col("priority")).alias("data"), F.col("updated_at").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at")))
    return store


@query("store_statistics", "SELECT status AS table_name, count(*) AS n_rows, count(business_key) AS n_keys, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM ords GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).statistics().withColumn("last_at", cells.display_time(F.col("last_at")))


@query("store_versions", "SELECT (SELECT count(*) FROM ords) AS n_rows, 3::BIGINT AS version, 0::BIGINT AS n_null, (SELECT count(*) FROM ords) AS n_null_before, 0::BIGINT AS n_first, (SELECT count(*) FROM ords) AS n_null_more")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-filling is a new snapshot; older ones stay readable, and columns they lack are null."""
    store = _stored(spark, sf_dir)
    version = store.backfill()
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return (
        count(store.read(), "n_rows").withColumn("version", F.lit(version).cast("bigint"))
        .crossJoin(count(store.read().where("updated_at IS NULL"), "n_null")).crossJoin(count(store.read(version=2).where("updated_at IS NULL"), "n_null_before"))
        .crossJoin(count(store.read(version=1), "n_first")).crossJoin(count(store.read(more={"transaction_id": "string"}).where("transaction_id IS NULL"), "n_null_more"))
    )


@query("catalog", "SELECT (row_number() OVER (ORDER BY m DESC) - 1)::INTEGER AS n, table_name FROM (SELECT status AS table_name, count(*) AS m FROM ords GROUP BY 1)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured tables in their order, which is that of their sizes here."""
    sizes = b.orders(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()  # a row for each table
    return Store(spark, "", {r.status: [] for r in sizes}).catalog()
