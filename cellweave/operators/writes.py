"""Batches of writes to a table: what each appends to the rows, the cell events, the pins and the audit log.

State is ``rows`` (``ROW``), cell events (see :mod:`layering`), ``pins`` and
``removed`` sources. Nothing is changed in place: a batch is computed from the
state before it, and its parts are appended to or replace what is stored. New
events and requests carry a ``seq`` that is greater than all before them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import is_writable, sanitised, stripped, time_ordered_id
from ..storage import stored
from . import layering
from .history import BATCH
from .layering import CELL

ROW = ["table_name", "row_id", "business_key", "created_at", "updated_at"]
ENTRY = ["timestamp", "table_name", "row_id", "column_name", "old_value", "new_value", "source_name", "updated_by", "transaction_id", "business_key"]


def entries(df: DataFrame, at: Column, tx: Column | None = None, **columns: Column) -> DataFrame:
    """Audit entries from ``df``: texts without invalid bytes; without ``tx`` a new transaction of the time ``at``."""
    tx = F.coalesce(*([tx] if tx is not None else []), time_ordered_id(at, F.lit("tx")))
    given = {"timestamp": at, "transaction_id": tx, "old_value": F.lit(None).cast("string"), "business_key": F.lit(None).cast("string")} | columns
    given |= {c: sanitised(given[c].cast("string")) for c in ("old_value", "new_value")}
    return df.select(*((given[c] if c in given else F.col(c)).alias(c) for c in ENTRY))


@dataclass(frozen=True)
class Batch:
    """What a batch of updates did."""

    rows: DataFrame  #: ``ROW, is_new, n_changed`` of every row an update names
    events: DataFrame  #: cell events to append
    changed: DataFrame  #: ``seq, table_name, row_id, col, old_value, new_value`` of changed cells
    audit: DataFrame  #: ``ENTRY``


def applied(
    rows: DataFrame, events: DataFrame, updates: DataFrame, tx: str, at: Column, key_column: str | None = None,
    pins: DataFrame | None = None, removed: DataFrame | None = None,
) -> Batch:
    """Updates ``seq, table_name, row_id, business_key, cells`` (a map), ``source, updated_by`` to rows by id or key.

    A row is found by its id within the table, else by its stripped key; updates
    that name the same new key are one new row, of which later ones win cell by
    cell. Cells of system columns are left out. The row's key follows the value
    of ``key_column``, if the update or the row has one that isn't null. A cell is
    changed if its row is new, or if the text of its effective value differs. A
    user's changes are logged cell by cell, others' by one entry for each update.

    Updates with their rows, and changed cells, are stored in the shared folder.
    """
    key = F.nullif(stripped(F.col("business_key")), F.lit(""))
    u = updates.withColumn("given_key", key).drop("business_key")
    by_id = rows.select("table_name", "row_id", F.lit(True).alias("by_id"))
    by_key = rows.where("business_key IS NOT NULL").groupBy("table_name", F.col("business_key").alias("given_key")).agg(F.min("row_id").alias("key_id"))
    u = u.join(by_id, ["table_name", "row_id"], "left").join(by_key, ["table_name", "given_key"], "left")
    found = F.when(F.col("by_id"), F.col("row_id")).otherwise(F.col("key_id"))
    # a key never names the row of a number, nor two parts together what two others do
    seed = F.to_json(F.struct(F.lit(tx).alias("tx"), "table_name", "given_key", F.when(F.col("given_key").isNull(), F.col("seq")).alias("seq")))
    # read by all that follows
    u = stored(u.withColumn("found", found).withColumn("row_id", F.coalesce("found", "row_id", time_ordered_id(at, seed))).drop("by_id", "key_id"))

    item = u.select("seq", "table_name", "row_id", "source", "updated_by", F.explode("cells").alias("col", "value")).where(is_writable(F.col("col")))
    new = item.select("seq", *CELL, "source", sanitised(F.col("value")).alias("value"), "updated_by", F.lit(tx).alias("tx"))
    # of the past only what each source said last of these cells
    past = layering.live_sources(events.join(new.select(*CELL).distinct(), CELL, "left_semi"), removed).withColumn("tx", F.lit(None).cast("string"))
    both = past.select(*new.columns, F.lit(False).alias("fresh")).unionByName(new.withColumn("fresh", F.lit(True)))
    firsts = u.where("found IS NULL").groupBy("table_name", "row_id").agg(F.min("seq").alias("born"))
    told = layering.changes(both, pins).where("fresh").join(firsts, ["table_name", "row_id"], "left")
    told = told.withColumn("row_is_new", F.coalesce(F.col("seq") == F.col("born"), F.lit(False)))
    changed = stored(told.where("row_is_new OR differs").select("seq", *CELL, "source", "updated_by", "old_value", "new_value", "row_is_new"))

    # keys: the update's own, else the stored cell's, else the row's, else the one it was named by
    of_update = stripped(F.col("cells")[key_column]) if key_column else F.lit(None).cast("string")
    named = u.groupBy("table_name", "row_id").agg(
        F.max_by(of_update, F.when(of_update.isNotNull(), F.col("seq"))).alias("k_update"), F.max_by("given_key", F.when(F.col("given_key").isNotNull(), F.col("seq"))).alias("k_given")
    )
    if key_column:
        of_cell = layering.effective(events.where(F.col("col") == key_column), pins, removed).select("table_name", "row_id", stripped(F.col("value")).alias("k_cell"))
        named = named.join(of_cell, ["table_name", "row_id"], "left")
    else:
        named = named.withColumn("k_cell", F.lit(None).cast("string"))
    counts = changed.groupBy("table_name", "row_id").agg(F.count_distinct("col").alias("n_changed"))
    old = rows.select("table_name", "row_id", F.col("business_key").alias("k_row"), "created_at", F.col("updated_at").alias("before"))
    after = (
        named.join(old, ["table_name", "row_id"], "left").join(counts, ["table_name", "row_id"], "left").join(firsts, ["table_name", "row_id"], "left")
        .withColumns({"is_new": F.col("born").isNotNull(), "n_changed": F.coalesce("n_changed", F.lit(0))})
        .select(
            "table_name", "row_id", F.coalesce("k_update", "k_cell", "k_row", "k_given").alias("business_key"),
            F.when(F.col("is_new"), at).otherwise(F.col("created_at")).alias("created_at"),
            F.when(F.col("is_new") | (F.col("n_changed") > 0), at).otherwise(F.col("before")).alias("updated_at"), "is_new", "n_changed",
        )
    )

    keys = after.select("table_name", "row_id", "business_key")
    user = changed.where("source = 'user'").join(keys, ["table_name", "row_id"])
    cells = entries(
        user, at, F.lit(tx), column_name=F.col("col"), old_value=F.col("old_value"), new_value=F.col("new_value"), source_name=F.col("source"),
        updated_by=F.coalesce("updated_by", F.lit("user")), business_key=F.col("business_key"),
    )
    others = changed.where("source <> 'user'").groupBy("table_name", "row_id", "seq", "source", "updated_by").agg(F.count("*").alias("n"), F.bool_or("row_is_new").alias("new"))
    summary = F.when(F.col("new"), F.lit("new data")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" fields updated")))
    lines = entries(
        others.join(keys, ["table_name", "row_id"]), at, F.lit(tx), column_name=F.lit("ROW_UPDATE"), new_value=summary, source_name=F.col("source"),
        updated_by=F.coalesce("updated_by", F.lit("system")), business_key=F.col("business_key"),
    )
    return Batch(after, new, changed.select("seq", *CELL, "old_value", "new_value"), cells.unionByName(lines))


def rows_after(rows: DataFrame, batch: Batch) -> DataFrame:
    """All rows as the batch leaves them."""
    return rows.select(*ROW).join(batch.rows.select("table_name", "row_id"), ["table_name", "row_id"], "left_anti").unionByName(batch.rows.select(*ROW))


def created(spark: SparkSession, table: str, n: int, at: Column, tx: str, user: str = "system") -> tuple[DataFrame, DataFrame]:
    """``n`` empty rows of a table, and one audit entry for all; none for no rows."""
    made = spark.range(n).select(
        F.lit(table).alias("table_name"), time_ordered_id(at, F.concat(F.lit(f"{tx}/"), F.col("id").cast("string"))).alias("row_id"),
        F.lit(None).cast("string").alias("business_key"), at.alias("created_at"), at.alias("updated_at"),
    )
    one = spark.range(1 if n else 0)
    return made, entries(one, at, F.lit(tx), **_of_batch(table, "CREATE", F.lit(f"{table} / {n} rows created"), user))


def _of_batch(table: str, what: str, text: Column, user: str) -> dict[str, Column]:
    return {"table_name": F.lit(table), "row_id": F.lit(BATCH), "column_name": F.lit(what), "new_value": text, "source_name": F.lit("system"), "updated_by": F.lit(user)}


def deleted(rows: DataFrame, ids: DataFrame, table: str, at: Column, tx: str, user: str = "system") -> tuple[DataFrame, DataFrame]:
    """The rows that stay when those of one table with ``ids.row_id`` go, and one audit entry with their count; none if none went."""
    gone = ids.select("row_id").distinct().withColumn("table_name", F.lit(table))
    left = rows.join(gone, ["table_name", "row_id"], "left_anti")
    n = rows.join(gone, ["table_name", "row_id"], "left_semi").agg(F.count("*").alias("n")).where("n > 0")
    text = F.concat(F.lit(f"{table} / "), F.col("n").cast("string"), F.lit(" rows deleted"))
    return left, entries(n, at, F.lit(tx), **_of_batch(table, "DELETE", text, user))


def _audited(before: DataFrame, after: DataFrame, asked: DataFrame, at: Column, what: str) -> DataFrame:
    """Entries for asked cells whose effective text differs; ``asked`` has ``CELL, source, updated_by, business_key, transaction_id``."""
    old, new = (x.select(*CELL, F.col("value").alias(n)) for x, n in ((before, "old_value"), (after, "new_value")))
    both = asked.join(old, CELL, "left").join(new, CELL, "left").where("coalesce(old_value, 'None') <> coalesce(new_value, 'None')")
    return entries(
        both, at, F.col("transaction_id"), column_name=F.col("col"), old_value=F.col("old_value"), new_value=F.col("new_value"),
        source_name=F.concat(F.lit(what), F.coalesce("source", F.lit("None"))), business_key=F.col("business_key"),
    )


def sources_removed(events: DataFrame, pins: DataFrame, removed: DataFrame, requests: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removals and pins to append, and audit entries, for ``CELL, seq, source, business_key, transaction_id``.

    Requests for sources a cell doesn't have are not found and do nothing. A
    removed source that is pinned loses its pin. One request for a cell.
    """
    cells = requests.select(*CELL).distinct()
    own = events.join(cells, CELL, "left_semi")
    there = layering.live_sources(own, removed).select(*CELL, "source")
    valid = requests.join(there, [*CELL, "source"], "left_semi")
    cleared = valid.join(layering.current_pins(pins), CELL).where("source = pin").select(*CELL, "seq", F.lit(None).cast("string").alias("source"))
    gone = valid.select(*CELL, "seq", "source")
    before = layering.effective(own, pins, removed)
    after = layering.effective(own, pins.select(*cleared.columns).unionByName(cleared), removed.select(*gone.columns).unionByName(gone))
    return gone, cleared, _audited(before, after, valid.withColumn("updated_by", F.lit("system")), at, "delete_source:")


def sources_pinned(events: DataFrame, pins: DataFrame, removed: DataFrame, requests: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Pins to append and audit entries for ``CELL, seq, source, updated_by, business_key, transaction_id``; a null source unpins.

    Requests for cells that don't exist, or sources a cell doesn't have, are not
    found and do nothing. One request for a cell.
    """
    own = events.join(requests.select(*CELL).distinct(), CELL, "left_semi")
    there = layering.live_sources(own, removed).select(*CELL, "source")
    valid = requests.where("source IS NOT NULL").join(there, [*CELL, "source"], "left_semi").unionByName(
        requests.where("source IS NULL").join(own.select(*CELL).distinct(), CELL, "left_semi")
    )
    pinned = valid.select(*CELL, "seq", "source")
    before = layering.effective(own, pins, removed)
    after = layering.effective(own, pins.select(*pinned.columns).unionByName(pinned), removed)
    return pinned, _audited(before, after, valid, at, "set_priority:")
