"""Cells with a value from each source, as events and as they stand.

Writes are append-only events ``seq, table_name, row_id, col, source, value,
updated_by`` (values as texts, their types in an optional ``kind``). The state of a cell is the latest event of each
source, of which the winning one counts. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import PRIORITY, canonical_column, is_writable, rank, stripped, value_text
from ..storage import stored

CELL = ["table_name", "row_id", "col"]


def latest_by_source(events: DataFrame) -> DataFrame:
    """The last event of each cell and source; null is a value like others."""
    last = F.max_by(F.struct("value", "updated_by", "seq"), F.col("seq")).alias("e")
    return events.where(is_writable(F.col("col"))).groupBy(*CELL, "source").agg(last).select(*CELL, "source", "e.*")


def live_sources(events: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """:func:`latest_by_source` without what ``removed`` (``CELL, seq, source``) took away."""
    live = latest_by_source(events)
    if removed is None:
        return live
    gone = removed.groupBy(*CELL, "source").agg(F.max("seq").alias("gone"))
    return live.join(gone, [*CELL, "source"], "left").where("gone IS NULL OR seq > gone").drop("gone")


def current_pins(pins: DataFrame) -> DataFrame:
    """``CELL, pin`` of each cell that was ever pinned; null if its last pin was cleared."""
    return pins.groupBy(*CELL).agg(F.max_by(F.struct("source"), "seq")["source"].alias("pin"))


def effective(events: DataFrame, pins: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``value, priority_source, is_overwrite, updated_by, n_sources`` of each cell.

    ``pins`` (``CELL, seq, source``; null unpins) name the source that counts while
    it has a value; ``removed`` (``CELL, seq, source``) takes away a source's
    earlier events. ``updated_by`` is the last writer, even of a masked value.
    """
    live = live_sources(events, removed)
    order = rank(F.col("source"))
    if pins is not None:
        live = live.join(current_pins(pins), CELL, "left")
        order = F.struct((~F.col("source").eqNullSafe(F.col("pin"))).alias("other"), order.alias("r"))
    return live.groupBy(*CELL).agg(
        F.min_by("value", order).alias("value"),
        F.min_by("source", order).alias("priority_source"),
        F.bool_or(F.col("source") == "user").alias("is_overwrite"),
        F.max_by("updated_by", "seq").alias("updated_by"),
        F.count("*").alias("n_sources"),
    )


def _carried(boxes: dict[str, Column], before: dict[str, Column], best: Column, best_before: Column) -> Column:
    """The effective value from what a segment has by now and what was there before it, by way: pin, known sources, ``other``."""
    ways = [F.coalesce(boxes[k], before[k]) for k in boxes if k != "other"]
    # of unlisted sources the least rank counts; if it is the same, the later value
    own = best.isNotNull() & (best_before.isNull() | (best <= best_before))
    return F.coalesce(*ways, F.when(own, boxes["other"]).otherwise(before["other"]))


def changes(events: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """``events`` and what each did: ``old_value, new_value, is_new`` (the cell's first), ``differs`` in text, ``changed``.

    For each known source its last value up to the event is carried along; the
    first by priority is the effective value. Of unlisted sources the least rank so
    far is carried, and its value. A pinned source counts before all others from its first event on.

    Events are range-partitioned by cell and ``seq``, so a cell of any number of events
    spans several partitions. In each of these segments values are carried along
    by itself; what cells that span segments have at each segment's end, a row or two for
    each segment, is carried from one to the next and joined back. Segments are stored in the shared folder.
    """
    e = events.where(is_writable(F.col("col")))
    kind = F.col("kind") if "kind" in events.columns else F.lit("str")
    known = sorted(PRIORITY, key=PRIORITY.get)
    if pins is not None:
        e = e.join(current_pins(pins).withColumnRenamed("pin", "__pin"), CELL, "left")
    else:
        e = e.withColumn("__pin", F.lit(None).cast("string"))
    ordered = e.repartitionByRange(*CELL, "seq").sortWithinPartitions(*CELL, "seq")
    parts = stored(ordered.withColumn("__part", F.spark_partition_id()))

    other = ~F.col("source").isin(*PRIORITY)
    cond = {"pin": F.col("source") == F.col("__pin")} | {k: F.col("source") == k for k in known}
    boxed = F.struct("value", kind.alias("kind"))
    segment = [*CELL, "__part"]
    cell = W.partitionBy(*segment).orderBy("seq")
    upto = cell.rowsBetween(W.unboundedPreceding, W.currentRow)
    by = lambda c: F.last(F.when(c, boxed), ignorenulls=True).over(upto)
    local = parts.withColumn("__best", F.min(F.when(other, rank(F.col("source")))).over(upto))
    local = local.withColumns({f"__{k}": by(c) for k, c in cond.items()} | {"__other": by(other & (F.col("source") == F.col("__best.source"))), "__nth": F.row_number().over(cell)})

    # what a segment leaves to the next ones, of the cells that have more than one
    spans = parts.select(*segment).distinct().groupBy(*CELL).agg(F.count("*").alias("__n")).where("__n > 1").select(*CELL)
    at_end = lambda c: F.max_by(F.when(c, boxed), F.when(c, F.col("seq")))
    least = F.min_by(F.struct(rank(F.col("source")).alias("rank"), boxed.alias("box")), F.when(other, F.struct(rank(F.col("source")).alias("r"), (-F.col("seq")).alias("s"))))
    ends = parts.join(spans, CELL, "left_semi").groupBy(*segment).agg(*(at_end(c).alias(k) for k, c in cond.items()), F.when(F.bool_or(other), least).alias("least"))
    each = W.partitionBy(*CELL).orderBy("__part")
    earlier = each.rowsBetween(W.unboundedPreceding, -1)
    # a segment whose least rank is the least so far sets the value of unlisted sources
    ends = ends.withColumn("sets", F.when(F.col("least.rank") == F.min("least.rank").over(each.rowsBetween(W.unboundedPreceding, W.currentRow)), F.col("least")))
    last = lambda c: F.last(c, ignorenulls=True).over(earlier)
    carry = stored(ends.select(*segment, (F.row_number().over(each) > 1).alias("__goes_on"), last("sets").alias("__set"), *(last(k).alias(f"__b_{k}") for k in cond)))

    e = local.join(carry, segment, "left")
    boxes = {k: F.col(f"__{k}") for k in (*cond, "other")}
    before = {k: F.col(f"__b_{k}") for k in cond} | {"other": F.col("__set.box")}
    e = e.withColumn("__now", _carried(boxes, before, F.col("__best"), F.col("__set.rank")))
    first = F.col("__nth") == 1
    came = F.coalesce(*before.values())
    out = e.withColumns({"__before": F.when(first, came).otherwise(F.lag("__now").over(cell)), "is_new": first & ~F.coalesce("__goes_on", F.lit(False))})
    text = lambda c: F.coalesce(value_text(c["value"], c["kind"]), F.lit("None"))
    differs = text(F.col("__before")) != text(F.col("__now"))
    return out.select(*events.columns, F.col("__before.value").alias("old_value"), F.col("__now.value").alias("new_value"), "is_new", differs.alias("differs"), (F.col("is_new") | differs).alias("changed"))


def audit_of(events: DataFrame) -> DataFrame:
    """Audit entries: one for each changed cell a user wrote; for other sources one for each row and ``tx``."""
    c = changes(events).where("changed")
    users = c.where("source = 'user'").select("tx", "table_name", "row_id", F.col("col").alias("column_name"), "old_value", "new_value", "source", "updated_by")
    rows = c.where("source <> 'user'").groupBy("tx", "table_name", "row_id", "source").agg(
        F.count_distinct("col").alias("n"), F.max("updated_by").alias("updated_by")
    )
    return users.unionByName(
        rows.select(
            "tx", "table_name", "row_id", F.lit("ROW_UPDATE").alias("column_name"), F.lit(None).cast("string").alias("old_value"),
            F.concat("n", F.lit(" fields updated")).alias("new_value"), "source", "updated_by",
        )
    )


def upserted(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """``row_id, business_key, is_new, n_updates`` after a batch of ``seq, row_id, business_key``.

    An update's row is the one of its ``row_id``, else the one of its trimmed key;
    updates of one new key are one new row.
    """
    key = F.nullif(stripped(F.col("business_key")), F.lit(""))
    u = updates.select("seq", F.col("row_id").alias("given"), key.alias("business_key"))
    by_id = rows.select(F.col("row_id").alias("given"), F.col("row_id").alias("found_id"))
    by_key = rows.where("business_key IS NOT NULL").groupBy("business_key").agg(F.min("row_id").alias("found_key"))
    matched = u.join(by_id, "given", "left").join(by_key, "business_key", "left")
    found = F.coalesce("found_id", "found_key")
    new_id = F.coalesce("given", F.concat(F.lit("new-"), F.md5("business_key")), F.concat(F.lit("new-seq-"), F.col("seq").cast("string")))
    return matched.groupBy(F.coalesce(found, new_id).alias("row_id")).agg(
        F.max_by("business_key", "seq").alias("business_key"), F.bool_and(found.isNull()).alias("is_new"), F.count("*").alias("n_updates")
    )


def without_rows(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    return rows.join(deleted.select("row_id"), "row_id", "left_anti")


def merged_columns(cells: DataFrame, display: list[str]) -> DataFrame:
    """Cells whose columns differ in case only become one; each source's latest value stays."""
    return latest_by_source(cells.withColumn("col", canonical_column(F.col("col"), display)))
