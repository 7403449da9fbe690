"""Searched, ordered and paged views of a grid, and places in them.

A grid is a DataFrame with ``row_id`` and any of ``business_key``, ``created_at``,
``updated_at``, and its cells' effective values as columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import SYSTEM_COLUMNS, display_time
from .numbering import numbered as _numbered

MODES = ("any", "page", "scanner", "export")


def contains(text: Column, q: str) -> Column:
    """Substring regardless of case; ``%``, ``_`` and backslash stand for themselves; null contains nothing."""
    return F.coalesce(F.contains(F.lower(text.cast("string")), F.lit(q.lower())), F.lit(False))


def _cells(grid: DataFrame) -> list[str]:
    return [c for c in grid.columns if c not in (*SYSTEM_COLUMNS, "business_key", "table_name")]


def searched(grid: DataFrame, q: str = "", cols: list[str] | None = None, mode: str = "any", visible: list[str] | None = None) -> DataFrame:
    """Rows in which ``q`` stands in one of ``cols``, or in any cell if none are named.

    Mode ``any`` is the plain meaning. The others keep what callers of the three
    older endpoints see: ``page`` and ``scanner`` ask for ``q`` in the row's JSON
    text as well (``scanner``: or in its key or id), ``export`` doesn't filter if
    all of ``cols`` are blank. Without ``cols`` the ``visible`` columns, if given,
    are the scope.
    """
    cols = cols or visible
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not q:
        return grid
    named = [c.strip() for c in cols or [] if c.strip()]
    column = {"id": "row_id"}
    any_col = reduce(or_, (contains(F.col(column.get(c, c)), q) for c in named), F.lit(False))
    if mode == "any":
        return grid.where(any_col if named else reduce(or_, (contains(F.col(c), q) for c in _cells(grid)), F.lit(False)))
    row = contains(F.to_json(F.struct(*_cells(grid))), q)
    if mode == "scanner":
        row = row | contains(F.col("business_key"), q) | contains(F.col("row_id"), q)
    if mode == "export":
        return grid.where(any_col) if named else (grid if cols else grid.where(row))
    return grid.where(row & any_col if named else row)


def in_transaction(grid: DataFrame, audit: DataFrame, tx: str) -> DataFrame:
    """Rows that some audit entry of the transaction names."""
    return grid.join(audit.where(F.col("transaction_id") == tx).select("row_id"), "row_id", "left_semi")


@dataclass(frozen=True)
class Order:
    """``updated_at``, ``id`` (the business key) or anything else (the row id, always ascending).

    Null keys come last ascending and first descending; ties follow the row id in
    the same direction. A ``scanner`` order by key has null keys last and ties by
    ascending row id in both directions. ``before`` is derived from the same keys as
    the order.
    """

    by: str = ""
    desc: bool = False
    scanner: bool = False

    @property
    def key(self) -> str | None:
        return {"updated_at": "updated_at", "id": "business_key"}.get(self.by)

    def columns(self) -> list[Column]:
        if self.key is None:
            return [F.asc("row_id")]
        k = F.col(self.key)
        if self.scanner and self.by == "id":
            return [k.desc_nulls_last() if self.desc else k.asc_nulls_last(), F.asc("row_id")]
        return [k.desc_nulls_first(), F.desc("row_id")] if self.desc else [k.asc_nulls_last(), F.asc("row_id")]

    def before(self, key: Column, row_id: Column) -> Column:
        """Whether a row stands before the one with these."""
        if self.key is None:
            return F.col("row_id") < row_id
        k = F.col(self.key)
        if self.scanner and self.by == "id":
            less = (k.isNotNull() & key.isNull()) | ((k > key) if self.desc else (k < key))
            return (k.eqNullSafe(key) & (F.col("row_id") < row_id)) | F.coalesce(less, F.lit(False))
        tie = k.eqNullSafe(key) & ((F.col("row_id") > row_id) if self.desc else (F.col("row_id") < row_id))
        less = (k.isNull() & key.isNotNull()) | (k > key) if self.desc else (k.isNotNull() & key.isNull()) | (k < key)
        return tie | F.coalesce(less, F.lit(False))


#: Pages that end further down than this are taken from numbered rows, not from a top-k of all rows before them.
DEEP = 1_000_000
#: Positions of up to so many rows are counted in one scan; beyond it all rows are numbered.
MAX_TARGETS = 64


def page(grid: DataFrame, order: Order, skip: int = 0, limit: int = 500) -> DataFrame:
    """``limit`` rows from ``skip`` on with their ``position``: a top-k, or for deep pages a slice of the numbered rows."""
    if skip + limit > DEEP:
        return _numbered(grid, order.columns(), name="position").where(F.col("position").between(skip, skip + limit - 1))
    top = grid.orderBy(*order.columns()).offset(skip).limit(limit)
    return top.withColumn("position", F.row_number().over(W.orderBy(*order.columns())) - 1 + skip)


def positions_of(grid: DataFrame, order: Order, targets: DataFrame) -> DataFrame:
    """``row_id, position`` of the rows named by ``targets.row_id``; absent ones have no row.

    For a few targets one scan counts the rows before each.
    """
    spark = grid.sparkSession
    asked = targets.select("row_id").distinct()
    some = asked.limit(MAX_TARGETS + 1).collect()
    if len(some) > MAX_TARGETS:
        return numbered(grid, order).join(asked, "row_id", "left_semi")
    key = F.col(order.key) if order.key else F.lit(None).cast("string")
    found = grid.where(F.col("row_id").isin([r.row_id for r in some])).select("row_id", key.alias("key")).collect()
    if not found:
        return spark.createDataFrame([], "row_id string, position bigint")
    kind = grid.schema[order.key].dataType if order.key else "string"
    counts = [F.count_if(order.before(F.lit(r.key).cast(kind), F.lit(r.row_id))) for r in found]
    each = F.array(*(F.struct(F.lit(r.row_id).alias("row_id"), c.alias("position")) for r, c in zip(found, counts, strict=True)))
    return grid.agg(each.alias("each")).select(F.inline("each"))


def page_around(grid: DataFrame, order: Order, target: str, limit: int = 500) -> DataFrame:
    """The page in whose middle ``target`` stands; empty if the grid doesn't have it."""
    at = positions_of(grid, order, grid.sparkSession.createDataFrame([(target,)], "row_id string")).first()
    return page(grid, order, max(0, at.position - limit // 2), limit) if at else grid.limit(0).withColumn("position", F.lit(0))


def page_result(grid: DataFrame, table: str, order: Order, skip: int = 0, limit: int = 500, target: str | None = None) -> DataFrame:
    """One row as a caller of a page gets it: ``table_name, total, skip, limit, calculated_skip, target_offset, data``.

    With a ``target`` the page around it, where it begins and where the target stands.
    If the grid doesn't have it: no table name, a total of 0, no rows, and an offset of -1.
    """
    spark = grid.sparkSession
    start, offset = skip, None
    if target is not None:
        at = positions_of(grid, order, spark.createDataFrame([(target,)], "row_id string")).first()
        if at is None:
            none = grid.limit(0).groupBy().agg(F.collect_list(F.struct(*grid.columns)).alias("data"))
            return none.select(
                F.lit(None).cast("string").alias("table_name"), F.lit(0).cast("bigint").alias("total"), F.lit(skip).alias("skip"), F.lit(limit).alias("limit"),
                F.lit(None).cast("int").alias("calculated_skip"), F.lit(-1).cast("bigint").alias("target_offset"), "data",
            )
        start, offset = max(0, at.position - limit // 2), at.position
    rows = page(grid, order, start, limit)
    # at most ``limit`` rows
    data = rows.agg(F.array_sort(F.collect_list(F.struct("position", *grid.columns))).alias("data")).crossJoin(grid.agg(F.count("*").alias("total")))
    return data.select(
        F.lit(table).alias("table_name"), "total", F.lit(skip).alias("skip"), F.lit(limit).alias("limit"),
        F.lit(start if target is not None else None).cast("int").alias("calculated_skip"), F.lit(offset).cast("bigint").alias("target_offset"),
        F.transform("data", lambda x: F.struct(*(x[c].alias(c) for c in grid.columns))).alias("data"),
    )


def jump(grid: DataFrame, filtered: DataFrame, order: Order, target: str, limit: int = 500) -> DataFrame:
    """The page around ``target`` in the ``filtered`` rows, or in all rows of the grid if the filter hides it."""
    there = filtered.where(F.col("row_id") == target).limit(1).count()
    return page_around(filtered if there else grid, order, target, limit)


def numbered(grid: DataFrame, order: Order) -> DataFrame:
    """``row_id, position`` of all rows without bringing them to one task."""
    keys = [c for c in (order.key,) if c]
    return _numbered(grid.select("row_id", *keys), order.columns(), name="position").select("row_id", "position")


def found_row(grid: DataFrame, row_id: str) -> DataFrame:
    """The row of an id, if there is one."""
    return grid.where(F.col("row_id") == row_id).limit(1)


def found_by_key(grid: DataFrame, key: object) -> DataFrame:
    """The first row, by id, of a business key, compared as stripped text; none for null and blank keys."""
    text = "" if key is None else str(key).strip()
    return grid.where((F.col("business_key") == text) & (F.lit(text) != "")).orderBy("row_id").limit(1)


def any_row(grid: DataFrame) -> DataFrame:
    """A sample of one row, always the same: that of the smallest id."""
    return grid.orderBy("row_id").limit(1)


def with_system_cells(data: Column, created_at: Column, updated_at: Column) -> Column:
    """A map of cells with ``created_at``, if it isn't there, and ``updated_at``, in any case, as the row has them."""
    latest = F.coalesce(updated_at, created_at)
    own = F.map_filter(data, lambda k, _: k != "updated_at")
    made = F.when(~F.map_contains_key(data, "created_at"), F.create_map(F.lit("created_at"), display_time(created_at)))
    return F.map_concat(own, F.coalesce(made, F.expr("cast(map() AS map<string,string>)")), F.create_map(F.lit("updated_at"), display_time(latest)))


def lifted_times(rows: DataFrame, data: str = "data") -> DataFrame:
    """``rows`` with the times of their cells as columns ``created_at, updated_at``, where the cells have them."""
    cell = lambda c: F.try_to_timestamp(F.col(data)[c])
    out = rows
    for c in ("created_at", "updated_at"):
        out = out.withColumn(c, F.coalesce(cell(c), F.col(c)) if c in rows.columns else cell(c))
    return out


def backfilled(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``updated_at`` is that of their creation where it is null."""
    return rows.withColumn("updated_at", F.coalesce("updated_at", "created_at"))


def merged_pages(loaded: DataFrame, new_page: DataFrame, skip: int) -> DataFrame:
    """Slots ``slot, row_id, value, is_duplicate`` after a page has come in (``n, row_id, value``) at ``skip``.

    ``loaded`` has ``slot, row_id, value``. A row that is loaded in another slot is
    refreshed there, and the slot it came for is marked as its duplicate.
    """
    came = new_page.select((F.col("n") + skip).alias("slot"), "row_id", "value")
    known = loaded.select("row_id", F.col("slot").alias("known_slot"))
    placed = came.join(known, "row_id", "left").withColumn("is_duplicate", F.col("known_slot").isNotNull() & (F.col("known_slot") != F.col("slot")))
    fresh = placed.select("slot", "row_id", F.when(~F.col("is_duplicate"), F.col("value")).alias("value"), "is_duplicate")
    again = placed.where("is_duplicate").select("row_id", F.col("value").alias("newer"))
    stay = loaded.join(came.select("slot"), "slot", "left_anti").join(again, "row_id", "left")
    return fresh.unionByName(stay.select("slot", "row_id", F.coalesce("newer", "value").alias("value"), F.lit(False).alias("is_duplicate")))


def without_duplicates(slots: DataFrame) -> DataFrame:
    """Slots that aren't marked as duplicates; no mark is none."""
    return slots.where(~F.coalesce(F.col("is_duplicate"), F.lit(False)))


def loaded_counts(slots: DataFrame) -> DataFrame:
    """``n_slots`` and ``n_loaded``, those that have a row."""
    return slots.agg(F.count("*").alias("n_slots"), F.count("row_id").alias("n_loaded"))


def known_ids(loaded: DataFrame, scanned: DataFrame) -> DataFrame:
    """The distinct ids of loaded and of scanned rows."""
    return loaded.select("row_id").union(scanned.select("row_id")).distinct()


def aligned_skip(row: int, chunk: int) -> int:
    """Where the chunk begins that a viewport's ``row`` is in."""
    return row // chunk * chunk


def adapted_chunk(chunk: int, seconds: float, batch: bool = False) -> int:
    """The next chunk: a tenth more after a fast answer, a tenth less after a slow one, within 50 to 1000; the same for batches."""
    if batch:
        return chunk
    return min(1000, int(chunk * 1.1)) if seconds < 0.5 else max(50, int(chunk * 0.9)) if seconds > 0.55 else chunk


def adapted_chunks(chunk: F.Column, seconds: F.Column, batch: F.Column) -> F.Column:
    """:func:`adapted_chunk` of every row; null times are neither fast nor slow, a null ``batch`` is none."""
    fast, slow = F.least(F.lit(1000), F.floor(chunk * 1.1)), F.greatest(F.lit(50), F.floor(chunk * 0.9))
    return F.when(batch, chunk).when(seconds < 0.5, fast).when(seconds > 0.55, slow).otherwise(chunk)


def next_batch(grid: DataFrame, order: Order, fetched: int, n: int = 10_000) -> DataFrame:
    """The ``n`` rows after those already fetched."""
    return page(grid, order, fetched, n)


MAX_SPAN = 50_000


def ids_at(grid: DataFrame, order: Order, offsets: list[int]) -> DataFrame:
    """``request, position, row_id`` for places asked for, in request order with repeats; places outside are left out.

    The places may span at most ``MAX_SPAN``.
    """
    if not offsets:
        return grid.limit(0).select(F.lit(0).alias("request"), F.lit(0).alias("position"), "row_id")
    lo, hi = max(0, min(offsets)), max(offsets)
    if hi - lo > MAX_SPAN:
        raise ValueError(f"offsets span more than {MAX_SPAN} rows")
    asked = grid.sparkSession.createDataFrame(list(enumerate(offsets)), "request int, position int")
    return page(grid, order, lo, hi - lo + 1).select("position", "row_id").join(F.broadcast(asked), "position").select("request", "position", "row_id")


def schema_of(grid: DataFrame, display: list[str] | None = None) -> list[str]:
    """Configured columns, else all cells' names in order; then the row's times."""
    names = list(display or sorted(_cells(grid)))
    return names + [c for c in ("created_at", "updated_at") if c not in names]


def should_search(q: str) -> bool:
    return len(q) == 0 or len(q) >= 3


def searches(q: F.Column) -> F.Column:
    """:func:`should_search` of every row; null counts as empty."""
    n = F.length(F.coalesce(q, F.lit("")))
    return (n == 0) | (n >= 3)
