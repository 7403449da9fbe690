"""Data out of and into grids: CSV, clipboard tables, matrices, the change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import SYSTEM_COLUMNS, csv_field, stripped
from .grid import Order
from .numbering import numbered

FEED_CHUNK, REFRESH_ABOVE = 500, 100
#: A quoted field. Its parts never give characters back, so no field is too long for the matcher's stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *(csv_field(F.col(c).cast("string")) for c in columns))


def export_lines(grid: DataFrame, columns: list[str], order: Order, most: int | None = None) -> DataFrame:
    """``row_id, line`` of all rows in order, or of the first ``most``."""
    ordered = grid.orderBy(*order.columns())
    return (ordered if most is None else ordered.limit(most)).select("row_id", csv_line(columns).alias("line"))


def export_header(grid: DataFrame, first_row: DataFrame | None = None) -> list[str]:
    """Cells' names in order, then the row's times; with ``first_row`` (one row of a map ``data``) only the names it has."""
    if first_row is None:
        names = [c for c in grid.columns if c not in (*SYSTEM_COLUMNS, "business_key", "table_name")]
    else:
        row = first_row.select(F.map_keys("data").alias("k")).first()
        names = [k for k in (row.k if row else []) if k not in SYSTEM_COLUMNS]
    return [*sorted(names), "created_at", "updated_at"]


def export_csv(grid: DataFrame, order: Order, path: str, columns: list[str] | None = None, most: int | None = None) -> None:
    """CSV files in order of their names: UTF-8 with a mark, a header, CRLF, quotes where needed, null as nothing.

    All rows, or the first ``most``. By default all cells and the row's times (null where the grid has none). The
    mark and the header are lines of their own before the first row, so the files
    put together are one export.
    """
    columns = columns or export_header(grid)
    for c in ("created_at", "updated_at"):
        if c in columns and c not in grid.columns:
            grid = grid.withColumn(c, F.lit(None).cast("timestamp"))
    first = grid if most is None else grid.orderBy(*order.columns()).limit(most)
    top = numbered(first.select("row_id", *({*columns} - {"row_id"}), *_keys(order, columns)), order.columns())
    head = F.concat(F.lit("\ufeff"), F.lit(",".join(columns)))
    lines = top.select(F.col("nth"), csv_line(columns).alias("line")).unionByName(grid.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("nth"), head.alias("line")))
    lines.repartitionByRange("nth").sortWithinPartitions("nth").select("line").write.option("lineSep", "\r\n").text(path)


def _keys(order: Order, columns: list[str]) -> list[str]:
    return [c for c in (order.key,) if c and c not in (*columns, "row_id")]


def export_name(table: str, at: Column) -> Column:
    return F.concat(F.lit(f"{table}_extract_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".csv"))


def export_size(grid: DataFrame, columns: list[str], order: Order, sample: int = 10) -> DataFrame:
    """``total_rows, estimated_bytes``: the mark, the header, and the rows at the mean length of the first ones."""
    mean = export_lines(grid, columns, order, sample).agg(F.avg(F.octet_length("line") + 2).alias("mean"))
    header = 3 + len(",".join(columns).encode()) + 2
    total = grid.agg(F.count("*").alias("total_rows"))
    # one row each
    return total.join(mean, F.lit(True)).select("total_rows", F.floor(F.lit(header) + F.coalesce("mean", F.lit(150.0)) * F.col("total_rows")).cast("bigint").alias("estimated_bytes"))


def tsv_header(columns: list[str]) -> str:
    """The line of names, in upper case, that may stand above copied rows."""
    return "\t".join(c.upper() for c in columns)


def tsv(grid: DataFrame, columns: list[str]) -> DataFrame:
    """``row_id, line``: cells by tabs; null is empty."""
    return grid.select("row_id", F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))


def tsv_lines(grid: DataFrame, columns: list[str], order: Order, header: bool = True) -> DataFrame:
    """``n, line``: rows as :func:`tsv` has them, numbered in order from 1, and the names as line 0."""
    top = grid.sparkSession.createDataFrame([(0, tsv_header(columns))] if header else [], "n bigint, line string")
    rows = numbered(grid.select("row_id", *({*columns} - {"row_id"}), *_keys(order, columns)), order.columns())
    body = rows.select((F.col("nth") + 1).alias("n"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))
    return top.unionByName(body)


def pasted(texts: DataFrame) -> DataFrame:
    """``id, r, c, value`` of clipboard texts (``id, text``): lines by tabs, empty lines left out, cells trimmed."""
    lines = F.filter(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: x != "")
    return texts.select("id", F.posexplode(lines).alias("r", "line")).select("id", "r", F.posexplode(F.split("line", "\t")).alias("c", "v")).select("id", "r", "c", stripped(F.col("v")).alias("value"))


def paste_targets(cells: DataFrame, rows: DataFrame, columns: DataFrame, top: int, left: int) -> DataFrame:
    """Pasted cells with the rows (``visual, row_id``) and columns (``visual, name``) they land on; those beyond the grid or on system columns are left out."""
    r, c = rows.withColumnRenamed("visual", "vr"), columns.withColumnRenamed("visual", "vc").where(~F.col("name").isin(*SYSTEM_COLUMNS))
    return cells.join(r, F.col("r") + top == F.col("vr")).join(c, F.col("c") + left == F.col("vc")).select("row_id", "name", "value")


def csv_fields(line: Column) -> Column:
    """The fields of a CSV record; quoted ones may have commas, line breaks, and doubled quotes."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f",({_QUOTED}|[^,]*+)"), 1)
    bare = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(parts, lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), bare(x)).otherwise(x))


def csv_records(text: Column) -> Column:
    """The records of a CSV text; a line break within quotes ends none. A quote that is never closed stands for itself."""
    whole = F.concat(F.regexp_replace(text, r"\r\n|\r", "\n"), F.lit("\n"))
    return F.regexp_extract_all(whole, F.lit(rf'((?:{_QUOTED}|[^"\n]++|")*+)\n'), 1)


def matrix_cells(lines: DataFrame) -> DataFrame:
    """``id, x, y, z, is_number, number`` of CSV records (``id, y, line``); blank cells are left out.

    A cell of digits with at most one point is a number.
    """
    cells = lines.select("id", "y", F.posexplode(csv_fields(F.col("line"))).alias("x", "raw")).withColumn("z", stripped(F.col("raw"))).where("z <> ''")
    is_number = F.col("z").rlike(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$")
    return cells.select("id", "x", "y", "z", is_number.alias("is_number"), F.when(is_number, F.col("z").try_cast("double")).alias("number"))


def matrix_of(texts: DataFrame) -> DataFrame:
    """:func:`matrix_cells` of whole CSV texts (``id, text``)."""
    return matrix_cells(texts.select("id", F.posexplode(csv_records(F.coalesce("text", F.lit("")))).alias("y", "line")).where("line <> ''"))


def feed(changed: DataFrame, kind: str, chunk: int = FEED_CHUNK, refresh_above: int = REFRESH_ABOVE, silent: bool = False) -> DataFrame:
    """Events for one batch's changed rows: chunks of ids, or for many upserts a request to refresh; none for a silent batch.

    ``table_name, event, chunk, row_ids``. A batch is what one commit changed;
    its rows are numbered within their table, without bringing a table to one task.
    """
    if silent:
        changed = changed.limit(0)
    many = None
    if kind == "upsert":
        sizes = changed.groupBy("table_name").agg(F.count("*").alias("n"))
        many = sizes.where(F.col("n") > refresh_above).select(
            "table_name", F.lit("batch_refresh_required").alias("event"), F.lit(0).alias("chunk"), F.array().cast("array<string>").alias("row_ids")
        )
        changed = changed.join(sizes.where(F.col("n") <= refresh_above).select("table_name"), "table_name", "left_semi")
    out = (
        numbered(changed.select("table_name", "row_id"), [F.asc("row_id")], ["table_name"])
        .groupBy("table_name", F.floor(F.col("nth") / chunk).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list("row_id")).alias("row_ids"))
        .select("table_name", F.lit(f"batch_row_{kind}").alias("event"), "chunk", "row_ids")
    )
    return out if many is None else out.unionByName(many)


def shown_after_create(shown: DataFrame, created: DataFrame, latest_first: bool = True, filtered: bool = False) -> DataFrame:
    """A client's rows ``at, row_id`` after a create event (``n, row_id``): new ones before all or after all, none under a filter."""
    if filtered:
        return shown
    size = F.coalesce(F.max("at") + 1, F.lit(0))
    edge = shown.agg(size.alias("size")).crossJoin(created.agg(F.count("*").alias("more")))  # one row each
    if latest_first:
        moved = shown.crossJoin(edge).select((F.col("at") + F.col("more")).alias("at"), "row_id")
        return moved.unionByName(created.select(F.col("n").alias("at"), "row_id"))
    return shown.unionByName(created.crossJoin(edge).select((F.col("size") + F.col("n")).alias("at"), "row_id"))


def shown_after_upsert(shown: DataFrame, events: DataFrame, latest_first: bool = True, searching: bool = False, filtered: bool = False) -> DataFrame:
    """A client's rows ``rank, row_id, value`` after upserts (``n, row_id, value``); smaller ranks stand first.

    Known rows are updated in place, or float to the top if the latest come first
    and nothing is searched for. Unknown ones come on top if the latest come first,
    but not under a search or filter. Only ranks are compared, so nothing is renumbered.
    """
    last = events.groupBy("row_id").agg(F.max_by("value", "n").alias("newer"), F.min("n").alias("n"))
    both = shown.join(last, "row_id", "full")
    known = F.col("rank").isNotNull()
    floats = F.lit(latest_first and not searching) & (F.col("rank") > 0)
    # ranks below all shown ones, in the order of the events
    top = shown.agg(F.coalesce(F.min("rank"), F.lit(0)).alias("low")).crossJoin(last.agg(F.coalesce(F.max("n") + 1, F.lit(0)).alias("many")))
    new_rank = F.col("low") - F.col("many") + F.col("n")
    enters = F.lit(latest_first and not searching and not filtered)
    return (
        both.crossJoin(top).where(known | enters)
        .select(F.when(F.col("n").isNull() | (known & ~floats), F.col("rank")).otherwise(new_rank).alias("rank"), "row_id", F.when(F.col("n").isNotNull(), F.col("newer")).otherwise(F.col("value")).alias("value"))
    )


def deletion(shown: DataFrame, ids: DataFrame, most: int = 500) -> DataFrame:
    """What a client removes for a delete event: ``kind, first, last`` of its rows ``at, row_id``.

    One ``reset`` for more than ``most`` ids or any id it doesn't show; else the
    ranges of places, to be removed from the last on.
    """
    asked = ids.select("row_id").distinct()
    found = shown.join(asked, "row_id", "left_semi").select(F.lit("remove").alias("kind"), F.col("at").alias("i"))
    n = asked.agg(F.count("*").alias("n")).crossJoin(found.agg(F.count("*").alias("hit")))
    reset = n.where((F.col("n") > most) | (F.col("hit") < F.col("n"))).select(F.lit("reset").alias("kind"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return ranges(found, "kind").join(reset.select(F.lit(1).alias("r")), F.lit(True), "left_anti").unionByName(reset)


def merged_view(local: DataFrame, events: DataFrame) -> DataFrame:
    """The client's rows after feed events (``seq, row_id, kind, value``): the last event of a row decides; deleted rows go."""
    last = events.groupBy("row_id").agg(F.max_by(F.struct("kind", "value"), "seq").alias("e"))
    both = local.join(last, "row_id", "full")
    return both.where("e IS NULL OR e.kind <> 'delete'").select("row_id", F.when(F.col("e").isNotNull(), F.col("e.value")).otherwise(F.col("value")).alias("value"))


def ranges(indices: DataFrame, key: str) -> DataFrame:
    """``key, first, last`` of runs of consecutive ``i``; places are numbered within a key without bringing it to one task."""
    each = numbered(indices.select(key, "i").distinct(), [F.asc("i")], [key])
    return each.groupBy(key, (F.col("i") - F.col("nth")).alias("g")).agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("g")
