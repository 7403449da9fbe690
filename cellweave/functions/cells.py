"""Column expressions on cells: which source wins, value texts, names, marks in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lower wins; sources not listed come after all of these.
PRIORITY = {"user": 0, "parser_a": 1, "parser_b": 2, "batch_ingester": 3, "custom_script": 4}
OTHER_PRIORITY = 99
# Columns that no write may touch.
SYSTEM_COLUMNS = ("created_at", "updated_at", "row_id", "id", "updated_by")


#: White space that is stripped from texts, beyond ASCII too.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def sanitised(text: Column) -> Column:
    """``text`` without the bytes that aren't valid UTF-8."""
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def time_ordered_id(at: Column, seed: Column) -> Column:
    """A version 7 UUID of the time ``at``; its other bits follow from ``seed``, so a repeated task gives the same."""
    ms, rest = F.lower(F.lpad(F.hex(F.unix_millis(at)), 12, "0")), F.sha2(seed, 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(rest, 4, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(rest, 1, 3), F.lit("-"), variant, F.substring(rest, 5, 3), F.lit("-"), F.substring(rest, 8, 12)
    )


def has_source(sources: Column, source: str) -> Column:
    """Whether a cell's map of sources has a value, null or not, from ``source``."""
    return F.coalesce(F.map_contains_key(sources, source), F.lit(False))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def target_text(business_key: Column, row_id: Column) -> Column:
    """How a log names a row: its key, cut to ten characters, else the first eight of its id."""
    return F.when(F.coalesce(business_key, F.lit("")) != "", shortened(business_key, 10)).otherwise(F.substring(row_id, 1, 8))


def log_text(table: Column, column: Column, user: Column, target: Column, at: Column) -> Column:
    """One log entry as a line."""
    did = (
        F.when(column == "CREATE", F.concat(F.lit("created "), table, F.lit(" ("), target, F.lit(")")))
        .when(column == "DELETE", F.concat(F.lit("deleted "), table, F.lit(" ("), target, F.lit(")")))
        .when(column == "ROW_UPDATE", F.concat(F.lit("updated by script "), table, F.lit(" ("), target, F.lit(")")))
        .otherwise(F.concat(F.lit("changed "), column, F.lit(" of "), table, F.lit(" ("), target, F.lit(")")))
    )
    return F.concat(F.lit("["), F.coalesce(F.nullif(user, F.lit("")), F.lit("system")), F.lit("] "), did, F.lit(" ["), F.coalesce(F.date_format(at, "HH:mm:ss"), F.lit("")), F.lit("]"))


def columns_text(columns: Column, most: int = 5) -> Column:
    """The first names of a list, and how many more there are."""
    more = F.when(F.size(columns) > most, F.concat(F.lit(" and "), (F.size(columns) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(columns, 1, most), ", "), more)


def change_text(column: Column, old: Column, new: Column) -> Column:
    """A change as a tooltip has it: both values cut to twenty characters, null as ``None``."""
    text = lambda v: F.substring(F.coalesce(v.cast("string"), F.lit("None")), 1, 20)
    return F.concat(F.lit("["), column, F.lit("] "), text(old), F.lit(" -> "), text(new))


def lineage_text(at: Column, old: Column, new: Column, source: Column, user: Column) -> Column:
    """A step in a cell's lineage."""
    text = lambda v: F.coalesce(v.cast("string"), F.lit("None"))
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), text(old), F.lit(" -> "), text(new), F.lit(" ("), text(source), F.lit(" by "), text(user), F.lit(")"))


def priority(source: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    return F.coalesce(known[source], F.lit(OTHER_PRIORITY))


def rank(source: Column) -> Column:
    """Orders sources: by priority, then the shorter name, then the name."""
    return F.struct(priority(source).alias("p"), F.length(source).alias("n"), source.alias("source"))


def winning_source(sources: Column, pin: Column | None = None) -> Column:
    """The source whose value counts, of a map by source; a pin wins if its source is there. Null without sources."""
    best = F.array_min(F.transform(F.map_keys(sources), rank))["source"]
    return best if pin is None else F.when(F.map_contains_key(sources, pin), pin).otherwise(best)


def value_text(value: Column, kind: Column) -> Column:
    """The text by which a change is told: ``None`` for null, ``True`` and ``False``; 5 and 5.0 differ."""
    text = F.when(kind == "bool", F.initcap(value)).when(
        (kind == "float") & value.rlike(r"^-?[0-9]+$"), F.concat(value, F.lit(".0"))
    ).otherwise(value)
    return F.when(value.isNull(), F.lit("None")).otherwise(text)


def is_writable(column: Column) -> Column:
    return ~column.isin(*SYSTEM_COLUMNS)


def canonical_column(column: Column, display: list[str]) -> Column:
    """The first of ``display`` that equals ``column`` but for case, else ``column``."""
    out = column
    for name in reversed(display):
        out = F.when(F.lower(column) == name.lower(), F.lit(name)).otherwise(out)
    return out


def uploader(file_name: Column) -> Column:
    """Who a file named ``user(<name>)_...`` is from, else null."""
    return F.nullif(F.regexp_extract(file_name, r"^user\(([^)]*)\)", 1), F.lit(""))


def unwrapped(json: Column, levels: int = 5) -> Column:
    """A value text that was wrapped as ``{"value": ...}`` up to ``levels`` times."""
    for _ in range(levels):
        json = F.when(json.startswith("{"), F.coalesce(F.get_json_object(json, "$.value"), json)).otherwise(json)
    return json


def display_time(at: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in the session's zone; empty for null."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def csv_field(value: Column) -> Column:
    """A field of a CSV line, quoted where it must be; empty for null."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(value.rlike('[",\r\n]'), quoted).otherwise(value), F.lit(""))
