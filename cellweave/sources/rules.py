"""Text files read by regular-expression rules into rows.

A rule is ``column, regex, type`` (``str``, ``int``, ``float``, ``bool``),
``required``, ``default``. Header rules read the lines up to the start mark, file
rules the file's name, body rules each line after the start mark up to the end
mark. Patterns are Java's.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import stripped


@dataclass(frozen=True)
class Rule:
    column: str
    regex: str
    type: str = "str"
    required: bool = False
    default: str | None = None

    def found(self, text: Column) -> Column:
        return text.rlike(self.regex)

    def value(self, text: Column) -> Column:
        """The first group of the first match, cast; null without a match or if the cast fails."""
        raw = F.when(self.found(text), F.regexp_extract(text, self.regex, 1))
        if self.type == "bool":
            return F.when(raw.isNotNull(), F.lower(raw).isin("true", "1", "yes").cast("string"))
        if self.type in ("int", "float"):
            return raw.try_cast("bigint" if self.type == "int" else "double").cast("string")
        return raw


@dataclass(frozen=True)
class Rules:
    body: list[Rule]
    header: list[Rule] = field(default_factory=list)
    file_name: list[Rule] = field(default_factory=list)
    start: str | None = None
    end: str | None = None
    table: str | None = None

    @classmethod
    def of(cls, config: dict) -> Rules:
        """From a configuration file's ``rules, header_rules, filename_rules, table_start_pattern, table_end_pattern, table_name``."""
        made = lambda name: [Rule(r["column"], r["regex"], r.get("type", "str"), bool(r.get("required")), r.get("default")) for r in config.get(name, [])]
        marks = (config.get(f"table_{x}_pattern") or None for x in ("start", "end"))
        return cls(made("rules"), made("header_rules"), made("filename_rules"), *marks, config.get("table_name"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def lines_of(texts: DataFrame, rules: Rules) -> DataFrame:
    """``file, n, line, part``: stripped lines of the ``body`` that aren't blank, and lines of the ``header`` as they are.

    The body lies between the first stripped line with the start mark and the next
    with the end mark; the header is all before the first line, as it is, with the
    start mark, or the whole file if there is no such mark. Marks are found within
    the row of the file, so lines aren't shuffled.
    """
    return _each(_marked(texts, rules))


def _marked(texts: DataFrame, rules: Rules) -> DataFrame:
    """``file``, all lines as they are (``raw``) and stripped, and where its body (``first, last``) and the end of its header (``head``) are."""
    # numbers of lines are from 0, those of found marks from 1; 0 is none
    found = lambda lines, mark: F.array_position(F.transform(lines, lambda x: x.rlike(mark)), F.lit(True))
    out = texts.select("file", F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n").alias("raw"))
    out = out.withColumns({"lines": F.transform("raw", lambda x: stripped(x)), "size": F.size("raw"), "first": F.lit(0), "head": F.size("raw")})
    if rules.start:
        at, raw_at = found(F.col("lines"), rules.start), found(F.col("raw"), rules.start)
        out = out.withColumns({"first": F.when(at > 0, at).otherwise(F.col("size")), "head": F.when(raw_at > 0, raw_at - 1).otherwise(F.col("size"))})
    end = found(F.slice("lines", F.col("first").cast("int") + 1, F.col("size")), rules.end) if rules.end else F.lit(0)
    return out.withColumn("last", F.when(end > 0, F.col("first") + end - 2).otherwise(F.col("size") - 1))


def _each(marked: DataFrame, *more: str) -> DataFrame:
    """The lines, with ``more`` columns of their files."""
    each = marked.select("file", *more, "first", "last", "head", F.posexplode(F.arrays_zip("raw", "lines")).alias("n", "l"))
    body = F.when(F.col("n").between(F.col("first"), F.col("last")) & (F.col("l.lines") != ""), F.struct(F.col("l.lines").alias("line"), F.lit("body").alias("part")))
    header = F.when(F.col("n") < F.col("head"), F.struct(F.col("l.raw").alias("line"), F.lit("header").alias("part")))
    return each.select("file", *more, "n", F.inline(F.array_compact(F.array(body, header))))


def rows_of(texts: DataFrame, rules: Rules) -> DataFrame:
    """``file, n`` and the rules' columns, as texts, of each kept line.

    A line is kept if some rule matched and cast, and every required column has a
    value or a default. Defaults fill what is missing; body columns override file and header ones.
    What the header says is found within the row of the file, too; nothing is shuffled.
    """
    marked, heads = _marked(texts, rules), _heads(rules)
    if not heads:
        return _body(_each(marked), rules)
    last = lambda r: F.try_element_at(F.filter(F.slice("raw", 1, F.col("head")), r.found), F.lit(-1))
    told = marked.withColumn("__line", F.array(*map(last, heads))).withColumn("__told", F.array(*(r.value(F.col("__line")[i]) for i, r in enumerate(heads))))
    body = _body(_each(told, "__told"), rules, "__told")
    return body.withColumns({r.column: F.col("__told")[i] for i, r in enumerate(heads)}).drop("__told")


def rows_of_lines(lines: DataFrame, rules: Rules) -> DataFrame:
    """:func:`rows_of` from lines of large files, whose headers are joined."""
    body, heads = _body(lines, rules), _heads(rules)
    if not heads:
        return body
    line = F.col("line")
    last = [F.max_by(r.value(line), F.when(r.found(line), F.col("n"))).alias(r.column) for r in heads]
    return body.join(lines.where("part = 'header'").groupBy("file").agg(*last), "file", "left")


def _body(lines: DataFrame, rules: Rules, *more: str) -> DataFrame:
    """``file, n``, ``more`` columns and those of the body and the file's name, of each kept line."""
    line = F.col("line")
    got = [r.value(line) for r in rules.body]
    keep = reduce(or_, (g.isNotNull() for g in got)) & reduce(
        and_, (F.coalesce(g, F.lit(r.default)).isNotNull() for r, g in zip(rules.body, got, strict=True) if r.required), F.lit(True)
    )
    own = [F.coalesce(g, F.lit(r.default)).alias(r.column) for r, g in zip(rules.body, got, strict=True)]
    body = lines.where("part = 'body'").where(keep).select("file", "n", *more, *own)
    return body.withColumns({r.column: r.value(F.element_at(F.split("file", "/"), -1)) for r in _on_file(rules)})


def _on_file(rules: Rules) -> list[Rule]:
    names = {r.column for r in rules.body}
    return [r for r in rules.file_name if r.column not in names]


def _heads(rules: Rules) -> list[Rule]:
    names = {r.column for r in (*rules.body, *_on_file(rules))}
    return [r for r in rules.header if r.column not in names]


def keyed(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows that have a business key, with it as ``business_key``."""
    name = next((c for c in reversed(rows.columns) if c.lower() == key.lower()), None)
    return rows.limit(0).withColumn("business_key", F.lit(None).cast("string")) if name is None else rows.withColumn("business_key", stripped(F.col(name))).where(F.col(name).isNotNull())


def canonical(rows: DataFrame, display: list[str]) -> DataFrame:
    """``rows`` whose columns have the names of ``display`` that equal them but for case; later columns win."""
    named = {c.lower(): c for c in reversed(display)}
    last = {named.get(c.lower(), c): c for c in rows.columns}
    return rows.select(*(F.col(f"`{c}`").alias(n) for n, c in last.items()))
