r"""Credentials in texts: strong patterns, and weak parts linked to their counterparts.

Strong spans are found leftmost and non-overlapping for each kind:

* assign: ``(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)``
  with the name's letters in either case and a value of 12 characters or more,
* access: ``AKIA[A-Z0-9]+`` of 18 characters or more,
* hex: ``[0-9a-f]+`` of 16 characters or more.

Weak parts prove nothing alone: a short assigned value, a mixed token of letters
and digits, a user or account name that is assigned, an address of a service.
They are linked by an interval join: a weak part is reported if within ``scope``
characters of it stands a part of another class (identifier, secret, endpoint),
at least one of the two being assigned or strong. Parts are dealt to slices of
``scope`` characters, so a slice has a bounded number of parts whatever the
text's length, and the join is a semi-join: no pairs are made.

Edge cases: null and empty texts have no spans; identical rows give identical
results; texts and tokens of any length are scanned whole, in time proportional to them;
bytes that aren't valid UTF-8 count as one character each run; spans that begin at the
same place are ordered by kind; an empty table gives no rows. Columns besides
``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, table

SCOPE = 200
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Weak parts: kind, class, whether something names it, pattern.
WEAK = (
    ("weak_value", "secret", True, re.compile(r"""(?i:password|passwd|pwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})""", re.ASCII)),
    ("weak_user", "identifier", True, re.compile(r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""", re.ASCII)),
    ("weak_token", "secret", False, re.compile(r"[A-Za-z0-9+/_=-]{20,}")),
)
#: An address of a service: a URL, a number address, or a name of at least two labels before a port.
_URL_OR_NUMBERS = re.compile(r"\b[a-z][a-z0-9+.-]{1,11}://[^\s\"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b(?::[0-9]{2,5})?", re.ASCII)
_PORT = re.compile(r":[0-9]{2,5}\b", re.ASCII)
_NAME_RUN = re.compile(r"[a-z0-9.-]+")
_WORD = re.compile(r"\w", re.ASCII)
#: A token is mixed if it has all of these.
_MIXED = tuple(re.compile(c) for c in ("[0-9]", "[a-z]", "[A-Z]"))
_CLASS = {"assign": "secret", "access": "identifier", "hex": "secret"}
_LOOK = re.compile(r"[:=/@.]|[0-9]")

_PART = "struct<kind:string,class:string,named:boolean,strong:boolean,at:int,end:int>"


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _name_before(text: str, lo: int, run: int, port: int) -> int | None:
    """Where the longest name begins that ends at ``port``, from ``lo`` on; ``run`` begins the characters of names before it."""
    at = max(lo, run)
    empty = text.rfind("..", at, port)
    at = empty + 2 if empty >= 0 else at + 1 if text[at] == "." else at
    dot = text.rfind(".", at, port)
    if dot < 0 or dot == port - 1:
        return None
    word = lambda i: 0 <= i < len(text) and _WORD.match(text[i]) is not None
    return next((i for i in range(at, dot) if text[i] != "." and word(i) != word(i - 1)), None)


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses of services, leftmost and non-overlapping. A name is found from its port back, in a run of its characters that is read once."""
    ports = {m.start(): m.end() for m in _PORT.finditer(text)}
    named = [r.span() for r in _NAME_RUN.finditer(text) if r.end() in ports] if ports else []
    out, done, k = [], 0, 0
    fixed, name = _URL_OR_NUMBERS.search(text), None
    while True:
        if fixed and fixed.start() < done:
            fixed = _URL_OR_NUMBERS.search(text, done)
        if name is not None and name < done:
            name = None
        while name is None and k < len(named):
            run, port = named[k]
            name = _name_before(text, done, run, port) if port > done else None
            if name is None:
                k += 1
        if name is None and fixed is None:
            return out
        if name is None or fixed and fixed.start() <= name:
            done = fixed.end()
            out.append(fixed.span())
        else:
            done = ports[named[k][1]]
            out.append((name, done))
            name, k = None, k + 1


def weak_parts(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, str, bool, int, int]]:
    """Weak candidates outside of all strong spans; time is proportional to the text."""
    begins = [a for _, a, _ in strong]
    reach = list(accumulate((b for _, _, b in strong), max))
    out = []
    for kind, what, named, pattern in WEAK:
        spans = (m.span(1) if pattern.groups else m.span() for m in pattern.finditer(text))
        out += [(kind, what, named, s, e) for s, e in spans if kind != "weak_token" or all(c.search(text, s, e) for c in _MIXED)]
    out += [("weak_endpoint", "endpoint", False, s, e) for s, e in endpoints(text)]
    # of the spans that begin before the candidate ends, none may reach into it
    before = lambda e: bisect_left(begins, e)
    return [x for x in out if not before(x[4]) or reach[before(x[4]) - 1] <= x[3]]


def parts_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, parts`` for each row; weak parts only where some other part could be near."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                text = raw and raw.decode("utf-8", "replace")
                strong = strong_spans(text or "")
                weak = weak_parts(text, strong) if text and _LOOK.search(text) else []
                if len({w[1] for w in weak} | {_CLASS[k] for k, *_ in strong}) < 2:
                    weak = []
                row = [(k, _CLASS[k], True, True, s, e) for k, s, e in strong]
                row += [(k, c, named, False, s, e) for k, c, named, s, e in weak]
                out.append([dict(zip(("kind", "class", "named", "strong", "at", "end"), p, strict=True)) for p in row])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("class", pa.string()), ("named", pa.bool_()), ("strong", pa.bool_()), ("at", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out, kind)], ["doc_id", "text_key", "parts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    return docs.select("doc_id", key, "text").mapInArrow(made, f"doc_id {id_type}, text_key bigint, parts array<{_PART}>")


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """``doc_id, text_key, kind, at, end`` of the weak parts that have a counterpart within ``scope`` characters."""
    flat = parts.where("exists(parts, p -> NOT p.strong)").select("doc_id", "text_key", F.inline("parts")).distinct()
    weak = flat.where("NOT strong")
    span = F.sequence(F.floor((F.col("at") - scope) / F.lit(scope)), F.floor((F.col("end") + scope) / F.lit(scope)))
    left = weak.withColumn("slice", F.explode(span)).alias("w")
    right = flat.select(
        F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), F.col("class").alias("r_class"),
        F.col("named").alias("r_named"), F.col("at").alias("r_at"), F.col("end").alias("r_end"),
        F.explode(F.sequence(F.floor(F.col("at") / F.lit(scope)), F.floor(F.col("end") / F.lit(scope)))).alias("r_slice"),
    )
    near = (
        (F.col("text_key") == F.col("r_key"))
        & (F.col("slice") == F.col("r_slice"))
        & F.col("doc_id").eqNullSafe(F.col("r_id"))
        & (F.col("class") != F.col("r_class"))
        & (F.col("named") | F.col("r_named"))
        & (F.col("r_at") - F.col("end") <= scope)
        & (F.col("at") - F.col("r_end") <= scope)
    )
    return left.join(right, near, "left_semi").select("doc_id", "text_key", "kind", "at", "end").distinct()


def credential_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, base, added`` for each row: arrays of ``kind, at, end`` by place."""
    parts = keep(parts_of(docs))
    span = F.struct("at", "end", "kind")
    added = linked(parts, scope).groupBy(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key")).agg(
        F.array_sort(F.collect_list(span)).alias("added")
    )
    base = F.expr("transform(filter(parts, p -> p.strong), p -> struct(p.at AS at, p.end AS end, p.kind AS kind))")
    both = parts.join(added, (F.col("text_key") == F.col("a_key")) & F.col("doc_id").eqNullSafe(F.col("a_id")), "left")
    none = F.lit([]).cast("array<struct<at:int,end:int,kind:string>>")
    return both.select("doc_id", base.alias("base"), F.coalesce("added", none).alias("added"))


def op5_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credential_spans(table(spark, sf_dir, "documents"))
    text = "array_join(transform({0}, s -> concat(s.kind, ':', s.at, ':', s.end)), ',')"
    rank = "CASE s.kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END"
    every = f"transform(array_sort(transform(concat(base, added), s -> struct(s.at AS at, {rank} AS o, s.kind AS kind, s.end AS end))), s -> s)"
    count = "cast(size(filter(base, s -> s.kind = '{0}')) AS bigint)"
    return found.select(
        "doc_id",
        *(F.expr(count.format(k)).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(text.format("base")), 256).alias("base_sha256"),
        F.expr(text.format(every)).alias("spans"),
    )

