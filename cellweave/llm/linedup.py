"""Lines that many documents share: which to keep, as compressed bitmaps.

A line's key is the line with ASCII white space stripped at both ends and A-Z
lower-cased; an empty key is never shared. Keys are 128-bit hashes. Lines are
range-partitioned by (key, document) and sorted by (key, document, position), so
each task streams its part of the order once, in which a key's occurrences stand
together from the first on. A very frequent key spans many partitions; only its
partial counts, one for each partition, are then added up.

Edge cases: null and empty texts have one empty line; rows that share a
``doc_id`` count as one document, null being one id; identical rows get the
same bitmap; lines and texts of any length are read whole,
as bytes, so invalid UTF-8 stays as it is; an empty table gives no
rows. Columns besides ``doc_id`` and ``text`` are carried by :func:`without_lines`
under names of their own and never referred to.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import keep, table

MIN_DOCS = 10


def _text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def line_keys(docs: DataFrame, copies: bool = False) -> DataFrame:
    """``doc_id, text_key, pos, k1, k2`` for each line whose key isn't empty.

    With ``copies`` also ``copy``, which is equal for texts with the same keys in the same order.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, digests, copy = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                before = len(digests)
                for j, line in enumerate((text or b"").split(b"\n")):
                    if key := line.strip(b" \t\n\x0b\x0c\r").lower():
                        row.append(i)
                        pos.append(j)
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                if copies:
                    copy += [hashlib.blake2b(b"".join(digests[before:]), digest_size=8).digest()] * (len(digests) - before)
            k = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = pa.array(row, pa.int64())
            more = {"copy": pa.array(np.frombuffer(b"".join(copy), dtype="<i8"))} if copies else {}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(pos, pa.int32()), pa.array(k[:, 0]), pa.array(k[:, 1]), *more.values()],
                ["doc_id", "text_key", "pos", "k1", "k2", *more],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _text_key(), "text").mapInArrow(
        made, f"doc_id {id_type}, text_key bigint, pos int, k1 bigint, k2 bigint" + (", copy bigint" if copies else "")
    )


def shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys found in at least ``min_docs`` documents: ``k1, k2, n_docs, n_lines`` and the first ``doc_id, pos``.

    A task keeps the run of one key open across its batches. A key that neither
    begins nor ends the task's part is complete, so it is passed on only if it
    has enough documents; the two at the ends are passed on always.
    """
    id_type = lines.schema["doc_id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last_doc, seen_any = None, None, False
        names = ["k1", "k2", "n_docs", "n_lines", "doc_id", "pos"]

        # Arrow columns keep their types where a ``doc_id`` is null; pandas would round all of a row's integers
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, doc, pos = (batch.column(c).to_numpy() for c in ("k1", "k2", "rank", "pos"))
            fresh = np.ones(len(k1), bool)
            fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            new_doc = fresh.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(fresh)
            n_docs = np.add.reduceat(new_doc, at, dtype=np.int64)
            n_lines = np.diff(np.append(at, len(k1)))
            ids, first_pos = batch.column("doc_id").take(pa.array(at)), pos[at]
            goes_on = held is not None and held.column("k1")[0].as_py() == k1[0] and held.column("k2")[0].as_py() == k2[0]
            if goes_on:
                n_docs[0] += held.column("n_docs")[0].as_py() - int(doc[0] == last_doc)
                n_lines[0] += held.column("n_lines")[0].as_py()
                ids = pa.concat_arrays([held.column("doc_id"), ids.slice(1)])
                first_pos[0] = held.column("pos")[0].as_py()
            out = pa.RecordBatch.from_arrays(
                [pa.array(k1[at]), pa.array(k2[at]), pa.array(n_docs), pa.array(n_lines, pa.int64()), ids, pa.array(first_pos, pa.int32())], names
            )
            if held is not None and not goes_on:
                out = pa.RecordBatch.from_arrays([pa.concat_arrays([h, o]) for h, o in zip(held.columns, out.columns, strict=True)], names)
            held, last_doc = out.slice(out.num_rows - 1), doc[-1]
            out = out.slice(0, out.num_rows - 1)
            if out.num_rows:
                enough = out.column("n_docs").to_numpy() >= min_docs
                if not seen_any:
                    enough[0] = True
                    seen_any = True
                yield out.filter(pa.array(enough))
        if held is not None:
            yield held

    ranked = lines.select("*", F.xxhash64("doc_id").alias("rank"))
    parts = (
        ranked.repartitionByRange("k1", "k2", "doc_id")
        .sortWithinPartitions("k1", "k2", "doc_id", "pos")
        .mapInArrow(runs, f"k1 bigint, k2 bigint, n_docs bigint, n_lines bigint, doc_id {id_type}, pos int")
    )
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("no"), "doc_id", "pos")).alias("first")
    return (
        parts.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("n_lines"), first)
        .where(F.col("n_docs") >= min_docs)
        .select("k1", "k2", "n_docs", "n_lines", "first.doc_id", "first.pos")
    )


@F.pandas_udf(T.BinaryType())
def _packed(positions: pd.Series) -> pd.Series:
    """zlib of a bit for each line up to the last dropped one, set where the line is dropped."""

    def one(p: np.ndarray) -> bytes:
        bits = np.zeros(int(max(p)) + 1, np.uint8)
        bits[np.asarray(p, dtype=np.int64)] = 1
        return zlib.compress(np.packbits(bits).tobytes())

    return positions.map(one)


def drop_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, copies_once: bool = False) -> DataFrame:
    """``doc_id, text_key, n_dropped, dropped`` for texts that lose lines.

    ``dropped`` is a compressed bitmap by line number; lines beyond its end stay.
    With ``keep_first`` a shared line's first occurrence by (``doc_id``, position)
    stays, else all go. With ``copies_once`` documents with the same keys in the
    same order count as one, so that copies alone don't make a line shared.
    """
    lines = keep(line_keys(docs, copies_once))
    shared = shared_keys(lines, min_docs).withColumnsRenamed({"doc_id": "first_doc", "pos": "first_pos"})
    hit = lines.join(shared, ["k1", "k2"])
    if keep_first:
        hit = hit.where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))))
    if copies_once:
        hit = keep(hit)
        texts = hit.select("k1", "k2", "copy").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_texts"))
        hit = hit.join(texts.where(F.col("n_texts") >= min_docs), ["k1", "k2"], "left_semi")
    gone = hit.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("at"))
    return gone.select("doc_id", "text_key", F.size("at").cast("bigint").alias("n_dropped"), _packed("at").alias("dropped"))


def keep_bitmaps(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_lines, n_dropped, kept`` for every row: a compressed bitmap with a bit for each line, set where it stays."""

    @F.pandas_udf(T.BinaryType())
    def turned(n_lines: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(np.packbits(_stays(n, d)).tobytes()) for n, d in zip(n_lines, bitmap, strict=True)])

    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    d = dropped.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n_dropped", "dropped")
    each = docs.select("doc_id", _text_key(), n_lines.alias("n_lines"))
    both = each.join(d, each["doc_id"].eqNullSafe(d["__id"]) & (each["text_key"] == d["__key"]), "left")
    return both.select("doc_id", "text_key", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), turned("n_lines", "dropped").alias("kept"))


def _stays(n: int, dropped: bytes | None) -> np.ndarray:
    """For each of ``n`` lines whether it stays."""
    out = np.ones(n, bool)
    if dropped is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8))[:n]
        out[: len(bits)] = bits == 0
    return out


def runs_of(stays: np.ndarray) -> str:
    """A bitmap as the lengths of its runs of kept, dropped, kept, ... lines."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], stays, [not stays[-1]]]).astype(np.int8)))
    return ",".join(map(str, np.diff(np.concatenate([[0], edges])).tolist()))


def _kept(text: bytes | None, dropped: bytes | None) -> tuple[bytes, np.ndarray]:
    lines = (text or b"").split(b"\n")
    stays = _stays(len(lines), dropped)
    return b"\n".join(x for x, s in zip(lines, stays.tolist(), strict=True) if s), stays


def without_lines(docs: DataFrame, bitmaps: DataFrame, digest: bool = False) -> DataFrame:
    """``docs`` with the marked lines gone from ``text``.

    With ``digest`` instead ``doc_id, n_lines, n_dropped, kept_sha256, keep_runs``.
    """
    keyed = docs.withColumn("__text_key", _text_key())
    b = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n_dropped", F.col("dropped").alias("__dropped"))
    both = keyed.join(b, keyed["doc_id"].eqNullSafe(b["__id"]) & (keyed["__text_key"] == b["__key"]), "left")
    if digest:

        @F.pandas_udf("n_lines long, kept_sha256 string, keep_runs string")
        def summed(text: pd.Series, dropped: pd.Series) -> pd.DataFrame:
            out = [_kept(t, d) for t, d in zip(text, dropped, strict=True)]
            sha = [hashlib.sha256(t).hexdigest() for t, _ in out]
            return pd.DataFrame({"n_lines": [len(s) for _, s in out], "kept_sha256": sha, "keep_runs": [runs_of(s) for _, s in out]})

        done = both.select(docs["doc_id"], F.coalesce(b["n_dropped"], F.lit(0)).cast("bigint").alias("n_dropped"), summed(docs["text"].cast("binary"), "__dropped").alias("x"))
        return done.select("doc_id", "x.n_lines", "n_dropped", "x.kept_sha256", "x.keep_runs")

    @F.pandas_udf(T.BinaryType())
    def kept(text: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series([_kept(t, d)[0] for t, d in zip(text, dropped, strict=True)], dtype=object)

    text = F.when(F.col("__dropped").isNull(), docs["text"]).otherwise(kept(docs["text"].cast("binary"), "__dropped").cast("string"))
    return both.select(*(text.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_lines(docs, drop_bitmaps(docs), digest=True)


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_az(btrim) AS key FROM (
    SELECT doc_id, pos, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS btrim FROM (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents))),
shared AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key),
islands AS (SELECT doc_id, gone, pos, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS g FROM marked),
runs AS (SELECT doc_id, gone, min(pos) AS first, count(*) AS n FROM islands GROUP BY doc_id, gone, g),
coded AS (SELECT doc_id, CASE WHEN bool_or(gone AND first = 1) THEN '0,' ELSE '' END || string_agg(n, ',' ORDER BY first) AS keep_runs FROM runs GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256, any_value(keep_runs) AS keep_runs
FROM marked JOIN coded USING (doc_id) GROUP BY doc_id
""".replace("lower_az(btrim)", "translate(btrim, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
