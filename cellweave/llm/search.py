r"""Ranked lexical search: an index of term-bucketed postings, integer scores, the best documents of each item.

Terms are runs of anything but ASCII other than letters and digits, A-Z
lower-cased. The index has a row for each term in some megabytes of text, with the
documents there that have it and how often, so that what is shuffled is gathered
before; it is partitioned by the term's bucket and sorted by term, and buckets are
split between tasks by the texts, whatever terms they hold. Lengths and ids of documents are
kept once, beside it. A search joins the items' terms with the buckets they are in,
deals only these postings by document, scores each, and there repeats it for every
item that has the term. So the sums of an item and a document end where they are
made, and of each task only the best documents of an item go on.

A document is a row: ``key`` tells rows apart that share an id. The weight of a term
is ``floor(1000*ln((2*N+2)/(2*df+1)))``, in doubles, and its score in a document
``w*((1000000000*tf) div (1000*tf+12*m))`` with ``m = 100-b+((b*n*N) div L)``.

Edge cases: null and empty texts, and texts without a term, are in no result and
don't count as documents; rows with equal ids or texts are ranked each, equal scores
by ascending ``doc_id``, null last; items that share an ``item_id`` are one item with all
their terms, items without terms have no rows; a single text of any length is indexed
whole; empty tables give no rows. ``n*N`` must be below 3e17, beyond it Spark raises an error. Columns
besides the ids and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import fresh_folder, keep, removed, stored, table
from .tokens import ALNUM, chunks, lower_texts

TOP, BUCKETS, SPLITS, LENGTH_WEIGHT = 20, 64, 64, 25
#: Of items, a term and an item each, that are searched for at once.
BLOCK_TERMS = 100_000
#: Of text whose postings are gathered in one row a term.
GATHER_BYTES = 4 << 20
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The bucket of rows without term, and the bits that tell a task's texts apart.
_NO_TERM, _TASK_BITS = -1, 33
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def gathered(docs: DataFrame) -> DataFrame:
    """``first, term, n_postings, postings``, and for each part of the texts a row without term that has its ``docs``.

    Texts of a part have the keys from ``first`` on. A posting is a number: the
    text's place in the part, times 2^32, and how often the term stands in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << _TASK_BITS
        for batch in batches:
            for w in chunks(batch.column("text"), ALNUM, GATHER_BYTES):
                _, at, term = np.unique(w.hash, return_index=True, return_inverse=True)
                pairs, tf = np.unique(term * w.n_texts + w.text, return_counts=True)
                offsets = np.searchsorted(pairs, np.arange(len(at) + 1) * w.n_texts).astype(np.int32)
                postings = pa.array(((pairs % w.n_texts) << 32) | tf)
                own = pa.StructArray.from_arrays([batch.column("doc_id").slice(w.first, w.n_texts), pa.array(w.counts, pa.int32())], ["doc_id", "n"])
                n = len(at)
                last = np.r_[offsets, offsets[-1]]
                lists = pa.ListArray.from_arrays(pa.array(last), postings)
                of_part = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(n + 1, np.int32), np.int32(w.n_texts)]), own)
                terms = pa.concat_arrays([lower_texts(w, at), pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, first)), terms, pa.array(np.diff(last)), lists, of_part], ["first", "term", "n_postings", "postings", "docs"])
                first += w.n_texts

    return docs.select("doc_id", "text").mapInArrow(made, f"first bigint, term string, n_postings int, postings array<bigint>, docs array<struct<doc_id:{kind},n:int>>")


def _bucket(buckets: int) -> F.Column:
    return F.when(F.col("term").isNull(), _NO_TERM).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).alias("bucket")


@dataclass(frozen=True)
class Index:
    """Postings and documents, read from the folder they were written to."""

    postings: DataFrame  #: ``bucket, term, first, n_postings, postings``
    documents: DataFrame  #: ``key, doc_id, n`` of texts that have a term


def indexed(docs: DataFrame, path: str, buckets: int = BUCKETS) -> Index:
    """The index of ``docs``, written to ``path``: a folder for each bucket, its files sorted by term."""
    rows = gathered(docs).select("*", _bucket(buckets))
    # a term of many documents is in many parts of the texts, by which its bucket is split
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("first"), F.lit(SPLITS))).sortWithinPartitions("bucket", "term")
    rows.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    all_rows = docs.sparkSession.read.schema(rows.schema).parquet(path)
    own = all_rows.where(F.col("bucket") == _NO_TERM).select("first", F.posexplode("docs").alias("text", "d"))
    return Index(all_rows.where(F.col("bucket") != _NO_TERM).drop("docs"), own.where("d.n > 0").select((F.col("first") + F.col("text")).alias("key"), "d.doc_id", "d.n"))


def item_terms(items: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``item_id, term, q, bucket``: each item's terms and how often it has them."""
    lower = F.translate("text", _CAPITALS, _CAPITALS.lower())
    each = items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(_TERM), 0)).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count("*").alias("q")).select("*", _bucket(buckets))


def scored(index: Index, asked: DataFrame, totals: tuple[int, int], small: bool, length_weight: int = LENGTH_WEIGHT) -> tuple[DataFrame, list[str]]:
    """``item_id, key, doc_id, score`` of all items and documents that share a term of some weight, and paths to remove.

    ``asked`` is :func:`item_terms`, stored; ``totals`` are the numbers of documents and
    of their terms. If ``asked`` is ``small``, it and its terms are broadcast.
    """
    n_docs, n_terms = totals
    sent = F.broadcast if small else lambda x: x
    where = ["bucket", "term"]
    terms = sent(asked.select(*where).distinct())
    df = index.postings.select(*where, "n_postings").join(terms, where, "left_semi").groupBy(*where).agg(F.sum("n_postings").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    known, at_known = stored(df.select(*where, w.alias("w"), F.monotonically_increasing_id().alias("no")).where("w > 0"))
    wanted, at_wanted = stored(asked.join(sent(known), where).select("no", "w", "item_id", "q"))
    hits = index.postings.select(*where, "first", "postings").join(sent(known.select(*where, "no")), where).select("no", "first", F.explode("postings").alias("p"))
    by_doc = hits.select((F.col("first") + F.shiftright("p", 32)).alias("key"), "no", F.col("p").bitwiseAND(0xFFFFFFFF).alias("tf")).repartition("key")
    m = f"({100 - length_weight} + ({length_weight}L * n * {n_docs}L) div {max(n_terms, 1)}L)"
    factor = F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * {m})")
    matches = by_doc.join(index.documents.select("key", "doc_id", F.col("n").cast("bigint").alias("n")), "key").select("key", "doc_id", "no", factor.alias("factor"))
    sums = matches.join(sent(wanted), "no").groupBy("item_id", "key", "doc_id").agg(F.sum(F.col("q") * F.col("w") * F.col("factor")).alias("score"))
    return sums, [at_known, at_wanted]


def best(sums: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's best documents, those of equal score by ascending id."""
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key"))
    return sums.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, buckets: int = BUCKETS, block: int = BLOCK_TERMS) -> DataFrame:
    """:func:`best` of ``docs`` for ``items``, kept in the shared folder; the index goes.

    Items are searched in blocks of about ``block`` terms. A block of at most twice
    as many is broadcast; with an item that has more, its block is joined by shuffles.
    """
    spark = docs.sparkSession
    path = fresh_folder(spark, "postings")
    index = indexed(docs, path, buckets)
    asked, at_asked = stored(item_terms(items, buckets))
    totals = tuple(index.documents.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first())  # two numbers
    n_blocks = max(1, -(-asked.count() // block))
    of_block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    parts, paths = [], [path, at_asked]
    for i in range(n_blocks):
        own = asked.where(of_block == i)
        sums, more = scored(index, own, totals, own.count() <= 2 * block)
        parts.append(keep(best(sums, top)))
        paths += more
    for p in paths:
        removed(spark, p)
    return reduce(DataFrame.unionByName, parts)


def op11_term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS key, doc_id, text FROM documents),
w AS (SELECT key, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
n AS (SELECT key, doc_id, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM n),
p AS (SELECT key, t, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
i AS (SELECT item_id, key, doc_id, q * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))) AS s
  FROM q JOIN df USING (t) JOIN p USING (t) JOIN n USING (key) CROSS JOIN g),
s AS (SELECT item_id, key, doc_id, sum(s)::BIGINT AS score FROM i GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, key) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""
