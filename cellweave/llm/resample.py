r"""Importance resampling towards a target distribution, by hashed n-gram counts.

Texts are read in parts of some megabytes. A part's distinct words get integer ids,
its n-grams are tuples of ids, and the bytes of each distinct tuple are put together
once. What is shuffled are the parts' distinct n-grams with their counts, not the
words: over all parts each n-gram is hashed once, by CRC32 modulo the number of
buckets, and the gain of its bucket is joined back to the parts that have it. A part is
then one row, with the gains of its n-grams beside the counts of its documents.

A bucket's gain is ``floor(1000*ln((t+1)*(S+B)/((s+1)*(T+B))))``: of ``S`` features of
the corpus ``s`` are in it, of ``T`` of the target ``t``; ``B`` buckets. A document's weight is
the sum of its features' gains; with a Gumbel variable from a hash of its id it is the
score, and the highest scores are a sample without replacement in proportion to the
exponentials of weights.

Edge cases: null and empty texts, and those without a word, have no features and
weight 0, and are never drawn; a null ``doc_id`` hashes as an empty one and comes last
among equal scores; rows with equal ids are drawn each, and count each; a text of any
length is one document, read whole; an empty target gives gains too; an empty table gives no
rows. Columns besides ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .shared import removed, stored, table
from .tokens import ALNUM, Words, chunks, lower_texts

N_GRAM, BUCKETS, PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, "2024"
PART_BYTES = 4 << 20


def id_tuples(w: Words, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Tuples of word ids for each length up to ``n``, a word of each id; the text and the tuple's number of all n-grams.

    Tuples are numbered through all lengths, the shortest first. A tuple of ``k`` ids is
    a tuple of ``k - 1`` and an id, so one sort of pairs of integers finds the distinct ones.
    """
    _, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
    tuples, texts, numbers = [np.arange(len(first)).reshape(-1, 1)], [w.text], [word]
    at, base = word, len(first)
    for k in range(2, n + 1):
        here = np.flatnonzero(w.text[: max(len(word) - k + 1, 0)] == w.text[k - 1 :])
        pairs, inverse = np.unique(at[here] * len(first) + word[here + k - 1], return_inverse=True)
        tuples.append(np.column_stack([tuples[-1][pairs // max(len(first), 1)], pairs % max(len(first), 1)]))
        at = np.zeros_like(word)
        at[here] = inverse
        texts.append(w.text[here])
        numbers.append(inverse + base)
        base += len(pairs)
    return tuples, first, np.concatenate(texts), np.concatenate(numbers)


def _bytes_of(tuples: list[np.ndarray], words: pa.Array) -> pa.Array:
    """The text of each tuple, its words joined by a space."""
    return pa.concat_arrays([pc.binary_join_element_wise(*(words.take(pa.array(t[:, j])) for j in range(t.shape[1])), " ") if t.shape[1] > 1 else words.take(pa.array(t[:, 0])) for t in tuples])


def parts_of(docs: DataFrame, n: int = N_GRAM) -> DataFrame:
    """``part, grams, totals, docs``: distinct n-grams with counts, and of each document the numbers of its n-grams with counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for w in chunks(batch.column("text"), ALNUM, PART_BYTES):
                tuples, first, text, number = id_tuples(w, n)
                size = sum(map(len, tuples))
                pairs, count = np.unique(text * size + number, return_counts=True)
                own = np.searchsorted(pairs, np.arange(w.n_texts + 1) * size).astype(np.int32)
                lists = lambda x, own=own: pa.ListArray.from_arrays(pa.array(own), pa.array(x, pa.int32()))
                ids = batch.column("doc_id").slice(w.first, w.n_texts)
                features = np.bincount(text, minlength=w.n_texts)
                docs = pa.StructArray.from_arrays([ids, pa.array(w.counts, pa.int64()), pa.array(features, pa.int64()), lists(pairs % max(size, 1)), lists(count)], ["doc_id", "n_words", "n_features", "gram", "count"])
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                grams = _bytes_of(tuples, lower_texts(w, first))
                totals = pa.array(np.bincount(number, minlength=size).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([part]), one(grams), one(totals), one(docs)], ["part", "grams", "totals", "docs"])
                part += 1

    return docs.select("doc_id", "text").mapInArrow(
        made, f"part bigint, grams array<string>, totals array<bigint>, docs array<struct<doc_id:{kind},n_words:bigint,n_features:bigint,gram:array<int>,count:array<int>>>"
    )


def grams_of(parts: DataFrame) -> DataFrame:
    """``part, no, gram, total`` of the parts' distinct n-grams."""
    return parts.select("part", F.posexplode(F.arrays_zip("grams", "totals")).alias("no", "g")).select("part", "no", F.col("g.grams").alias("gram"), F.col("g.totals").alias("total"))


def hashed(grams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``gram, total, bucket``: each n-gram once."""
    return grams.groupBy("gram").agg(F.sum("total").alias("total")).withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int"))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of the corpus's buckets, from :func:`hashed` n-grams of both; ``buckets`` rows at most."""
    s = corpus.groupBy("bucket").agg(F.sum("total").cast("double").alias("s"))
    t = target.groupBy("bucket").agg(F.sum("total").cast("double").alias("t"))
    total = lambda x, c: F.coalesce(x, F.lit(0.0)) + c
    all_s, all_t = s.agg(F.sum("s").alias("all_s")), t.agg(F.sum("t").alias("all_t"))  # one row each
    both = s.join(t, "bucket", "left").crossJoin(all_s).crossJoin(all_t)
    ratio = total(F.col("t"), 1) * total(F.col("all_s"), buckets) / (total(F.col("s"), 1) * total(F.col("all_t"), buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """``floor(-1000*ln(-ln(u)))`` of a number ``u`` between 0 and 1 that follows from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _with_place(no: Column, gain: Column) -> Column:
    """Both in one number, which sorts by ``no``; gains are within 32 bits, as logarithms of doubles are."""
    return no.cast("bigint") * (1 << 32) + gain + (1 << 31)


def _without_place(x: Column) -> Column:
    return x.bitwiseAND((1 << 32) - 1) - (1 << 31)


def weighed(docs: DataFrame, target: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row, stored in the shared folder; ``target`` has ``text``."""
    spark = docs.sparkSession
    parts, at_parts = stored(parts_of(docs, n), large_rows=True)
    own = grams_of(parts)
    corpus, at_corpus = stored(hashed(own, buckets))
    wanted = hashed(grams_of(parts_of(target.select(F.lit(0).alias("doc_id"), "text"), n)), buckets)
    gains, at_gains = stored(gains_of(corpus, wanted, buckets))
    # of ``buckets`` rows at most
    each = corpus.select("gram", "bucket").join(F.broadcast(gains), "bucket").select("gram", "gain")
    # as many as the part's few megabytes, or its one text, have distinct n-grams
    back = own.select("part", "no", "gram").join(each, "gram").groupBy("part").agg(F.array_sort(F.collect_list(_with_place(F.col("no"), F.col("gain")))).alias("g"))
    weight = "aggregate(zip_with(d.gram, d.count, (g, c) -> c * element_at(gains, g + 1)), 0L, (a, x) -> a + x)"
    rows = f"transform(docs, d -> struct(d.doc_id AS doc_id, d.n_words AS n_words, d.n_features AS n_features, {weight} AS weight))"
    joined = parts.select("part", "docs").join(back.select("part", F.transform("g", _without_place).alias("gains")), "part", "left")
    out, _ = stored(joined.select(F.inline(F.expr(rows))))
    for p in (at_parts, at_corpus, at_gains):
        removed(spark, p)
    return out


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, n: int = N_GRAM, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row; ``rank`` is from 1 for the documents drawn, else null.

    ``percent`` of the documents of ``min_words`` words or more are drawn. They are
    numbered by ranges of scores, so no task has all of them.
    """
    rows = weighed(docs, target, n, buckets).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    able = F.col("n_words") >= min_words
    drawn = percent * rows.where(able).count() // 100
    nth = numbered(rows.where(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")])
    rank = F.when(F.col("nth") < drawn, F.col("nth") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return nth.select(*columns, rank.alias("rank")).unionByName(rows.where(~able).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def op13_id_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC32 goes through a word's bits, the lowest of each byte first.
OP13_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS key, doc_id, {_WORDS} AS words FROM documents),
p AS (SELECT key, f, count(*) AS n FROM (SELECT key, unnest(words) AS f FROM d) GROUP BY ALL),
b AS (SELECT f, count(*) AS n FROM (SELECT unnest({_WORDS}) AS f FROM benchmark) GROUP BY ALL),
fs AS (SELECT DISTINCT f, hex(f) AS h FROM (SELECT f FROM p UNION ALL SELECT f FROM b)),
bits AS (SELECT f, list_transform(range(4 * length(h)), lambda i: ((instr('123456789ABCDEF', h[(i // 8) * 2 + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END]) >> (i % 4)) & 1)::UBIGINT) AS bits FROM fs),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, bits), lambda c, x: xor(c >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT) % 10000 AS bucket FROM bits),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM p JOIN crc USING (f) GROUP BY 1),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM b JOIN crc USING (f) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT key, sum(n * gain)::BIGINT AS weight FROM p JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY key),
r AS (SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (key)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, weight DESC, n_features DESC) AS nth FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= (SELECT 10 * count(*) // 100 FROM r WHERE n_features >= 20) THEN nth END AS rank FROM k"""
