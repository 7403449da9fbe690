"""Length buckets of least padding, and batches of a token budget inside each.

A text's length is its number of words (runs of anything but ASCII white space)
and one end token. Texts longer than ``max_len`` are cut into pieces of
``max_len`` and a rest; nothing is dropped. The histogram of piece lengths has at
most ``max_len`` entries whatever the size of the corpus, and dynamic programming
over it finds the ``n_buckets`` upper bounds for which padding every piece to its
bucket's bound wastes least. A batch of a bucket with bound ``b`` has
``budget // b`` pieces.

Pieces are numbered within a bucket by length and id without bringing the bucket
to one task: they are range-partitioned by this order, and a piece's number follows
from its place in its partition and the sizes of those before. So batches depend on
the rows only, not on the size or layout of the table, and hold like lengths.

Edge cases: null, empty and blank texts are one piece, the end token alone; a null
``doc_id`` comes first among equal lengths; texts of any length are cut, none is
dropped; repeated rows and ties are packed each; an empty table gives no rows.
Columns besides ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .shared import keep, table

MAX_LEN, BUCKETS, BUDGET = 2048, 8, 65_536
_WORD_GAP = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: F.Column) -> F.Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, _WORD_GAP))).cast("bigint")


def bucket_bounds(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """The upper bounds that minimise the padding; ``histogram`` has counts by length."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    count = np.array([histogram[x] for x in lengths.tolist()], dtype=np.float64)
    before = np.concatenate([[0], np.cumsum(count)])
    n = len(lengths)
    best = np.full((min(n_buckets, n) + 1, n + 1), np.inf)
    best[0, 0] = 0
    cut = np.zeros(best.shape, dtype=np.int64)
    for k in range(1, len(best)):
        for j in range(1, n + 1):
            # pieces i..j-1 padded to lengths[j-1]; the pieces' own tokens are the same in any case
            cost = best[k - 1, :j] + lengths[j - 1] * (before[j] - before[:j])
            cut[k, j] = i = int(np.argmin(cost))
            best[k, j] = cost[i]
    k, j, out = int(np.argmin(best[:, n])), n, []
    while j:
        out.append(int(lengths[j - 1]))
        k, j = k - 1, int(cut[k, j])
    return out[::-1]


def packed(docs: DataFrame, max_len: int = MAX_LEN, n_buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """A row for each piece: ``doc_id, piece, first_token, n_tokens, bucket, padded_len, batch, slot``.

    ``batch`` counts from 0 within its ``bucket``, ``slot`` within its batch.
    """
    if budget < max_len:
        raise ValueError("a batch must hold at least one piece of max_len tokens")
    total = docs.select("doc_id", (n_words(F.col("text")) + 1).alias("total"))
    cuts = F.ceil(F.col("total") / F.lit(max_len)).cast("int")
    pieces = keep(
        total.select("doc_id", "total", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("piece")).select(
            "doc_id",
            "piece",
            (F.col("piece").cast("bigint") * max_len).alias("first_token"),
            F.least(F.lit(max_len).cast("bigint"), F.col("total") - F.col("piece").cast("bigint") * max_len).alias("n_tokens"),
        )
    )
    # at most max_len rows
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    bounds = bucket_bounds(histogram, n_buckets)
    bucket, padded = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(i)).otherwise(bucket)
        padded = F.when(F.col("n_tokens") <= b, F.lit(b).cast("bigint")).otherwise(padded)
    dealt = numbered(pieces.withColumns({"bucket": bucket, "padded_len": padded}), [F.asc("n_tokens"), F.asc("doc_id"), F.asc("piece")], ["bucket"])
    rows = F.floor(F.lit(budget) / F.col("padded_len"))
    return dealt.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket", "padded_len", F.floor(F.col("nth") / rows).alias("batch"), (F.col("nth") % rows).alias("slot")
    )


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
