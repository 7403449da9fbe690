"""Near duplicates by BagMinHash signatures, banding and exact multiset overlap.

Two texts are linked if their multisets of runs of five words overlap by a
weighted Jaccard similarity of at least ``threshold``; classes are the connected
components of the links. Words are runs of letters, digits and non-ASCII
characters, A-Z lower-cased; a text of one to four words is one run.

A signature component keeps the earliest event of its Poisson process over all
runs of a text. A run that occurs ``w`` times owns the levels 1..w; levels are
grouped in dyadic blocks (0,1], (1,2], (2,4], ..., and a block's events are drawn
together, each with a random level, and kept up to level ``w``. So a run costs
1 + log2(w) processes, and equal components appear with the probability of the
weighted Jaccard similarity. Processes end at a time by which, as checked, every
component has its first event.

Candidates meet in one of ``bands`` buckets of ``rows`` components, with
probability 1 - 3e-6 at similarity 0.8 (42 bands of 6). Pairs of a bucket are
never listed; two steps find its links:

1. Every text is compared with the most central text of its buckets, the one that
   meets the most others. This joins large groups by stars.
2. In buckets that still hold different components, texts are compared with the
   bucket's own most central text, the lead. What only one of the two has is the
   text's difference ``D`` from the lead. Two texts ``a, b`` of sizes ``n`` reach
   the threshold ``t`` only if ``|Da ^ Db| <= (na + nb) (1 - t) / (1 + t)``, so
   their differences must be largely the same: with the items of ``D`` in one
   order (first what few texts have and the lead lacks, then what most have and the
   lead, too; last what nearly all differ in from the lead), they have a common item
   among the first few of both, and what follows it bounds their overlap. Pairs
   that meet there are compared in full. The number of items that are looked at
   follows from the sizes alone, see :func:`_prefix`; nothing is capped, and texts
   that link to the lead meet only texts that don't.

Edge cases: null and wordless texts have no runs and are classes of their own
row; repeated rows and ties give equal classes; null ``doc_id`` counts as larger
than any other. A class is named by its smallest ``doc_id`` (null if it has none).
Texts of any length are read whole, one at a time if they are longer than a chunk;
an empty table gives no rows. Columns besides ``doc_id`` and ``text`` may have any
names and types: they are carried as one struct and never referred to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import keep, table
from .tokens import ALNUM, Words, chunks, mix, windows

ROWS, BANDS, SHINGLE, THRESHOLD = 6, 42, 5, 0.8
#: Into how many parts the pairs of one text are dealt when they are joined with its runs.
SALTS = 256
#: Of the filter that is sent to all tasks: 16 MB.
MAX_FILTER_BITS = 1 << 27
_SHARED = 1 << 57
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xA0761D6478BD642F)


def _steps(i: int) -> np.uint64:
    return np.uint64(int(_STEP) * i & 0xFFFFFFFFFFFFFFFF)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and their texts; short texts are one run."""
    h, at = windows(w, k)
    text = w.text[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = np.full(len(short), _SALT)
        for j in range(k - 1):
            has = w.counts[short] > j
            whole[has] = mix(whole[has] * _STEP + w.hash[w.begin[short[has]] + j])
        h, text = np.concatenate([h, whole]), np.concatenate([text, short])
    return h, text


def counted(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with how often each occurs, ordered by both."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], text[at], np.diff(np.append(at, len(h)))


def bag_minhash(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Signatures of ``m`` event times for each text; infinite for a text without runs."""
    keys, owner, rate, low, top = [mix(h)], [text], [np.ones(len(h))], [np.zeros(len(h))], [np.ones(len(h))]
    block = 1
    while len(at := np.flatnonzero(weight > 2 ** (block - 1))):
        size = float(2 ** (block - 1))
        keys.append(mix(h[at] + _steps(block)))
        owner.append(text[at])
        rate.append(np.full(len(at), size))
        low.append(np.full(len(at), size))
        top.append(np.minimum(weight[at], 2.0 * size))
        block += 1
    key, own, rate, low, top = map(np.concatenate, (keys, owner, rate, low, top))
    total = np.bincount(own, weights=top - low, minlength=n_texts)
    sig = np.full(n_texts * m, np.inf)
    limit = np.zeros(n_texts)
    open_ = total > 0
    limit[open_] = (np.log(m) + 4) * m / total[open_]
    todo = np.flatnonzero(open_[own]) if len(own) else np.zeros(0, int)
    while len(todo):
        live, t, i = todo, np.zeros(len(todo)), 0
        while len(live):
            i += 1
            a = mix(key[live] + _steps(2 * i))
            t = t - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[live]
            on = np.flatnonzero(t < limit[own[live]])
            live, t = live[on], t[on]
            b = mix(key[live] + _steps(2 * i + 1))
            size = rate[live]
            level = low[live] + size * ((b >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32
            hit = np.flatnonzero(level <= top[live])
            cell = own[live[hit]] * m + ((b[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(sig, cell, t[hit])
        bad = np.flatnonzero(np.isinf(sig.reshape(n_texts, m)).any(axis=1) & open_)
        again = np.zeros(n_texts, dtype=bool)
        again[bad] = True
        limit[bad] *= 2
        sig.reshape(n_texts, m)[bad] = np.inf
        todo = np.flatnonzero(again[own])
    return sig.reshape(n_texts, m)


def contents(w: Words) -> pa.Array:
    """A 128-bit hash of each text's word sequence; null for a wordless text."""
    place = (np.arange(len(w.hash), dtype=np.int64) - w.begin[w.text]).astype(np.uint64)
    two = [np.zeros(w.n_texts, np.uint64), np.zeros(w.n_texts, np.uint64)]
    for x, salt in zip(two, (_STEP, _SALT), strict=True):
        np.add.at(x, w.text, mix(w.hash * salt + mix(place + salt)))
    raw = np.stack([x.byteswap() for x in two], axis=1).reshape(-1).tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] if c else None for i, c in enumerate(w.counts)], pa.binary())


def _signed(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in chunks(batch.column("text"), ALNUM):
            own, of, n = counted(*shingles(w, k))
            sig = bag_minhash(own, of, n, w.n_texts, bands * rows).view(np.uint64)
            band = np.zeros((w.n_texts, bands), dtype=np.uint64)
            for r in range(rows):
                band = mix(band * _STEP + sig[:, r::rows])
            band = mix(band + np.arange(bands, dtype=np.uint64) * _SALT)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).reshape(-1)), bands)
            size = np.maximum(w.counts - k + 1, (w.counts > 0).astype(int))
            same = [batch.column(c).slice(w.first, w.n_texts) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays(
                [*same, contents(w), pa.array(size, pa.int64()), lists.cast(pa.list_(pa.int64()))],
                ["doc_id", "text_key", "node", "n", "bands"],
            )


def _text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _row_key(text_key: F.Column) -> F.Column:
    """A number of fixed width for the rows of an id and text."""
    return F.xxhash64("doc_id", text_key)


def signatures(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each text ``doc_id, text_key, node`` (:func:`contents`), ``n`` runs and ``bands``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _text_key().alias("text_key"), "text").mapInArrow(
        lambda it: _signed(it, k, bands, rows),
        f"doc_id {id_type}, text_key bigint, node binary, n bigint, bands array<bigint>",
    )


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of the hashed numbers ``key``: 16 bits for each, ``MAX_FILTER_BITS`` at most."""
    n = keys.count()
    bits = min(MAX_FILTER_BITS, max(1 << 16, 1 << (16 * n - 1).bit_length()))
    place = keys.select(F.explode(F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1))).alias("at"))
    words = place.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"]] = words["bits"]
    return out.view(np.uint64)


def _in_filter(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    last, key = np.uint64((len(words) << 6) - 1), key.view(np.uint64)
    there = lambda at: (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return there(key & last) & there((key >> np.uint64(32)) & last)


def shingle_sets(docs: DataFrame, k: int = SHINGLE, wanted: DataFrame | None = None) -> DataFrame:
    """``node`` and ``runs``: its hashed runs, repeated ones made distinct by their count.

    With ``wanted``, a table of :func:`_row_key`, only of those rows, and of a few
    others that its filter can't tell from them, so that no text has to be joined.
    The filter is of bounded size; when it is full, more of the others come along.
    """
    words = None if wanted is None else docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if words is not None:
                batch = batch.filter(pa.array(_in_filter(words.value, batch.column("key").to_numpy())))
            for w in chunks(batch.column("text"), ALNUM):
                h, text = shingles(w, k)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                at = np.arange(len(h))
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                nth = at - np.maximum.accumulate(np.where(new, at, 0))
                runs = np.where(nth == 0, h, mix(h + nth.astype(np.uint64) * _SALT)).view(np.int64)
                bounds = np.searchsorted(text, np.arange(w.n_texts + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(runs))
                yield pa.RecordBatch.from_arrays([contents(w), lists], ["node", "runs"])

    return docs.select("text", _row_key(_text_key()).alias("key")).mapInArrow(made, "node binary, runs array<bigint>")


def _joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs``, the runs of ``a`` and ``b``, ``ra`` and ``rb``, and what else ``left`` has; a text ``a`` in many pairs is dealt over ``SALTS`` tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    of_a = salted.select("a", "salt").distinct().join(left.withColumnsRenamed({"node": "a", "runs": "ra"}), "a")
    return salted.join(right.select(F.col("node").alias("b"), F.col("runs").alias("rb")), "b").join(of_a, ["a", "salt"]).drop("salt")


def _verified(pairs: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """Of ``a, b`` those whose multisets of runs overlap by ``threshold``."""
    both = F.size(F.array_intersect("ra", "rb"))
    return (
        _joined(pairs, runs, runs)
        .select("a", "b", both.alias("i"), (F.size("ra") + F.size("rb")).alias("t"))
        .where(F.col("i") >= F.lit(threshold) * (F.col("t") - F.col("i")))
        .select("a", "b")
    )


def near_classes(
    docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row for each of ``docs``: ``doc_id, text_key, class_id, class_size`` (rows in the class), ``stays``.

    ``stays`` marks the class's first row by ``doc_id``, then ``text_key``, and
    every wordless row.
    """
    signed = keep(signatures(docs, k, bands, rows))
    row = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")
    texts = keep(
        signed.where("node IS NOT NULL").groupBy("node").agg(F.min(row).alias("row"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    )
    met = texts.select("node", F.explode("bands").alias("bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = keep(met.join(sizes, "bucket"))

    # the runs of candidates only, from one row each
    wanted = texts.join(members.select("node").distinct(), "node", "left_semi").select("row.doc_id", "row.text_key")
    wanted = keep(wanted.select(_row_key(F.col("text_key")).alias("key")))
    runs = keep(shingle_sets(docs, k, wanted).where("node IS NOT NULL").dropDuplicates(["node"]))

    # one partner for each text: the most central one that leads a bucket of it
    central = members.groupBy("node").agg(F.sum("size").alias("met"))
    members = keep(members.join(central, "node"))
    leads = members.groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("lead"))
    partners = (
        members.join(leads, "bucket").where("node <> lead.node")
        .groupBy(F.col("node").alias("b")).agg(F.max("lead").getField("node").alias("a"))
    )
    links = keep(_verified(partners, runs, threshold))
    labels = components(links)
    more = _further_links(members, labels, runs, threshold)
    if more is not None:
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

    named = texts.join(labels, "node", "left").select("node", "row", "copies", F.coalesce("label", "node").alias("label"))
    classes = named.groupBy("label").agg(F.min("row").alias("first"), F.sum("copies").alias("class_size"))
    of = named.join(classes, "label").select("node", "first", "class_size")
    alone = F.col("node").isNull()
    return signed.join(of, "node", "left").select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("bigint")).otherwise(F.col("class_size")).alias("class_size"),
        (alone | (row == F.col("first"))).alias("stays"),
    )


def _split(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``bucket, node, label, lead, size`` of buckets whose members are in different components."""
    of = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = of.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("met", "node")).alias("most"))
    split = split.where("lo <> hi").select("bucket", F.col("most.node").alias("lead"))
    return keep(of.select("bucket", "node", "label", "size").join(split, "bucket"))


def _by_rarity(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n, runs`` of ``nodes``, with runs coded so that rarer ones are smaller; those of one text only are below ``_SHARED``."""
    there = runs.join(nodes, "node", "left_semi").select("node", F.size("runs").alias("n"), "runs")
    each = there.select("node", F.explode("runs").alias("run"))
    common = each.groupBy("run").agg(F.count("*").alias("df")).where("df > 1")
    code = F.shiftleft(F.floor(F.log2(F.coalesce("df", F.lit(1)))).cast("bigint"), 57).bitwiseOR(F.shiftrightunsigned("run", 7))
    return each.join(common, "run", "left").select("node", code.alias("run")).groupBy("node").agg(F.count("*").cast("int").alias("n"), F.collect_list("run").alias("runs"))


def _prefix(threshold: float) -> F.Column:
    """How many items of a difference of size ``d`` from a lead of ``nl`` runs must be looked at, for a text of ``n``.

    With ``r = (1 - t) / (1 + t)`` a partner of ``m`` runs, ``t n <= m <= n / t``, whose
    difference is ``e`` must have ``(d + e - r (n + m)) / 2`` of the items. As
    ``e >= d - r (n + m)`` that is ``d - r (n + n / t)`` at least. As ``e >= |m - nl|``
    it is at least the value at the ``m`` nearest to ``nl``; and where the text links
    to its lead, the partner does not, so ``e > r (m + nl)``.
    """
    r = (1 - threshold) / (1 + threshold)
    n, d, nl = F.col("n"), F.col("d"), F.col("nl")
    m = F.greatest(threshold * n, F.least(n / threshold, nl))
    need = F.greatest(d - r * (n + n / threshold), (F.abs(m - nl) + d - r * (n + m)) / 2, F.when(~F.col("far"), (d + r * (nl - n)) / 2))
    return F.greatest(F.lit(0), F.least(d, F.floor(d - need + 1e-6) + 1)).cast("int")


def _further_links(members: DataFrame, labels: DataFrame, runs: DataFrame, threshold: float) -> DataFrame | None:
    """Links between different components that share a bucket, or None if no bucket has any."""
    apart = _split(members, labels)
    if apart.isEmpty():
        return None
    coded = keep(_by_rarity(runs, apart.select("node").distinct()))
    spokes = apart.where("node <> lead").groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg((F.max("size") > 2).alias("more"))
    # a text's own runs that no one else has come first in its difference; as they can't be met, their number will do
    shared = coded.select("node", F.filter("runs", lambda x: x >= _SHARED).alias("runs"))
    # in differences from one lead, rare items are what few texts have and the lead lacks, and what most have and the lead, too
    hubs = spokes.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("g"))
    hubs = coded.select("node", "runs").join(hubs, "node").withColumn("many", F.shiftleft(F.greatest(F.floor(F.log2("g")) - 1, F.lit(1)).cast("bigint"), 57)).drop("g")
    more, less = (F.array_except(*x) for x in (("rb", "ra"), ("ra", "rb")))
    few = lambda x: x < F.col("many")
    # what only the lead has is in all differences, so it is last, and one item stands for all of it
    own = lambda x: x < _SHARED
    both = _joined(spokes, hubs, shared).select(
        "a", "b", "more", F.size("ra").alias("nl"), F.size(F.array_intersect("ra", "rb")).alias("i"), (F.size(more) + F.size(less)).alias("met"),
        F.concat(
            F.array_sort(F.filter(more, few)), F.sort_array(F.filter(less, lambda x: ~few(x)), asc=False), F.sort_array(F.filter(less, lambda x: few(x) & ~own(x)), asc=False),
            F.array_sort(F.filter(more, lambda x: ~few(x))), F.slice(F.array_sort(F.filter(less, own)), 1, 1),
        ).alias("items"),
    )
    sized = both.join(coded.select(F.col("node").alias("b"), "n"), "b").withColumn("d", F.col("n") + F.col("nl") - 2 * F.col("i"))
    stars = sized.withColumn("far", F.col("i") < F.lit(threshold) * (F.col("n") + F.col("nl") - F.col("i")))
    stars = stars.withColumn("lone", F.col("d") - F.col("met")).withColumn("p", _prefix(threshold))
    looked_at = F.expr("IF(more, slice(items, 1, greatest(p - lone, 0)), cast(array() AS array<bigint>))")
    stars = keep(stars.select("a", "b", "n", "d", "far", "lone", looked_at.alias("items")))
    links = stars.where("NOT far").select("a", "b")
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))

    of = labels.select(F.col("node").alias("b"), "label")
    met = stars.join(of, "b", "left").select(
        F.xxhash64("a").alias("lead"), F.col("b").alias("node"), F.coalesce("label", "b").alias("label"), "n", "d", "far", "lone", F.posexplode("items").alias("at", "item")
    )
    met = met.select(F.xxhash64("lead", "item").alias("key"), "node", "label", "n", "d", "far", (F.col("d") - F.col("lone") - F.col("at")).alias("rest"))
    x, y = (met.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "n", "d", "far", "rest"))) for s in "xy")
    r = (1 - threshold) / (1 + threshold)
    once = ~F.col("far_y") | (F.col("node_x") < F.col("node_y"))
    reach = 2 * F.least("rest_x", "rest_y") >= F.col("d_x") + F.col("d_y") - F.lit(r) * (F.col("n_x") + F.col("n_y")) - 1e-6
    alike = F.least("n_x", "n_y") >= F.lit(threshold) * F.greatest("n_x", "n_y")
    pairs = (
        x.where("far_x").join(y, (x["key"] == y["key"]) & (F.col("label_x") != F.col("label_y")) & once & reach & alike)
        .select(F.col("node_x").alias("b"), F.col("node_y").alias("a")).distinct()
    )
    return keep(links.unionByName(_verified(pairs, runs, threshold).select("a", "b")))


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: ``doc_id, class_id, class_size``."""
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def _may_be(keys: DataFrame) -> Callable[[F.Column], F.Column]:
    """Whether a number may be one of ``keys``: always true for those, seldom for others while the filter isn't full."""
    words = keys.sparkSession.sparkContext.broadcast(_filter_of(keys))

    @F.pandas_udf("boolean")
    def there(key: pd.Series) -> pd.Series:
        return pd.Series(_in_filter(words.value, key.to_numpy(np.int64)))

    return there


def keep_one_of_each_class(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with only the first row (by ``doc_id``) of each near-duplicate class; wordless rows all stay.

    Of rows that are the same in id and text, and not wordless, the one whose JSON text is the least stays.

    Rows aren't shuffled to learn what becomes of them. One filter has what goes, or
    must be looked at for repeated rows; another those that stay although the first
    may have them. What only the first has goes, what it lacks stays, and just the
    rows that both may have are joined with what is known of them.
    """
    classes = near_classes(docs.select("doc_id", "text"), **options)
    kinds = keep(
        classes.groupBy("doc_id", "text_key").agg(F.first("stays").alias("stays"), ((F.count("*") > 1) & (F.first("class_size") > 1)).alias("twice"))
        .withColumn("key", _row_key(F.col("text_key")))
    )
    may_go = _may_be(kinds.where("NOT stays OR twice").select("key"))
    doubtful = keep(kinds.where("stays").where(may_go(F.col("key"))))
    may_stay = _may_be(doubtful.select("key"))

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    own = docs.select(row, F.col("doc_id").alias("__doc"), _text_key().alias("__text"), _row_key(_text_key()).alias("__at"))
    known = doubtful.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("twice").alias("__twice"))
    left = own.where(may_go(F.col("__at")) & may_stay(F.col("__at"))).join(known, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")))
    # one of the rows that are the same in id and text; wordless texts excepted, which are classes of one
    first = left.where("__twice").groupBy("__id", "__key").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    sure = own.where(~may_go(F.col("__at"))).select("__row")
    return sure.unionByName(left.where("NOT __twice").select("__row")).unionByName(first.select("__row")).select("__row.*")
