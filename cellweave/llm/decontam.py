"""Benchmark passages in training texts, by a positional inverted index of the rarest test words.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A
window is ten consecutive words of a benchmark item, or a shorter item as a whole.

1. One pass over the texts counts in how many of them each benchmark word occurs.
2. Each window is anchored at the places of its two rarest words by that count.
3. A second pass stores the postings of all anchor words: for each text and word
   the positions. :func:`postings` also indexes all words, if none are named.
4. Postings are joined with the anchors on the word. A position less the anchor's
   place is where the item would begin; lists are intersected by grouping on that
   beginning, and only those with two anchors (one, for one-word items) go on.
5. Around these the words are compared one by one. Runs of a window's length are
   phrase matches. Where most of an item's anchors lie near one beginning though
   not all at it, the item is a proximity match.

The benchmark is processed in blocks of bounded size, each against all texts, so
what is sent to the tasks is bounded whatever the benchmark's size.

Edge cases: null and empty texts have no words and are clean; texts of any length
are read whole; items without words never occur; items of equal words are searched
once and all reported; ties in rarity go to the earlier word; repeated rows get the
same result each; an empty benchmark finds nothing, and an empty table gives no rows.
Columns besides ids and texts are not read; :func:`keep_clean` carries them in a
struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, stored, table
from .tokens import ALNUM, chunks

WINDOW, SLOP, NEAR_SHARE, MIN_NEAR = 10, 4, 0.6, 4
BLOCK_CHARS = 2_000_000


def _text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


@dataclass
class Block:
    """A part of the benchmark: distinct word sequences, end to end."""

    words: np.ndarray  #: hashes
    begin: np.ndarray  #: of each item the number of its first word, and the number of all words
    ids: list[list]  #: of each item the item_ids that have its words


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark in parts of about ``block_chars`` characters of distinct texts."""
    items = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.collect_set("item_id").alias("ids"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).orderBy("text").collect()
        found: dict[bytes, tuple[np.ndarray, list]] = {}
        if part:
            for w in chunks(pa.array([r.text for r in part]), ALNUM):
                for j in range(w.n_texts):
                    h = w.hash[w.begin[j] : w.begin[j + 1]]
                    if len(h):
                        found.setdefault(h.tobytes(), (h, []))[1].extend(part[w.first + j].ids)
        if found:
            runs = [h for h, _ in found.values()]
            yield Block(np.concatenate(runs), np.cumsum([0, *map(len, runs)]), [sorted(set(x)) for _, x in found.values()])


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many texts each of the sorted hashes ``vocabulary`` occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        n = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for w in chunks(batch.column("text"), ALNUM):
                at = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
                hit = vocab[at] == w.hash
                pairs = np.unique(w.text[hit] * len(vocab) + at[hit])
                n += np.bincount(pairs % len(vocab), minlength=len(vocab))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there])], ["term", "n"])

    rows = docs.select("text").mapInArrow(counted, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[rows["term"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return out


def anchors_of(block: Block, term: np.ndarray, df: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Items and places (within the item) of the two rarest words of every window; different words, if there are two."""
    items, places = [], []
    for i in range(len(block.ids)):
        own = term[block.begin[i] : block.begin[i + 1]]
        cost = df[own]
        taken: set[int] = set()
        for s in range(max(1, len(own) - window + 1)):
            part = np.argsort(cost[s : s + window], kind="stable") + s
            other = part[own[part] != own[part[0]]]
            second = other[0] if len(other) else part[min(1, len(part) - 1)]
            taken |= {int(part[0]), int(second)}
        items += [i] * len(taken)
        places += sorted(taken)
    return np.array(items, np.int32), np.array(places, np.int32)


def postings(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """``doc_id, text_key, n_words, postings`` (array of ``term, positions``) of each text.

    ``term`` is the place in the sorted ``vocabulary``, or without one the word's
    hash. ``explode(postings)`` is the inverted index.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for w in chunks(batch.column("text"), ALNUM):
                pos = np.arange(len(w.hash)) - w.begin[w.text]
                if vocab is None:
                    term, text = w.hash.view(np.int64), w.text
                else:
                    at = np.minimum(np.searchsorted(vocab, w.hash), max(0, len(vocab) - 1))
                    hit = np.flatnonzero(vocab[at] == w.hash) if len(vocab) else np.zeros(0, int)
                    term, text, pos = at[hit].astype(np.int64), w.text[hit], pos[hit]
                order = np.lexsort((pos, term, text))
                term, text, pos = term[order], text[order], pos[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(pos)), pa.int32()), pa.array(pos, pa.int32()))
                entry = pa.StructArray.from_arrays([pa.array(term[at]), lists], ["term", "positions"])
                bounds = pa.array(np.searchsorted(text[at], np.arange(w.n_texts + 1)), pa.int32())
                same = [batch.column(c).slice(w.first, w.n_texts) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(bounds, entry)],
                    ["doc_id", "text_key", "n_words", "postings"],
                )

    return docs.select("doc_id", _text_key(), "text").mapInArrow(
        made, f"doc_id {id_type}, text_key bigint, n_words bigint, postings array<struct<term:bigint,positions:array<int>>>"
    )


def equal_runs(text: np.ndarray, words: np.ndarray, begin: np.ndarray, item: np.ndarray, at: np.ndarray, window: int, most: int = 1 << 20) -> np.ndarray:
    """Distinct ``item, begin, end`` of runs of at least a window's length in which a text equals an item that begins ``at``, in order.

    All beginnings are compared side by side, as many at a time as have about ``most`` words.
    """
    size = begin[item + 1] - begin[item]
    low, high = np.maximum(0, -at), np.minimum(size, len(text) - at)
    fits = high - low >= np.minimum(window, size)
    item, at, size, low, n = item[fits], at[fits], size[fits], low[fits], (high - low)[fits]
    # a word that equals nothing ends each beginning's part
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out, i = [np.zeros((3, 0), np.int64)], 0
    while i < len(item):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        which = np.repeat(np.arange(i, j), n[i:j] + 1)
        nth = np.arange(bounds[i], bounds[j]) - bounds[which]
        inside = np.flatnonzero(nth < n[which])
        place = low[which[inside]] + nth[inside]
        equal = np.zeros(len(which) + 1, np.int8)
        equal[inside + 1] = words[begin[item[which[inside]]] + place] == text[at[which[inside]] + place]
        edge = np.diff(equal)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        whole = last - first >= np.minimum(window, size[which[first]])
        own, length = which[first[whole]], (last - first)[whole]
        start = at[own] + low[own] + nth[first[whole]]
        out.append(np.stack([item[own], start, start + length]))
        i = j
    return np.unique(np.concatenate(out, axis=1), axis=1)


def _compared(docs: DataFrame, wanted: DataFrame, block: Block, window: int) -> DataFrame:
    """``doc_id, text_key, item, spans``: where runs of a window's length begin and end (exclusive), for ``wanted`` beginnings."""
    shared = docs.sparkSession.sparkContext.broadcast((block.words, block.begin))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # stored, so that Spark knows its size in bytes and broadcasts it only below its limit
    wanted = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")).agg(F.collect_list(F.struct("item", "at")).alias("w"))
    w = stored(wanted)[0]
    keyed = docs.select("doc_id", _text_key(), "text")
    both = keyed.join(w, (keyed["text_key"] == w["w_key"]) & keyed["doc_id"].eqNullSafe(w["w_id"])).select("doc_id", "text_key", "text", "w")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, begin = shared.value
        for batch in batches:
            lists = batch.column("w")
            edges = lists.offsets.to_numpy()
            item, at = (lists.values.field(x).to_numpy().astype(np.int64) for x in ("item", "at"))
            of, found = [], []
            for c in chunks(batch.column("text"), ALNUM):
                for j in range(c.n_texts):
                    own = slice(edges[c.first + j], edges[c.first + j + 1])
                    got = equal_runs(c.hash[c.begin[j] : c.begin[j + 1]], words, begin, item[own], at[own], window)
                    found.append(got)
                    of.append(np.full(got.shape[1], c.first + j))
            row = np.concatenate(of) if of else np.zeros(0, np.int64)
            which, start, end = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (which[1:] != which[:-1]))) if len(row) else np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["begin", "end"])
            texts = pa.array(row[new])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(texts), batch.column("text_key").take(texts), pa.array(which[new], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), spans),
                ],
                ["doc_id", "text_key", "item", "spans"],
            )

    found = both.mapInArrow(runs, f"doc_id {id_type}, text_key bigint, item int, spans array<struct<begin:int,end:int>>")
    # repeated rows have the same matches
    return found.dropDuplicates(["doc_id", "text_key", "item"])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """Texts with ``doc_id, text_key, n_words``, and matches with ``doc_id, text_key, kind, item_ids, spans``.

    ``kind`` is ``phrase`` or ``proximity``; spans of the latter are empty.
    """
    spark = docs.sparkSession
    counted, found = None, None
    for block in blocks_of(benchmark):
        vocab, term = np.unique(block.words, return_inverse=True)
        items, places = anchors_of(block, term, document_frequencies(docs, vocab), window)
        of_anchor = term[block.begin[items] + places]
        used = np.unique(of_anchor)
        index = keep(postings(docs, vocab[used]))
        # bounded by the block
        n_anchors = np.bincount(items, minlength=len(block.ids))
        anchors = spark.createDataFrame(
            pa.table({
                "a_term": pa.array(np.searchsorted(used, of_anchor), pa.int64()), "item": pa.array(items), "place": pa.array(places),
                "n_anchors": pa.array(n_anchors[items], pa.int32()),
            })
        )
        inverted = index.select("doc_id", "text_key", F.explode("postings").alias("p"))
        hits = (
            inverted.join(F.broadcast(anchors), F.col("p.term") == F.col("a_term"))
            .select("doc_id", "text_key", "item", "place", "n_anchors", F.explode("p.positions").alias("pos"))
            .select("doc_id", "text_key", "item", "place", "n_anchors", (F.col("pos") - F.col("place")).alias("at"))
        )
        begun = keep(hits.groupBy("doc_id", "text_key", "item", "at").agg(F.collect_set("place").alias("places"), F.first("n_anchors").alias("n_anchors")))
        wanted = begun.where(F.size("places") >= F.least(F.lit(2), F.col("n_anchors"))).select("doc_id", "text_key", "item", "at")
        phrases = _compared(docs, wanted, block, window)
        bins = F.explode(F.array(F.floor(F.col("at") / slop), F.floor(F.col("at") / slop) + 1))
        near = (
            begun.where(F.col("n_anchors") >= MIN_NEAR)
            .select("doc_id", "text_key", "item", "n_anchors", "places", bins.alias("bin"))
            .groupBy("doc_id", "text_key", "item", "bin")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.first("n_anchors").alias("n_anchors"))
            .where(F.col("n") >= F.greatest(F.lit(MIN_NEAR), F.ceil(NEAR_SHARE * F.col("n_anchors"))))
            .select("doc_id", "text_key", "item")
            .distinct()
        )
        id_type = benchmark.schema["item_id"].dataType.simpleString()
        ids = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), f"i int, item_ids array<{id_type}>"))
        none = F.expr("cast(array() AS array<struct<begin:int,end:int>>)")
        both = phrases.withColumn("kind", F.lit("phrase")).unionByName(near.withColumns({"spans": none, "kind": F.lit("proximity")}))
        both = both.join(ids, F.col("item") == F.col("i")).select("doc_id", "text_key", "kind", "item_ids", "spans")
        found = both if found is None else found.unionByName(both)
        counted = counted if counted is not None else index.select("doc_id", "text_key", "n_words")
    if found is None:
        counted = postings(docs, np.zeros(0, np.uint64)).select("doc_id", "text_key", "n_words")
        id_type, item_type = (x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id")))
        found = spark.createDataFrame(
            [], f"doc_id {id_type}, text_key bigint, kind string, item_ids array<{item_type}>, spans array<struct<begin:int,end:int>>"
        )
    return counted, found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row ``doc_id, text_key, n_words, n_hit, items`` (sorted strings) and ``near_items``."""
    counted, found = matches(docs, benchmark, window)
    ids = lambda kind: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("item_ids"))))).cast("array<string>"))
    each = found.groupBy("doc_id", "text_key").agg(ids("phrase").alias("items"), ids("proximity").alias("near_items"), F.flatten(F.collect_list("spans")).alias("spans"))
    merged = (
        "aggregate(array_sort(spans), named_struct('n', 0L, 'e', -1), (a, s) -> named_struct("
        "'n', a.n + greatest(0, s.end - greatest(s.begin, a.e)), 'e', greatest(a.e, s.end)), a -> a.n)"
    )
    each = each.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "items", "near_items", F.expr(merged).alias("n_hit"))
    same = (F.col("text_key") == F.col("h_key")) & F.col("doc_id").eqNullSafe(F.col("h_id"))
    none = F.array().cast("array<string>")
    return counted.join(each, same, "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the texts in which a benchmark window occurs."""
    bad = contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window).where("n_hit > 0")
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("doc_id").alias("__doc"), _text_key().alias("__text"))
    return own.join(bad, (F.col("__text") == F.col("__key")) & F.col("__doc").eqNullSafe(F.col("__id")), "left_anti").select("__row.*")


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )
