"""Interpolated modified Kneser-Ney model of word pairs, in memory-mapped sorted arrays.

Tokens are the words of a text (runs of anything but ASCII white space, A-Z
lower-cased) and one end. A text's first word follows an end. The model of order
two is built in two passes over the training texts:

1. Words are counted. Tasks send sorted hashes with counts, in packed arrays, to
   ``shards`` ranges of the hash; each range is merged and written as one file of
   sorted hashes and counts. A word's number is its place in all ranges.
2. Pairs are counted likewise. A pair goes to a shard by its first word; the
   pairs of a word with more than a quarter of a shard's tokens are dealt over
   as many shards as its share asks for. From each shard's merged, sorted pairs
   follow the sums over contexts and the continuation counts of words, which are
   added up by word range and written beside the words.

Files lie in the folder all executors share, are written under a temporary name
and then renamed, so a repeated task does no harm. Scoring maps them (from other
file systems than a mounted one, a copy whose name is removed at once) and looks
up each batch's distinct words and pairs in sorted order. A worker's memory thus
holds its batches, not the model. Only sums by shard come to the driver. Shards
grow in number with the texts' bytes, not in size. The query deletes the files when
its scores are stored; :func:`train` alone leaves them to the caller.

The order is two: three would need, for these texts, about 15 bytes a token for
keys and probabilities alone, which is all the disk that an input may take.

Edge cases: null and empty texts are one end; texts of any length are read whole;
columns besides ``doc_id`` and ``text`` are not read, whatever their names; a null ``doc_id`` is held out (its
remainder is taken of an empty text's checksum, 0); repeated rows count each;
without training texts every token has probability 1/(V+1) = 1.
"""

from __future__ import annotations

import io
import mmap
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_folder, keep, removed, stored, table
from .tokens import BLANK, Words, chunks, mix

FOLDS, TOKENS_A_SHARD, BYTES_A_SHARD, BUFFER = 10, 4_000_000, 16_000_000, 2_000_000
END = np.uint64(0x3C9F51B7A0D24E68)
_U64, _U32 = np.dtype("<u8"), np.dtype("<u4")


# ---- files of arrays in the shared folder


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:|/", folder):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays end to end, after their number of bytes; each begins at a multiple of eight."""
    there, path = _place(folder)
    there.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with there.open_output_stream(tmp) as out:
        out.write(np.array([len(arrays), *(a.nbytes for a in arrays)], _U64).tobytes())
        for a in arrays:
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    there.move(tmp, f"{path}/{name}")


def _mapped(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, as bytes, mapped into memory."""
    there, path = _place(folder)
    if isinstance(there, fs.LocalFileSystem):
        f: io.IOBase = open(f"{path}/{name}", "rb")  # noqa: SIM115
    else:
        f = tempfile.TemporaryFile()  # noqa: SIM115
        with there.open_input_stream(f"{path}/{name}") as src:
            while block := src.read(1 << 22):
                f.write(block)
        f.flush()
    with f:
        own = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **own)
    n = int(np.frombuffer(m, _U64, 1)[0])
    sizes = np.frombuffer(m, _U64, n, 8).tolist()
    at, out = 8 * (n + 1), []
    for size in sizes:
        out.append(np.frombuffer(m, np.uint8, size, at))
        at += size + -size % 8
    return out


_open: dict[str, dict[str, list[np.ndarray]]] = {}


def _arrays(folder: str, name: str) -> list[np.ndarray]:
    """Mapped once in a worker, which keeps the maps of one model only."""
    if folder not in _open:
        _open.clear()
        _open[folder] = {}
    if name not in _open[folder]:
        _open[folder][name] = _mapped(folder, name)
    return _open[folder][name]


# ---- packed, sorted numbers on their way between tasks


def _packed(a: np.ndarray) -> bytes:
    """Compressed by byte planes; sorted 64-bit numbers by their differences."""
    if a.dtype == _U64 and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(b: bytes, dtype: np.dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], n * dtype.itemsize, "zstd", asbytes=True)
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
    return np.cumsum(a, dtype=_U64) if dtype == _U64 else a


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not keys:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return k[at], np.add.reduceat(c, at) if len(k) else c


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` equal ranges of the hash, the one each lies in."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


_BLOB = "shard int, keys binary, counts binary"


def _sent(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard that has some of the sorted ``keys``."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for i, j in zip(at, np.append(at[1:], len(shard)), strict=True):
        own = order[i:j]
        blobs = [_packed(keys[own].astype(_U64)), _packed(counts[own].astype(_U32))]
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[i])], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], ["shard", "keys", "counts"])


class _Buffer:
    """Distinct keys and counts of many chunks."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)

    def full(self) -> bool:
        if self.n > BUFFER:
            k, c = _merged(self.keys, self.counts)
            self.keys, self.counts, self.n = [k], [c], len(k)
        return self.n > BUFFER // 2 and len(self.keys) == 1

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = _merged(self.keys, self.counts)
        self.__init__()
        return out


# ---- building


def _sequence(w: Words, number: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with their ends, what stands before each, and their texts; ``number`` of each word."""
    n = w.counts + 1
    text = np.repeat(np.arange(w.n_texts), n)
    token = np.full(len(text), end, dtype=np.int64)
    token[np.arange(len(w.hash)) + w.text] = number
    before = np.concatenate([[end], token[:-1]]) if len(token) else token
    before[np.cumsum(n) - n] = end
    return token, before, text


def _count_words(shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = _Buffer()
    for batch in batches:
        for w in chunks(batch.column("text"), BLANK):
            own.add(*np.unique(w.hash, return_counts=True))
            own.add(np.array([END]), np.array([w.n_texts]))
            if own.full():
                k, c = own.taken()
                yield from _sent(k, c, _range_of(k, shards))
    k, c = own.taken()
    yield from _sent(k, c, _range_of(k, shards))


def _merge_words(folder: str, t: pa.Table) -> pa.Table:
    shard = t.column("shard")[0].as_py()
    k, c = _merged([_unpacked(b, _U64) for b in t.column("keys").to_pylist()], [_unpacked(b, _U32).astype(np.int64) for b in t.column("counts").to_pylist()])
    _write(folder, f"words-{shard}", [k.astype(_U64), c.astype(_U64)])
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(k)], pa.int64()), "total": pa.array([int(c.sum())], pa.int64())})


class Model:
    """What tasks are told of a model: its folder, and numbers of a few bytes for each shard."""

    def __init__(self, folder: str, word_shards: int, sizes: dict[int, tuple[int, int]]) -> None:
        self.folder, self.word_shards = folder, word_shards
        n = [sizes.get(i, (0, 0))[0] for i in range(word_shards)]
        self.offset = np.cumsum([0, *n])
        self.vocabulary, self.tokens = int(self.offset[-1]), sum(t for _, t in sizes.values())
        if self.vocabulary >= 1 << 32:
            raise ValueError("more than 2**32 distinct words")
        self.pair_shards = max(word_shards, -(-self.tokens // TOKENS_A_SHARD))
        self.pairs = 0
        self.full: set[int] = set()
        self.d2 = self.d1 = np.array([0.0, 0.5, 1.0, 1.5])
        self.base_left = 1.0

    def words(self, h: np.ndarray, with_stats: bool) -> list[np.ndarray]:
        """Of sorted hashes: number (-1 if unknown) and count, then continuation count, context's total and its n1, n2, n3+."""
        out = [np.full(len(h), -1, np.int64), *(np.zeros(len(h), np.int64) for _ in range(6 if with_stats else 1))]
        edges = np.searchsorted(_range_of(h, self.word_shards), np.arange(self.word_shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            if self.offset[s + 1] == self.offset[s]:
                continue
            i, j = edges[s], edges[s + 1]
            keys, counts = (x.view(_U64) for x in _arrays(self.folder, f"words-{s}"))
            at = np.minimum(np.searchsorted(keys, h[i:j]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == h[i:j])
            out[0][i + hit] = self.offset[s] + at[hit]
            out[1][i + hit] = counts[at[hit]]
            if with_stats:
                for o, a in zip(out[2:], _arrays(self.folder, f"stats-{s}"), strict=True):
                    o[i + hit] = a.view(_U64)[at[hit]]
        return out

    def shard_of(self, before: np.ndarray, token: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of pairs; ``count`` is the first word's."""
        spread = 1 + np.minimum(count * self.pair_shards * 4 // max(1, self.tokens), self.pair_shards - 1)
        home = _range_of(mix(before.astype(np.uint64)), self.pair_shards)
        return (home + mix(token.astype(np.uint64)).astype(np.int64) % spread) % self.pair_shards

    def counts(self, before: np.ndarray, token: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How often each pair occurs in training."""
        out = np.zeros(len(token), np.int64)
        key = (before.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64)
        shard = self.shard_of(before, token, count)
        order = np.lexsort((key, shard))
        edges = np.searchsorted(shard[order], np.arange(self.pair_shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            if s not in self.full:
                continue
            own = order[edges[s] : edges[s + 1]]
            keys, small, where, large = _arrays(self.folder, f"pairs-{s}")
            keys = keys.view(_U64)
            at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
            hit = keys[at] == key[own]
            n = np.where(hit, small[at], 0).astype(np.int64)
            if len(where) and len(over := np.flatnonzero(n == 255)):
                n[over] = large.view(_U64)[np.searchsorted(where.view(_U64), at[over])]
            out[own] = n
        return out


def _count_pairs(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = _Buffer()
    end = model.words(np.array([END]), False)

    def sent() -> Iterator[pa.RecordBatch]:
        k, c = own.taken()
        before, token = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        shard = model.shard_of(before, token, known_counts(before))
        yield from _sent(k, c, shard)

    def known_counts(numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        edges = np.searchsorted(numbers, model.offset)  # pairs are sorted by their first words
        for s in np.flatnonzero(np.diff(edges)):
            out[edges[s] : edges[s + 1]] = _arrays(model.folder, f"words-{s}")[1].view(_U64)[numbers[edges[s] : edges[s + 1]] - model.offset[s]]
        return out

    for batch in batches:
        for w in chunks(batch.column("text"), BLANK):
            h, inverse = np.unique(w.hash, return_inverse=True)
            token, before, _ = _sequence(w, model.words(h, False)[0][inverse], int(end[0][0]))
            own.add(*np.unique((before.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64), return_counts=True))
            if own.full():
                yield from sent()
    if own.n:
        yield from sent()


def _sums(numbers: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct ``numbers``, sorted, and the sums of each of ``weights``."""
    order = np.argsort(numbers, kind="stable")
    n = numbers[order]
    at = np.flatnonzero(np.append(True, n[1:] != n[:-1])) if len(n) else np.zeros(0, int)
    return n[at], [np.add.reduceat(w[order], at) if len(n) else w for w in weights]


_PARTS = "shard int, numbers binary, sums binary, facts array<bigint>"


def _merge_pairs(model: Model, t: pa.Table) -> pa.Table:
    shard = t.column("shard")[0].as_py()
    k, c = _merged([_unpacked(b, _U64) for b in t.column("keys").to_pylist()], [_unpacked(b, _U32).astype(np.int64) for b in t.column("counts").to_pylist()])
    large = np.flatnonzero(c >= 255)
    _write(model.folder, f"pairs-{shard}", [k.astype(_U64), np.minimum(c, 255).astype(np.uint8), large.astype(_U64), c[large].astype(_U64)])
    before, token = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
    as_context = _sums(before, [c, *((c == i).astype(np.int64) for i in (1, 2)), (c >= 3).astype(np.int64)])
    as_token = _sums(token, [np.ones(len(c), np.int64)])
    both = np.union1d(as_context[0], as_token[0])
    sums = np.zeros((5, len(both)), np.int64)
    sums[0, np.searchsorted(both, as_token[0])] = as_token[1][0]
    sums[1:, np.searchsorted(both, as_context[0])] = as_context[1]
    # rows for each range of words, and one with facts of the shard
    edges = np.searchsorted(both, model.offset)
    rows = [(-1 - shard, None, None, [len(k), *(int((c == i).sum()) for i in (1, 2, 3, 4))])]
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        rows.append((int(s), _packed(both[part].astype(_U64)), pa.compress(sums[:, part].astype(_U64).tobytes(), "zstd", asbytes=True), None))
    a, b, d, e = zip(*rows, strict=True)
    return pa.table({"shard": pa.array(a, pa.int32()), "numbers": pa.array(b, pa.binary()), "sums": pa.array(d, pa.binary()), "facts": pa.array(e, pa.list_(pa.int64()))})


def _merge_stats(model: Model, t: pa.Table) -> pa.Table:
    """Writes, for each word of a range: continuation count, context's total, n1, n2, n3+."""
    shard = t.column("shard")[0].as_py()
    first, n = int(model.offset[shard]), int(model.offset[shard + 1] - model.offset[shard])
    out = np.zeros((5, n), np.int64)
    for a, b in zip(t.column("numbers").to_pylist(), t.column("sums").to_pylist(), strict=True):
        at = _unpacked(a, _U64).astype(np.int64) - first
        out[:, at] += np.frombuffer(pa.decompress(b, 40 * len(at), "zstd", asbytes=True), np.int64).reshape(5, len(at))
    _write(model.folder, f"stats-{shard}", [x.astype(_U64) for x in out])
    return pa.table({"facts": pa.array([[int(out[0].sum()), *(int((out[0] == i).sum()) for i in (1, 2, 3, 4))]], pa.list_(pa.int64()))})


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more; 0.5, 1 and 1.5 where the counts of counts say nothing."""
    if not min(n1, n2, n3, n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(float(np.clip(i - (i + 1) * y * b / a, 0, i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def train(docs: DataFrame) -> Model:
    """The model of all of ``docs``."""
    spark = docs.sparkSession
    folder, texts = fresh_folder(spark, "ngrams"), docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_A_SHARD))
    words = texts.mapInArrow(lambda it: _count_words(shards, it), _BLOB).groupBy("shard")
    merged = words.applyInArrow(lambda t: _merge_words(folder, t), "shard int, n bigint, total bigint").collect()
    model = Model(folder, shards, {r.shard: (r.n, r.total) for r in merged})
    if not model.vocabulary:
        return model
    pairs = texts.mapInArrow(lambda it: _count_pairs(model, it), _BLOB).groupBy("shard")
    parts = keep(pairs.applyInArrow(lambda t: _merge_pairs(model, t), _PARTS))
    facts = parts.where("facts IS NOT NULL").select("shard", "facts").collect()
    stats = parts.where("facts IS NULL").select("shard", "numbers", "sums").groupBy("shard").applyInArrow(lambda t: _merge_stats(model, t), "facts array<bigint>").collect()
    of_pairs, of_words = (np.array([r.facts for r in x]).sum(axis=0).tolist() for x in (facts, stats))
    model.full = {-1 - r.shard for r in facts}
    model.pairs = of_words[0]
    model.d2, model.d1 = discounts(*of_pairs[1:]), discounts(*of_words[1:])
    n1, n2 = of_words[1:3]
    n3 = model.vocabulary - n1 - n2
    model.base_left = float((model.d1[1:] * [n1, n2, n3]).sum() / model.pairs)
    return model


# ---- scoring


def _scores(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    big_v = model.vocabulary + 1
    for batch in batches:
        for w in chunks(batch.column("text"), BLANK):
            h, inverse = np.unique(np.append(w.hash, END), return_inverse=True)
            number, count, types, total, n1, n2, n3 = model.words(h, True)
            base = np.log10((count + 0.1) / (model.tokens + 0.1 * big_v))
            low = np.maximum(types - model.d1[np.minimum(types, 3)], 0) / max(1, model.pairs) + model.base_left / big_v
            left = np.where(total > 0, (model.d2[1] * n1 + model.d2[2] * n2 + model.d2[3] * n3) / np.maximum(total, 1), 1.0)
            # tokens by their place among the chunk's distinct words
            token, before, text = _sequence(w, inverse[:-1], int(inverse[-1]))
            pair, of = np.unique(before * len(h) + token, return_inverse=True)
            a, b = pair // len(h), pair % len(h)
            c = np.zeros(len(pair), np.int64)
            known = np.flatnonzero((number[a] >= 0) & (number[b] >= 0))
            c[known] = model.counts(number[a[known]], number[b[known]], count[a[known]])
            p = np.maximum(c - model.d2[np.minimum(c, 3)], 0) / np.maximum(total[a], 1) + left[a] * low[b]
            n = w.n_texts
            same = [batch.column(x).slice(w.first, n) for x in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays(
                [
                    *same, pa.array(w.counts + 1, pa.int64()), pa.array(np.bincount(text, weights=count[token] > 0, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(text, weights=base[token], minlength=n)), pa.array(np.bincount(text, weights=np.log10(p)[of], minlength=n)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


def held_out(folds: int = FOLDS, fold: int = 0) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == fold


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score, perplexity`` of each row; scores are log10 probabilities."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        lambda it: _scores(model, it), f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    out = stored(scored(docs, model))[0].withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
    removed(spark, model.folder)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
