"""Importance resampling against a brute-force version."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from cellweave.llm import resample, shared

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, part int, gram string, docs string, bucket int, weight int, rank int"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent, min_words, n, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(i, len(words(t)), features(t, n)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in each for f in fs), Counter(bucket(f) for x in target for f in features(x, n))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, n_words, fs in each:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def sample(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "Été", "naïve", "x-1", "日本", "A", "Zz9", "q" * 300]
    text = lambda most: " ".join(rnd.choice(vocabulary[: rnd.choice((8, 30, 69))]) + rnd.choice(("", ",", "!?", "\n", "\x00")) for _ in range(rnd.randrange(1, most)))
    docs = [(i, text(80)) for i in range(n)]
    docs += [(None, text(90)), (None, None), (7, docs[7][1]), (7, text(60)), (900, None), (901, ""), (902, " -- \n"), (903, "w1 " * 20_000), (904, "one")]
    docs += [(1000 + i, docs[4][1]) for i in range(30)]
    return docs, [text(40) for _ in range(9)] + [None, ""]


def frames(spark, docs, target):
    return spark.createDataFrame([(*r, 1, "g", "d", 2, 3, 4) for r in docs], SCHEMA), spark.createDataFrame([(1, t) for t in target], "doc_id int, text string")


@pytest.mark.parametrize(("n", "part", "buckets"), [(1, 1 << 22, 10_000), (1, 300, 50), (3, 500, 997)])
def test_weights_scores_and_ranks(spark, monkeypatch, n, part, buckets):
    monkeypatch.setattr(resample, "PART_BYTES", part)
    docs, target = sample(n + buckets)
    got = [tuple(r) for r in resample.resampled(*frames(spark, docs, target), percent=25, min_words=10, n=n, buckets=buckets).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, target, 25, 10, n, buckets), key=repr)


def test_each_gram_is_hashed_once(spark, monkeypatch):
    monkeypatch.setattr(resample, "PART_BYTES", 400)
    docs, _ = sample(3)
    d, _ = frames(spark, docs, [])
    rows = resample.hashed(resample.grams_of(resample.parts_of(d, 2)), 1 << 20).collect()
    want = Counter(f for _, t in docs for f in features(t, 2))
    assert {r.gram: r.total for r in rows} == want and len(rows) == len(want)
    assert all(r.bucket == zlib.crc32(r.gram.encode()) % (1 << 20) for r in rows)


def test_empty_tables(spark):
    docs, target = sample(4, 20)
    d, t = frames(spark, docs, target)
    assert resample.resampled(d.limit(0), t).count() == 0
    got = [tuple(r) for r in resample.resampled(d, t.limit(0), percent=50).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, [], 50, 20, 1, 10_000), key=repr)


def test_a_row_group_has_few_parts(spark, monkeypatch):
    """Readers take a row group of nested columns at once, so a group must not have all parts of a file."""
    monkeypatch.setattr(resample, "PART_BYTES", 1)
    monkeypatch.setattr(resample, "removed", lambda *_: None)
    monkeypatch.setitem(shared._FEW_ROWS, "parquet.block.size", 1 << 20)
    rnd, kept = random.Random(5), []

    def stored(df, **how):
        out = shared.stored(df, **how)
        kept.append((df.columns, out[1]))
        return out

    monkeypatch.setattr(resample, "stored", stored)
    docs = [(i, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(20_000))) for i in range(12)]
    rows = resample.weighed(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame([("a b",)], "text string"))
    assert rows.count() == 12
    path = next(p for columns, p in kept if "grams" in columns)
    path = path.removeprefix("file:")
    groups = [f.row_group(i).num_rows for f in map(pq.read_metadata, glob.glob(f"{path}/*.parquet")) for i in range(f.num_row_groups)]
    assert sum(groups) == 12 and max(groups) <= 4
