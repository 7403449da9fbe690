"""Ranked search against a brute-force version."""

import math
import random
import re
from collections import Counter

import pytest

from cellweave.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, key int, term string, bucket int, postings int, q int"
ITEMS = "item_id bigint, text string, score int, no int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    words = [(i, terms(t)) for i, t in docs]
    words = [(i, t) for i, t in words if t]
    n_docs, n_terms = len(words), sum(len(t) for _, t in words)
    counts = [(i, len(t), Counter(t)) for i, t in words]
    df = Counter(t for _, _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for at, (i, n, tf) in enumerate(counts):
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in wanted if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, at, i))
        out += [(item, k, i, -s) for k, (s, _, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def sample(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "the", "Été", "été", "naïve", "x-1", "日本", "A", "Zz9", "q" * 300]
    text = lambda most: " ".join(rnd.choice(vocabulary[: rnd.choice((5, 20, 50))]) + rnd.choice(("", ",", "!?", "\n", "\x00")) for _ in range(rnd.randrange(1, most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(None, text(20)), (None, docs[3][1]), (7, docs[7][1]), (7, text(9)), (900, None), (901, ""), (902, " -- \n"), (903, "w1 " * 20_000)]
    docs += [(1000 + i, docs[4][1]) for i in range(40)]
    items = [(1, text(30)), (2, text(30)), (2, text(10)), (3, None), (4, ""), (5, "unheardof"), (None, "w1 w2 w2 The"), (6, docs[4][1]), (8, " ".join(vocabulary))]
    return docs, items


@pytest.mark.parametrize("gather", [1 << 22, 200])
def test_best_documents(spark, monkeypatch, gather):
    monkeypatch.setattr(search, "GATHER_BYTES", gather)
    docs, items = sample(5)
    d = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)
    got = [tuple(r) for r in search.ranked(d, i).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, items, 20), key=repr)


@pytest.mark.parametrize("block", [2, 40])
def test_in_blocks_with_and_without_broadcasts(spark, block):
    docs, items = sample(6, 60)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(r) for r in search.ranked(spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in docs], DOCS), spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS), top=3, buckets=5, block=block).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got, key=repr) == sorted(brute(docs, items, 3), key=repr)


def test_index_has_every_posting_in_its_bucket(spark, tmp_path):
    docs, _ = sample(7, 40)
    d = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in docs], DOCS)
    index = search.indexed(d, f"{tmp_path}/index", 8)
    named = {r.key: (r.doc_id, r.n) for r in index.documents.collect()}
    assert len(named) == sum(1 for _, t in docs if terms(t))
    rows, got = index.postings.collect(), Counter()
    for r in rows:
        assert r.n_postings == len(r.postings)
        for p in r.postings:
            i, n = named[r.first + (p >> 32)]
            got[(r.term, i, p & 0xFFFFFFFF, n)] += 1
    want = Counter((t, i, n, len(terms(text))) for i, text in docs for t, n in Counter(terms(text)).items())
    assert got == want
    assert len({(r.term, r.bucket) for r in rows}) == len({r.term for r in rows})


def test_empty_tables(spark):
    docs, items = sample(8, 12)
    none = lambda schema: spark.createDataFrame([], schema)
    d = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in docs], DOCS)
    assert search.ranked(none(DOCS), none(ITEMS)).count() == 0
    assert search.ranked(d, none(ITEMS)).count() == 0
    assert search.ranked(none(DOCS), spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)).count() == 0
