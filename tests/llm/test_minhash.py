import random
import re
from collections import Counter

import numpy as np
import pytest

from cellweave.llm import minhash
from cellweave.llm.minhash import bag_minhash, keep_one_of_each_class, near_classes

SCHEMA = "doc_id bigint, text string, n bigint"


def bag(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def brute(rows, threshold=0.8):
    bags = [bag(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and (bags[i] & bags[j]).total() >= threshold * (bags[i] | bags[j]).total():
                label[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    return {r[0]: min(groups[root(i)]) for i, r in enumerate(rows)}


def test_classes_equal_all_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(40):
        base = rnd.choices(words, k=rnd.choice([3, 40, 120]))
        for _ in range(rnd.choice([1, 4, 12])):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy), 1))
    rows += [(900, "loop the loop " * 200, 1), (901, "loop the loop " * 190, 1), (902, "loop the loop " * 20, 1)]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_chain_of_a_large_group(spark):
    """Copies that drift from one text: ends are far apart, and links run by frequent and by rare runs."""
    rnd = random.Random(8)
    words = [f"v{i}" for i in range(400)]
    base, rows = rnd.choices(words, k=150), []
    for _ in range(160):
        copy = list(base)
        for _ in range(rnd.choice([0, 2, 3, 4, 5, 6])):
            copy[rnd.randrange(150)] = rnd.choice(words[:6])
        rows.append((len(rows), " ".join(copy), 1))
    for _ in range(30):
        copy = rows[-1][1].split()
        copy[rnd.randrange(150)] = rnd.choice(words)
        rows.append((len(rows), " ".join(copy), 1))
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_signature_estimates_weighted_jaccard():
    h = np.arange(1, 41, dtype=np.uint64)
    one, two = np.full(40, 6), np.full(40, 3)
    sig = bag_minhash(np.concatenate([h, h]), np.repeat([0, 1], 40), np.concatenate([one, two]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.04


@pytest.mark.parametrize("n", [0, 5])
def test_edges(spark, n):
    rows = [(1, None, 1), (2, "", 2), (3, "A b", 3), (3, "A b", 3), (4, "a, B!", 4), (None, "a b", 5)][: n + 1] if n else []
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n", "node")
    got = [(r.doc_id, r.class_id, r.class_size) for r in near_classes(docs).collect()]
    kept = sorted((r.doc_id for r in keep_one_of_each_class(docs).collect()))
    if not n:
        assert got == [] and kept == []
    else:
        assert sorted(got, key=str) == sorted([(1, 1, 1), (2, 2, 1), (3, 3, 4), (3, 3, 4), (4, 3, 4), (None, 3, 4)], key=str)
        assert kept == [1, 2, 3] and keep_one_of_each_class(docs).columns == docs.columns


@pytest.mark.parametrize("bits", [1 << 6, 1 << 27])
def test_kept_rows_are_exact_whatever_the_filter_holds(spark, monkeypatch, bits):
    """A full filter sends all rows through the join; the rows that stay are the same."""
    monkeypatch.setattr(minhash, "MAX_FILTER_BITS", bits)
    words = [f"w{i}" for i in range(400)]
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices(words, k=30)) for _ in range(40)]
    rows = [(i % 90 if i % 17 else None, texts[i % 40] if i % 13 else ("" if i % 2 else None), i % 3) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA).withColumnsRenamed({"n": "__key"})
    firsts: dict[str, tuple] = {}
    for r in rows:
        if r[1]:
            firsts[r[1]] = min(firsts.get(r[1], (True, 0)), (r[0] is None, r[0] or 0))
    want = [r for r in rows + rows[:20] if not r[1]]
    for text, (no, i) in firsts.items():
        want.append(min(((None if no else i), text, r[2]) for r in rows if r[1] == text and (r[0] is None, r[0] or 0) == (no, i)))
    assert sorted(map(str, (tuple(r) for r in keep_one_of_each_class(docs).collect()))) == sorted(map(str, want))
