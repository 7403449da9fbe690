"""Weak supervision: selection, votes and the label model against plain versions; held-out accuracy; edge cases."""

import math
import zlib

import numpy as np
import pytest

from cellweave.llm import toxicity as tx
from cellweave.llm.tokens import string_hash

FORMS = ["zorgling", "zorglat", "zorglum"]


def corpus(n, seed=0):
    """Every fifth text is toxic: by a listed word, or by two forms of one unlisted stem that clean texts have one of at most."""
    rnd = np.random.default_rng(seed)
    plain = [f"word{i}" for i in range(400)]
    out = []
    for i in range(n):
        words = list(rnd.choice(plain, 60))
        toxic = i % 5 == 0
        if toxic and i % 2:
            words[7] = "idiot"
        elif toxic:
            words[3], words[9] = rnd.choice(FORMS, 2, replace=False)
        elif i % 7 == 0:
            words[5] = str(rnd.choice(FORMS))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def learnt(spark):
    rows = corpus(3000)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (99999, ""), (7, rows[7][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (0, None), (5, 0)], "doc_id bigint, toxic int")
    return rows, docs, labels


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1


def test_held_out_accuracy(learnt):
    rows, docs, labels = learnt
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 3
    by = {}
    for r in got:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1
        assert by.setdefault(r.doc_id, r.score) == r.score  # repeated rows score the same
    out = [(by[i], t) for i, _, t in rows if held(i)]
    toxic, clean = [s for s, t in out if t], [s for s, t in out if not t]
    assert np.mean([s >= tx.THRESHOLD for s in toxic]) > 0.9
    assert np.mean([s < tx.THRESHOLD for s in clean]) > 0.97


def test_labels_of_the_held_out_fold_are_not_read(spark, learnt):
    rows, docs, labels = learnt
    other = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, _, t in rows] + [(None, 1), (0, None), (5, 0)], "doc_id bigint, toxic int")
    score = lambda x: sorted((r.doc_id or -1, round(r.score, 9)) for r in tx.toxicity(docs, x).collect())
    assert score(labels) == score(other)


def test_label_model_is_plain_expectation_maximisation(spark):
    rnd = np.random.default_rng(4)
    ballots = [(int(rnd.integers(0, 1 << 12)) | (int(k % 3 == 0) * 7 << 20), *map(int, rnd.integers(0, 5, 3))) for k in range(90)]
    ballots += [((1 << 61) | 1, 0, 3, 9), (0, 40, 0, 200)]
    lexicon = tx.Lexicon(np.zeros(0, np.uint64), np.zeros((0, 3)), np.zeros(0), np.zeros(0), sum(b[2] for b in ballots), sum(b[1] + b[2] for b in ballots))
    model = tx.label_model(spark.createDataFrame(ballots, "ballot bigint, n_clean bigint, n_toxic bigint, n bigint").repartition(3), lexicon, rounds=4)

    m = tx.N_VOTERS
    vote = [[b >> v & 1 for v in range(m)] for b, *_ in ballots]
    share = min(1.0, lexicon.n_labelled / sum(b[3] for b in ballots))
    post = [0.0] * len(ballots)
    for i in range(5):
        weigh = [[b[1] + (share * b[3] * (1 - p) if i else 0), b[2] + (share * b[3] * p if i else 0)] for b, p in zip(ballots, post)]
        n = [sum(w[c] for w in weigh) for c in (0, 1)]
        share_of = [[sum(w[c] * x[v] for w, x in zip(weigh, vote)) / n[c] for v in range(m)] for c in (0, 1)]
        corr = [[0.0] * m for _ in range(m)]
        for a in range(m):
            for b in range(m):
                both = []
                for c in (0, 1):
                    cov = sum(w[c] * x[a] * x[b] for w, x in zip(weigh, vote)) / n[c] - share_of[c][a] * share_of[c][b]
                    sd = [math.sqrt(max(share_of[c][v] * (1 - share_of[c][v]), 1e-9)) for v in (a, b)]
                    both.append(1.0 if a == b else max(-1.0, min(1.0, cov / sd[0] / sd[1])))
                corr[a][b] = max(both)
        say = [1 / sum(x for x in corr[a] if x >= tx.MIN_CORRELATION) for a in range(m)]
        votes = [[(share_of[c][v] * n[c] + 0.5) / (n[c] + 1) for v in range(m)] for c in (0, 1)]
        base = min(max((n[1] + 1) / (sum(n) + 2), 1e-6), 0.5)
        odds = [
            math.log(base / (1 - base))
            + sum(say[v] * (math.log(votes[1][v] / votes[0][v]) if x[v] else math.log((1 - votes[1][v]) / (1 - votes[0][v]))) for v in range(m))
            for x in vote
        ]
        post = [1 / (1 + math.exp(-o)) for o in odds]
    assert np.allclose(model.votes, votes) and np.allclose(model.weight, say) and abs(model.base - base) < 1e-9
    assert np.allclose(model.posterior(np.array(vote, dtype=float)), post)


def test_significance_is_the_step_rule():
    counts = {30: 4, 12: 6, 8: 10, 3: 100, 0: 5000}
    tested = sum(counts.values())
    plain = [g for g in range(1, 31) if all(tested * math.erfc(math.sqrt(h / 2)) <= 0.05 * max(1, sum(n for k, n in counts.items() if k >= h)) for h in counts if h >= g)]
    assert tx.significance(counts, tested) == min(k for k in counts if k >= min(plain))
    assert tx.significance({0: 10}, 10) is None


@pytest.mark.parametrize("times", [1, 10])
def test_words_of_one_class_go_on_voting(spark, times):
    """More labels make no word of the toxic class lose its vote to words that are more frequent in it only."""
    said = {0: "scumbag abcdefgh", 1: "fool ijklmnop"}
    rows = [(i, f"plain{i % 3 if i % 6 < 2 else i % 2} {said.get(i % 6, 'words')}", i % 6 < 2) for i in range(300 * times)]
    lexicon = tx.lexicon_of(spark.createDataFrame(rows, "doc_id bigint, text string, toxic boolean"))
    strong = {int(b) for b in lexicon.bank if b >= 0 and b % len(tx.BANDS) == 0 and b < tx.N_BANKS - 1}
    # of words in the same texts one votes
    for words in said.values():
        there = [lexicon.place[np.searchsorted(lexicon.hashes, np.uint64(h)), 0] for h in string_hash(words) if np.uint64(h) in lexicon.hashes]
        assert any(p >= 0 and int(lexicon.bank[p]) in strong for p in there)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(2, 0)], "doc_id bigint, toxic int")
    assert {r.score for r in tx.toxicity(docs, labels).collect()} == {0.0}
    assert {r.score for r in tx.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert tx.toxicity(docs.limit(0), labels).count() == 0


def test_query_with_clashing_columns(spark, learnt, tmp_path):
    rows, docs, labels = learnt
    clash = docs.selectExpr("doc_id", "text", "1 AS toxic", "2 AS hits", "3 AS ballot", "4 AS k_id", "5 AS score", "6 AS row")
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr("doc_id", "toxic", "'x' AS text", "1 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.op10_weak_supervision(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) + 3 and all(r.predicted == int(r.score >= 0.7) for r in got)
