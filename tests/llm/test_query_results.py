"""Every query function on a written folder, column by column against plain Python, with clashing extra columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import pytest

from cellweave.llm import entry, packing, quality, urls
from cellweave.llm.minhash import keep_one_of_each_class

from .test_operators import GAP, TEXTS, WORD, low

CLASH = ["rows", "size", "id", "key", "b_id", "b_key", "host", "n_words", "base", "matches", "stratum", "steps", "node", "n", "row", "path", "bands", "runs"]
ITEMS = [(1, TEXTS[6]), (2, "Apache license"), (3, None), (4, " "), (5, "apache LICENSE"), (6, "wort3"), (10, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    prose = lambda n: " ".join(rnd.choice(["plain", "text", "Word", "of", "all", "MIT", "license", "gnu", "general", "public", "Apache", "x1", "#", "a|b"]) for _ in range(n))
    secret = lambda: rnd.choice(['api_key: "Zz9' + "q" * 12 + '"', "apikey=short", "AKIA" + "Q7" * 9, "AKIAxx", "deadbeef" * 3, "PASSWORD='abcdefghijklmnop' tail", "é token = A.b-c_d/e+f=12345"])
    texts = [*TEXTS, "same text twice"]
    for i in range(120):
        lines = [prose(rnd.randrange(1, 60)) for _ in range(rnd.randrange(1, 6))]
        if i % 3 == 0:
            lines.insert(0, lines[0])
        if i % 4 == 0:
            lines.append(" ".join(f"w{j}" for j in range(rnd.randrange(8), 16)))
        if i % 2:
            lines.append(" ".join(secret() for _ in range(3)))
        texts.append("\n".join(lines))
    docs = [(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(16, "same text twice")]
    path = tmp_path_factory.mktemp("tables")
    d = spark.createDataFrame([(*r, "en", "s", 1) for r in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d.selectExpr("*", *(f"{i} AS {c}" for i, c in enumerate(CLASH)), "map('a', 1) AS m").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 AS item", "2 AS doc_id").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 100, 2)], "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' AS text").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def result(spark, folder, name):
    got = entry.QUERIES[name](spark, folder[0]).collect()
    key = lambda r: json.dumps([r[0], [str(x) for x in r[1:]]])
    return sorted((tuple(r.asDict().values()) for r in got), key=key), got


def same(spark, folder, name, columns, want):
    _, got = result(spark, folder, name)
    order = lambda rows: sorted(rows, key=repr)
    assert order([tuple(r[c] for c in columns) for r in got]) == order(want)
    return got


def test_op1_and_the_stage(spark, folder):
    path, docs = folder
    from .test_minhash import brute

    named = [(i if r[0] is not None else 5, r[1]) for i, r in enumerate(docs)]
    _, got = result(spark, folder, "op1_bag_minhash")
    assert len(got) == len(docs)
    classes = {}
    for k, v in brute(named).items():
        classes.setdefault(v, set()).add(docs[k][0])
    want = sorted(map(lambda s: sorted(s, key=repr), classes.values()), key=repr)
    mine = {}
    for r in got:
        mine.setdefault((r.class_id, r.class_size), set()).add(r.doc_id)
    merged = [s for s in map(lambda s: sorted(s, key=repr), mine.values())]
    # both rows of id 16 are in one class; the null id is a class of its own
    assert sorted(map(repr, merged)) == sorted({repr(sorted(set(s), key=repr)) for s in want})
    table = spark.read.parquet(f"{path}/documents.parquet")
    kept = keep_one_of_each_class(table)
    wordless = sum(not WORD.findall(low(t)) for _, t in docs)
    assert kept.columns == table.columns and kept.count() == len({r.class_id for r in got if WORD.findall(low(dict(docs).get(r.doc_id, "x")))}) + wordless


def test_op3(spark, folder):
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for i, t in folder[1]:
        w = WORD.findall(low(t))
        at = [(j, label) for p, label in base.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = same(spark, folder, "op3_rare_word_index", ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], want)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_op3_labels_and_scores(spark, tmp_path):
    """The method's own part by plain Python, on notices that are whole, damaged, repeated and run together."""
    import math

    from cellweave.llm import licenses

    rnd = random.Random(6)
    texts = [None, ""]
    for i in range(160):
        words = []
        for _ in range(rnd.randrange(4)):
            notice = rnd.choice(licenses.TEMPLATES).text.split()
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                notice[rnd.randrange(len(notice))] = rnd.choice(["the", "license", "x", "version", "5"])
            words += [*rnd.choices(["of", "this", "text", "GNU", "mozilla"], k=rnd.randrange(9)), *notice]
        texts.append(" ".join(words).upper() if i % 5 == 0 else ", ".join(words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    split = [WORD.findall(low(t)) for t in texts]
    df = Counter(w for t in split for w in set(t))
    idf = lambda w: math.log1p(len(texts) / (1 + df[w]))
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    some = 0
    for r in entry.QUERIES["op3_rare_word_index"](spark, str(tmp_path)).collect():
        w, labels, score = split[r.doc_id], set(), 0.0
        for t in licenses.TEMPLATES:
            own = t.text.split()
            rare = sorted(set(own), key=lambda x: (-idf(x), x))[: licenses.ANCHORS]
            anchors = [(x, i) for i, x in enumerate(own) if x in rare]
            total, need = sum(idf(x) for x, _ in anchors), t.phrase.split()
            at = t.text.split(t.phrase)[0].count(" ")
            for d in range(-len(own), len(w)):
                got = sum(idf(x) for x, i in anchors if 0 <= d + i < len(w) and w[d + i] == x)
                if got >= licenses.THRESHOLD * total - 1e-12 and d + at >= 0 and w[d + at : d + at + len(need)] == need:
                    labels.add(t.label)
                    score = max(score, min(got / total, 1.0))
        some += bool(labels)
        labels |= {label for p, label in base.items() if any(w[j : j + len(p.split())] == p.split() for j in range(len(w)))}
        assert r.labels == ",".join(sorted(labels)) and abs(r.score - score) < 1e-9, r.doc_id
    assert some > 40


def test_op4(spark, folder):
    _, got = result(spark, folder, "op4_length_buckets")
    pieces = []
    for i, t in folder[1]:
        n = len(GAP.findall(t or "")) + 1
        pieces += [(i, k, k * packing.MAX_LEN, min(packing.MAX_LEN, n - k * packing.MAX_LEN)) for k in range(-(-n // packing.MAX_LEN))]
    assert sorted(((r.doc_id, r.piece, r.first_token, r.n_tokens) for r in got), key=repr) == sorted(pieces, key=repr)
    bounds = packing.bucket_bounds(Counter(p[3] for p in pieces), packing.BUCKETS)
    for r in got:
        assert r.padded_len == min(b for b in bounds if b >= r.n_tokens) and bounds[r.bucket] == r.padded_len
    # slots are filled without a gap, batch by batch
    for b, bound in enumerate(bounds):
        nth = sorted(r.batch * (packing.BUDGET // bound) + r.slot for r in got if r.bucket == b)
        assert nth == list(range(len(nth)))


def plain_secrets(text):
    """By single characters, without the operator's patterns."""
    value, found, t = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), [], text or ""
    i = 0
    while i < len(t):
        # the pattern tries its names in this order; a value of any length ends a match
        end = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low(t[i : i + len(name)]) == name:
                j = i + len(name)
                j += t[j : j + 1] in ('"', "'") and t[j : j + 1] != ""
                while t[j : j + 1] == " ":
                    j += 1
                if t[j : j + 1] not in (":", "="):
                    continue
                j += 1
                k = j
                while t[k : k + 1] == " ":
                    k += 1
                k += t[k : k + 1] in ('"', "'") and t[k : k + 1] != ""
                e = k
                while e < len(t) and t[e] in value:
                    e += 1
                if e > k:
                    end = e
                    if e - k >= 12:
                        found.append(("assign", i, e))
                    break
        i = end or i + 1
    for kind, head, chars, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), ("hex", "", "0123456789abcdef", 16)):
        i = 0
        while i < len(t):
            j = i + len(head)
            if t[i:j] == head:
                e = j
                while e < len(t) and t[e] in chars:
                    e += 1
                if e > j:
                    if e - i >= least:
                        found.append((kind, i, e))
                    i = e
                    continue
            i += 1
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_op5(spark, folder):
    want = []
    for i, t in folder[1]:
        s = plain_secrets(t)
        n = Counter(k for k, *_ in s)
        want.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{e}" for k, a, e in s))))
    got = same(spark, folder, "op5_credential_links", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], want)
    assert sum(r.n_assign for r in got) > 20 and sum(r.n_access for r in got) > 10 and sum(r.n_hex for r in got) > 10
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert sum(k in ("assign", "access", "hex") for k, *_ in spans) == r.n_assign + r.n_access + r.n_hex
        assert [int(s) for _, s, _ in spans] == sorted(int(s) for _, s, _ in spans)


def test_op5_links_by_all_pairs(spark, tmp_path):
    """Weak parts are reported just where some pair of parts within the scope says so."""
    from cellweave.llm import secrets

    rnd = random.Random(8)
    bits = ["user=ann", "login: bob", "pwd=abc1", "token: xy12", "Ab3" * 8, "db.example.com:5432", "https://h.org/x", "10.0.0.1", "AKIA" + "Q7" * 9, "deadbeef" * 3, "secret='abcdefghijklmnop'"]
    texts = [None, ""]
    for _ in range(200):
        texts.append(" ".join(rnd.choice(bits) + " " + "fill " * rnd.choice([0, 1, 5, 38, 39, 40, 80]) for _ in range(rnd.randrange(7))))
    texts.append("user=ann " + "word " * 30000 + "token: xy12 login: bob")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    some = 0
    for r in entry.QUERIES["op5_credential_links"](spark, str(tmp_path)).collect():
        strong = plain_secrets(texts[r.doc_id])
        parts = [(k, "identifier" if k == "access" else "secret", True, True, a, e) for k, a, e in strong]
        parts += [(k, c, named, False, a, e) for k, c, named, a, e in secrets.weak_parts(texts[r.doc_id] or "", strong)]
        near = lambda p, q: q[4] - p[5] <= secrets.SCOPE and p[4] - q[5] <= secrets.SCOPE
        weak = {p[0::4] + p[5:] for p in parts if not p[3] and any(q[1] != p[1] and (p[2] or q[2]) and near(p, q) for q in parts)}
        got = {(k, int(a), int(e)) for k, a, e in (x.split(":") for x in r.spans.split(",") if x)}
        assert got == weak | {tuple(x) for x in strong}, r.doc_id
        some += len(weak)
    assert some > 100


def test_op6(spark, folder):
    win = {}
    for i, t in ITEMS:
        w = WORD.findall(low(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            win.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    want = []
    for i, t in folder[1]:
        w, hit, ids = WORD.findall(low(t)), set(), set()
        for n in {len(k) for k in win}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in win:
                    hit.update(range(j, j + n))
                    ids |= win[tuple(w[j : j + n])]
        want.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    same(spark, folder, "op6_positional_index", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], want)


def test_op7(spark, folder):
    import math

    tokens = [(i, [*GAP.findall(low(t)), None]) for i, t in folder[1]]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(x for i, t in tokens if not held(i) for x in t)
    n = sum(c.values())
    want = {}
    for i, t in tokens:
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in t)
        want.setdefault(i, []).append((held(i), len(t), sum(c[x] > 0 for x in t), n, base))
    _, got = result(spark, folder, "op7_kneser_ney")
    assert len(got) == len(tokens)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9) for w in want[r.doc_id])
        assert r.score < 0 or r.n_tokens == 0


def plain_measures(t):
    t = t or ""
    w, lines = GAP.findall(t), [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    seen = Counter(zip(w, w[1:], w[2:]))
    rep = {j + k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in range(3)}
    chars, dup = sum(map(len, w)), len(lines) - len(set(lines))
    shares = [(len(re.findall(r"[#*$%&|<>]", t)), len(w)), (len(re.findall("[A-Z]", t)), chars), (t.count("!"), len(w)), (dup, len(lines)), (len(rep), len(w)), (chars, len(w))]
    widths = [width for _, width in quality.MEASURES.values()]
    steps = [min(int(a / b / width), quality.STEPS) if b else 0 for (a, b), width in zip(shares, widths)]
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return (len(w), chars, shares[0][0], dup, len(rep), failed), steps


def test_op9(spark, folder):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = same(spark, folder, "op9_risk_controlled", columns, [(i, *plain_measures(t)[0]) for i, t in folder[1]])
    # fifty labels prove nothing
    assert all(r.kept != r.base_failed for r in got)
    table = spark.read.parquet(f"{folder[0]}/documents.parquet")
    kept = quality.keep_good(table, spark.read.parquet(f"{folder[0]}/labels.parquet"))
    assert kept.columns == table.columns and kept.count() == sum(not r.base_failed for r in got)


def test_binomial_bound(spark):
    from math import comb

    for x, n, p in ((0, 10, 0.1), (1, 40, 0.05), (3, 500, 0.02), (17, 900, 0.03), (30, 900, 0.03)):
        exact = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)) if x <= n * p else 1.0
        got = spark.sql(f"SELECT {quality.binomial_cdf(f'{x}L', f'{n}D', f'{p!r}D')}").first()[0]
        assert abs(got - exact) < 1e-9, (x, n, p)


def test_cutoffs_by_plain_rules(spark):
    """Ranking on one half and the sequence of tests on the other, by plain Python over the same halves."""
    from math import comb

    from pyspark.sql import functions as F

    rnd = random.Random(2)
    rows = []
    for i in range(5000):
        bad = rnd.random() < 0.2
        steps = [min(64, int(rnd.expovariate(1 / (9 if bad and m < 3 else 1.5)))) for m in range(6)]
        rows.append((i, rnd.choice(["en", "en", None, "xx"]) if i > 40 else "few", steps, i % 50 == 0, int(not bad)))
    m = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, stratum string, steps array<int>, base_failed boolean")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id bigint, quality int")
    half = {r.doc_id: r.h for r in labels.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(2)) == 1).alias("h")).collect()}
    risk, delta, cost = 0.03, 0.05, 2
    used = [r for r in rows if not r[3]]
    good_of = Counter(r[1] for r in used if half[r[0]] and r[4])
    want = {}
    for s in good_of:
        tune, hold = ([r for r in used if r[1] == s and half[r[0]] == h] for h in (False, True))
        pairs = []
        for k in range(6):
            for c in {r[2][k] for r in tune if r[2][k] > 0}:
                over = [r[4] for r in tune if r[2][k] >= c]
                x, hit = sum(over), len(over) - sum(over)
                if hit > cost * x:
                    pairs.append(((x + 1) / (x + hit + 2), -hit, k, -c))
        least, n = [None] * 6, good_of[s]
        for *_, k, c in sorted(pairs):
            trial = list(least)
            trial[k] = -c if trial[k] is None else min(trial[k], -c)
            x = sum(bool(r[4]) and any(t is not None and v >= t for v, t in zip(r[2], trial)) for r in hold)
            if x > n * risk or sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(x + 1)) > delta / len(good_of):
                break
            least = trial
        if any(x is not None for x in least):
            want[s] = least
    got = {r.stratum: list(r.least) for r in quality.cutoffs(m, labels, risk, delta, cost).collect()}
    assert got == want and len(want) > 1


def test_op8_with_a_long_list(spark):
    """A hundred thousand entries, of which URLs hit some by host, subdomain and path, against a plain lookup."""
    rnd = random.Random(1)
    listed = {(f"h{i % 40000}.example{i % 7}.org", "/" + "p" * (i % 90) + ("/" if i % 2 else "")): ("block" if i % 3 else "allow") for i in range(100_000)}
    rows = [(h, p, v, 0) for (h, p), v in listed.items()]
    urls_ = [None, "x", "", "http:///nohost", "a://" + "b" * 3000 + "/x"]
    keys = list(listed)
    for _ in range(400):
        h, p = rnd.choice(keys)
        urls_.append(f"https://{rnd.choice(['', 'www.', 'a.b.'])}{h if rnd.random() < 0.8 else 'z' + h}{p[: rnd.choice([1, 99])]}{rnd.choice(['', 'q', '?x=1'])}")
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id int, url string").selectExpr("*", "'own' AS host", "'mine' AS row", "1 AS entry")
    got = urls.judged(pages, spark.createDataFrame(rows, "host string, path string, verdict string, rank int"))
    assert got.columns == ["page_id", "url", "row", *urls.ADDED]
    got = {r.page_id: r for r in got.collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        parts = host.split(".")
        fits = [(len(h + path[:n]), len(h), listed[h, path[:n]] == "block", h + path[:n]) for k in range(len(parts)) for h in [".".join(parts[k:])] for n in range(len(path) + 1) if (h, path[:n]) in listed]
        best = max(fits, default=None)
        assert (got[i].host, got[i].path, got[i].entry) == (host, path, best[3] if best else None) and got[i].row == "mine"
