"""The pipeline against its own stages' brute-force versions on one small corpus."""

import os
import random
import re

import corpus_pipeline
from cellweave.llm.shared import checkpoint_dir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_stages(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    item, copied = text(30), text(120).split()
    near = [*copied]
    near[7] = "changed"
    rows = [(i, f"{text(70)}\nshared footer\n{text(20)}") for i in range(12)]
    rows += [(20, "too short"), (21, " ".join(copied)), (22, " ".join(near)), (23, " ".join(copied)), (24, f"{text(60)} {item} {text(9)}"), (25, None)]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 20 and 25 are too short, 22 and 23 are near 21, 24 has the benchmark item; the footer goes from the twelve
    assert {r.doc_id: r.n_tokens for r in got} == {**{i: 91 for i in range(12)}, 21: 121}


def test_many_copies(spark, tmp_path):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choices([f"w{i}" for i in range(4000)], k=n))
    copied = [text(60), text(40)]
    texts = ["\n".join(copied)] * 12 + [f"{copied[0].upper()} \n\n{copied[1]}"] * 12 + [f"{text(70)}\nshared footer" for _ in range(11)]
    docs = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # one of the copies stays with its whole text; the footer goes from the eleven
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(0, 101), *((i, 71) for i in range(24, 35))]


def brute(docs, items):
    """All stages in plain Python on ``(doc_id, text)`` with distinct ids; labels too few to prove a cutoff. Gives pieces by id."""
    from cellweave.llm.packing import MAX_LEN

    from .test_minhash import brute as classes_of
    from .test_query_results import plain_measures

    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(i, t) for i, t in docs if not plain_measures(t)[0][-1]]

    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    keys = {i: tuple(filter(None, map(key, (t or "").split("\n")))) for i, t in docs}
    ids, copies = {}, {}
    for i, _ in docs:
        for k in keys[i]:
            ids.setdefault(k, set()).add(i)
            copies.setdefault(k, set()).add(keys[i])
    shared = {k for k in ids if len(ids[k]) >= 10 and len(copies[k]) >= 10}
    docs = [(i, "\n".join(x for x in t.split("\n") if key(x) not in shared) if t is not None else None) for i, t in docs]

    classes = classes_of(docs)
    docs = [(i, t) for i, t in docs if classes[i] == i or not WORD.findall(low(t))]

    windows = {tuple(w[j : j + 10]) for t in items for w in [WORD.findall(low(t))] for j in range(max(1, len(w) - 9)) if w}
    inside = lambda w: any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for j in range(len(w) - n + 1))
    docs = [(i, t) for i, t in docs if not inside(WORD.findall(low(t)))]
    out = {}
    for i, t in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
        out[i] = [min(MAX_LEN, n - k) for k in range(0, n, MAX_LEN)]
    return out


def test_whole_pipeline_by_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    words = [f"W{i}" for i in range(900)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    items = [text(30), text(4), None, " "]
    passage, footer, texts = text(60), "Shared Footer, of many", [None, "", "short", " \n "]
    for i in range(140):
        lines = [text(rnd.randrange(20, 60)) for _ in range(rnd.randrange(1, 4))]
        if i % 3 == 0:
            lines.append(passage if i % 2 else passage.upper() + " ")
        if i % 4 == 0:
            lines.insert(0, footer)
        if i % 17 == 0:
            lines.append(f"{text(3)} {items[i % 2]} {text(3)}")
        if i % 23 == 0:
            lines += [lines[-1]] * 3
        texts.append("\n".join(lines))
        if i % 9 == 0:
            w = texts[-1].split(" ")
            for _ in range(rnd.choice([0, 1, 2, 6])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts += [" ".join(w)] * rnd.choice([1, 3])
    texts += ["\n".join([text(80), passage])] * 14 + [text(5000)]
    rnd.shuffle(texts)
    docs = list(enumerate(texts))
    clash = ["rows", "size", "id", "key", "b_id", "b_key", "n_words", "steps", "stratum", "row", "kept", "node", "w_id", "nth", "bucket"]
    d = spark.createDataFrame([(i, t, rnd.choice(["en", None]), "src", 1) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d.selectExpr("*", *(f"{i} AS {c}" for i, c in enumerate(clash)), "map('a', 1) AS m").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got, places, shared = {}, set(), checkpoint_dir(spark).removeprefix("file:")
    before = {*os.listdir(shared)}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
        places.add((r.bucket, r.batch, r.slot))
    # of all that was kept on the way, the last stage's table is left
    (left,) = {*os.listdir(shared)} - before
    assert os.listdir(f"{shared}/{left}") == ["pack"]
    want = brute(docs, items)
    assert {i: [n for _, n in sorted(p)] for i, p in got.items()} == want
    assert len(places) == sum(map(len, want.values())) and 40 < len(want) < 140


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("benchmark", "item_id bigint, text string"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    from cellweave.llm import entry

    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in entry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
