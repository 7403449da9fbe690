"""The merge store, the segmented scan, the rank index and the manifest of ingestion."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions.cells import PRIORITY
from cellweave.operators import exchange, grid, layering, writes
from cellweave.operators.ranked import RankIndex
from cellweave.sources.ledger import Ledger
from cellweave.sources.merged import Conflict, MergeStore, meeting
from cellweave.sources.rules import Rule, Rules
from cellweave.sources.store import SCHEMA
from cellweave.storage import scratch, stored
from cellweave.streaming import ingest as ingestion
from cellweave.streaming.ingest import ingest
from cellweave.streaming.manifest import Manifest

EVENTS = "seq long, tx string, table_name string, row_id string, col string, source string, value string, updated_by string"


# ---- merge store


def rows(spark, ids, value, table="t"):
    return spark.createDataFrame([(table, i, f"k{i}", {"v": value}, None, None) for i in ids], SCHEMA)


def state(df):
    return {(r.table_name, r.row_id): r.data["v"] for r in df.collect()}


def test_a_batch_touches_its_own_range_only(spark, tmp_path):
    s = MergeStore(spark, str(tmp_path / "m"), files=8)
    ids = [f"r{i:04}" for i in range(400)]
    assert s.read().count() == 0 and s.versions() == []
    assert s.applied(rows(spark, ids, "a")) == 1
    base = s.catalogue()
    assert len(base) == 8 and all(f.kind == "base" for f in base) and sum(f.n_rows for f in base) == 400
    assert all(a.hi < b.lo for a, b in zip(sorted(base, key=lambda f: f.lo), sorted(base, key=lambda f: f.lo)[1:]))
    few = MergeStore(spark, str(tmp_path / "m"), files=1)
    assert few.applied(rows(spark, ["r0003", "r0005", "r0003x"], "b"), rows(spark, ["r0007", "gone"], "")) == 2
    want = {("t", i): "a" for i in ids} | {("t", i): "b" for i in ("r0003", "r0005", "r0003x")}
    del want[("t", "r0007")]
    assert state(s.read()) == want
    assert {f.path for f in base} <= {f.path for f in s.catalogue()}
    assert few.compacted() == 3 and state(s.read()) == want
    after = s.catalogue()
    touched = meeting(base, [(("t", "gone"), ("t", "r0007"))])
    assert len(touched) == 1
    assert {f.path for f in base} - touched == {f.path for f in base} & {f.path for f in after}
    assert all(f.kind == "base" for f in after) and few.compacted() == 3
    assert state(s.read(version=1)) == {("t", i): "a" for i in ids}
    assert s.found("t", "r0005").first().data["v"] == "b" and s.found("t", "r0007").count() == 0 and s.found("t", "r0007", 1).count() == 1


def test_versions_differ_by_events(spark, tmp_path):
    s = MergeStore(spark, str(tmp_path / "m"), files=4)
    rnd, want, kept = random.Random(2), {}, {}
    for v in range(1, 7):
        put = {f"r{rnd.randrange(60):02}": rnd.choice("abc") for _ in range(25)}
        gone = {f"r{rnd.randrange(60):02}" for _ in range(6)}
        up = [("t" if i < "r30" else "u", i, None, {"v": x, "w": "1"}, None, None) for i, x in put.items()]
        keys = [("t" if i < "r30" else "u", i) for i in gone]
        s.applied(spark.createDataFrame(up, SCHEMA), spark.createDataFrame(keys, "table_name string, row_id string"))
        want = {k: x for k, x in want.items() if k[1] not in gone or k[1] in put} | {("t" if i < "r30" else "u", i): x for i, x in put.items()}
        kept[v] = dict(want)
        if v == 4:
            s.compacted()
    assert s.versions() == list(range(1, 8)) and state(s.read()) == kept[6]
    kept = {1: kept[1], 2: kept[2], 3: kept[3], 4: kept[4], 5: kept[4], 6: kept[5], 7: kept[6]}
    for a, b in ((1, 2), (2, 6), (4, 5), (3, 7), (7, 1), (3, 3)):
        got = {(r.table_name, r.row_id): (r.event, r.before and r.before.data["v"], r.after and r.after.data["v"]) for r in s.changes_between(a, b).collect()}
        old, new = kept[a], kept[b]
        assert got == {k: ("create" if k not in old else "delete" if k not in new else "update", old.get(k), new.get(k)) for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    assert state(s.read("u")) == {k: v for k, v in want.items() if k[0] == "u"}


def test_repeats_conflicts_and_odd_rows(spark, tmp_path):
    s = MergeStore(spark, str(tmp_path / "m"))
    assert s.applied(rows(spark, ["a"], "1"), stream=("in", 0)) == 1
    assert s.applied(rows(spark, ["a"], "2"), stream=("in", 0)) == 1 and state(s.read()) == {("t", "a"): "1"}
    assert s.applied(rows(spark, ["a"], "2"), stream=("in", 1)) == 2
    with pytest.raises(Conflict):
        s._commit(1, [], None)
    twice = spark.createDataFrame([("t", "b", None, {"v": x}, None, None) for x in "xy"], SCHEMA).withColumn("updated_at", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, CASE data['v'] WHEN 'x' THEN 2 ELSE 1 END)"))
    s.applied(twice)
    assert state(s.read()) == {("t", "a"): "2", ("t", "b"): "x"}
    with pytest.raises(Exception, match="without row_id"):
        s.applied(spark.createDataFrame([("t", None, None, None, None, None)], SCHEMA))
    s.applied(rows(spark, [], "z"))
    s.applied(deletes=rows(spark, ["a", "b"], "").select("table_name", "row_id"))
    assert s.read().count() == 0 and s.compacted() and s.read().count() == 0


# ---- segmented scan


def replayed(events, pins):
    """What every event does, one after the other."""
    cells, out = {}, {}
    rank = lambda s, cell: (s != pins.get(cell), PRIORITY.get(s, 99), len(s), s)
    for seq, _, table, row, col, source, value, _ in sorted(events):
        cell = cells.setdefault((table, row, col), {})
        effective = lambda c=cell, k=(table, row, col): c[min(c, key=lambda s: rank(s, k))] if c else None
        is_new, old = not cell, effective()
        cell[source] = value
        new = effective()
        out[seq] = (old, new, is_new, is_new or (old or "None") != (new or "None"))
    return out


@pytest.mark.parametrize(("n_cells", "partitions"), [(1, 7), (3, 5), (40, 6)])
def test_segments_compose(spark, n_cells, partitions):
    rnd = random.Random(n_cells)
    sources = [*PRIORITY, "zz", "aa", "longer", "b"]
    # sources come late, so that segments differ in what they know
    made = [(i, "x", "t", f"r{rnd.randrange(n_cells)}", "c", rnd.choice(sources[max(0, 7 - i // 40) :]), rnd.choice(["1", "2", "3", None]), "u") for i in range(400)]
    pins = {("t", "r0", "c"): "longer"}
    e = spark.createDataFrame(made, EVENTS)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for given in ({}, pins):
            p = spark.createDataFrame([(*k, 0, v) for k, v in given.items()], "table_name string, row_id string, col string, seq long, source string") if given else None
            with scratch(spark):
                got = {r.seq: (r.old_value, r.new_value, r.is_new, r.changed) for r in layering.changes(e, p).collect()}
            assert got == replayed(made, given)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_cell_of_all_events_is_dealt_evenly(spark):
    e = spark.range(40_000).selectExpr("id AS seq", "'x' AS tx", "'t' AS table_name", "'r' AS row_id", "'c' AS col", "'user' AS source", "string(id % 3) AS value", "'u' AS updated_by")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with scratch(spark):
            done = layering.changes(e)
            sizes = [r[0] for r in e.repartitionByRange(*layering.CELL, "seq").groupBy(F.spark_partition_id()).count().select("count").collect()]
            assert done.where("changed").count() == 40_000 and done.where("is_new").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_scratch_goes(spark, tmp_path):
    import os

    with scratch(spark) as path:
        assert stored(spark.range(5)).count() == 5
        local = path.removeprefix("file:")
        assert os.listdir(local)
    assert not os.path.exists(local)


# ---- rank index


@pytest.mark.parametrize("order", [grid.Order(), grid.Order("id"), grid.Order("id", True), grid.Order("updated_at", True)])
def test_pages_by_rank(spark, tmp_path, order):
    g = spark.range(300).selectExpr("concat('r', lpad(id * 7 % 300, 3, '0')) AS row_id", "CASE WHEN id % 5 > 0 THEN string(id % 11) END AS business_key", "timestamp_seconds(id % 13) AS updated_at", "id AS v")
    index = RankIndex.made(g, order, str(tmp_path / "i"), files=6)
    whole = [r.row_id for r in g.orderBy(*order.columns()).collect()]
    for skip, limit in ((0, 10), (95, 30), (290, 50), (300, 10), (149, 2), (0, 0)):
        got = index.page(skip, limit).orderBy("position").collect()
        assert [(r.row_id, r.position) for r in got] == list(zip(whole[skip : skip + limit], range(skip, skip + limit)))
        assert got == [] or set(got[0].asDict()) == {"row_id", "business_key", "updated_at", "v", "position"}
    assert len(index.files()) > 2 and len(index.files_of(150, 5)) <= 2 and index.files_of(300, 5) == []
    for x in ("r000", "r123", "r299"):
        assert index.position(x) == whole.index(x)
        at = max(0, whole.index(x) - 5)
        assert [r.row_id for r in index.page_around(x, 10).orderBy("position").collect()] == whole[at : at + 10]
    assert index.position("absent") is None and index.page_around("absent").count() == 0


# ---- texts that are long, and names of new rows


def test_long_fields(spark):
    long = 'say ""hi"", ' * 100_000
    text = f'a,"{long}",{"x" * 200_000}\n"two\nlines",b\n"never closed,c\nd'
    got = spark.createDataFrame([(text,)], "t string").select(exchange.csv_records(F.col("t")).alias("r")).first().r
    assert got == [f'a,"{long}",{"x" * 200_000}', '"two\nlines",b', '"never closed,c', "d"]
    fields = spark.createDataFrame([(got[0],)], "t string").select(exchange.csv_fields(F.col("t")).alias("f")).first().f
    assert fields == ["a", long.replace('""', '"'), "x" * 200_000]
    cells = exchange.matrix_of(spark.createDataFrame([(1, f'"{"y" * 1_000_000}",1')], "id int, text string")).collect()
    assert sorted((c.x, len(c.z), c.number) for c in cells) == [(0, 1_000_000, None), (1, 1, 1.0)]


def test_keys_and_numbers_name_different_rows(spark):
    none = spark.createDataFrame([], "table_name string, row_id string, business_key string, created_at timestamp, updated_at timestamp")
    up = [(5, "t", None, None, {"a": "1"}), (6, "t", None, "5", {"a": "2"}), (7, "t/a", None, "b", {"a": "3"}), (8, "t", None, "a/b", {"a": "4"})]
    u = spark.createDataFrame([(*r, "user", "ann") for r in up], "seq long, table_name string, row_id string, business_key string, cells map<string,string>, source string, updated_by string")
    with scratch(spark):
        done = writes.applied(none, spark.createDataFrame([], EVENTS), u, "tx", F.lit("2024-01-01").cast("timestamp"))
        assert done.rows.select("row_id").distinct().count() == 4 and done.changed.count() == 4


# ---- ingestion


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["texts", "write", "after the write", "quarantine", "move", "after the moves", None])
def test_a_batch_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, step):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.log").write_text(f"k={i}a\nk={i}b\n")
    (tmp_path / "in" / "bad.log").write_bytes(b"k=z \xff")
    store, bad, left = MergeStore(spark, str(tmp_path / "store")), [], {"n": 1}

    def fails(at):
        if step == at and left["n"]:
            left["n"] -= 1
            raise Broken(at)

    def write(rows, batch):
        fails("write")
        named = rows.selectExpr("'t' AS table_name", "concat(business_key, '/', uuid()) AS row_id", "business_key", "map('v', business_key) AS data", "CAST(NULL AS timestamp) AS created_at", "CAST(NULL AS timestamp) AS updated_at")
        store.applied(named, stream=("in", batch))

    def quarantine(rows, batch):
        fails("quarantine")
        bad.append((batch, sorted(r.file.rsplit("/", 1)[-1] for r in rows.collect())))

    mark, archive, moves = Manifest.mark, ingestion.archive, []

    def marked(self, batch, name):
        if name == {"after the write": "written", "after the moves": "moved", "texts": "texts"}.get(step):
            fails(step)
        mark(self, batch, name)

    def archived(*a):
        moves.append(a[1])
        if len(moves) == 2:
            fails("move")
        return archive(*a)

    monkeypatch.setattr(Manifest, "mark", marked)
    monkeypatch.setattr(ingestion, "archive", archived)
    monkeypatch.setattr(ingestion, "attempted", lambda do: do())
    run = lambda: ingest(spark, str(tmp_path / "in"), Rules([Rule("k", r"k=(\w+)")]), "k", str(tmp_path / "ck"), write, archives=str(tmp_path / "done"), quarantine=quarantine).awaitTermination(120)
    if step:
        with pytest.raises(Exception, match=step):
            run()
    run()
    assert sorted(r.business_key for r in store.read().collect()) == ["0a", "0b", "1a", "1b", "2a", "2b"]
    assert sorted(p.name for p in (tmp_path / "done").iterdir() if not p.name.startswith(".")) == ["f0.log", "f1.log", "f2.log"]
    assert [p.name for p in (tmp_path / "in").iterdir() if not p.name.startswith(".")] == ["bad.log"]
    assert bad == [(0, ["bad.log"])]


def test_chunks_that_fail_are_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.log").write_text("".join(f"k={i}x{j}\n" for j in range(20)))
    got, lost, calls = [], [], []

    def write(rows, batch):
        calls.append(batch)
        keys = [r.business_key for r in rows.collect()]
        if "1x7" in keys or "2x19" in keys:
            raise Broken("no such row")
        got.extend(keys)

    dead = lambda rows, batch: lost.extend((r.business_key, r.error) for r in rows.collect())
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), Rules([Rule("k", r"k=(\w+)")]), "k", str(tmp_path / "ck"), write, chunk=5, dead=dead).awaitTermination(120)
    every = {f"{i}x{j}" for i in range(3) for j in range(20)}
    assert sorted(k for k, _ in lost) == sorted([f"1x{j}" for j in range(5, 10)] + [f"2x{j}" for j in range(15, 20)])
    assert {e for _, e in lost} == {"Broken: no such row"} and len(got) == len(set(got)) and set(got) == every - {k for k, _ in lost}


# ---- large files, recent transactions, counts that are kept


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_files_in_splits_are_read_as_whole_ones(spark, tmp_path, ends):
    from cellweave.sources.lines import csv_records_of, lines_of_files, numbered_lines
    from cellweave.sources.rules import lines_of

    rnd = random.Random(4)
    files = {}
    (tmp_path / "in").mkdir()
    for i in range(3):
        lines = ["head 1", f"lot: {i}", *(["  == begin"] if i else []), *(rnd.choice(["k=1", "", "  x \t", "y" * 300]) for _ in range(3000)), *(["== end", "k=2"] if i == 2 else []), "last"]
        files[f"f{i}.log"] = ends.join(lines)
        (tmp_path / "in" / f"f{i}.log").write_bytes(files[f"f{i}.log"].encode())
    rules = Rules([], start="^== begin$", end="^== end$")
    texts = spark.createDataFrame(list(files.items()), "file string, text string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        with scratch(spark):
            key = lambda df: sorted((r.file.rsplit("/", 1)[-1], r.n, r.line, r.part) for r in df.collect())
            assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 12
            for r in (rules, Rules([]), Rules([], end="^== end$")):
                assert key(lines_of_files(spark, str(tmp_path / "in"), r)) == key(lines_of(texts, r))
            n = {r.file.rsplit("/", 1)[-1]: r.n for r in numbered_lines(spark, str(tmp_path / "in")).groupBy("file").agg(F.max("n").alias("n")).collect()}
            assert n == {f: t.count(ends) for f, t in files.items()}

            (tmp_path / "csv").mkdir()
            records = [f'"{"a" * rnd.randrange(40)}{rnd.choice(["", ",", chr(10), chr(10) * 2 + "x", chr(34) * 2])}",{i}' for i in range(2500)]
            (tmp_path / "csv" / "one.csv").write_bytes("\n".join(records).replace("\n", ends).encode())
            got = [r.line for r in csv_records_of(spark, str(tmp_path / "csv")).orderBy("y").collect()]
            assert got == records
            whole = spark.createDataFrame([("\n".join(records),)], "t string").select(exchange.csv_records(F.col("t")).alias("r")).first().r
            assert got == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_recent_transactions_need_the_newest_days(spark, tmp_path):
    from cellweave.operators import history

    a = spark.range(6000).selectExpr(
        "id", "timestamp '2024-01-01' + make_interval(0, 0, 0, int(id / 200)) AS timestamp", "CASE WHEN id % 9 = 0 THEN '_BATCH_' ELSE concat('c', id % 50) END AS row_id", "concat('col', id % 4) AS column_name",
        "string(id) AS new_value", "'u' AS updated_by", "CASE WHEN id % 13 > 0 THEN concat('tx', pmod(hash(id), 900)) END AS transaction_id",
    )
    live = spark.range(0, 50, 2).selectExpr("concat('c', id) AS row_id")
    log = history.AuditLog(spark, str(tmp_path / "log"))
    log.add(a.where("id < 4000"))
    log.add(a.where("id >= 4000"))
    key = lambda df: [tuple(r) for r in df.collect()]
    assert len(log.days()) == 30
    for limit in (5, 40, 100, 5000):
        assert key(log.transactions(live, limit)) == key(history.transactions(a, live, limit))
    assert log.newest(live, 5)[1] == 1 and log.newest(live, 100)[1] <= 4


def test_counts_of_batches_add_up(spark, tmp_path):
    from cellweave.operators import history

    s, rnd, path = MergeStore(spark, str(tmp_path / "m")), random.Random(8), str(tmp_path / "board")
    for v in range(1, 5):
        put = [(rnd.choice("tu"), f"r{rnd.randrange(20)}", None, {"v": str(v)}, rnd.randrange(3 * 86400), rnd.choice([None, rnd.randrange(5 * 86400)])) for _ in range(15)]
        up = spark.createDataFrame(put, "table_name string, row_id string, business_key string, data map<string,string>, c long, u long").selectExpr("table_name", "row_id", "business_key", "data", "timestamp_seconds(c) AS created_at", "timestamp_seconds(u) AS updated_at")
        s.applied(up, spark.createDataFrame([(rnd.choice("tu"), f"r{rnd.randrange(20)}") for _ in range(5)], "table_name string, row_id string"))
        history.board_changes(s.changes_between(v - 1, v)).write.mode("append").parquet(path)
        now = F.lit("1970-01-05").cast("timestamp")
        assert history.board_of(spark.read.parquet(path), ["t", "u", "none"], now).collect() == history.dashboard(s.read(), ["t", "u", "none"], now).collect()


def test_search_by_pieces(spark, tmp_path):
    from cellweave.operators.pieces import PieceIndex, pieces_of

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdé%_\\") for _ in range(rnd.randrange(1, 7)))
    rows = [(f"r{i:04}", rnd.choice([None, "", word().upper()]), word() + (" needle" if i == 77 else "")) for i in range(400)]
    g = spark.createDataFrame(rows, "row_id string, a string, b string")
    index = PieceIndex.made(g, ["a", "b"], str(tmp_path / "p"), files=8)
    ids = lambda df: sorted(r.row_id for r in df.collect())
    for q in ("NEEDLE", "abc", "É%_", "\\a", "b", "", "abcdabcd", "needles"):
        assert ids(index.search(q)) == ids(grid.searched(g, q, ["a", "b"]) if q else g)
    assert ids(index.search("abc", ["a"])) == ids(grid.searched(g, "abc", ["a"]))
    assert len(index.files()) == 8 and len(index.files_of("needle")) == 1 and index.files_of("needles") == [] and index.files_of("ab") is None
    changed = spark.createDataFrame([("r0077", "x", "hay"), ("r0001", "Needle", None), ("r9999", "a needle", "")], "row_id string, a string, b string")
    assert ids(index.search("needle", changed=changed)) == ["r0001", "r9999"]
    assert pieces_of("ABAB") == ["aba", "bab"] and pieces_of("ab") == []
    with pytest.raises(ValueError, match="indexed"):
        index.search("abc", ["row_id"])


# ---- the ledger


def _updates(spark, rows):
    return spark.createDataFrame(rows, "seq long, table_name string, row_id string, business_key string, cells map<string,string>, source string, updated_by string")


def _ledger(spark, path):
    ledger = Ledger(MergeStore(spark, path, files=4))
    given = spark.createDataFrame([("t", f"r{i}", f"k{i}", None, None) for i in range(8)], "table_name string, row_id string, business_key string, created_at timestamp, updated_at timestamp")
    events = spark.createDataFrame([(i, "old", "t", f"r{i}", "a", "parser_a", f"v{i}", "p") for i in range(8)], EVENTS)
    assert ledger.begun(given, events) == 1
    return ledger


def test_batches_of_a_ledger_follow_each_other(spark, tmp_path):
    """Cells as all events make them, whichever batch brought them; what a batch doesn't change stays."""
    ledger, at = _ledger(spark, str(tmp_path / "l")), F.lit("2024-01-02").cast("timestamp")
    first = [(10, "t", "r1", None, {"a": "user's", "b": "x"}, "user", "ann"), (11, "t", None, "new", {"a": "n"}, "parser_a", "p"), (12, "t", "r2", None, {"a": "v2"}, "parser_a", "p")]
    second = [(20, "t", "r1", None, {"a": "masked", "c": None}, "parser_a", "p"), (21, "t", None, " new ", {"b": "later"}, "parser_a", "p"), (22, "t", "r1", None, {"b": "y"}, "user", "ann")]
    assert ledger.committed(_updates(spark, first), "tx-1", at, stream=("s", 0)) == 2
    assert ledger.committed(_updates(spark, second), "tx-2", at, stream=("s", 1)) == 3
    for batch, n in ((first, 0), (second, 1)):
        assert ledger.committed(_updates(spark, batch), "again", at, stream=("s", n)) == 3
    got = {r.business_key: {k: v for k, v in r.data.items() if v is not None} for r in ledger.rows().collect()}
    want = {f"k{i}": {"a": f"v{i}"} for i in range(8)} | {"k1": {"a": "user's", "b": "y"}, "new": {"a": "n", "b": "later"}}
    assert got == want
    of = {r.row_id: r.business_key for r in ledger.rows().collect()}
    told: dict[str, dict] = {}
    for r in layering.effective(ledger.events()).where("value IS NOT NULL").collect():
        told.setdefault(of[r.row_id], {})[r.col] = r.value
    assert told == want
    audit = sorted((r.transaction_id, r.business_key, r.column_name, r.new_value) for r in ledger.audit().collect())
    assert audit == [("tx-1", "k1", "a", "user's"), ("tx-1", "k1", "b", "x"), ("tx-1", "new", "ROW_UPDATE", "new data"), ("tx-2", "k1", "b", "y"), ("tx-2", "new", "ROW_UPDATE", "1 fields updated")]
    assert ledger.audit(2).count() == 3 and ledger.events(1).count() == 8 and ledger.audit(1).count() == 0


@pytest.mark.parametrize("step", ["_written", "_commit"])
def test_a_batch_counts_whole_or_not_at_all(spark, tmp_path, monkeypatch, step):
    ledger, at = _ledger(spark, str(tmp_path / "l")), F.lit("2024-01-02").cast("timestamp")
    batch, plain = _updates(spark, [(10, "t", "r1", None, {"a": "u"}, "user", "ann")]), getattr(MergeStore, step)

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(MergeStore, step, fails)
    with pytest.raises(OSError):
        ledger.committed(batch, "tx-1", at, stream=("s", 0))
    assert ledger.store.versions() == [1] and ledger.events().count() == 8 and ledger.audit().count() == 0 and ledger.rows().where("data['a'] = 'u'").count() == 0
    monkeypatch.setattr(MergeStore, step, plain)
    assert ledger.committed(batch, "tx-1", at, stream=("s", 0)) == 2
    assert ledger.events().count() == 9 and ledger.audit().count() == 1 and ledger.rows().where("data['a'] = 'u'").count() == 1


def test_a_batch_on_a_version_that_is_no_longer_the_last_is_a_conflict(spark, tmp_path):
    ledger = _ledger(spark, str(tmp_path / "l"))
    ledger.store.applied(rows(spark, ["r1"], "other"))
    with pytest.raises(Conflict):
        ledger.store.applied(rows(spark, ["r1"], "mine"), parts_to_append={"events": ledger.events()}, on=1)
    assert ledger.store.found("t", "r1").first().data == {"v": "other"} and ledger.events().count() == 8


def test_groups_of_a_stream_are_computed_once_a_batch(spark, tmp_path):
    at = str(tmp_path)
    entries = spark.range(90).select(F.col("id").alias("seq"), (F.col("id") % 30).cast("string").alias("transaction_id"))
    entries.coalesce(1).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(entries.schema).parquet(f"{at}/in")
    store = MergeStore(spark, f"{at}/store")
    run = ingestion.followed(ingestion.live_groups(stream, 2), store, "groups", f"{at}/checkpoint")
    run.awaitTermination()
    assert sum(s["numRowsUpdated"] for p in run.recentProgress for s in p["stateOperators"]) == 30
    assert {r.row_id: (r.data["total_count"], r.data["n_logs"]) for r in store.read("groups").collect()} == {str(i): ("3", "2") for i in range(30)}


def test_a_batch_computes_its_updates_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "seq long, table_name string, row_id string, business_key string, cells map<string,string>, source string, updated_by string"
    given = spark.createDataFrame([(i, "t", None, f"k{i % 5}", {"a": str(i)}, "user" if i % 2 else "feed", "ann") for i in range(20)], kind).mapInArrow(counted, kind)
    ledger = Ledger(MergeStore(spark, str(tmp_path / "m"), files=2))
    ledger.begun(spark.createDataFrame([], "table_name string, row_id string, business_key string, created_at timestamp, updated_at timestamp"), spark.createDataFrame([], EVENTS))
    ledger.committed(given, "tx", F.lit("2024-01-01").cast("timestamp"))
    assert seen.value == 20
    assert sorted((r.business_key, r.data["a"]) for r in ledger.rows().collect()) == [("k0", "15"), ("k1", "11"), ("k2", "17"), ("k3", "13"), ("k4", "19")]
