import pytest
from pyspark.sql import functions as F

from cellweave.functions import cells
from cellweave.operators import exchange, grid, layering
from cellweave.sources import parsers, store
from cellweave.sources.rules import Rule, Rules, canonical, keyed, lines_of, rows_of
from cellweave.streaming.ingest import ingest, ingest_all

EVENTS = "seq long, tx string, table_name string, row_id string, col string, source string, value string, updated_by string"


def events(spark, rows):
    return spark.createDataFrame([(i, "t1", "t", "r", c, s, v, s) for i, (c, s, v) in enumerate(rows)], EVENTS)


@pytest.mark.parametrize(
    "writes, value, winner",
    [
        ([("user", "a"), ("parser_a", "b")], "a", "user"),
        ([("parser_b", "a"), ("parser_a", "b")], "b", "parser_a"),
        ([("zz", "a"), ("longer", "b")], "a", "zz"),
        ([("bb", "a"), ("aa", "b")], "b", "aa"),
        ([("user", "a"), ("user", None)], None, "user"),
        ([("batch_ingester", "x"), ("other", "y")], "x", "batch_ingester"),
    ],
)
def test_priority(spark, writes, value, winner):
    r = layering.effective(events(spark, [("c", s, v) for s, v in writes])).first()
    assert (r.value, r.priority_source, r.is_overwrite) == (value, winner, winner == "user")


def test_system_columns_are_not_written(spark):
    assert layering.effective(events(spark, [("row_id", "user", "x"), ("c", "user", "y")])).count() == 1


def test_masked_write_changes_nothing(spark):
    c = layering.changes(events(spark, [("c", "user", "a"), ("c", "parser_a", "b"), ("c", "user", "a"), ("c", "user", None)])).orderBy("seq").collect()
    assert [r.changed for r in c] == [True, False, False, True]
    a = layering.audit_of(events(spark, [("c", "user", "a"), ("d", "parser_a", "b"), ("e", "parser_a", "b")])).orderBy("column_name").collect()
    assert [(r.column_name, r.new_value) for r in a] == [("ROW_UPDATE", "2 fields updated"), ("c", "a")]


def test_pin_of_a_missing_source_is_ignored(spark):
    e = events(spark, [("c", "user", "a"), ("c", "parser_a", "b")])
    pin = lambda s: spark.createDataFrame([("t", "r", "c", 1, s)], "table_name string, row_id string, col string, seq long, source string")
    assert layering.effective(e, pin("parser_a")).first().value == "b"
    assert layering.effective(e, pin("gone")).first().value == "a"


def test_value_text(spark):
    rows = [("5", "int", "5"), ("5", "float", "5.0"), ("5", "str", "5"), (None, "str", "None"), ("true", "bool", "True")]
    df = spark.createDataFrame(rows, "v string, k string, want string")
    assert df.where(cells.value_text(F.col("v"), F.col("k")) != F.col("want")).count() == 0


def test_pages_concatenate_to_the_order(spark):
    g = spark.createDataFrame([(f"r{i:02}", str(i % 4) if i % 5 else None) for i in range(23)], "row_id string, business_key string")
    for order in (grid.Order(), grid.Order("id"), grid.Order("id", True)):
        whole = [r.row_id for r in g.orderBy(*order.columns()).collect()]
        parts = [r.row_id for s in range(0, 30, 7) for r in grid.page(g, order, s, 7).orderBy("position").collect()]
        assert parts == whole
        at = {r.row_id: r.position for r in grid.positions_of(g, order, g).collect()}
        assert [at[x] for x in whole] == list(range(23))
        assert {r.row_id: r.position for r in grid.numbered(g, order).collect()} == at


def test_search_takes_marks_literally(spark):
    g = spark.createDataFrame([("1", "50%"), ("2", "a_b"), ("3", "c\\d"), ("4", None)], "row_id string, x string")
    for q, ids in (("%", ["1"]), ("_", ["2"]), ("\\", ["3"]), ("A_", ["2"])):
        assert [r.row_id for r in grid.searched(g, q).collect()] == ids
    assert grid.searched(g.limit(0), "x").count() == 0


def test_headers_are_read_without_a_shuffle(spark):
    rules = Rules([Rule("a", r"a=(\d+)")], header=[Rule("lot", r"lot=(\S*)"), Rule("k", r"k=(\S+)", "int"), Rule("a", "(lot)")], file_name=[Rule("f", r"f_(\d+)")], start="^begin$")
    texts = [("x/f_1", "lot=p\nlot=q k=7\nk=no\nbegin\na=1\nlot=z a=2"), ("x/g", "begin\na=3"), ("x/f_2", None), (None, "k=5\nbegin\na=4")]
    got = rows_of(spark.createDataFrame(texts, "file string, text string"), rules)
    want = [("x/f_1", 4, "1", "1", "q", None), ("x/f_1", 5, "2", "1", "q", None), ("x/g", 1, "3", None, None, None), (None, 2, "4", None, None, "5")]
    assert sorted(map(tuple, got.select("file", "n", "a", "f", "lot", "k").collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_offsets_too_far_apart(spark):
    g = spark.createDataFrame([("1",)], "row_id string")
    with pytest.raises(ValueError):
        grid.ids_at(g, grid.Order(), [0, 50_001])
    assert grid.ids_at(g, grid.Order(), []).count() == 0
    assert [tuple(r) for r in grid.ids_at(g, grid.Order(), [-1, 0, 49_000]).collect()] == [(1, 0, "1")]


def test_every_row_is_exported(spark, tmp_path):
    n = 1_000_003
    g = spark.range(n).select(F.format_string("r%07d", "id").alias("row_id"), F.col("id").alias("x"))
    lines = exchange.export_lines(g, ["x"], grid.Order())
    assert lines.agg(F.count("*"), F.sum("line"), F.max("row_id")).first() == (n, n * (n - 1) / 2, f"r{n - 1:07}")
    exchange.export_csv(g, grid.Order(), str(tmp_path / "all"), ["x"])
    assert spark.read.text(str(tmp_path / "all")).count() == n + 1
    assert [r.line for r in exchange.export_lines(g, ["x"], grid.Order(), 2).collect()] == ["0", "1"]


def test_csv_fields(spark):
    df = spark.createDataFrame([("a,b", 'q"q', None, "x\ny")], "a string, b string, c string, d string")
    assert df.select(exchange.csv_line(df.columns)).first()[0] == '"a,b","q""q",,"x\ny"'


def test_rules(spark):
    text = "id: H\nid: I\nbegin\nk=1 v=x\n\n v=5\nk=2 v=7\nend\nk=9 v=9"
    rules = Rules([Rule("k", r"k=(\d)", "int"), Rule("v", r"v=(\S)", "int", default="0")], [Rule("h", r"^id: (\w)")], [Rule("day", r"_(\d+)\.")], "begin", "end")
    got = rows_of(spark.createDataFrame([("/d/f_12.log", text)], "file string, text string"), rules)
    assert sorted((r.k or "", r.v, r.h, r.day) for r in got.collect()) == [("", "5", "I", "12"), ("1", "0", "I", "12"), ("2", "7", "I", "12")]
    assert keyed(got, "K").count() == 2 and keyed(got, "none").count() == 0


def test_files_are_ingested_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "user(ann)_1.log").write_text("k=1 v=a\nnothing\nk=2 v=b\n")
    rules, got = Rules([Rule("k", r"k=(\d)"), Rule("v", r"v=(\w)")]), []
    write = lambda rows, _: got.extend(rows.collect())
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), rules, "k", str(tmp_path / "ck"), write).awaitTermination(60)
    assert sorted((r.business_key, r.v, r.source, r.updated_by) for r in got) == [("1", "a", "user", "ann"), ("2", "b", "user", "ann")]


def test_required_columns_may_have_defaults(spark):
    rules = lambda **k: Rules([Rule("a", r"a=(\d)", "int", **k), Rule("b", r"b=(\w)")])
    rows = lambda r: sorted((x.a, x.b) for x in rows_of(spark.createDataFrame([("f", "b=x\na=1 b=y\nnothing\n")], "file string, text string"), r).collect())
    assert rows(rules(required=True)) == [("1", "y")]
    assert rows(rules(required=True, default="7")) == [("1", "y"), ("7", "x")]


def test_marks_are_matched_on_stripped_lines_in_the_body_and_on_raw_ones_in_the_header(spark):
    text = "one\r\n  == begin\t\r\ntwo\n\u00a0\n\tthree \r== end\nfour"
    got = lines_of(spark.createDataFrame([("f", text), ("g", None), ("h", "no mark")], "file string, text string"), Rules([], start="^== begin$", end="^== end$")).collect()
    assert [(r.file, r.line) for r in got if r.part == "body"] == [("f", "two"), ("f", "three")]
    assert [r.line for r in got if r.part == "header" and r.file == "f"] == ["one", "  == begin\t", "two", "\u00a0", "\tthree ", "== end", "four"]
    assert [r.part for r in got if r.file == "h"] == ["header"]


def test_canonical_names(spark):
    df = spark.createDataFrame([("1", "2", "3")], "PART_NO string, part_no_2 string, Other string")
    assert canonical(df, ["part_no", "Part_No"]).columns == ["part_no", "part_no_2", "Other"]


def test_matrix_of_quoted_records(spark):
    text = '1,"a,b",\n"two\nlines",.5, "x"\r\n\r\n"say ""hi""",1.2.3'
    got = exchange.matrix_of(spark.createDataFrame([(1, text), (2, None)], "id int, text string")).collect()
    assert sorted((r.x, r.y, r.z, r.number) for r in got if r.y < 2) == [(0, 0, "1", 1.0), (0, 1, "two\nlines", None), (1, 0, "a,b", None), (1, 1, ".5", 0.5), (2, 1, '"x"', None)]
    assert [(r.z, r.is_number) for r in got if r.y > 1] == [('say "hi"', False), ("1.2.3", False)]


def test_lengths_and_chunks():
    assert [grid.should_search(q) for q in ("", "a", "ab", "abc")] == [True, False, False, True]
    assert [grid.aligned_skip(r, 50) for r in (0, 49, 50, 120)] == [0, 0, 50, 100]
    assert [grid.adapted_chunk(100, s) for s in (0.1, 0.52, 0.9)] == [110, 100, 90]
    assert (grid.adapted_chunk(990, 0.1), grid.adapted_chunk(51, 1), grid.adapted_chunk(300, 0.1, batch=True)) == (1000, 50, 300)


def test_deep_pages_are_slices_of_numbered_rows(spark, monkeypatch):
    g = spark.createDataFrame([(f"r{i:03}", str(i % 7) if i % 5 else None) for i in range(90)], "row_id string, business_key string")
    want = [(r.row_id, r.position) for r in grid.page(g, grid.Order("id", True), 40, 9).orderBy("position").collect()]
    monkeypatch.setattr(grid, "DEEP", 10)
    assert [(r.row_id, r.position) for r in grid.page(g, grid.Order("id", True), 40, 9).orderBy("position").collect()] == want


def test_ids_are_ordered_by_time(spark):
    rows = [("2024-01-01 00:00:00", "b"), ("2024-01-01 00:00:01", "a")]
    ids = [r[0] for r in spark.createDataFrame(rows, "t string, s string").select(cells.time_ordered_id(F.col("t").cast("timestamp"), F.col("s"))).collect()]
    assert ids == sorted(ids) and all(len(i) == 36 and i[14] == "7" for i in ids)


def test_sanitised(spark):
    got = spark.createDataFrame([(b"a\xffb\xc3",), ("ok \ufffd".encode(),), (None,)], "b binary").select(cells.sanitised(F.col("b").cast("string"))).collect()
    assert [r[0] for r in got] == ["ab", "ok \ufffd", None]


def test_parser_attempts(spark):
    def parser(name, content):
        if name == "locked":
            raise PermissionError("locked")
        return [{"n": name, "none": None}] if name != "bad" else 1 / 0

    files = spark.createDataFrame([("/x/good", b"1"), ("/x/bad", b"2"), ("/x/locked", b"3")], "file string, content binary")
    rows = parsers.parsed(files, parser)
    assert [r.row for r in parsers.good(rows).collect()] == [{"n": "good", "none": None}]
    assert sorted(r.error.split(":")[0] for r in parsers.quarantined(rows).collect()) == ["PermissionError", "ZeroDivisionError"]


def test_ingestion_to_the_end(spark, tmp_path):
    """Two tables, by rules and by a parser: rows are written, good files are archived, also under a taken name, bad ones stay."""
    s = store.Store(spark, str(tmp_path), {"parts": ["Part_No"], "shapes": [], "idle": []})
    for t in s.tables:
        s.workspace(t)
    s.configure("parts", {"rules": [{"column": "part_no", "regex": r"p=(\w+)"}, {"column": "qty", "regex": r"q=(\d+)", "type": "int"}]})
    name = s.upload("parts", "a.log", b"p=x q=1\np=y q=2\n", "ann")
    s.paste("shapes", "ignored")
    (tmp_path / "workspace/parts/raws/bad.log").write_bytes(b"p=z \xff")
    (tmp_path / "workspace/parts/archives" / name).write_text("taken")
    got = []
    run = lambda: [q.awaitTermination(60) for q in ingest_all(s, lambda t, rows, i: got.extend((t, r.asDict()) for r in rows.collect()), {"shapes": lambda n, c: [{"ID": n[:5], "size": len(c)}]}, {"parts": "PART_NO"}).values()]
    run()
    run()
    parts = sorted((r["business_key"], r["qty"], r["source"], r["updated_by"]) for t, r in got if t == "parts")
    assert parts == [("x", "1", "user", "ann"), ("y", "2", "user", "ann")]
    assert [(r["business_key"], r["row"], r["source"]) for t, r in got if t == "shapes"] == [("paste", {"ID": "paste", "size": "7"}, "custom_script")]
    left = sorted(p.name for p in (tmp_path / "workspace/parts/raws").iterdir() if not p.name.startswith("."))
    kept = sorted(p.name for p in (tmp_path / "workspace/parts/archives").iterdir() if not p.name.startswith("."))
    assert left == ["bad.log"] and len(kept) == 2 and name in kept and name[:4] == "user"
    assert s.configuration("idle") is None


def test_store_reset_needs_to_be_sure(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), {"t": []})
    assert s.versions() == []
    s.create()
    s.create()
    assert s.versions() == [1] and s.read().count() == 0
    with pytest.raises(ValueError):
        s.reset()
    s.write(s.read())
    s.reset(sure=True)
    assert s.versions() == [1]


def test_store_reads_one_table_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.write(spark.sql("SELECT 't' || id % 3 AS table_name, 'r' || id AS row_id, NULL AS business_key, map('a', 'b') AS data, now() AS created_at, now() AS updated_at FROM range(30)"))
    one = s.read("t1")
    assert one.count() == 10 and all("table_name=t1" in f for f in one.inputFiles()) or "PartitionFilters: [isnotnull(table_name" in one._jdf.queryExecution().toString()


def test_copy_over_jdbc(spark, tmp_path):
    """Between two in-memory databases, with the driver that comes with Spark."""
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no JDBC driver")
    a, b = ({"url": f"jdbc:derby:memory:{x};create=true", "driver": driver} for x in ("one", "two"))
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id int, name string")
    for end in (a, b):
        (rows if end is a else rows.limit(0)).write.format("jdbc").options(**end, dbtable="t").save()
    store.copied_over_jdbc(spark, a, b, {"t": {"partitionColumn": "id", "lowerBound": "0", "upperBound": "20", "numPartitions": "4"}})
    got = spark.read.format("jdbc").options(**b, dbtable="t").load()
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted((i, f"n{i}") for i in range(20))
    # a copy that was stopped: some rows are there, some not; bounds are asked for
    spark.createDataFrame([(i, f"n{i}") for i in range(20, 50)], "id int, name string").write.format("jdbc").options(**a, dbtable="t").mode("append").save()
    for _ in range(2):
        store.copied_over_jdbc(spark, a, b, {"t": {"partitionColumn": "id", "numPartitions": "4"}}, keys={"t": ["id"]})
        got = spark.read.format("jdbc").options(**b, dbtable="t").load()
        assert sorted((r[0], r[1]) for r in got.collect()) == sorted((i, f"n{i}") for i in range(50))
    for end in (a, b):
        rows.limit(0).write.format("jdbc").options(**end, dbtable="empty_one").save()
    store.copied_over_jdbc(spark, a, b, {"empty_one": {"partitionColumn": "id", "numPartitions": "4"}}, keys={"empty_one": ["id"]})
    assert spark.read.format("jdbc").options(**b, dbtable="empty_one").load().count() == 0


def test_columns_agree_with_the_client_helpers(spark):
    rows = [(c, s, b) for c in (50, 51, 100, 333, 909, 910, 1000) for s in (0.0, 0.499, 0.5, 0.55, 0.56, 9.0, None) for b in (True, False, None)]
    got = spark.createDataFrame(rows, "c int, s double, b boolean").select("*", grid.adapted_chunks(F.col("c"), F.col("s"), F.col("b")).alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n == (r.c if r.s is None else grid.adapted_chunk(r.c, r.s, bool(r.b)))
    texts = [("",), ("a",), ("ab",), ("abc",), ("ab ",), (None,)]
    found = spark.createDataFrame(texts, "q string").select("q", grid.searches(F.col("q")).alias("runs")).collect()
    assert [r.runs for r in found] == [grid.should_search(r.q or "") for r in found]
