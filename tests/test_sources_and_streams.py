import datetime
import json
import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.sources import files, paged, sinks, xlsx
from tessera.streaming import state as St


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_skills(spark, tmp_path):
    put(tmp_path / "one/SKILL.md", "---\nname: one\ndescription: \"First: it\"\n---\nBody\n")
    put(tmp_path / "two/SKILL.md", "no front matter")
    put(tmp_path / "one/scripts/a.py", "x = 1")
    put(tmp_path / "one/references/r.md", "ref")
    put(tmp_path / "one/references/blank.md", " ")
    got = files.skills(spark, str(tmp_path)).collect()
    assert [(r.name, r.description, r.content.strip(), r.folder) for r in got] == [("one", "First: it", "Body", "one")]
    assert files.skills(spark, str(tmp_path), full=False).columns == ["name", "description", "folder"]
    assert {(r.folder, r.kind): r.files for r in files.attached(spark, str(tmp_path)).collect()} == {("one", "scripts"): {"a.py": "x = 1"}, ("one", "references"): {"r.md": "ref"}}


def test_jsonl(spark, tmp_path):
    put(tmp_path / "e.jsonl", '{"event_id": "1", "type": "assistant", "ts": 1.5}\n\nbroken\n{"event_id": "2", "type": "tool_result", "text": "x"}\n')
    assert [r.event_id for r in files.jsonl_events(spark, str(tmp_path)).orderBy("line").collect()] == ["1", "2"]
    assert [r.event_id for r in files.jsonl_events(spark, str(tmp_path), strict=True).collect()] == ["1"]


def test_run_log(spark, tmp_path):
    put(tmp_path / "log.json", json.dumps({"runs": [{"date": "2024-01-01", "docs_scanned": 3, "created_files": ["a"]}, {"date": "2024-01-03"}]}))
    got = files.run_log(spark, str(tmp_path / "log.json")).orderBy("run").collect()
    assert [(r.run, r.date, r.docs_scanned, r.created_files) for r in got] == [(1, "2024-01-01", 3, ["a"]), (2, "2024-01-03", None, None)]


def test_git_log(spark):
    text = spark.createDataFrame([("h1\x1fme\x1f2024-02-01\x1ffeat: x\x1fbody\x1fsrc/a.py\ndocs/b.md\x1eh2\x1fme\x1f2024-01-01\x1fMerge y\x1f\x1fc.py\x1eh3\x1fyou\x1f2024-03-01\x1fdocs: z\x1f\x1fdocs/q.md\n",)], "value string")
    log = files.git_log(text)
    assert [(r.hash, r.files) for r in log.collect()] == [("h1", ["src/a.py", "docs/b.md"]), ("h2", ["c.py"]), ("h3", ["docs/q.md"])]
    assert [(r.hash, r.files) for r in files.code_commits(log, "2024-01-01").collect()] == [("h1", ["src/a.py"])]


def test_trees(spark, tmp_path):
    put(tmp_path / "r/b/x.py", "1")
    put(tmp_path / "r/A.md", "22")
    put(tmp_path / "r/node_modules/z.ts", "3")
    put(tmp_path / "r/log-2024-05-02.txt", "4")
    put(tmp_path / "r/log-2024-04-01.txt", "5")
    root = str(tmp_path / "r")
    assert [(r.language, r.value) for r in files.source_tree(spark, root, ["node_modules"]).collect()] == [("python", "1")]
    assert files.markdown_tree(spark, root).count() == 1
    tree = [(r.folder, r.name, r.is_dir) for r in files.folder_tree(spark, root).collect()]
    assert tree[:3] == [("", "b", True), ("", "node_modules", True), ("", "A.md", False)] and ("b", "x.py", False) in tree
    logs = files.log_files(spark, root, "2024-05-01").where("path like '%log-%'").collect()
    assert [r.day for r in logs] == [datetime.date(2024, 5, 2)]


def test_eval_runs(spark, tmp_path):
    put(tmp_path / "eval-3/with/run-2/grading.json", json.dumps({"summary": {"pass_rate": 0.5, "passed": 1, "failed": 1, "total": 2}}))
    put(tmp_path / "eval-4/with/run-1/grading.json", "{")
    got = files.eval_runs(spark, str(tmp_path)).collect()
    assert [(r.eval_id, r.config, r.run_number, r.pass_rate, r.time_seconds) for r in got] == [(3, "with", 2, 0.5, 0.0)]


def test_xlsx(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>he</t><t>llo</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="e"><f>1/0</f><v>#DIV/0!</v></c><c r="C1"/></row></sheetData></worksheet>')
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    got = xlsx.read_cells(spark, str(tmp_path))
    assert sorted((r.sheet, r.cell, r.value, r.formula) for r in got.collect()) == [("One", "A1", "hello", None), ("One", "B1", "#DIV/0!", "1/0")]
    assert [(r.token, r.n, r.places) for r in xlsx.error_summary(got).collect()] == [("#DIV/0!", 1, ["One!B1"])]
    assert [r.formulas for r in xlsx.formula_count(got).collect()] == [1]


def test_pages_with_addresses(spark):
    source = paged.paged_source("addressed", "name string", lambda options, page: ((page + x,) for x in options["q"]), lambda options: ["b", "a", "c"])
    assert sorted(r.name for r in paged.read(spark, source, q="xy").collect()) == ["ax", "ay", "bx", "by", "cx", "cy"]


def test_search_is_served_by_pages_of_500(spark, tmp_path):
    import duckdb
    from pyarrow import parquet

    from tessera import plans
    from tessera.storage import shared_folder

    rows = [(None if k == 7 else 5000 - k, None if k % 9 == 0 else "s", None if k == 3 else f"{'Heed' if k % 100 == 7 else 'x'} " + "é" * (k * 3)) for k in range(1300)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(shared_folder(spark)))
    got = [tuple(r) for r in plans.QUERIES["scan_web_search"](spark, str(tmp_path)).select("doc_id", "source", "snippet").collect()]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == duck.execute(plans.ORACLES["scan_web_search"]).fetchall() and len(got) == 13 and got[-1][0] is None
    (at,) = (x for x in set(os.listdir(shared_folder(spark))) - before if x.startswith("search-"))
    at = os.path.join(shared_folder(spark), at)
    assert sorted(parquet.read_metadata(os.path.join(at, f)).num_rows for f in os.listdir(at) if f.endswith(".parquet")) == [300, 500, 500]


def test_paged_and_polled(spark, tmp_path):
    source = paged.paged_source("catalog", "page int, name string", lambda options, k: [(k, options["q"] + str(k))], 3)
    assert {tuple(r) for r in paged.read(spark, source, q="x").collect()} == {(0, "x0"), (1, "x1"), (2, "x2")}
    poll = paged.polled_source("polls", "n int", lambda options, at: ([(at,)] if at < 4 else [], min(at + 1, 4)))
    q = paged.read_stream(spark, poll).writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("polled").count() >= 4:
                break
    finally:
        q.stop()
    assert sorted(r.n for r in spark.table("polled").collect()) == [0, 1, 2, 3]


def test_embedded_restores_order(spark):
    df = spark.createDataFrame([(k, "t" * k) for k in range(5)], "k int, t string")
    got = paged.embedded(df, "k", "t", lambda texts: [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))], 2).collect()
    assert {r.k: r.embedding for r in got} == {k: [float(k)] for k in range(5)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "short", "2024-01-01"), (2, "x" * 5000, "2024-01-02")], "id int, text string, day string")
    sinks.write_folded(df, "text", str(tmp_path / "m"), str(tmp_path / "a"))
    assert {r.id: (r.folded, len(r.text), r["size"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {1: (False, 5, 5), 2: (True, 500, 5000)}
    assert [len(r.text) for r in spark.read.parquet(str(tmp_path / "a")).collect()] == [5000]
    sinks.write_daily(df, "day", str(tmp_path / "d"))
    assert (tmp_path / "d/day=2024-01-01").is_dir()
    sinks.append_json(df, str(tmp_path / "j"))
    sinks.append_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert sinks.markdown_report(df.select("id", "day")).first().line == "| 1 | 2024-01-01 |" and len(sinks.markdown_head(df)) == 2
    assert json.loads(sinks.json_report(df.select("id")).first().json) == {"id": 1}


ROWS = [(u, k, t, f) for u in (1, 2) for k, (t, f) in enumerate([(0.0, True), (1.0, True), (2.0, False), (3.0, False), (70.0, False), (71.0, False), (72.0, False), (73.0, True)])]


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(ROWS, "user long, id long, t double, failed boolean")


def by_user(df, column):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        out.setdefault(r.user, []).append(r[column])
    assert out[1] == out[2]
    return out[1]


def test_limits(calls):
    limit = St.scan(calls, "user", ["t"], St.sliding_limit(2, 3.0, "user", "t", "id"), "user long, id long, accepted boolean")
    assert by_user(limit, "accepted") == [True, True, False, True, True, True, False, True]  # a time at the window's start is outside it
    bucket = St.scan(calls, "user", ["t"], St.token_bucket(0.5, 2.0, "user", "t", "id"), "user long, id long, accepted boolean, tokens double")
    assert by_user(bucket, "accepted") == [True, True, True, False, True, True, True, False]
    breaker = St.scan(calls, "user", ["t"], St.circuit_breaker("user", "t", "id", "failed", 2, 60.0, 3), "user long, id long, allowed boolean, state string")
    assert by_user(breaker, "state") == ["closed", "open", "open", "open", "half_open", "half_open", "closed", "closed"]
    assert by_user(breaker, "allowed") == [True, True, False, False, True, True, True, True]


def test_runs(spark):
    kinds = [("a", 0, "TEXT_MESSAGE_START", None, None), ("a", 1, "TEXT_MESSAGE_CONTENT", "x", None), ("a", 2, "TEXT_MESSAGE_CONTENT", "y", None), ("a", 3, "TEXT_MESSAGE_END", None, None), ("a", 4, "RUN_FINISHED", None, None), ("b", 0, "TEXT_MESSAGE_START", None, None), ("b", 1, "RUN_ERROR", None, None), ("c", 0, "RUN_FINISHED", None, "given")]
    df = spark.createDataFrame(kinds, "run string, at int, type string, delta string, output string")
    got = St.scan(df, "run", ["at"], St.run_accumulator("run"), "run string, output string, messages long").collect()
    assert {(r.run, r.output, r.messages) for r in got} == {("a", "xy", 1), ("c", "given", 0)}


def test_stream_equals_scan(spark, calls, tmp_path):
    step = St.sliding_limit(2, 3.0, "user", "t", "id")
    schema = "user long, id long, accepted boolean"
    for k in range(3):  # three files, read one after the other
        calls.where((F.col("id") % 8 >= 3 * k) & (F.col("id") % 8 < 3 * k + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = St.stream(spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "user", ["t"], step, schema)
    q = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {tuple(r) for r in St.scan(calls, "user", ["t"], step, schema).collect()}
    assert {tuple(r) for r in spark.table("live").collect()} == want


def test_windows_and_fan_out(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    pdf = pd.DataFrame({"id": [1, 1, 2, 3], "ts": [base + datetime.timedelta(minutes=m) for m in (0, 1, 2, 40)]})
    spark.createDataFrame(pdf).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    q = St.fan_out(St.deduplicated(stream(), "ts", ["id"], "10 minutes"), [lambda b, n: seen.append(b.count()), lambda b, n: seen.append(-b.count())]).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert seen[:2] == [3, -3]
    q = St.windowed_counts(stream(), "ts", [], "5 minutes", "10 minutes").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("counts").collect()] == [3]


def test_matched_calls(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("c1", t, "x")], "call string, call_ts timestamp, arguments string").write.parquet(str(tmp_path / "calls"))
    spark.createDataFrame([("c1", t + datetime.timedelta(seconds=5), "r1"), ("c2", t, "r2"), ("c9", t + datetime.timedelta(hours=9), "late")], "call string, ts timestamp, result string").write.parquet(str(tmp_path / "results"))
    calls = spark.readStream.schema("call string, call_ts timestamp, arguments string").parquet(str(tmp_path / "calls"))
    results = spark.readStream.schema("call string, ts timestamp, result string").parquet(str(tmp_path / "results"))
    q = St.matched_calls(calls, results, "1 minute").writeStream.format("memory").queryName("matched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.call, r.arguments) for r in spark.table("matched").collect()}
    assert ("c1", "x") in got
