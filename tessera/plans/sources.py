"""Queries of the readers' parsing, over files made of table rows, and of sources over a function."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.plans.registry import Tables, query
from tessera.sources import files, paged, sinks, xlsx
from tessera.storage import new_folder
from tessera.streaming import state as St


def s(*parts: Column | str) -> Column:
    """Columns and texts joined to one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


c = F.col


def _skill_files(t: Tables):
    text = F.when(c("p_size") > 5, s("---\nname: ", c("p_name"), "\ndescription: \"", c("p_type"), ": it\"\n---\n", c("p_brand"))).otherwise(s("no head ", c("p_name")))
    return t.part.select(s("/skills/k", c("p_partkey"), "/SKILL.md").alias("path"), text.alias("value"))


@query("scan_skill_dir", "SELECT 'k' || p_partkey AS folder, p_name AS name, p_brand AS content FROM part WHERE p_size > 5")
def scan_skill_dir(t: Tables):
    return files.skills_of(_skill_files(t)).select("folder", "name", "content")


@query("scan_front_matter", "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_name END AS name, CASE WHEN p_size > 5 THEN p_type || ': it' END AS description FROM part")
def scan_front_matter(t: Tables):
    return _skill_files(t).select(F.regexp_extract("path", r"k(\d+)/", 1).cast("long").alias("p_partkey"), *files.front_matter(c("value"), "name", "description"))


@query(
    "scan_scripts_refs",
    """WITH f AS (SELECT 'k' || l_orderkey AS folder, CASE WHEN l_linenumber % 2 = 0 THEN 'scripts' ELSE 'references' END AS kind, l_suppkey, max(CASE WHEN l_linenumber % 2 = 1 AND l_returnflag = 'A' THEN ' ' ELSE l_returnflag END) AS v FROM lineitem GROUP BY ALL)
SELECT folder, kind, count(*) AS files FROM f WHERE kind = 'scripts' OR trim(v) <> '' GROUP BY ALL""",
)
def scan_scripts_refs(t: Tables):
    path = F.when(c("l_linenumber") % 2 == 0, s("/k", c("l_orderkey"), "/scripts/f", c("l_suppkey"), ".py")).otherwise(s("/k", c("l_orderkey"), "/references/f", c("l_suppkey"), ".md"))
    text = F.when((c("l_linenumber") % 2 == 1) & (c("l_returnflag") == "A"), " ").otherwise(c("l_returnflag"))
    d = t.lineitem.select(path.alias("path"), text.alias("value")).groupBy("path").agg(F.max("value").alias("value"))  # a file once
    return files.attached_of(d).select("folder", "kind", F.size("files").cast("long").alias("files"))


def _event_files(t: Tables):
    line = F.when(c("event_type") == "error", s("broken ", c("event_id"))).otherwise(F.to_json(F.struct(c("event_id").cast("string").alias("event_id"), c("event_type").alias("type"), c("value").alias("ts"))))
    g = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))
    return g.select(s("/u", c("user_id"), ".jsonl").alias("path"), F.array_join(F.transform("x", lambda v: v["line"]), "\n\n").alias("value"))


@query("scan_jsonl_events", "SELECT event_id::VARCHAR AS event_id, event_type AS type, value AS ts FROM events WHERE event_type <> 'error'")
def scan_jsonl_events(t: Tables):
    return files.events_of(_event_files(t)).select("event_id", "type", "ts")


@query("scan_jsonl_events_strict", "SELECT event_id::VARCHAR AS event_id FROM (SELECT *, min(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS stop FROM events) WHERE stop IS NULL OR event_id < stop")
def scan_jsonl_events_strict(t: Tables):
    return files.events_of(_event_files(t), strict=True).select("event_id")


@query("scan_json_log", "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 100)::INT END AS docs_scanned FROM orders")
def scan_json_log(t: Tables):
    run = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(c("o_orderstatus") == "F", c("o_orderkey") % 100).alias("docs_scanned"))
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", run.alias("run")))).alias("x"))
    d = g.select(s("/log", c("o_custkey"), ".json").alias("path"), F.to_json(F.struct(F.transform("x", lambda v: v["run"]).alias("runs"))).alias("value"))
    return files.runs_of(d).select(F.regexp_extract("path", r"log(\d+)", 1).cast("long").alias("o_custkey"), c("run").cast("long").alias("run"), "date", "docs_scanned")


def _log(t: Tables):
    body = F.when(c("o_orderpriority") == "5-LOW", s("docs/a.md\nREADME.md")).when(c("o_orderpriority") == "1-URGENT", s("src/x.py\ndocs/b.md")).otherwise(s("src/y.py"))
    subject = F.when(c("o_orderstatus") == "P", s("Merge ", c("o_orderkey"))).otherwise(s("feat: ", c("o_orderkey")))
    record = s(c("o_orderkey"), "\x1f", c("o_custkey"), "\x1f", F.date_format("o_orderdate", "yyyy-MM-dd"), "\x1f", subject, "\x1f\x1f", body, "\n\x1e")
    return t.orders.select(record.alias("value"))


_LOG = "SELECT o_orderkey::VARCHAR AS hash, o_custkey::VARCHAR AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderstatus = 'P' THEN 'Merge ' ELSE 'feat: ' END || o_orderkey AS subject, CASE o_orderpriority WHEN '5-LOW' THEN 'docs/a.md,README.md' WHEN '1-URGENT' THEN 'src/x.py,docs/b.md' ELSE 'src/y.py' END AS files FROM orders"


@query("scan_git_log", _LOG)
def scan_git_log(t: Tables):
    return files.git_log(_log(t)).select("hash", "author", "date", "subject", F.array_join("files", ",").alias("files"))


@query("scan_code_commits", f"SELECT hash, regexp_extract(files, '^([^,]*)', 1) AS files FROM ({_LOG}) WHERE date >= '1995-01-01' AND NOT starts_with(subject, 'Merge') AND starts_with(files, 'src')")
def scan_code_commits(t: Tables):
    return files.code_commits(files.git_log(_log(t)), "1995-01-01").select("hash", F.array_join("files", ",").alias("files"))


def _paths(t: Tables):
    end = F.when(c("p_size") % 4 == 0, ".py").when(c("p_size") % 4 == 1, ".TS").when(c("p_size") % 4 == 2, ".md").otherwise("")
    return t.part.select("p_partkey", s("/r/", F.when(c("p_size") > 40, "node_modules/").otherwise(""), c("p_brand"), "/f", c("p_partkey"), end).alias("path"), c("p_name").alias("value"))


@query("scan_source_tree", "SELECT p_name AS value, CASE p_size % 4 WHEN 0 THEN 'python' ELSE 'typescript' END AS language FROM part WHERE p_size % 4 < 2 AND p_size <= 40")
def scan_source_tree(t: Tables):
    return files.sources_of(_paths(t), ["node_modules"]).select("value", "language")


@query("scan_markdown_tree", "SELECT p_name AS value FROM part WHERE p_size % 4 = 2")
def scan_markdown_tree(t: Tables):
    return files.markdown_of(_paths(t)).select("value")


@query("scan_dir_tree", "SELECT 'f' || p_partkey AS name, p_brand AS folder, FALSE AS is_dir, p_size::BIGINT AS length FROM part UNION ALL SELECT DISTINCT p_brand, '', TRUE, NULL::BIGINT FROM part")
def scan_dir_tree(t: Tables):
    return files.tree_of(t.part.select(s(c("p_brand"), "/f", c("p_partkey")).alias("path"), c("p_size").cast("long").alias("length")))


@query("scan_eval_dirs", "SELECT l_orderkey::INT AS eval_id, l_returnflag AS config, l_linenumber AS run_number, l_discount AS pass_rate, l_linenumber AS total FROM lineitem WHERE l_linestatus = 'F'")
def scan_eval_dirs(t: Tables):
    body = F.when(c("l_linestatus") == "F", F.to_json(F.struct(F.struct(c("l_discount").alias("pass_rate"), c("l_linenumber").alias("total")).alias("summary")))).otherwise("{")
    d = t.lineitem.select(s("/eval-", c("l_orderkey"), "/", c("l_returnflag"), "/run-", c("l_linenumber"), "/grading.json").alias("path"), body.alias("value"))
    return files.eval_runs_of(d).select("eval_id", "config", "run_number", "pass_rate", "total")


def _rows(options: dict, columns: list[str]) -> list[tuple]:
    """Rows of a page of a table, as a service would serve it."""
    from pyarrow import dataset

    k, size = int(options["page"]), int(options["size"])
    found = dataset.dataset(options["table"], format="parquet").to_table(columns=columns).sort_by(columns[0]).slice(k * size, size)
    return list(zip(*(c.to_pylist() for c in found.columns)))


def _catalog(options: dict, k: int) -> list[tuple]:
    return [(k, *r) for r in _rows(options | {"page": k}, ["p_partkey", "p_name", "p_type"])]


def _pages(options: dict) -> list[str]:
    """Addresses of a service's pages: the files of its folder that have rows."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(options["table"])
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet"))


def _results(options: dict, page: str) -> Iterator[tuple]:
    """What a page holds of a query's results; a row at a time, as texts may be long."""
    from pyarrow import fs, parquet

    with fs.FileSystem.from_uri(options["table"])[0].open_input_file(page) as file:
        for batch in parquet.ParquetFile(file).iter_batches(64, columns=["doc_id", "source", "text"]):
            for doc_id, source, text in zip(*(x.to_pylist() for x in batch.columns)):
                if options["query"] in (text or "").lower():
                    yield doc_id, source, text[:3000]


@query("scan_remote_catalog", "SELECT ((row_number() OVER (ORDER BY p_partkey) - 1) // 97)::INT AS page, p_partkey, p_name, p_type FROM part")
def scan_remote_catalog(t: Tables):
    """All pages of a catalog that serves parts by 97."""
    pages = -(-t.part.count() // 97)
    return paged.read(t.spark, paged.paged_source("catalog", "page int, p_partkey long, p_name string, p_type string", _catalog), table=f"{t.dir}/part.parquet", size="97", pages=str(pages))


@query("scan_web_search", "SELECT doc_id, source, substr(text, 1, 3000) AS snippet FROM documents WHERE contains(lower(text), 'heed') ORDER BY doc_id LIMIT 40")
def scan_web_search(t: Tables):
    """The first forty results of a search that is served by pages of 500 documents, with snippets of 3000 characters. Spark writes the pages, so that no page needs a pass over the table, and the table may be where only Spark reads."""
    at = new_folder(t.spark, "search")
    t.documents.select("doc_id", "source", "text").write.option("maxRecordsPerFile", 500).parquet(at)
    d = paged.read(t.spark, paged.paged_source("search", "doc_id long, source string, snippet string", _results, _pages), table=at, query="heed")
    return d.orderBy(F.col("doc_id").asc_nulls_last()).limit(40)


@query("scan_chat_messages", "SELECT conv_id, turn FROM conversations WHERE turn BETWEEN 1 AND 3 AND contains(lower(text), 'the')")
def scan_chat_messages(t: Tables):
    return t.conversations.where(c("turn").between(1, 3) & F.lower("text").contains("the")).select("conv_id", "turn")


def _embed(texts: list[str]) -> list[tuple[int, list[float]]]:
    return [(i, [float(len(x)), float(x.count("a"))]) for i, x in reversed(list(enumerate(texts)))]


@query("scan_embeddings_api", "SELECT doc_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS b FROM documents")
def scan_embeddings_api(t: Tables):
    return paged.embedded(t.documents, "doc_id", "text", _embed).select("doc_id", c("embedding")[0].cast("double").alias("a"), c("embedding")[1].cast("double").alias("b"))


def _linted(t: Tables):
    md = s("# My Great Title\n\ntext ", c("p_brand"), "\n- item\n\n```\n", "{\"a\": ", c("p_size"), "}\n```\n", c("p_name"), "\n1. one")
    return C.lint(t.part.select("p_partkey", md.alias("text")), "p_partkey", "text")


@query("fn_blank_before_list", "SELECT p_partkey, line FROM part, (VALUES (4), (11)) v(line)")
def fn_blank_before_list(t: Tables):
    return _linted(t).where("rule = '6.1'").select("p_partkey", "line")


@query("style_rules_3_1_4_1", "SELECT p_partkey, rule, line, after FROM part, (VALUES ('3.1', 1, '# My great title'), ('4.1', 6, '```json')) v(rule, line, after)")
def style_rules_3_1_4_1(t: Tables):
    return _linted(t).where("rule in ('3.1', '4.1')").select("p_partkey", "rule", "line", "after")


def _polls(options: dict, cursor: int) -> tuple[list[tuple], int]:
    """What a service has after a cursor: up to ``size`` rows of a table, and the cursor after them."""
    from pyarrow import dataset

    found = dataset.dataset(options["table"], format="parquet").to_table(columns=["o_orderkey", "o_orderstatus"]).sort_by("o_orderkey").slice(cursor, int(options["size"]))
    return list(zip(*(c.to_pylist() for c in found.columns))), cursor + found.num_rows


def _polled(t: Tables, at: str, size: int, rounds: int) -> None:
    """Runs the long poll from where the checkpoint has it, for a number of rounds, and stops as a process would."""
    source = paged.polled_source("orders_poll", "o_orderkey long, o_orderstatus string", _polls)
    stream = paged.read_stream(t.spark, source, table=f"{t.dir}/orders.parquet", size=str(size))
    q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").start()
    try:
        for _ in range(rounds):
            q.processAllAvailable()
    finally:
        q.stop()


@query("scan_long_poll", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_long_poll(t: Tables):
    """Orders as a service hands them out after a cursor, a fifth at a time, until there are no more."""
    at, n = new_folder(t.spark, "poll"), t.orders.count()
    _polled(t, at, n // 5 + 1, 1)
    return t.spark.read.schema("o_orderkey long, o_orderstatus string").parquet(f"{at}/rows")


@query("stream_cursor_resume", "SELECT o_orderkey, o_orderstatus, 1::BIGINT AS times FROM orders")
def stream_cursor_resume(t: Tables):
    """The same, stopped and started again twice: the checkpoint's cursor neither loses nor repeats an order."""
    at, n = new_folder(t.spark, "poll"), t.orders.count()
    for _ in range(3):
        _polled(t, at, n // 4 + 1, 1)
    d = t.spark.read.schema("o_orderkey long, o_orderstatus string").parquet(f"{at}/rows")
    return d.groupBy("o_orderkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("times"))


@query("sink_atomic_cursor", "SELECT n_name AS account, CASE WHEN n_nationkey % 5 = 4 THEN 'none' ELSE 'c' || n_regionkey || '-' || n_nationkey END AS cursor FROM nation")
def sink_atomic_cursor(t: Tables):
    """Cursors of nations (a fixed table) saved twice, some forgotten, and loaded."""
    cursors = sinks.Cursors(tempfile.mkdtemp())  # the polling driver's own files
    rows = t.nation.select("n_name", "n_nationkey", "n_regionkey").collect()
    for r in rows:
        cursors.save(r.n_name, "old")
        cursors.save(r.n_name, f"c{r.n_regionkey}-{r.n_nationkey}")
        if r.n_nationkey % 5 == 4:
            cursors.forget(r.n_name)
    return t.spark.createDataFrame([(r.n_name, cursors.load(r.n_name, "none")) for r in rows], "account string, cursor string")


@query("sink_jsonl_append", "SELECT event_id, event_type, value FROM events")
def sink_jsonl_append(t: Tables):
    """Events appended in two parts, and read back."""
    at = new_folder(t.spark, "jsonl")
    d = t.events.select("event_id", "event_type", "value")
    for k in range(2):
        sinks.append_json(d.where(F.col("event_id") % 2 == k), at)
    return t.spark.read.schema(d.schema).json(at)


@query("stream_log_rotation", "SELECT event_id, ts::DATE AS day FROM events WHERE ts::DATE >= (SELECT min(d) FROM (SELECT DISTINCT ts::DATE AS d FROM events ORDER BY d DESC LIMIT 7))")
def stream_log_rotation(t: Tables):
    """A log by day that keeps seven days: rows come in two batches, and days are dropped after each."""
    name, at = f"log_{uuid.uuid4().hex}", new_folder(t.spark, "log")
    d = t.events.select("event_id", F.to_date("ts").alias("day"))
    for k in range(2):
        sinks.log_daily(d.where(F.col("event_id") % 2 == k), "day", name, at, keep=None if k == 0 else 7)
    return t.spark.table(name)


@query("stream_fanout", """SELECT 'all' AS sink, event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'errors', event_type, count(*) FROM events WHERE event_type = 'error' GROUP BY event_type""")
def stream_fanout(t: Tables):
    """A stream whose batches go to two sinks: all rows, and errors."""
    at, schema = new_folder(t.spark, "fan"), t.events.schema
    put = lambda name, cond: lambda batch, k: batch.where(cond).write.mode("overwrite").parquet(f"{at}/{name}/batch={k}")
    t.events.repartition(5).write.parquet(f"{at}/in")
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    q = St.fan_out(stream, [put("all", "true"), put("errors", "event_type = 'error'")]).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = [t.spark.read.schema(schema).parquet(f"{at}/{name}").select(F.lit(name).alias("sink"), "event_type") for name in ("all", "errors")]
    return parts[0].unionByName(parts[1]).groupBy("sink", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _workbook(key: int, name: str, total: int) -> bytes:
    """A spreadsheet of two sheets, with shared and inline texts, formulas and a failed cell for each third."""
    failed = "#DIV/0!" if key % 3 == 0 else "#REF!" if key % 3 == 1 else str(total)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda cells: f'<worksheet xmlns="{main}"><sheetData><row r="1">{cells}</row></sheetData></worksheet>'
    one = f'<c r="A1" t="s"><v>0</v></c><c r="B1"><f>SUM(C1:C9)</f><v>{total}</v></c><c r="C1" t="e"><f>1/0</f><v>{failed}</v></c>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sum" sheetId="1" r:id="r1"/><sheet name="Names" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>total of {key}</t></si></sst>',
        "xl/worksheets/sheet1.xml": sheet(one),
        "xl/worksheets/sheet2.xml": sheet(f'<c r="A1" t="inlineStr"><is><t>{escape(name)}</t></is></c>'),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, text in parts.items():
            z.writestr(path, text)
    return out.getvalue()


@query(
    "scan_xlsx_cells",
    """WITH b AS (SELECT p_partkey, p_name, p_size, CASE p_partkey % 3 WHEN 0 THEN '#DIV/0!' WHEN 1 THEN '#REF!' ELSE p_size::VARCHAR END AS failed FROM part)
SELECT p_partkey || '.xlsx' AS path, sheet, cell, value, formula FROM b, LATERAL (VALUES ('Sum', 'A1', 'total of ' || p_partkey, NULL), ('Sum', 'B1', p_size::VARCHAR, 'SUM(C1:C9)'), ('Sum', 'C1', failed, '1/0'), ('Names', 'A1', p_name, NULL)) v(sheet, cell, value, formula)""",
)
def scan_xlsx_cells(t: Tables):
    """Cells of a workbook for each part."""
    books = C.per_document(t.part.select("p_partkey", "p_name", "p_size"), "path string, content binary", lambda k, n, z: iter([(f"{k}.xlsx", _workbook(k, n, z))]))
    return xlsx.cells(books)
