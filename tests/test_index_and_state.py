import difflib
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import text as T
from tessera.operators import corpus, evals, retrieval, sessions
from tessera.operators.bm25_index import Bm25Index
from tessera.sources import sinks
from tessera.tools import TOOLS


@pytest.fixture
def docs(spark):
    rows = [(1, "Alpha", "beta beta gamma"), (2, "beta", None), (3, None, "gamma delta delta"), (None, "alpha", "alpha"), (4, "", "")]
    return spark.createDataFrame(rows, "doc_id long, name string, body string")


def test_index_equals_a_pass_over_the_documents(docs, tmp_path):
    i = Bm25Index(docs.sparkSession, str(tmp_path / "i"), "doc_id", ["name", "body"], 3).build(docs)
    whole = docs.where("doc_id is not null")
    for query in (["beta"], ["alpha", "gamma", "gamma"], ["nothing"], [], ["delta", "beta"]):
        for weights in ({"name": 4, "body": 1}, {"body": 1}):
            want = {r.doc_id: pytest.approx(r.score) for r in retrieval.bm25_search(whole, "doc_id", query, 10, weights).collect()}
            assert {r.doc_id: r.score for r in i.search(query, 10, weights).collect()} == want
    assert {r.term: r.df for r in i.document_frequency().collect()} == {"alpha": 1, "beta": 2, "gamma": 2, "delta": 1}


def test_index_reads_the_terms_of_a_query_only(docs, tmp_path):
    i = Bm25Index(docs.sparkSession, str(tmp_path / "i"), "doc_id", ["name", "body"], 8).build(docs)
    plan = i.search(["beta"], 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket").replace("[(bucket", "[bucket") or "PartitionFilters: [" in plan
    assert "EqualTo(term,beta)" in plan or "In(term, [beta])" in plan


def test_index_refresh_forgets_what_it_replaces(docs, tmp_path):
    spark = docs.sparkSession
    i = Bm25Index(spark, str(tmp_path / "i"), "doc_id", ["name", "body"], 3).build(docs)
    new = spark.createDataFrame([(1, "omega", "omega"), (9, "beta", "beta")], docs.schema)
    i.refresh(new, spark.createDataFrame([(3,)], "doc_id long"))
    i.refresh(new.where("doc_id = 9").withColumn("body", F.lit("zeta")))
    now = spark.createDataFrame([(1, "omega", "omega"), (2, "beta", None), (4, "", ""), (9, "beta", "zeta")], docs.schema)
    for query in (["beta"], ["omega"], ["gamma"], ["zeta", "beta"]):
        want = {r.doc_id: pytest.approx(r.score) for r in retrieval.bm25_search(now, "doc_id", query, 10, {"name": 1, "body": 1}).collect()}
        assert {r.doc_id: r.score for r in i.search(query).collect()} == want


def test_index_of_nothing(spark, docs, tmp_path):
    i = Bm25Index(spark, str(tmp_path / "i"), "doc_id", ["name", "body"]).build(docs.where("false"))
    assert i.search(["beta"]).collect() == [] and i.generation() == 0


def test_numbered_equals_row_number(spark):
    rows = [(k, "ab"[k % 7 == 0] if k % 11 else None, (k * 37) % 50 if k % 13 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(4)
    for falling in (False, True):
        got = {r.id: r.place for r in sessions.numbered(df, ["g"], F.col("v"), ["id"], "place", falling, parts=8).collect()}
        for g in ("a", "b", None):
            order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0) if falling else (r[2] or 0), r[0]))
            assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
    assert sessions.numbered(df.where("false"), ["g"], F.col("v"), ["id"], "place").collect() == []


def test_fusion_of_three_lists(spark):
    rows = [("a", "x", "local", 1, 9.0), ("a", "y", "remote", 2, 8.0), ("b", "z", "remote", 1, 7.0), ("c", "own", "local", None, 0.5)]
    df = spark.createDataFrame(rows, "name string, strategy string, source string, rank int, score double")
    got = {r.name: r for r in retrieval.fuse(df, strategies=("x", "y", "z")).collect()}
    assert (got["a"].match_type, got["b"].match_type, got["c"].match_type) == ("hybrid", "z", "listed")
    assert got["a"].score == pytest.approx(1 / 61 + 1 / 62) and got["c"].score == 0.5 and got["a"].source == "local"


def test_page_text_survives_open_frames():
    assert corpus.page_text("<aside><nav>x</aside><p>kept text</p>") == "kept text"
    assert corpus.page_text("<nav><ul><li>menu<article><h1>Title</h1><p>body</article>") == "# Title\nbody"
    assert corpus.page_text("<header><p>a</header><p>b<footer>c") == "b"
    assert corpus.page_text(None) == "" and corpus.page_text("<p>" + "x" * 20, 5) == "xxxxx"


def test_page_text_decodes_whole_references():
    assert corpus.page_text("<h1>a&amp</h1><p>&lt;b&gt; &copyright &notit; &#39;&#x41; &#65 & &quo &amp;lt;") == "# a&amp\n<b> &copyright &notit; 'A &#65 & &quo &lt;"
    assert corpus.page_text("<p>\n a\u00a0\f") == "a\u00a0"


@pytest.mark.parametrize("name", ["fn_html_main_text", "scan_http_page"])
def test_pages_that_are_odd_equal_sql(spark, tmp_path, name):
    import duckdb

    page = "<html><head><title>x &amp{0}</title></head><body><nav><li>menu</nav><article><h1>x &amp{0}</h1><p>body &amp;lt; &quo</article></body></html>"
    rows = [(1, "a", page.format("")), (1, "a", page.format(" y")), (1, "b", page.format("")), (None, "c", page.format("")), (2, None, page.format("&copy"))]
    rows += [(3, "d", None), (4, "e", "<p>no content"), (5, "f", "<article></article>"), (6, "g", f"<article>{'z ' * 9000}</article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(plans.ORACLES[name])
    got = plans.QUERIES[name](spark, str(tmp_path)).select(*[d[0] for d in want.description]).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want.fetchall(), key=str)


def test_scan_http_page_has_every_page(spark, tmp_path):
    import duckdb

    top = "<html><head><title>title</title><script>'<main>'</script></head><body><header><h1>site</h1><nav>menu</nav>line</header>"
    pages = {
        "<p>a<article><h2>b</h2></article>c": "## b",
        top + "<p>a<article>b</article><p>c<article>d</article><p>e</body></html>": "b\ncd",
        top + "<p>a<main><h1>b</h1><article>c</article><p>d</main><article>e</article>": "# bc\nd",
        top + "<p>a<article class='x'>b</article>c": "b",
        top + "<p>a<ARTICLE>b</ARTICLE>c": "b",
        top + "<p>a<article>b<p>cut": "b\ncut",
        top + "<p>a<article></article>b": "",
        top + "<p>a<aside>b<footer>c</footer>d</aside><div>e</div></body>f": "a\ne",
        top + "<!-- <article>old</article> --><ul><li>a<li>b<footer>c": "- a\n- b",
        top + "<main>a<nav>b<article>c</article>d</main>": "acd",
        "<title>a</title><p>b": "a\nb",
        "a &amp; b": "a & b",
        "": "",
        None: "",
    }
    rows = [(k, f"u{k}", html) for k, html in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in plans.QUERIES["scan_http_page"](spark, str(tmp_path)).select("page_id", "url", "text").collect())
    assert got == [(k, url, pages[html]) for k, url, html in rows]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(duck.execute(plans.ORACLES["scan_http_page"]).fetchall()) == got


def test_locked_artifacts(spark):
    rows = [(k, p) for k, p in enumerate(["a/Report.docx", "a/report_v2.docx", "b/plan.docx", "a/Report.docx", "n.txt", "x.pdf", "x_final.pdf", "y.DOCX", "z.md"])]
    df = spark.createDataFrame([("r", *r) for r in rows], "run string, at int, path string")
    got = {r["at"]: r.existing for r in evals.locked_artifacts(df, "run", ["at"], "path").collect()}
    assert got == {0: None, 1: "a/Report.docx", 2: None, 3: None, 4: None, 5: None, 6: "x.pdf", 7: None, 8: None}
    got = {r["at"]: r.existing for r in evals.locked_artifacts(df, "run", ["at"], "path", preferred=".pdf").collect()}
    assert got[7] == got[8] == "x.pdf" and got[6] == "x.pdf" and got[4] is None and got[1] == "a/Report.docx"


def test_duplicate_entries(spark):
    texts = ["the quick brown fox jumps", " quick brown fox ", "fox", "brown  fox", "", None, "ick brown fox ju", "   ", "the quick brown fox jumps over"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, "fox"), (2, 1, "quick brown fox")], "owner long, at long, text string")
    got = {(r.owner, r["at"]): r.duplicate for r in sessions.duplicate_entries(df, "owner", "at", "text").collect()}
    assert [k for k, d in got.items() if d] and {k for k, d in got.items() if d} == {(1, 1), (1, 2), (1, 4), (1, 6), (1, 7)}


def test_duplicate_entries_that_repeat_a_place_or_text(spark):
    rows = [(1, 0, "one two three four"), (1, 1, "two three"), (1, 1, "zero"), (1, 1, "two three"), (1, 2, "zero"), (1, 2, " zero "), (1, None, "zero"), (None, 0, "a"), (None, 1, "a"), (2, 0, "zero")]
    df = spark.createDataFrame(rows, "owner long, at long, text string")
    want = [(*a, any(b[0] is not None and b[0] == a[0] and None not in (a[1], b[1]) and b[1] < a[1] and a[2].strip() in b[2] for b in rows)) for a in rows]
    got = [tuple(r) for r in sessions.duplicate_entries(df, "owner", "at", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[3] for r in got) == 4


def test_duplicate_entries_broadcast_no_words(spark, tmp_path):
    spark.createDataFrame([(1, k, f"w{k} some more words") for k in range(9)], "owner long, at long, text string").write.parquet(f"{tmp_path}/e")
    plan = sessions.duplicate_entries(spark.read.parquet(f"{tmp_path}/e"), "owner", "at", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "BroadcastExchange" not in plan


def test_routes(spark):
    calls = spark.createDataFrame([("a",), ("a",), ("b",), ("zz",)], "tool string")
    workers = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, [])], "w long, can array<string>")
    got = sorted((r.tool, r.w) for r in evals.route(calls, "tool", workers, "w", "can").collect())
    assert got == [("a", 1), ("a", 2), ("b", 2), ("zz", 1), ("zz", 2), ("zz", 3)]


def test_slim_results_and_outputs(spark):
    rows = ["x" * 400, "[1]", "{broken", '{"skill_name": "s", "ok": false}', '{"summary": "did", "ok": null}', '{"results": [{"tool": "t", "error": "bad"}, {"result": {"a": 1}}]}', '{"other": 1}', None]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string").orderBy("k").select(T.slim_result(F.col("x"))).collect()]
    assert got[0] == "x" * 300 + "...[truncated]" and got[1:3] == ["[1]", "{broken"]
    assert got[3] == "[tool: s] FAIL — " and got[4] == "[tool: unknown] ? — did"
    assert got[5] == '[batch results]\n  - t: FAIL — bad\n  - unknown: OK — {"a":1}' and got[6] == '{"other": 1}' and got[7] is None
    outs = ['{"output": "", "summary": "s"}', '{"result": 7}', "plain", '{"none": 1}', "{bad", '["output"]']
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(outs)], "k int, x string").orderBy("k").select(T.step_output(F.col("x"))).collect()]
    assert got == ["s", "7", "plain", '{"none": 1}', "{bad", '["output"]']


def test_cursors_are_replaced_as_a_whole(tmp_path, monkeypatch):
    c = sinks.Cursors(str(tmp_path / "c"))
    assert c.load("a") == "" and c.load("a", "first") == "first"
    c.save("a", "1")
    c.save("../b", "é")
    assert (c.load("a"), c.load("../b")) == ("1", "é") and sorted(os.listdir(tmp_path)) == ["c"]
    monkeypatch.setattr(json, "dump", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        c.save("a", "2")
    assert c.load("a") == "1" and not [f for f in os.listdir(tmp_path / "c") if f.endswith(".tmp")]
    monkeypatch.undo()
    (tmp_path / "c" / os.path.basename(c._file("a"))).write_text("{torn")
    assert c.load("a", "none") == "none"
    c.forget("a")
    c.forget("a")


def test_log_keeps_its_last_days(spark, tmp_path):
    d = spark.createDataFrame([(k, f"2024-01-{1 + k % 9:02d}") for k in range(90)], "id long, day string")
    sinks.log_daily(d, "day", "kept_log", str(tmp_path / "log"), keep=3)
    assert {r.day for r in spark.table("kept_log").select("day").distinct().collect()} == {"2024-01-07", "2024-01-08", "2024-01-09"}
    assert spark.table("kept_log").count() == 30 and sinks.retain(spark, "kept_log", "day", 3) == 0
    spark.sql("DROP TABLE kept_log")


def test_tools(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\ntwo fox\nthree")
    assert "grep" in TOOLS and "nothing" not in TOOLS and TOOLS.schema("nothing") is None
    assert TOOLS.schema("grep")["required"] == ["path", "pattern"] and "- search: " in TOOLS.summary()
    at = str(tmp_path / "a")
    assert [r.line for r in TOOLS.call(spark, "grep", {"path": at, "pattern": "fox"}).collect()] == ["two fox"]
    assert [(r.line_no, r.line) for r in TOOLS.call(spark, "read_file", {"path": at, "start": 2, "stop": None}).collect()] == [(2, "two fox"), (3, "three")]
    assert TOOLS.call(spark, "fly", {}) == "ERR: unknown tool 'fly'"
    assert TOOLS.call(spark, "grep", {"path": at}) == "ERR: grep needs pattern"
    assert TOOLS.call(spark, "grep", {"path": at, "pattern": "x", "most": "3"}) == "ERR: most of grep must be integer"
    assert TOOLS.call(spark, "list_dir", {"path": at, "deep": 1}) == "ERR: list_dir takes no deep"
    spark.createDataFrame([(1, "red fox"), (2, "blue")], "id long, t string").write.parquet(f"{tmp_path}/t")
    assert [r.id for r in TOOLS.call(spark, "search", {"path": f"{tmp_path}/t", "query": "Fox", "key": "id", "text": "t"}).collect()] == [1]


def test_close_matches_are_ordered_by_ratio(spark):
    known = ["alpha", "alphas", "alp", "beta", "betas", "gamma", "alpine"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(["alph", "bet", "zzzz", "", None, "gammas"])], "id long, name string")
    got = {}
    for r in corpus.close_matches(df, "id", "name", known).collect():
        got.setdefault(r.id, {})[r.place] = r.match
    ratio = lambda a, b: difflib.SequenceMatcher(None, b, a).ratio()
    for k, x in ((0, "alph"), (1, "bet"), (5, "gammas")):
        scores = [ratio(x, got[k][p]) for p in sorted(got[k])]
        assert scores == sorted(scores, reverse=True) and min(scores) >= 0.5 and len(scores) <= 3
        assert scores[0] == max(ratio(x, y) for y in known)
    assert not {2, 3, 4} & set(got)
