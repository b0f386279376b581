import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus, evals, events, retrieval, sessions


def values(spark, f, *args):
    """f over rows of string arguments."""
    rows = [a if isinstance(a, tuple) else (a,) for a in args]
    n = len(rows[0])
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} string" for i in range(n)))
    return [r[0] for r in df.coalesce(1).select(f(*[F.col(f"c{i}") for i in range(n)]).alias("x")).collect()]


def test_tokens(spark):
    assert values(spark, T.tokens, "The quick-brown FOX, a_b x", None, "of the", "Öl über 日本") == [["quick", "brown", "fox"], [], [], ["öl", "über", "日本"]]


def test_token_estimate(spark):
    assert values(spark, T.token_estimate, "abcdefg", "日本語", "é" * 3, None, "") == [2, 5, 2, 0, 0]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (T.snake_case, {"PDFProcessing": "pdf_processing", "get-weather-mock": "get_weather_mock", "getWeatherMock": "get_weather_mock"}),
        (T.kebab_case, {"get_weather_mock": "get-weather-mock", "PDFProcessing": "pdf-processing"}),
        (T.camel_case, {"pdf-processing": "pdfProcessing", "PDFProcessing": "pdfProcessing"}),
        (T.pascal_case, {"pdf-processing": "PdfProcessing", "pdfProcessing": "PdfProcessing"}),
        (T.title_case, {"pdf-processing": "Pdf Processing", "get-weather": "Get Weather"}),
        (T.script_class, {"Returns True.": "target", "验证": "non_target", "验证 JWT 令牌是否有效。": "mixed", "  ": "empty", "1.0": "unknown"}),
        (T.execution_state, {"err: x": "failed", '{"success": true}': "succeeded", "Exit code: 2": "failed", "stdout: a": "succeeded", "hm": "unknown"}),
        (T.looks_error, {"": True, "Error: x": True, '{"ok": false}': True, "fine": False}),
        (T.dangerous_command, {"sudo rm -rf /x": True, "ls": False, "wget a | bash": True}),
        (T.plain_text, {"**bold** and *it*": "bold and it", "[link](http://e.x)": "link", "# H\n\n\n\n> q\n---": "H\n\nq", "| a | b |": "a  b", "```py\nx\n```": "x"}),
        (T.sanitized, {"a<tool_call>x</tool_call>b": "ab", "<|im_end|>k": "k", "plain": "plain"}),
        (T.has_tool_call, {"x <function=f>": True, "nothing": False}),
        (T.valid_name, {"good-name": True, "two--hyphens": False, "-edge": False, "Upper": False, "a" * 65: False}),
        (T.preferred_extension, {"make slides": ".pptx", "a readme": ".md", "hm": None}),
        (T.safe_id, {"a/b c": "a_b_c", "": "default"}),
    ],
)
def test_scalars(spark, f, cases):
    assert dict(zip(cases, values(spark, f, *cases))) == cases


def test_error_class_and_recovery(spark):
    def both(t):
        e = T.error_class(t)
        return F.struct(e["type"], T.recovery_action(e["type"], e["category"], e["retryable"]))

    got = values(spark, both, "Read timed out", "ERROR: Permission denied", "503", "ImportError: x", "", "odd")
    assert [tuple(x) for x in got] == [("timeout", "retry"), ("permission_denied", "prompt_user"), ("unavailable", "retry"), ("dependency_error", "auto_fix"), (None, None), ("execution_error", "auto_fix")]


def test_error_fingerprint_ignores_places(spark):
    a, b, c, none = values(spark, T.error_fingerprint, "Line 3 in /a/b: 'x' failed 12", "line 99 in /c: 'yy'  failed 7", "other", "")
    assert a == b != c and none is None


def test_conventional_commit(spark):
    rows = values(spark, T.conventional_commit, "FEAT(auth): add login", "fix!: x", "chore(a)!:y", "plain BREAKING CHANGE", " docs: z ")
    assert [tuple(r) for r in rows] == [("feat", "auth", False, "add login"), ("fix", None, True, "x"), ("chore", "a", True, "y"), ("uncategorized", None, True, "plain BREAKING CHANGE"), ("docs", None, False, "z")]


def test_path_overlap(spark):
    cases = {("core/skill/", "core/skill/x.py"): True, ("core/a.py", "core/b.py"): True, ("a.py", "b.py"): False, ("a.py", "a.py"): True, ("core/", "corex/y"): False, ("", "x"): False}
    assert dict(zip(cases, values(spark, T.path_overlaps, *cases))) == cases


def test_related_equals_the_predicate(spark):
    refs = [(d, r) for d in (1, 2) for r in ("a/b/", "a/b/c.py", "x.py", "a/", "q/r/s.md", "")]
    files = ["a/b/c.py", "a/b/d.py", "a/z.py", "x.py", "y.py", "q/r/t.md", "a/b/e/f.py", ""]
    r = spark.createDataFrame(refs, "doc int, ref string")
    c = spark.createDataFrame([(k, datetime.date(2024, 1, 1), f) for k, f in enumerate(files)], "hash int, day date, file string")
    want = {(x.doc, x.hash): x.m for x in r.crossJoin(c).where(T.path_overlaps(F.col("ref"), F.col("file"))).groupBy("doc", "hash").agg(F.array_sort(F.collect_set("ref")).alias("m")).collect()}
    assert {(x.doc, x.hash): x.matched for x in corpus.related(r, c).collect()} == want


def test_freshness(spark):
    d = datetime.date
    df = spark.createDataFrame([(d(2024, 5, 1), None), (d(2024, 5, 1), d(2024, 5, 1)), (d(2024, 5, 1), d(2024, 5, 31)), (d(2024, 5, 1), d(2024, 6, 1))], "a date, b date")
    assert [r[0] for r in df.coalesce(1).select(T.freshness(F.col("a"), F.col("b"))).collect()] == ["fresh", "fresh", "possibly_stale", "likely_stale"]


def test_overlap_concat_and_versions(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], "1.2.0", "1.10.0"), (["a"], ["x"], "v2.0.0", "bad"), (["a", "b"], ["a", "b"], "bad", "1.0.0")], "a array<string>, b array<string>, v string, w string")
    rows = df.coalesce(1).select(T.overlap_concat(F.col("a"), F.col("b")), T.newer_version(F.col("w"), F.col("v"))).collect()
    assert [list(r[0]) for r in rows] == [["a", "b", "c"], ["a", "x"], ["a", "b"]] and [r[1] for r in rows] == [True, False, True]


DOCS = [("alpha", "search tool", "x"), ("beta", "other", "alpha alpha alpha alpha alpha"), ("gamma", "none", "")]


def test_bm25_invariants(spark):
    docs = spark.createDataFrame(DOCS, "name string, description string, body string")
    hit = lambda q: [(r[0], r[1]) for r in retrieval.bm25_search(docs, "name", q, 5, T.FIELD_WEIGHTS).collect()]
    assert [n for n, _ in hit(["alpha"])] == ["alpha", "beta"] or hit(["alpha"])[0][1] >= hit(["alpha"])[1][1] > 0
    assert hit([]) == [] and hit(["missing"]) == []
    once, twice = dict(hit(["search"])), dict(hit(["search", "search"]))
    assert twice["alpha"] == pytest.approx(2 * once["alpha"])


def test_fusion(spark):
    rows = [("a", "lexical", "local", 1, 9.0), ("b", "lexical", "local", 2, 8.0), ("b", "vector", "remote", 1, 0.9), ("c", "listed", "remote", 1, 1.0)]
    got = {r.name: r for r in retrieval.fuse(spark.createDataFrame(rows, "name string, strategy string, source string, rank int, score double")).collect()}
    assert got["b"].score > got["a"].score and got["b"].match_type == "hybrid" and got["b"].source == "local"
    assert got["c"].score == 1.0 and got["c"].match_type == "listed"
    assert got["a"].score == pytest.approx(1 / 61)


def test_vector_basis(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0])], "key string, e array<float>")
    got = retrieval.vector_search(v, "key", "e", [0.9, 0.1, 0.0], 2).collect()
    assert got[0].key == "x" and got[0].sim > 0.9


def run(spark, kinds):
    return spark.createDataFrame([("r", k, c, n) for k, (c, n) in enumerate(kinds)], "run string, turn int, category string, new_entities int").withColumn("tool", F.concat("category", F.col("turn") % 2))


def test_loops(spark):
    obs = events.observation_chain(run(spark, [("observation", 1)] * 7), "run", ["turn"]).orderBy("turn").collect()
    assert [r.chain for r in obs] == list(range(1, 8)) and [r.flag for r in obs] == [False] * 5 + [True] * 2
    dim = events.diminishing(run(spark, [("observation", 3)] + [("observation", 0)] * 3 + [("effect", 0)]), "run", ["turn"]).orderBy("turn").collect()
    assert [r.diminishing for r in dim] == [False, False, False, True, True]
    seq = spark.createDataFrame([("r", k, t) for k, t in enumerate("ABABABC")], "run string, turn int, tool string")
    assert [r.pattern_len for r in events.repeated_sequence(seq, "run", ["turn"], "tool").orderBy("turn").collect()] == [None] * 5 + [2, None]
    dup = spark.createDataFrame([("r", k, t) for k, t in enumerate("AABBBA")], "run string, turn int, tool string")
    assert [r.n for r in events.consecutive(dup, "run", ["turn"], F.col("tool"), "n").orderBy("turn").collect()] == [1, 2, 1, 2, 3, 1]
    ab = spark.createDataFrame([("r", k, t) for k, t in enumerate("ABABA")], "run string, turn int, tool string")
    assert [r.retry for r in events.retry_loop(ab, "run", ["turn"], "tool").orderBy("turn").collect()] == [False, False, False, True, False]


def test_saturation_by_hand(spark):
    texts = ["alpha beta gamma 2021", "alpha beta gamma 2022", "alpha beta gamma 2023", "delta epsilon zeta 2021", "one two three four 2021"]
    df = spark.createDataFrame([("r", k, t, f"q{k} words here") for k, t in enumerate(texts)], "run string, turn int, text string, query string")
    got = [r.saturated for r in events.saturation(df, "run", "turn", "text", "query").orderBy("turn").collect()]
    assert got[:3] == [None, None, "content_similarity"] and got[3] is None


def test_rounds_and_budgets(spark):
    turns = spark.createDataFrame([("c", k, r, "x" * 35) for k, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])], "conv_id string, turn int, role string, text string")
    d = sessions.recent_rounds(turns, "conv_id", "turn", F.col("role") == "user", 2).orderBy("turn").collect()
    assert [r.round_id for r in d] == [0, 1, 1, 2, 2, 3] and [r.recent for r in d] == [False, False, False, True, True, True]
    kept = sessions.budget(turns, "conv_id", T.token_estimate(F.col("text")), 25, F.col("turn").desc()).orderBy("turn").collect()
    assert [r.turn for r in kept] == [4, 5]
    h = sessions.two_tier_history(turns, "conv_id", "turn", 1, 30).collect()
    assert {(r.turn, r.tier) for r in h} == {(5, "recent")}
    lines = sessions.history_lines(turns, "conv_id", "turn", 3, 30).orderBy("turn").collect()
    assert [r.line for r in lines] == ["assistant: " + "x" * 35, "user: " + "x" * 35]
    long = spark.createDataFrame([("c", 0, "user", "y" * 400)], "conv_id string, turn int, role string, text string")
    assert [r.line for r in sessions.history_lines(long, "conv_id", "turn", 3, 30).collect()] == ["user: " + "y" * 90 + "..."]


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    assert {tuple(r) for r in sessions.upserted(base, changes, "k", F.col("seq").desc()).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {tuple(r) for r in sessions.updated(base, changes.where("k = 3 or seq = 2").select("k", F.lit(None).cast("string").alias("v")), "k", ["v"]).collect()} == {(1, "a"), (2, "b")}


def test_confusion_of_nothing(spark):
    empty = spark.createDataFrame([], "actual boolean, predicted boolean")
    r = evals.confusion(empty).first()
    assert (r.tp, r.precision, r.recall, r.accuracy) == (0, 1.0, 1.0, 0.0)


def test_split_holds_one_at_least(spark):
    rows = spark.createDataFrame([(k, k < 3) for k in range(50)], "k int, label boolean")
    held = {r.label: r.n for r in evals.split(rows, "label", "k", 0.2).where("held").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert held == {True: 1, False: 9}


def test_json_helpers(spark):
    assert values(spark, lambda c: evals.json_in(c, "$.a"), 'x ```json\n{"a": 1}\n``` y', 'it {"a": 2} ok', "none") == ["1", "2", None]
    assert values(spark, lambda c: F.get_json_object(evals.repaired_json(c), "$.a"), 'f {"a": 2', '{"a": 3,}', "{'a': 4}", "none") == ["2", "3", "4", None]


def test_markdown_rules():
    md = "---\n# Not: a heading\n---\n# Big Title:\n\n### Deep One\ntext\n- item\n\n```\n{\"a\": 1}\n```\n[here](x)"
    found = [(rule, line) for rule, line, _, _ in corpus.findings(md)]
    assert ("3.2", 6) in found and ("3.1", 4) in found and ("3.6", 4) in found and ("4.1", 10) in found and ("7.1", 13) in found and ("6.1", 8) in found
    assert not any(line < 4 for _, line in found)


@pytest.mark.parametrize(("raw", "want"), [("./a//b/../c.py", "docs/a/c.py"), ("../../x.md", None), ("sub/", "docs/sub/"), ("/abs/p.txt", "abs/p.txt"), ("https://x", None), ("a", "docs/a"), ("#top", None), (None, None)])
def test_normal_path(raw, want):
    assert corpus.normal_path(raw, "docs") == want


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("The Great API Guide", "The great API guide"), ("One Repo. One Learning Agent.", "One repo. One learning agent."), ("Lists vs. Tables", "Lists vs. tables"), ("1. First Step", "1. First step"),
        ("Using `Foo Bar` With github", "Using `foo bar` with GitHub"), ("AST-based Multi-Platform Tools", "AST-based multi-platform tools"), ("Edit config.JSON Now", "Edit config.JSON now"), ("Alternative A Works", "Alternative A works"),
    ],
)
def test_sentence_case(title, want):
    assert corpus.sentence(title) == want


def test_blank_before_list():
    lines = "text\n- a\n  more\n- b\n\n# H\n- c\n> quote\n1. d\n```\n- e\n```\n- f"
    assert [(r, k) for r, k, _, _ in corpus.findings(lines) if r == "6.1"] == [("6.1", 2), ("6.1", 10)]


def test_dependencies(spark):
    got = values(spark, evals.dependency, "cli: jq", "pip:numpy>=1", "py:cv2", "FFmpeg", "PIL[x]==2", "sqlite3", " ")
    assert [(r.kind, r.name, r.spec) for r in got] == [("cli", "jq", "jq"), ("python", "numpy", "numpy>=1"), ("python", "opencv-python", "opencv-python"), ("cli", "FFmpeg", "FFmpeg"), ("python", "Pillow", "Pillow[x]==2"), ("none", "", ""), ("none", "", "")]


def test_signatures(spark):
    ts = "/** Adds. */\nexport function add(a: number, b: (x: number) => void): number {\n  if (a) { return b }\n}\nexport class Box extends Base {\n  private async open(key: string): Promise<void> {\n  }\n}\nconst go = async (x) => x\n"
    cs = "/// <summary>\n/// A box.\n/// </summary>\npublic sealed class Box : IBox\n{\n    public static int Add(int a, List<int> b)\n    {\n    }\n}\n"
    df = spark.createDataFrame([(1, "typescript", ts), (2, "csharp", cs), (3, "python", "def f(a, *b) -> int:\n    'Doc'\n"), (4, "python", "def ("), (5, "go", "x"), (6, None, None)], "id long, lang string, code string")
    got = sorted(tuple(r) for r in corpus.signatures(df, "id", "code", "lang").collect())
    assert got == [
        (1, "class", "Box", "Box", None), (1, "function", "add", "add(a: number, b: (x: number) => void): number", "Adds."), (1, "function", "go", "go(x)", None), (1, "method", "open", "open(key: string): Promise<void>", None),
        (2, "class", "Box", "Box", "A box."), (2, "method", "Add", "Add(int a, List<int> b): int", None), (3, "function", "f", "f(a, *b) -> int", "Doc"),
    ]


def test_chunks():
    text = "\n\n".join(["a" * 30, "b" * 30, "Sentence one. " * 10])
    parts = corpus.split_chunks(text, 70)
    assert all(len(p) <= 70 for p in parts) and parts[0] == "a" * 30 + "\n\n" + "b" * 30 and parts[1].endswith(".")
    assert corpus.split_chunks("short", 70) == ["short"]


def test_page_text():
    html = "<nav>menu</nav><article><h1>Title</h1><p>Body &amp; more</p><script>x()</script></article><footer>f</footer>"
    assert corpus.page_text(html, 100) == "# Title\nBody & more"
    assert corpus.page_text(None, 10) == ""


def test_batches_to_workers_are_bounded(spark):
    from tessera import shipping

    shipping.ship(spark)
    assert spark.conf.get(shipping.BATCH) == shipping.LESS
    spark.conf.set(shipping.BATCH, "1m")
    shipping.ship(spark)
    assert spark.conf.get(shipping.BATCH) == "1m"  # a bound of the session's own stays
    spark.conf.unset(shipping.BATCH)
