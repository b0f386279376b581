"""Queries that look for loops, repeats and progress in ordered event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import events as E
from tessera.operators import sessions as S
from tessera.plans.registry import Tables, query

ORDER = ["ts", "event_id"]
_CAT = "CASE WHEN event_type IN ('view', 'click') THEN 'observation' WHEN event_type IN ('purchase', 'signup') THEN 'effect' ELSE 'mixed' END"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_E = f"(SELECT *, {_CAT} AS category, (trunc(value)::BIGINT % 3) AS new_entities FROM events)"


def log(t: Tables):
    kind = F.when(F.col("event_type").isin("view", "click"), "observation").when(F.col("event_type").isin("purchase", "signup"), "effect").otherwise("mixed")
    return t.events.withColumn("category", kind).withColumn("new_entities", F.col("value").cast("long") % 3)


_CHAIN = f"""SELECT *, CASE WHEN category = 'observation' THEN row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - (first_is_other)::INT ELSE 0 END AS chain FROM
(SELECT *, min(CASE WHEN category = 'observation' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS x, bool_or(category <> 'observation') OVER (PARTITION BY user_id, g) AS first_is_other FROM
(SELECT *, sum((category <> 'observation')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM {_E}))"""


@query("win_observation_chain", f"SELECT user_id, event_id, chain, chain >= 6 AS flag FROM ({_CHAIN})")
def win_observation_chain(t: Tables):
    return E.observation_chain(log(t), "user_id", ORDER).select("user_id", "event_id", "chain", "flag")


_RATIO = "SELECT *, CASE WHEN count(*) OVER v = 10 THEN avg((category = 'effect')::INT::DOUBLE) OVER v END AS ratio FROM {0} WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)"


@query("win_effect_ratio", f"SELECT user_id, event_id, round(ratio, 6) AS ratio, coalesce(ratio < 0.15, FALSE) AS low FROM ({_RATIO.format(_E)})")
def win_effect_ratio(t: Tables):
    return E.effect_ratio(log(t), "user_id", ORDER).select("user_id", "event_id", F.round("ratio", 6).alias("ratio"), "low")


_DIM = """SELECT *, CASE WHEN category = 'observation' THEN (count(*) OVER v6 >= 4 AND max(new_entities) OVER v3 <= 1 AND sum(new_entities) OVER v6 > 0) END AS hit FROM {0}
WINDOW v6 AS (PARTITION BY user_id, category ORDER BY ts, event_id ROWS 5 PRECEDING), v3 AS (PARTITION BY user_id, category ORDER BY ts, event_id ROWS 2 PRECEDING)"""
_DIMINISH = f"SELECT *, coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), FALSE) AS diminishing FROM ({_DIM})"


@query("win_diminishing", f"SELECT user_id, event_id, diminishing FROM ({_DIMINISH.format(_E)})")
def win_diminishing(t: Tables):
    return E.diminishing(log(t), "user_id", ORDER).select("user_id", "event_id", "diminishing")


_REPEAT = """SELECT *, CASE WHEN row_number() OVER w < 6 THEN NULL WHEN event_type = lag(event_type, 2) OVER w AND lag(event_type, 1) OVER w = lag(event_type, 3) OVER w THEN 2
WHEN event_type = lag(event_type, 3) OVER w AND lag(event_type, 1) OVER w = lag(event_type, 4) OVER w AND lag(event_type, 2) OVER w = lag(event_type, 5) OVER w THEN 3 END AS pattern_len FROM {0} """ + _W


@query("win_repeat_sequence", f"SELECT user_id, event_id, pattern_len FROM ({_REPEAT.format('events')})")
def win_repeat_sequence(t: Tables):
    return E.repeated_sequence(t.events, "user_id", ORDER, "event_type").select("user_id", "event_id", "pattern_len")


@query(
    "loop_detect",
    f"""WITH a AS ({_CHAIN}), b AS ({_RATIO.format('a')}), c AS ({_DIMINISH.format('b')}), d AS ({_REPEAT.format('c')}), e AS (SELECT *, row_number() OVER w AS n FROM d {_W})
SELECT user_id, event_id, CASE WHEN n < 5 THEN NULL WHEN chain >= 6 THEN 'observation_chain' WHEN ratio < 0.15 THEN 'low_effect_ratio' WHEN diminishing THEN 'diminishing_returns' WHEN pattern_len IS NOT NULL THEN 'repeating_sequence' END AS loop FROM e""",
)
def loop_detect(t: Tables):
    return E.loops(log(t), "user_id", ORDER, "event_type").select("user_id", "event_id", "loop")


_ISLAND = f"SELECT *, sum((event_type IS DISTINCT FROM p)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, lag(event_type) OVER w AS p FROM events {_W})"


@query("win_consecutive_dup", f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS dup_count FROM ({_ISLAND})")
def win_consecutive_dup(t: Tables):
    return E.consecutive(t.events, "user_id", ORDER, F.col("event_type"), "dup_count").select("user_id", "event_id", "dup_count")


@query("win_repeated_error", f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) - 1 AS repeated FROM ({_ISLAND.replace('FROM events', chr(70) + 'ROM (SELECT * FROM events WHERE event_type <> ' + chr(39) + 'view' + chr(39) + ')')})")
def win_repeated_error(t: Tables):
    return E.consecutive(t.events.where("event_type <> 'view'"), "user_id", ORDER, F.col("event_type"), "repeated", 0).select("user_id", "event_id", "repeated")


@query(
    "win_retry_loop",
    f"""SELECT user_id, event_id, (len(l) >= 3 AND len(list_distinct(l)) = 1) OR (len(l) = 4 AND len(list_distinct(l)) = 2 AND l[1] = l[3] AND l[2] = l[4]) AS retry FROM
(SELECT *, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS l FROM events)""",
)
def win_retry_loop(t: Tables):
    return E.retry_loop(t.events, "user_id", ORDER, "event_type").select("user_id", "event_id", "retry")


@query(
    "win_error_pattern_count",
    """SELECT user_id, event_id, sum((contains(event_type, 'i') AND contains(event_type, 'w'))::INT) OVER w::BIGINT AS views, sum(contains(event_type, 'c')::INT) OVER w::BIGINT AS with_c FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)""",
)
def win_error_pattern_count(t: Tables):
    return E.pattern_counts(t.events, "user_id", ORDER, "event_type", {"views": ["i", "w"], "with_c": ["c"]}).select("user_id", "event_id", "views", "with_c")


@query("win_first_seen", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def win_first_seen(t: Tables):
    return E.first_seen(t.events, "user_id", ORDER, "event_type").select("user_id", "event_type", "event_id")


_SIG = "CASE event_type WHEN 'purchase' THEN 'strong' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'weak' ELSE 'none' END"


@query(
    "win_progress_policy",
    f"""WITH s AS (SELECT *, {_SIG} AS signal FROM {_E}), i AS (SELECT *, sum((signal IN ('strong', 'medium'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM s),
p AS (SELECT *, sum(CASE WHEN signal IN ('strong', 'medium') THEN 0 WHEN signal = 'weak' THEN 1 ELSE 2 END) OVER (PARTITION BY user_id, i ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS no_progress FROM i)
SELECT user_id, event_id, no_progress, no_progress >= CASE category WHEN 'observation' THEN 4 WHEN 'effect' THEN 2 ELSE 3 END AS stalled FROM p""",
)
def win_progress_policy(t: Tables):
    kind = F.when(F.col("event_type") == "purchase", "strong").when(F.col("event_type") == "signup", "medium").when(F.col("event_type") == "click", "weak").otherwise("none")
    return E.no_progress(log(t).withColumn("signal", kind), "user_id", ORDER).select("user_id", "event_id", "no_progress", "stalled")


_WORDS = "list_distinct(list_concat(regexp_extract_all(substr(text, 1, 2000), '[\\x{4e00}-\\x{9fa5}]{2,}'), regexp_extract_all(substr(text, 1, 2000), '[a-zA-Z]{3,}')))"


@query(
    "saturation_jaccard",
    f"""WITH s AS (SELECT doc_id, source || '-' || doc_id // 200 AS run, {_WORDS} AS w FROM documents), p AS (SELECT *, lag(w) OVER (PARTITION BY run ORDER BY doc_id) AS p FROM s)
SELECT doc_id, round(CASE WHEN p IS NULL THEN NULL WHEN len(p) = 0 OR len(w) = 0 THEN 0 ELSE len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p)))::DOUBLE END, 6) AS jaccard FROM p""",
)
def saturation_jaccard(t: Tables):
    run = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 200).cast("string"))  # searches of a source, of at most 200 results each
    return E.content_similarity(t.documents.select("doc_id", run.alias("run"), "text"), "run", "doc_id", "text").select("doc_id", F.round("jaccard", 6).alias("jaccard"))


@query("set_intersect_jaccard", """SELECT o_custkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS jaccard FROM
(SELECT o_custkey, list(DISTINCT o_orderpriority) AS a, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY o_custkey) WHERE b IS NOT NULL""")
def set_intersect_jaccard(t: Tables):
    g = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("b"))
    return g.where(F.size("b") > 0).select("o_custkey", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


_ENT = """list_distinct(list_concat(list_slice(regexp_extract_all(text, 'https?://[^\\s\\]\\)"''>]+'), 1, 5), list_slice(regexp_extract_all(text, '[\\x{4e00}-\\x{9fa5}]{2,}诉[\\x{4e00}-\\x{9fa5}]{2,}案'), 1, 3),
  list_slice(regexp_extract_all(text, '[\\x{4e00}-\\x{9fa5}]{2,}(?:公司|集团|企业)'), 1, 5), list_slice(regexp_extract_all(text, '202[0-5]'), 1, 3)))"""
_JAC = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"
_RUN_TEXT = "text || CASE WHEN doc_id % 3 = 0 THEN ' seen in 2021 and http://a.b/' || doc_id % 7 ELSE '' END"


@query(
    "saturation_detect",
    f"""WITH r AS (SELECT doc_id, source || doc_id % 23 AS run, {_RUN_TEXT} AS text, lang || ' ' || source || ' ' || doc_id % 4 AS query FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, {_WORDS} AS w, {_ENT} AS e, list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '')) AS q, row_number() OVER (PARTITION BY run ORDER BY doc_id) AS n FROM r),
p AS (SELECT *, lag(w) OVER (PARTITION BY run ORDER BY doc_id) AS p FROM s),
j AS (SELECT *, CASE WHEN p IS NOT NULL THEN {_JAC.format(a="w", b="p")} END AS jac FROM p),
c AS (SELECT run, n, x, count(*) OVER (PARTITION BY run, x ORDER BY n) AS c FROM (SELECT run, n, unnest(e) AS x FROM s)),
f AS (SELECT a.run, a.n, 1 - count(DISTINCT x) FILTER (c > 1) / count(DISTINCT x)::DOUBLE AS fresh FROM s a JOIN c b ON a.run = b.run AND b.n BETWEEN a.n - 2 AND a.n GROUP BY ALL),
d AS (SELECT a.run, a.n, avg({_JAC.format(a="x.q", b="y.q")}) AS mean FROM s a JOIN s x ON x.run = a.run AND x.n BETWEEN a.n - 4 AND a.n JOIN s y ON y.run = a.run AND y.n BETWEEN a.n - 4 AND a.n AND x.n < y.n GROUP BY ALL),
m AS (SELECT doc_id, run, n, avg(jac) OVER (PARTITION BY run ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS sim FROM j)
SELECT doc_id, CASE WHEN m.n < 3 THEN NULL WHEN sim > 0.7 THEN 'content_similarity' WHEN coalesce(fresh, 1) < 0.2 THEN 'low_new_entities' WHEN 1 - mean < 0.3 THEN 'repetitive_queries' END AS saturated
FROM m LEFT JOIN f ON f.run = m.run AND f.n = m.n LEFT JOIN d ON d.run = m.run AND d.n = m.n""",
)
def saturation_detect(t: Tables):
    d = t.documents.where("text is not null").select("doc_id", F.concat("source", (F.col("doc_id") % 23).cast("string")).alias("run"), F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" seen in 2021 and http://a.b/"), (F.col("doc_id") % 7).cast("string"))).otherwise("")).alias("text"), F.concat_ws(" ", "lang", "source", (F.col("doc_id") % 4).cast("string")).alias("query"))
    return E.saturation(d, "run", "doc_id", "text", "query").select("doc_id", "saturated")


@query("agg_tool_stats", f"SELECT user_id, count(*) AS total, round(avg((category = 'effect')::INT), 6) AS effect_ratio, round(avg((category = 'observation')::INT), 6) AS observation_ratio FROM {_E} GROUP BY user_id")
def agg_tool_stats(t: Tables):
    share = lambda c: F.round(F.avg((F.col("category") == c).cast("double")), 6)
    return log(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), share("effect").alias("effect_ratio"), share("observation").alias("observation_ratio"))


@query(
    "agg_entity_stats",
    "SELECT user_id, count(*) AS entities, count(*) FILTER (c > 1) AS repeated, round(count(*) FILTER (c > 1) / count(*)::DOUBLE, 6) AS reuse FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY user_id",
)
def agg_entity_stats(t: Tables):
    c = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    again = F.sum((F.col("c") > 1).cast("long"))
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("entities"), again.alias("repeated"), F.round(again / F.count(F.lit(1)), 6).alias("reuse"))


@query("agg_command_usage", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 0 ORDER BY n DESC, event_type")
def agg_command_usage(t: Tables):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 0").orderBy(F.col("n").desc(), "event_type")


@query("agg_routing_stats", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_routing_stats(t: Tables):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("agg_connection_stats", "SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL")
def agg_connection_stats(t: Tables):
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_stage_durations",
    f"SELECT user_id, event_type, datediff('millisecond', p, ts) AS ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT *, lag(ts) OVER w AS p FROM events {_W})) WHERE rn = 1 AND p IS NOT NULL",
)
def agg_stage_durations(t: Tables):
    d = t.events.withColumn("p", F.lag("ts").over(S.ordered("user_id", *ORDER)))
    d = d.withColumn("rn", F.row_number().over(S.ordered(["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()))).where("rn = 1 and p is not null")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return d.select("user_id", "event_type", (ms("ts") - ms("p")).alias("ms"))


@query("agg_timing_categories", "SELECT user_id, round(coalesce(sum(value) FILTER (starts_with(event_type, 'p')), 0), 4) AS platform, round(coalesce(sum(value) FILTER (starts_with(event_type, 's')), 0), 4) AS ai, round(coalesce(sum(value) FILTER (NOT (starts_with(event_type, 'p') OR starts_with(event_type, 's'))), 0), 4) AS processing FROM events GROUP BY user_id")
def agg_timing_categories(t: Tables):
    p, s = F.col("event_type").startswith("p"), F.col("event_type").startswith("s")
    of = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0)), 4)
    return t.events.groupBy("user_id").agg(of(p).alias("platform"), of(s).alias("ai"), of(~(p | s)).alias("processing"))


@query(
    "agg_overall_log",
    """WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events WHERE event_type = 'signup'), g AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM d)
SELECT count(*) AS runs, (max(day) - min(day))::BIGINT AS span_days, round(count(*) / (greatest(max(day) - min(day), 1) / 7.0::DOUBLE), 2) AS runs_per_week, max(gap)::BIGINT AS longest_gap FROM g""",
)
def agg_overall_log(t: Tables):
    days = t.events.where("event_type = 'signup'").select(F.to_date("ts").alias("day")).distinct()  # a row a day, so one window holds them
    g = days.withColumn("gap", F.datediff("day", F.lag("day").over(Window.orderBy("day"))))
    span = F.datediff(F.max("day"), F.min("day"))
    return g.agg(F.count(F.lit(1)).alias("runs"), span.cast("long").alias("span_days"), F.round(F.count(F.lit(1)) / (F.greatest(span, F.lit(1)) / 7), 2).alias("runs_per_week"), F.max("gap").cast("long").alias("longest_gap"))


@query("win_gap_days", "SELECT user_id, day, (day - lag(day) OVER (PARTITION BY user_id ORDER BY day))::BIGINT AS gap FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events)")
def win_gap_days(t: Tables):
    d = t.events.select("user_id", F.to_date("ts").alias("day")).distinct()
    return d.select("user_id", "day", F.datediff("day", F.lag("day").over(S.ordered("user_id", "day"))).cast("long").alias("gap"))


@query(
    "agg_time_bucket",
    """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d = DATE '2024-01-25' THEN 'today' WHEN d = DATE '2024-01-24' THEN 'yesterday' WHEN d >= date_trunc('week', DATE '2024-01-25') THEN 'this_week'
WHEN d >= DATE '2024-01-01' THEN 'this_month' ELSE 'earlier' END AS bucket FROM (SELECT ts::DATE AS d FROM events) WHERE d <= DATE '2024-01-25') GROUP BY bucket""",
)
def agg_time_bucket(t: Tables):
    today, d = F.lit("2024-01-25").cast("date"), F.to_date("ts")
    case = F.when(d == today, "today").when(d == F.date_sub(today, 1), "yesterday").when(d >= F.date_trunc("week", today), "this_week").when(d >= F.trunc(today, "month"), "this_month").otherwise("earlier")
    return t.events.where(d <= today).groupBy(case.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("retention_keep_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def retention_keep_n(t: Tables):
    d = t.events.withColumn("rn", F.row_number().over(S.ordered("user_id", F.col("ts").desc(), F.col("event_id").desc())))
    return d.where("rn <= 10").select("user_id", "event_id")


@query("retention_age", "SELECT event_id FROM events WHERE ts::DATE >= DATE '2024-01-30' - 7")
def retention_age(t: Tables):
    return t.events.where(F.to_date("ts") >= F.date_sub(F.lit("2024-01-30").cast("date"), 7)).select("event_id")


@query("filter_logs_by_date", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def filter_logs_by_date(t: Tables):
    return t.events.where("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-12'").select("event_id")  # reaches the scan


@query("fn_date_trunc_dir", "SELECT strftime(ts, '%Y-%m-%d') AS dir, count(*) AS n FROM events GROUP BY dir")
def fn_date_trunc_dir(t: Tables):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dir")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_json_path_get", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def fn_json_path_get(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn_tool_category", "SELECT event_id, CASE event_type WHEN 'view' THEN 'observation' WHEN 'click' THEN 'observation' WHEN 'purchase' THEN 'effect' ELSE 'mixed' END AS category FROM events")
def fn_tool_category(t: Tables):
    names = F.create_map(*[F.lit(x) for kv in {"view": "read_file", "click": "grep", "purchase": "bash"}.items() for x in kv])
    return t.events.select("event_id", T.tool_category(F.coalesce(names[F.col("event_type")], F.lit("other"))).alias("category"))


@query(
    "fn_task_signal",
    f"""WITH l AS (SELECT *, lag(event_type) OVER w AS before, lag(props) OVER w AS props_before, (props->>'$.k')::INT AS k, trunc(value)::BIGINT AS v FROM {_E} {_W})
SELECT event_id, CASE WHEN coalesce(event_type = before AND props = props_before, false) OR event_type = 'error' THEN 'none' WHEN k % 9 = 0 THEN 'strong'
WHEN k % 11 = 0 OR coalesce(before = 'error', false) OR v % 13 = 0 THEN 'medium'
WHEN category = 'observation' AND v % 4 >= 2 THEN 'strong' WHEN category = 'observation' AND (v % 4 >= 1 OR new_entities >= 2) THEN 'medium'
WHEN new_entities > 0 AND k % 2 = 0 THEN 'weak' ELSE 'none' END AS signal FROM l""",
)
def fn_task_signal(t: Tables):
    """Steps of each user: the same action again, errors before, files, dependencies, urls and entities from the event's value."""
    w, c = S.ordered("user_id", *ORDER), F.col
    d = log(t).withColumns({"before": F.lag("event_type").over(w), "props_before": F.lag("props").over(w), "k": F.get_json_object("props", "$.k").cast("int"), "v": c("value").cast("long")})
    signal = T.task_signal(
        c("category"),
        repeated=F.coalesce((c("event_type") == c("before")) & (c("props") == c("props_before")), F.lit(False)),
        success=c("event_type") != "error",
        files=(c("k") % 9 == 0).cast("int"),
        dependencies=(c("k") % 11 == 0).cast("int"),
        error_changed=F.coalesce(c("before") == "error", F.lit(False)),
        concluding=T.concludes(F.when(c("v") % 13 == 0, "In summary, it works").otherwise("going on")),
        new_urls=c("v") % 4,
        new_entities=c("new_entities"),
        has_entities=c("new_entities") > 0,
        error=F.when(c("k") % 2 == 1, "warning").otherwise(""),
    )
    return d.select("event_id", signal.alias("signal"))


@query("fn_action_signature", """SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS id, sha1(l_returnflag || '|' || CASE WHEN l_suppkey % 4 = 3 THEN 'plain ' || l_partkey ELSE '{"a": {"x": ' || l_partkey || ', "y": "é ' || l_linestatus || '"}, "b": [' || l_suppkey || ', 1], "path": "/f/' || l_orderkey || '"}' END) AS signature FROM lineitem""")
def fn_action_signature(t: Tables):
    """Arguments whose keys come in three orders, with and without spaces, and plain texts."""
    c = F.col
    inner = F.when(c("l_suppkey") % 2 == 0, F.format_string('{"y":"é %s","x":%d}', "l_linestatus", "l_partkey")).otherwise(F.format_string('{"x": %d, "y": "é %s"}', "l_partkey", "l_linestatus"))
    one = F.format_string('{"b": [%d,1],"path":"/f/%d", "a":%s}', "l_suppkey", "l_orderkey", inner)
    two = F.format_string('{"path": "/f/%d","a":  %s ,"b":[%d, 1]}', "l_orderkey", inner, "l_suppkey")
    three = F.format_string('{"a": %s, "b": [%d, 1], "path": "/f/%d"}', inner, "l_suppkey", "l_orderkey")
    args = F.when(c("l_suppkey") % 4 == 0, one).when(c("l_suppkey") % 4 == 1, two).when(c("l_suppkey") % 4 == 2, three).otherwise(F.format_string("plain %d", "l_partkey"))
    d = t.lineitem.select((c("l_orderkey") * 1000 + c("l_linenumber") * 100 + c("l_suppkey") % 100).alias("id"), "l_returnflag", args.alias("args"))
    return E.signed(d, "id", "l_returnflag", "args")


@query("fn_state_fingerprint", "SELECT user_id, sha1('[' || string_agg(DISTINCT '\"' || event_type || '\"', ',' ORDER BY '\"' || event_type || '\"') || ']') AS fingerprint FROM events GROUP BY user_id")
def fn_state_fingerprint(t: Tables):
    return t.events.groupBy("user_id").agg(F.sha1(F.to_json(F.array_sort(F.collect_set("event_type")))).alias("fingerprint"))


@query("fn_progress", "SELECT event_id, round(least(1, value / 50), 6) AS pct FROM events")
def fn_progress(t: Tables):
    return t.events.select("event_id", F.round(F.least(F.lit(1.0), F.col("value") / 50), 6).alias("pct"))


@query("stream_backoff", f"""SELECT user_id, event_id, least(0.5::DOUBLE * 2 ** (row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - 1), 30) AS delay FROM
(SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) WHERE event_type = 'error'""")
def stream_backoff(t: Tables):
    """The wait after each of a user's errors in a row."""
    d = t.events.withColumn("g", F.sum((F.col("event_type") != "error").cast("long")).over(S.so_far("user_id", *ORDER))).where("event_type = 'error'")
    return d.select("user_id", "event_id", T.backoff(F.row_number().over(S.ordered(["user_id", "g"], *ORDER)) - 1).alias("delay"))


_FRAGMENTS = """SELECT conv_id, (turn % 3)::INT AS index, turn, CASE WHEN turn % 2 = 0 THEN 'call_' || turn ELSE '' END AS id, CASE WHEN turn % 4 < 2 THEN role END AS name, CASE WHEN turn % 5 < 4 THEN text END AS arguments FROM conversations"""


@query("stream_delta_assemble", f"""SELECT conv_id, index, coalesce(max_by(id, turn) FILTER (id <> ''), '') AS id, coalesce(max_by(name, turn) FILTER (name <> ''), '') AS name, coalesce(string_agg(arguments, '' ORDER BY turn), '') AS arguments FROM ({_FRAGMENTS}) GROUP BY conv_id, index""")
def stream_delta_assemble(t: Tables):
    c = F.col
    d = t.conversations.select("conv_id", (c("turn") % 3).cast("int").alias("index"), "turn", F.when(c("turn") % 2 == 0, F.concat(F.lit("call_"), "turn")).otherwise("").alias("id"), F.when(c("turn") % 4 < 2, c("role")).alias("name"), F.when(c("turn") % 5 < 4, c("text")).alias("arguments"))
    return S.assembled(d, "conv_id", "index", "turn")


@query("extension_session_window", """WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def extension_session_window(t: Tables):
    w = F.session_window(F.col("ts").cast("timestamp"), "12 hours")
    return t.events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("extension_tumbling_window", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def extension_tumbling_window(t: Tables):
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    return t.events.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
