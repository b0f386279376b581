"""Queries of evaluation statistics, integrity checks, set operations and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evals as V
from tessera.operators import sessions as S
from tessera.plans.corpus import forms
from tessera.plans.registry import Tables, query
from tessera.sources import sinks
from tessera.storage import new_folder

_STATS = "round(avg(l_quantity), 4) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 4) AS stddev, min(l_quantity) AS min, max(l_quantity) AS max"


@query("agg_stats_by_config", f"SELECT l_returnflag AS config, {_STATS} FROM lineitem GROUP BY 1")
def agg_stats_by_config(t: Tables):
    return V.stats(t.lineitem, F.col("l_returnflag").alias("config"), "l_quantity")


@query("join_delta_two_configs", "SELECT round(avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'N'), 4) AS delta FROM lineitem")
def join_delta_two_configs(t: Tables):
    mean = lambda c: F.avg(F.when(F.col("l_returnflag") == c, F.col("l_quantity")))
    return t.lineitem.agg(F.round(mean("A") - mean("N"), 4).alias("delta"))


@query("benchmark_summary", f"SELECT l_returnflag || l_linestatus AS config, {_STATS} FROM lineitem GROUP BY 1")
def benchmark_summary(t: Tables):
    return V.stats(t.lineitem, F.concat("l_returnflag", "l_linestatus").alias("config"), "l_quantity")


@query("agg_perf_summary", "SELECT l_returnflag, count(*) AS n, round(sum(l_tax), 4) AS total, round(median(l_tax), 6) AS median, round(stddev_samp(l_tax), 6) AS stdev, round(count(*) / sum(l_tax), 4) AS per_unit FROM lineitem GROUP BY 1")
def agg_perf_summary(t: Tables):
    x = F.col("l_tax")
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(x), 4).alias("total"), F.round(F.median(x), 6).alias("median"), F.round(F.stddev_samp(x), 6).alias("stdev"), F.round(F.count(F.lit(1)) / F.sum(x), 4).alias("per_unit"))


_HIT = "(event_type IN ('purchase', 'signup'))::INT"


@query("agg_trigger_rate", f"SELECT user_id, round(avg({_HIT}), 6) AS rate, count(*) AS runs, sum({_HIT})::BIGINT AS triggers, CASE WHEN user_id % 2 = 0 THEN avg({_HIT}) >= 0.5 ELSE avg({_HIT}) < 0.5 END AS pass FROM events GROUP BY user_id")
def agg_trigger_rate(t: Tables):
    d = t.events.select("user_id", (F.col("user_id") % 2 == 0).alias("should"), F.col("event_type").isin("purchase", "signup").alias("triggered"))
    return V.trigger_rate(d, "user_id").select("user_id", F.round("rate", 6).alias("rate"), "runs", "triggers", "pass")


@query(
    "agg_confusion",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS tn, count(*) FILTER (quality = 1 AND toxic = 1) AS fn FROM labels)
SELECT tp, fp, tn, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END, 6) AS recall, round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn)::DOUBLE ELSE 0 END, 6) AS accuracy FROM c""",
)
def agg_confusion(t: Tables):
    d = V.confusion(t.labels.select((F.col("quality") == 1).alias("actual"), (F.col("toxic") == 0).alias("predicted")))
    return d.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


@query("agg_correct_runs", f"SELECT sum(n)::BIGINT AS runs, sum(CASE WHEN user_id % 2 = 0 THEN h ELSE n - h END)::BIGINT AS correct FROM (SELECT user_id, count(*) AS n, sum({_HIT}) AS h FROM events GROUP BY user_id)")
def agg_correct_runs(t: Tables):
    hit = F.col("event_type").isin("purchase", "signup")
    return t.events.agg(F.count(F.lit(1)).alias("runs"), F.sum((hit == (F.col("user_id") % 2 == 0)).cast("long")).alias("correct"))


@query("agg_best_iteration", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def agg_best_iteration(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("eval_split", "SELECT quality, count(*) FILTER (rn <= k) AS held, count(*) FILTER (rn > k) AS kept FROM (SELECT *, greatest(1, floor(n * 0.4)) AS k FROM (SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)) GROUP BY quality")
def eval_split(t: Tables):
    d = V.split(t.labels, "quality", "doc_id", 0.4, seed=42)
    return d.groupBy("quality").agg(F.sum(F.col("held").cast("long")).alias("held"), F.sum((~F.col("held")).cast("long")).alias("kept"))


@query("join_train_test", "SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)) AS train, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)) AS test")
def join_train_test(t: Tables):
    keep = t.labels.where("toxic = 0").select("doc_id").distinct()
    ids = t.documents.select("doc_id")
    n = lambda how, name: ids.join(keep, "doc_id", how).agg(F.count(F.lit(1)).alias(name))
    return n("left_semi", "train").crossJoin(n("left_anti", "test"))  # a row each


@query(
    "pipeline_scorecard",
    """WITH r AS (SELECT *, o_orderkey AS run FROM orders), n AS (SELECT count(*) AS n FROM orders)
SELECT rule, count(*) AS runs, round(count(*) / any_value(n)::DOUBLE, 6) AS utilization, arg_max(o_totalprice, run) AS last_value FROM (
SELECT 'urgent' AS rule, * FROM r WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'filled', * FROM r WHERE o_orderstatus = 'F' UNION ALL SELECT 'large', * FROM r WHERE o_totalprice > 200000 UNION ALL SELECT 'all', * FROM r), n GROUP BY rule""",
)
def pipeline_scorecard(t: Tables):
    rules = {"urgent": F.col("o_orderpriority") == "1-URGENT", "filled": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200_000, "all": F.lit(True)}
    return V.scorecard(t.orders, rules, "o_orderkey", "o_totalprice").withColumn("utilization", F.round("utilization", 6))


@query("agg_skill_scorecard", """WITH n AS (SELECT count(*) AS n FROM events) SELECT event_type AS rule, count(*) AS runs, round(count(*) / any_value(n)::DOUBLE, 6) AS utilization, arg_max(value, event_id) AS last_value FROM events, n WHERE event_type IN ('click', 'signup') GROUP BY 1""")
def agg_skill_scorecard(t: Tables):
    rules = {k: F.col("event_type") == k for k in ("click", "signup")}
    return V.scorecard(t.events, rules, "event_id", "value").withColumn("utilization", F.round("utilization", 6))


@query("win_latest_attributed", "SELECT user_id, arg_max(value, (ts, event_id)) AS latest FROM events WHERE event_type = 'click' GROUP BY user_id")
def win_latest_attributed(t: Tables):
    return t.events.where("event_type = 'click'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


@query("agg_plan_progress", "SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS done, count(*) AS total, array_to_string(list_slice(list_sort(list(DISTINCT l_returnflag)), 1, 8), ',') AS flags FROM lineitem GROUP BY 1")
def agg_plan_progress(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.sum((F.col("l_linestatus") == "F").cast("long")).alias("done"), F.count(F.lit(1)).alias("total"), F.array_join(F.slice(F.array_sort(F.collect_set("l_returnflag")), 1, 8), ",").alias("flags"))


@query("join_anti_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti_orphans(t: Tables):
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("join_anti_unreferenced", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def join_anti_unreferenced(t: Tables):
    return t.part.select("p_partkey").join(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("join_anti_dangling_refs", "SELECT 'no_label' AS kind, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'no_document', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def join_anti_dangling_refs(t: Tables):
    return V.dangling(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id", "no_label", "no_document")


@query(
    "join_diff_manifest",
    """SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'missing' ELSE 'updated' END AS reason FROM (SELECT p_partkey AS k, p_size AS s, md5(p_name) AS h FROM part) a
FULL JOIN (SELECT p_partkey + 3 AS k, p_size AS s, md5(p_name) AS h FROM part) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s OR a.h IS DISTINCT FROM b.h""",
)
def join_diff_manifest(t: Tables):
    m = t.part.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("s"), F.md5("p_name").alias("h"))
    return V.manifest_diff(m, m.withColumn("key", F.col("key") + 3), "key", ["s", "h"])


@query(
    "join_self_bbox_overlap",
    """SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
AND a.l_quantity < b.l_quantity + 5 AND b.l_quantity < a.l_quantity + 5 AND a.l_discount < b.l_discount + 0.02 AND b.l_discount < a.l_discount + 0.02""",
)
def join_self_bbox_overlap(t: Tables):
    box = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_discount") + 0.02).alias("y1"))
    return V.overlapping(box, "l_orderkey", "l_linenumber")


@query("join_count_diff", "SELECT a.l_suppkey, a.n - coalesce(b.n, 0) AS more FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (l_suppkey) WHERE a.n > coalesce(b.n, 0)")
def join_count_diff(t: Tables):
    n = lambda c: F.sum((F.col("l_returnflag") == c).cast("long"))
    return t.lineitem.groupBy("l_suppkey").agg((n("A") - n("R")).alias("more")).where("more > 0")  # one pass instead of a join


@query("agg_unique_violation", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg_unique_violation(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("agg_author_changes", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS inserted, count(*) FILTER (l_returnflag = 'R') AS deleted FROM lineitem GROUP BY 1")
def agg_author_changes(t: Tables):
    n = lambda c: F.sum((F.col("l_returnflag") == c).cast("long"))
    return t.lineitem.groupBy("l_suppkey").agg(n("A").alias("inserted"), n("R").alias("deleted"))


@query("agg_excel_errors", "SELECT o_orderpriority AS token, count(*) AS n, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 20), ',') AS first FROM orders GROUP BY 1")
def agg_excel_errors(t: Tables):
    return V.first_places(t.orders, F.col("o_orderpriority").alias("token"), "o_orderkey", 20)


@query("topk_colors", "SELECT '#' || printf('%06x', k) AS color, n FROM (SELECT (l_suppkey * 65537) % 16777216 AS k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, k LIMIT 5)")
def topk_colors(t: Tables):
    k = (F.col("l_suppkey") * 65537) % 16777216
    top = t.lineitem.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "k").limit(5)
    return top.select(F.concat(F.lit("#"), F.lower(F.lpad(F.hex("k"), 6, "0"))).alias("color"), "n")


@query("win_row_boundaries", "SELECT l_orderkey, top, lead(top) OVER (PARTITION BY l_orderkey ORDER BY top) AS bottom, round(lead(top) OVER (PARTITION BY l_orderkey ORDER BY top) - top, 1) AS height FROM (SELECT DISTINCT l_orderkey, l_quantity AS top FROM lineitem)")
def win_row_boundaries(t: Tables):
    d = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("top")).distinct()
    d = d.withColumn("bottom", F.lead("top").over(S.ordered("l_orderkey", "top")))
    return d.withColumn("height", F.round(F.col("bottom") - F.col("top"), 1))


@query("filter_checkbox_rect", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 15 AND l_linenumber + 8 BETWEEN 5 AND 15 AND abs(l_quantity - l_linenumber - 8) < 2")
def filter_checkbox_rect(t: Tables):
    w, h = F.col("l_quantity"), F.col("l_linenumber") + 8
    return t.lineitem.where(w.between(5, 15) & h.between(5, 15) & (F.abs(w - h) < 2)).select("l_orderkey", "l_linenumber")


@query("sort_fields_reading_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount, l_linenumber, l_suppkey, l_partkey) AS place FROM lineitem")
def sort_fields_reading_order(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(S.ordered("l_orderkey", F.col("l_quantity").desc(), "l_discount", "l_linenumber", "l_suppkey", "l_partkey")).cast("long").alias("place"))


@query("join_radio_groups", "SELECT n_regionkey, r_name, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS options FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def join_radio_groups(t: Tables):
    g = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return g.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_regionkey", "r_name", F.array_join(F.transform("x", lambda v: v["n_name"]), ",").alias("options"))


@query(
    "align_three_way",
    """WITH k AS (SELECT k, bool_or(s = 'c') AS c, bool_or(s = 'o') AS o, bool_or(s = 's') AS s FROM (SELECT c_custkey AS k, 'c' AS s FROM customer UNION ALL SELECT DISTINCT o_custkey, 'o' FROM orders UNION ALL SELECT s_suppkey, 's' FROM supplier) GROUP BY k)
SELECT k, CASE WHEN c AND NOT o THEN 'missing_in_db' WHEN c AND NOT s THEN 'missing_in_vector' WHEN o AND NOT c THEN 'orphan_in_db' WHEN s AND NOT c THEN 'orphan_in_vector' ELSE 'aligned' END AS state FROM k""",
)
def align_three_way(t: Tables):
    parts = {"c": t.customer.select(F.col("c_custkey").alias("k")), "o": t.orders.select(F.col("o_custkey").alias("k")), "s": t.supplier.select(F.col("s_suppkey").alias("k"))}
    return V.alignment(parts["c"], parts["o"], parts["s"], "k")


@query("set_ops", "SELECT 'both' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'first_only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_ops(t: Tables):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    tag = lambda d, op: d.select(F.lit(op).alias("op"), "k")
    return tag(a.intersect(b), "both").unionByName(tag(a.union(b).distinct(), "either")).unionByName(tag(a.subtract(b), "first_only"))


@query("set_difference", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference(t: Tables):
    return t.orders.select("o_orderkey").join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


_BY = "l_linenumber, l_returnflag, l_linestatus"
_PAIR = f"(SELECT l_orderkey, list(l_returnflag ORDER BY {_BY}) AS a, list(l_linestatus ORDER BY {_BY}) AS b FROM lineitem GROUP BY 1)"


def _pair(t: Tables):
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("x"))
    return g.select("l_orderkey", F.transform("x", lambda v: v["l_returnflag"]).alias("a"), F.transform("x", lambda v: v["l_linestatus"]).alias("b"))


@query("set_union_ordered", f"SELECT l_orderkey, (SELECT string_agg(v, ',' ORDER BY p) FROM (SELECT v, min(p) AS p FROM (SELECT unnest(list_concat(a, b)) AS v, generate_subscripts(list_concat(a, b), 1) AS p) GROUP BY v)) AS files FROM {_PAIR}")
def set_union_ordered(t: Tables):
    return _pair(t).select("l_orderkey", F.array_join(F.array_distinct(F.concat("a", "b")), ",").alias("files"))


@query("set_dep_union", f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS deps FROM {_PAIR}")
def set_dep_union(t: Tables):
    return _pair(t).select("l_orderkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("deps"))


@query("set_unknown_tools", f"SELECT l_orderkey, coalesce(array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(['A', 'N'], x))), ','), '') AS unknown FROM {_PAIR}")
def set_unknown_tools(t: Tables):
    return _pair(t).select("l_orderkey", F.array_join(F.array_sort(F.array_except("a", F.array(F.lit("A"), F.lit("N")))), ",").alias("unknown"))


@query("filter_allowed_tools", "SELECT event_type AS tool FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('click', 'view') UNION ALL SELECT 'virtual'")
def filter_allowed_tools(t: Tables):
    return V.allowed(t.events.select(F.col("event_type").alias("tool")).distinct(), "tool", ["view", "click", "nothing"], "virtual")


@query("filter_blocked_calls", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")
def filter_blocked_calls(t: Tables):
    return t.events.where(~F.col("event_type").isin("error", "view")).select("event_id")


@query("filter_env_whitelist", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR starts_with(p_type, 'STANDARD')")
def filter_env_whitelist(t: Tables):
    env = F.map_filter(F.create_map(F.col("p_brand"), F.lit("b"), F.col("p_type"), F.lit("t")), lambda k, v: F.exists(F.array(F.lit("Brand#11"), F.lit("STANDARD*")), lambda p: F.when(p.endswith("*"), k.startswith(F.rtrim(F.translate(p, "*", "")))).otherwise(k == p)))
    return t.part.where(F.size(env) > 0).select("p_partkey")


@query("fn_required_fields", f"SELECT l_orderkey, coalesce(array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(a, x))), ','), '') AS missing FROM {_PAIR}")
def fn_required_fields(t: Tables):
    return _pair(t).select("l_orderkey", F.array_join(F.array_except(F.array(F.lit("A"), F.lit("N"), F.lit("R")), "a"), ",").alias("missing"))


@query("join_capability_route", "SELECT DISTINCT event_type, n_nationkey AS worker FROM events, nation WHERE n_nationkey % 3 = CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE n_nationkey % 3 END")
def join_capability_route(t: Tables):
    can = t.nation.select(F.col("n_nationkey").alias("worker"), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("view"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("click"))).otherwise(F.array()).alias("can"))
    return V.route(t.events.select("event_type").distinct(), "event_type", can, "worker", "can")


@query("join_mention_contains", "SELECT c_custkey, min(n_nationkey) AS nation FROM customer JOIN nation ON contains(lower(c_mktsegment || ' nation_' || c_nationkey), lower(n_name)) GROUP BY c_custkey")
def join_mention_contains(t: Tables):
    names = t.nation.select("n_nationkey", F.lower("n_name").alias("name"))
    text = F.lower(F.concat("c_mktsegment", F.lit(" nation_"), F.col("c_nationkey").cast("string")))
    return t.customer.select("c_custkey", text.alias("text")).join(F.broadcast(names), F.col("text").contains(F.col("name"))).groupBy("c_custkey").agg(F.min("n_nationkey").alias("nation"))  # nations are a fixed table


_SITES = "(SELECT p_partkey, '1.' || p_size % 5 || '.0' AS version FROM part)"


def _sites(t: Tables):
    """Places that name a version, each in its own way."""
    v, k = F.concat(F.lit("1."), (F.col("p_size") % 5).cast("string"), F.lit(".0")), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat("p_name", F.lit(" v"), v, F.lit(" of 3.1.4"))).when(k == 1, F.concat(F.lit('version = "'), v, F.lit('"'))).otherwise(F.concat(F.lit("<v>"), v, F.lit("</v> 9.9.9")))
    pattern = F.when(k == 0, r"v(\d+\.\d+\.\d+)").when(k == 1, r'version\s*=\s*"([^"]+)"').otherwise(r"<v>([\d.]+)</v>")
    return t.part.select("p_partkey", text.alias("text"), pattern.alias("pattern"))


@query("join_version_drift", f"SELECT p_partkey, version AS found, version = '1.2.0' AS in_sync FROM {_SITES}")
def join_version_drift(t: Tables):
    return V.version_drift(_sites(t), "1.2.0")


@query("version_drift", f"SELECT count(*) AS drifted FROM {_SITES} WHERE version <> '1.2.0'")
def version_drift(t: Tables):
    return V.version_drift(_sites(t), "1.2.0").where("not in_sync").agg(F.count(F.lit(1)).alias("drifted"))


@query(
    "join_config_overlay",
    """SELECT coalesce(a.k, b.k) AS path, coalesce(b.v, a.v) AS value, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'kept' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS change
FROM (SELECT 'p.' || p_partkey AS k, p_size::VARCHAR AS v FROM part) a FULL JOIN (SELECT 'p.' || (p_partkey + 5) AS k, p_size::VARCHAR AS v FROM part WHERE p_size > 25) b ON a.k = b.k""",
)
def join_config_overlay(t: Tables):
    base = t.part.select(F.concat(F.lit("p."), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("string").alias("value"))
    user = t.part.where("p_size > 25").select(F.concat(F.lit("p."), (F.col("p_partkey") + 5).cast("string")).alias("path"), F.col("p_size").cast("string").alias("value"))
    return V.overlay(base, user)


@query(
    "config_merge_managed",
    """SELECT a.k AS path, CASE WHEN starts_with(a.k, 'u.') THEN b.v ELSE coalesce(b.v, a.v) END AS value FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'u.' ELSE 't.' END || p_partkey AS k, 'a' AS v FROM part) a
LEFT JOIN (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'u.' ELSE 't.' END || p_partkey AS k, 'b' AS v FROM part WHERE p_size > 25) b ON a.k = b.k WHERE NOT starts_with(a.k, 'u.') OR b.k IS NOT NULL""",
)
def config_merge_managed(t: Tables):
    k = F.concat(F.when(F.col("p_partkey") % 2 == 0, "u.").otherwise("t."), F.col("p_partkey").cast("string")).alias("path")
    return V.merge_managed(t.part.select(k, F.lit("a").alias("value")), t.part.where("p_size > 25").select(k, F.lit("b").alias("value")), ["u."])


@query("account_by_suffix", "SELECT DISTINCT regexp_replace(k, ':user$', '') AS account FROM (SELECT c_name || ':' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ':user' ELSE ':bot' END AS k FROM customer) WHERE ends_with(k, ':user')")
def account_by_suffix(t: Tables):
    k = F.concat("c_name", F.lit(":"), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, ":user").otherwise(":bot"))
    return t.customer.select(k.alias("k")).where(F.col("k").endswith(":user")).select(F.expr("substring_index(k, ':', 2)").alias("account")).distinct()


_MADE = """(SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, '/w' || l_suppkey % 2 || '/Report' || l_partkey % 2 || (['', '_v2', '-final', '_copy', '.old'])[l_linenumber % 5 + 1] || (['.docx', '.PDF', '.txt'])[l_partkey % 3 + 1] AS path FROM lineitem)"""


@query(
    "dedupe_similar_artifact",
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS o FROM {_MADE}),
s AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, regexp_replace(regexp_replace(lower(regexp_extract(path, '([^/]*)$', 1)), '[_-]?(v\\d+|final|draft|copy|backup|new|old)[_-]?', '', 'g'), '(.)\\.[^.]*$', '\\1') AS stem FROM m),
f AS (SELECT *, first_value(path) OVER (PARTITION BY l_orderkey, ext ORDER BY o) AS p, first_value(stem) OVER (PARTITION BY l_orderkey, ext ORDER BY o) AS ps, row_number() OVER (PARTITION BY l_orderkey, path ORDER BY o) AS again FROM s)
SELECT l_orderkey, o, path, CASE WHEN again = 1 AND ext IN ('.docx', '.pdf') AND path <> p AND stem = ps THEN p END AS existing FROM f""",
)
def dedupe_similar_artifact(t: Tables):
    """Files that orders make: versions of two reports in three formats, of which .txt is no result of its own."""
    c = F.col
    part = lambda names, k: F.array(*[F.lit(n) for n in names])[k.cast("int")]
    path = F.concat(F.lit("/w"), (c("l_suppkey") % 2).cast("string"), F.lit("/Report"), (c("l_partkey") % 2).cast("string"), part(["", "_v2", "-final", "_copy", ".old"], c("l_linenumber") % 5), part([".docx", ".PDF", ".txt"], c("l_partkey") % 3))
    d = t.lineitem.select("l_orderkey", F.row_number().over(S.ordered("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")).cast("long").alias("o"), path.alias("path"))
    return V.locked_artifacts(d, "l_orderkey", ["o"], "path").select("l_orderkey", "o", "path", "existing")


@query("join_prev_feedback", "SELECT coalesce(o_orderkey, doc_id) AS id, coalesce(o_orderstatus, '') AS output, coalesce(quality, -1) AS feedback FROM orders FULL JOIN labels ON doc_id = o_orderkey")
def join_prev_feedback(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    f = t.labels.select(F.col("doc_id").alias("id"), "quality")
    return o.join(f, "id", "full_outer").select("id", F.coalesce("o_orderstatus", F.lit("")).alias("output"), F.coalesce("quality", F.lit(-1)).alias("feedback"))


@query("join_step_inputs", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 1 BETWEEN 1 AND 3 THEN 'available' WHEN l_linenumber = 1 THEN 'none' ELSE 'not yet' END AS input FROM lineitem")
def join_step_inputs(t: Tables):
    refs = F.filter(F.array(F.col("l_linenumber") - 1), lambda r: r >= 1)
    state = F.transform(refs, lambda r: F.when(r <= 3, "available").otherwise("not yet"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(F.get(state, F.lit(0)), F.lit("none")).alias("input"))


@query("join_validate_plan", "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS step, s_suppkey AS skill FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")
def join_validate_plan(t: Tables):
    known = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").alias("skill"))
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").join(known, "l_suppkey", "left")
    return d.select("l_orderkey", F.row_number().over(S.ordered("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")).cast("long").alias("step"), "skill")


_STEPS = "(['out ' || o_orderkey, 'sum ' || o_orderstatus, trunc(o_totalprice)::BIGINT::VARCHAR, 'plain ' || o_orderpriority, '[1, 2]'])[o_orderkey % 5 + 1]"


@query("fn_step_output", f"SELECT o_custkey, string_agg(substr(CASE o_orderkey % 7 WHEN 6 THEN repeat({_STEPS} || ' ', 100) ELSE {_STEPS} END, 1, 500), chr(10) || '---' || chr(10) ORDER BY o_orderkey) AS output FROM orders GROUP BY o_custkey")
def fn_step_output(t: Tables):
    """Results of a customer's orders, joined: JSON objects with output, summary or result, other JSON and plain texts, some long."""
    c, k = F.col, F.col("o_orderkey") % 5
    times = F.when(c("o_orderkey") % 7 == 6, 100).otherwise(1)
    long = lambda x: F.when(times > 1, F.repeat(F.concat(x, F.lit(" ")), times)).otherwise(x)
    num = F.when(times > 1, F.to_json(F.struct(long(c("o_totalprice").cast("long").cast("string")).alias("result")))).otherwise(F.format_string('{"result": %d}', c("o_totalprice").cast("long")))
    raw = F.when(k == 0, F.to_json(F.struct(long(F.concat(F.lit("out "), c("o_orderkey").cast("string"))).alias("output"), F.lit("x").alias("summary"))))
    raw = raw.when(k == 1, F.to_json(F.struct(F.lit("").alias("output"), long(F.concat(F.lit("sum "), "o_orderstatus")).alias("summary")))).when(k == 2, num)
    raw = raw.when(k == 3, long(F.concat(F.lit("plain "), "o_orderpriority"))).otherwise(long(F.lit("[1, 2]")))
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", T.step_output(raw).alias("x")))).alias("l"))
    return g.select("o_custkey", F.array_join(F.transform("l", lambda r: r["x"]), "\n---\n").alias("output"))


@query("fn_coerce_args", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 7 ELSE o_orderkey END AS n, o_orderkey % 4 IN (0, 1) AS flag FROM orders")
def fn_coerce_args(t: Tables):
    raw = F.when(F.col("o_orderkey") % 4 == 3, "abc").otherwise(F.col("o_orderkey").cast("string"))
    word = F.array(*[F.lit(x) for x in ("Yes", "true", "off", "")])[(F.col("o_orderkey") % 4).cast("int")]
    return t.orders.select("o_orderkey", F.coalesce(raw.try_cast("long"), F.lit(7)).alias("n"), F.lower(word).isin("true", "yes", "1", "on").alias("flag"))


@query("fn_extract_json", "SELECT o_orderkey, o_custkey AS v FROM orders")
def fn_extract_json(t: Tables):
    body = F.format_string('{"v": %d}', "o_custkey")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("see\n```json\n"), body, F.lit("\n```\n"))).otherwise(F.concat(F.lit("it is "), body, F.lit(" ok")))
    return t.orders.select("o_orderkey", V.json_in(text, "$.v").cast("long").alias("v"))


@query("fn_repair_json", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE o_custkey::VARCHAR END AS a FROM orders")
def fn_repair_json(t: Tables):
    raw = F.array(*[F.lit(x) for x in ('{"a": %d}', 'call {"a": %d', '{"b": [1, 2,], "a": %d,}', "{'a': %d, 'b': 'x'}", "none of %d")])[(F.col("o_orderkey") % 5).cast("int")]
    return t.orders.select("o_orderkey", F.get_json_object(V.repaired_json(F.replace(raw, F.lit("%d"), F.col("o_custkey").cast("string"))), "$.a").alias("a"))


_NTH = "list_transform(range(0, n_chars::BIGINT % 13), lambda i: '  - tool' || i || CASE WHEN (doc_id + i) % 3 = 0 THEN ': FAIL — ' || substr('broke on ' || source || repeat('!', 90), 1, 80) ELSE ': OK — ' || substr(text, 1, 80) END)"


@query(
    "fn_slim_json",
    f"""SELECT doc_id, '[historical] ' || CASE doc_id % 4 WHEN 0 THEN '[tool: ' || coalesce(source, 'unknown') || '] ' || (['OK', 'FAIL', '?'])[doc_id // 4 % 3 + 1] || ' — ' || coalesce(lang, '')
WHEN 1 THEN CASE WHEN n_chars % 13 = 0 THEN '{{"results":[]}}' ELSE '[batch results]' || chr(10) || array_to_string(list_slice({_NTH}, 1, 10), chr(10)) END
WHEN 2 THEN CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...[truncated]' ELSE text END ELSE '[' || doc_id || ']' END AS line FROM documents WHERE text IS NOT NULL""",
)
def fn_slim_json(t: Tables):
    """Results with a status, lists of up to twelve results, texts and other JSON, of documents' texts."""
    c, k = F.col, F.col("doc_id") % 4
    one = F.to_json(F.struct(F.element_at(F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean")), (F.floor(c("doc_id") / 4) % 3).cast("int") + 1).alias("ok"), c("source").alias("skill_name"), F.coalesce("lang", F.lit("")).alias("summary")))
    bad = lambda i: (c("doc_id") + i) % 3 == 0
    broke = F.concat(F.lit("broke on "), "source", F.repeat(F.lit("!"), 90))
    item = lambda i: F.struct(F.concat(F.lit("tool"), i.cast("string")).alias("tool"), F.when(bad(i), broke).alias("error"), F.when(~bad(i), c("text")).alias("result"))
    n = (c("n_chars") % 13).cast("int")
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), item)).otherwise(F.array().cast("array<struct<tool:string,error:string,result:string>>"))
    many = F.to_json(F.struct(items.alias("results")))
    content = F.when(k == 0, one).when(k == 1, many).when(k == 2, c("text")).otherwise(F.format_string("[%d]", "doc_id"))
    return t.documents.where("text is not null").select("doc_id", T.slim_result(content, historical=True).alias("line"))


@query("fn_parse_dep", "SELECT p_partkey, (['cli', 'python', 'python', 'cli', 'python', 'python'])[p_partkey % 6 + 1] AS kind, (['jq' || p_size, 'num' || p_partkey, 'opencv-python', 'ffmpeg', 'lib-' || p_size, 'python-docx'])[p_partkey % 6 + 1] AS name FROM part")
def fn_parse_dep(t: Tables):
    raw = forms(["cli: jq{z}", "pip:num{k}>={z}", "py:cv2", " ffmpeg ", "lib-{z}[socks]=={k}", "docx<{z}"], "p_partkey", k="p_partkey", z="p_size")
    return t.part.select("p_partkey", V.dependency(raw).alias("d")).select("p_partkey", "d.kind", "d.name")


@query("fn_dep_alias", "SELECT p_partkey, (['opencv-python>=' || p_size, 'Pillow', 'lib' || p_partkey || '==1', 'PyYAML[x' || p_size || ']', ''])[p_partkey % 5 + 1] AS spec FROM part")
def fn_dep_alias(t: Tables):
    raw = forms(["cv2>={z}", " PIL ", "lib{k}==1", "yaml[x{z}]", "sqlite3"], "p_partkey", k="p_partkey", z="p_size")
    return t.part.select("p_partkey", V.dependency_alias(raw).alias("spec"))


@query("win_merge_adjacent", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS o FROM lineitem),
i AS (SELECT *, sum((l_linestatus IS DISTINCT FROM p)::INT) OVER (PARTITION BY l_orderkey ORDER BY o ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY o) AS p FROM o))
SELECT l_orderkey, min(o) AS first, count(*) AS n, string_agg(l_returnflag, '' ORDER BY o) AS text FROM i GROUP BY l_orderkey, g""")
def win_merge_adjacent(t: Tables):
    d = t.lineitem.withColumn("o", F.row_number().over(S.ordered("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")).cast("long"))
    return S.merged_runs(d, "l_orderkey", "o", "l_linestatus", "l_returnflag", "").select("l_orderkey", "first", "n", "text")


@query("sort_priority_rules", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part")
def sort_priority_rules(t: Tables):
    return S.numbered(t.part, ["p_brand"], F.col("p_size"), ["p_partkey"], "place", falling=True).select("p_partkey", "place")


@query("sink_markdown_json_report", """WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT '| l_returnflag | l_linestatus | n |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT '| ' || l_returnflag || ' | ' || l_linestatus || ' | ' || n || ' |' FROM g
UNION ALL SELECT '{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '","n":' || n || '}' FROM g""")
def sink_markdown_json_report(t: Tables):
    """Both reports of one table, written and read back."""
    d = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    at = new_folder(t.spark, "report")
    sinks.markdown_report(d, head=True).write.text(f"{at}/markdown")
    sinks.json_report(d).write.text(f"{at}/json")
    return t.spark.read.text([f"{at}/markdown", f"{at}/json"]).withColumnRenamed("value", "line")


@query("filter_files_preview", "SELECT p_partkey FROM part WHERE NOT starts_with(p_name, '_') AND NOT contains(p_name, '9')")
def filter_files_preview(t: Tables):
    return t.part.where(~F.col("p_name").startswith("_") & ~F.col("p_name").like("%9%")).select("p_partkey")
