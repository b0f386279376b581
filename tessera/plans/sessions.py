"""Queries over sessions, turns and stored rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import sessions as S
from tessera.plans.registry import Tables, query


def est(c: str) -> str:
    a, j = f"length(regexp_replace({c}, '[^\\x00-\\x7F]+', '', 'g'))", f"length(regexp_replace({c}, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3000}}-\\x{{303f}}]+', '', 'g'))"
    return f"trunc({a} / 3.5::DOUBLE + {j} * 1.8::DOUBLE + (length({c}) - {a} - {j}) / 1.5::DOUBLE)::BIGINT"


EST = est("text")


@query("scan_by_pk", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def scan_by_pk(t: Tables):
    return t.orders.where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice").limit(1)


@query("scan_paged", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 40")
def scan_paged(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(40).limit(100)


@query("filter_eq", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@query("filter_ne_optional", "SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def filter_ne_optional(t: Tables):
    return t.conversations.where("role <> 'system'").select("conv_id", "turn")


@query("project_single_col", "SELECT DISTINCT c_mktsegment AS name FROM customer")
def project_single_col(t: Tables):
    return t.customer.select(F.col("c_mktsegment").alias("name")).distinct()


@query("agg_distinct_names", "SELECT count(DISTINCT source) AS n FROM documents")
def agg_distinct_names(t: Tables):
    return t.documents.agg(F.count_distinct("source").alias("n"))


@query("sort_recent", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def sort_recent(t: Tables):
    return t.orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey").select("o_orderkey").limit(20)


@query("sort_name", "SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS place, c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def sort_name(t: Tables):
    return t.customer.where("c_acctbal > 0").select(F.row_number().over(S.ordered("c_nationkey", "c_name")).cast("long").alias("place"), "c_custkey", "c_name")


@query("agg_session_stats", f"SELECT conv_id, count(*) AS n_turns, coalesce(sum({EST}), 0)::BIGINT AS total_tokens, max(turn) + 1 AS next_seq FROM conversations GROUP BY conv_id")
def agg_session_stats(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.count("turn").alias("n_turns"), F.coalesce(F.sum(T.token_estimate(F.col("text"))), F.lit(0)).alias("total_tokens"), (F.max("turn") + 1).alias("next_seq"))


@query("agg_next_sequence", "SELECT coalesce(max(turn), 0) + 1 AS next_seq FROM conversations WHERE conv_id = 3")
def agg_next_sequence(t: Tables):
    return t.conversations.where("conv_id = 3").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_seq"))


@query("agg_tokens_messages", f"SELECT conv_id, sum({EST} + 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def agg_tokens_messages(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.sum(T.token_estimate(F.col("text")) + 4).alias("tokens"))


@query("fn_token_estimate", f"SELECT doc_id, {EST} AS tokens FROM documents")
def fn_token_estimate(t: Tables):
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("join_session_turns", "SELECT o_orderkey, count(l_orderkey) AS n, list(l_linenumber::BIGINT ORDER BY l_linenumber) FILTER (l_linenumber IS NOT NULL) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def join_session_turns(t: Tables):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("lines"))
    return t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), "lines")


_ROUND = "SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS round_id FROM conversations"


@query("win_round_id", f"SELECT conv_id, turn, round_id, CASE WHEN total <= 3 OR round_id > total - 3 THEN 'recent' ELSE 'earlier' END AS tier FROM (SELECT *, max(round_id) OVER (PARTITION BY conv_id) AS total FROM ({_ROUND}))")
def win_round_id(t: Tables):
    d = S.recent_rounds(t.conversations, "conv_id", "turn", F.col("role") == "user", 3)
    return d.select("conv_id", "turn", "round_id", F.when(F.col("recent"), "recent").otherwise("earlier").alias("tier"))


@query("win_recent_rounds", f"SELECT conv_id, turn FROM (SELECT *, max(round_id) OVER (PARTITION BY conv_id) AS total FROM ({_ROUND})) WHERE total <= 1 OR round_id > total - 1")
def win_recent_rounds(t: Tables):
    return S.recent_rounds(t.conversations, "conv_id", "turn", F.col("role") == "user", 1).where("recent").select("conv_id", "turn")


@query(
    "win_event_rounds",
    "SELECT conv_id, turn FROM (SELECT *, max(r) OVER (PARTITION BY conv_id) AS total FROM (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM conversations)) WHERE total <= 2 OR r > total - 2",
)
def win_event_rounds(t: Tables):
    return S.recent_rounds(t.conversations, "conv_id", "turn", F.col("role") == "assistant", 2).where("recent").select("conv_id", "turn")


@query("win_token_budget_tail", f"SELECT conv_id, turn, cum FROM (SELECT conv_id, turn, sum({EST}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM conversations) WHERE cum <= 400")
def win_token_budget_tail(t: Tables):
    return S.budget(t.conversations, "conv_id", T.token_estimate(F.col("text")), 400, F.col("turn").desc()).select("conv_id", "turn", "cum")


@query("win_token_budget_head", f"SELECT conv_id, turn, cum FROM (SELECT conv_id, turn, sum({EST}) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM conversations WHERE conv_id IN (SELECT vec_id FROM embeddings WHERE label = 1)) WHERE cum <= 400")
def win_token_budget_head(t: Tables):
    near = t.embeddings.where("label = 1").select(F.col("vec_id").alias("conv_id"))
    return S.budget(t.conversations.join(near, "conv_id", "left_semi"), "conv_id", T.token_estimate(F.col("text")), 400, "turn").select("conv_id", "turn", "cum")


@query("join_semi_relevant_ids", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 2)")
def join_semi_relevant_ids(t: Tables):
    return t.documents.select("doc_id").join(t.embeddings.where("label = 2").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")


_LINE = "role || ': ' || trim(text)"


@query(
    "win_history_summary",
    f"""WITH c AS (SELECT *, {_LINE} AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
s AS (SELECT *, sum({est('line')}) OVER (PARTITION BY conv_id ORDER BY rn ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM c WHERE rn <= 6),
b AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY conv_id ORDER BY rn), 0) AS before FROM s)
SELECT conv_id, turn, CASE WHEN cum <= 800 THEN line ELSE role || ': ' || substr(trim(text), 1, (800 - before) * 3) || '...' END AS line FROM b WHERE before <= 800 AND (cum <= 800 OR (800 - before) * 3 > 50)""",
)
def win_history_summary(t: Tables):
    return S.history_lines(t.conversations, "conv_id", "turn")


@query("win_tail_n", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS rn FROM conversations) WHERE role = 'system' OR rn <= 4")
def win_tail_n(t: Tables):
    own = F.col("role") == "system"
    d = t.conversations.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id", own).orderBy(F.col("turn").desc())))
    return d.where(own | (F.col("rn") <= 4)).select("conv_id", "turn")


@query("filter_intent_history", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4 AND role IN ('user', 'assistant')")
def filter_intent_history(t: Tables):
    d = t.conversations.withColumn("rn", F.row_number().over(S.ordered("conv_id", F.col("turn").desc())))
    return d.where("rn <= 4 and role in ('user', 'assistant')").select("conv_id", "turn")


@query("set_concat_tiers", f"SELECT conv_id, turn, tier FROM (SELECT conv_id, turn, (total > 2 AND round_id <= total - 2)::INT AS e FROM (SELECT *, max(round_id) OVER (PARTITION BY conv_id) AS total FROM ({_ROUND}))), (VALUES (0, 'recent'), (1, 'earlier')) v(k, tier) WHERE k = e")
def set_concat_tiers(t: Tables):
    d = S.recent_rounds(t.conversations, "conv_id", "turn", F.col("role") == "user", 2)
    part = lambda c, name: d.where(c).select("conv_id", "turn", F.lit(name).alias("tier"))
    return part("not recent", "earlier").unionByName(part("recent", "recent"))


@query("predicate_fold", "SELECT doc_id, length(text) > 4000 OR length(text) - length(replace(text, chr(10), '')) + 1 > 120 AS folded, substr(array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)), 1, 500) AS preview, length(text) AS size FROM documents")
def predicate_fold(t: Tables):
    return t.documents.select("doc_id", T.must_fold(F.col("text")).alias("folded"), T.preview(F.col("text")).alias("preview"), F.length("text").cast("long").alias("size"))


@query("fn_preview", "SELECT doc_id, substr(array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)), 1, 80) AS preview FROM documents")
def fn_preview(t: Tables):
    return t.documents.select("doc_id", T.preview(F.col("text"), 2, 80).alias("preview"))


@query("fn_truncate_mark", "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS text FROM documents")
def fn_truncate_mark(t: Tables):
    return t.documents.select("doc_id", T.truncated(F.col("text"), 120).alias("text"))


@query("limit_text", "SELECT doc_id, substr(text, 1, 60) AS head, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS lines FROM documents")
def limit_text(t: Tables):
    return t.documents.select("doc_id", F.substring("text", 1, 60).alias("head"), F.array_join(F.slice(F.split("text", "\n"), 1, 3), "\n").alias("lines"))


@query("sink_artifact_fold", "SELECT doc_id, length(text) AS size, md5(text) AS digest FROM documents WHERE length(text) > 4000 OR length(text) - length(replace(text, chr(10), '')) + 1 > 120")
def sink_artifact_fold(t: Tables):
    return S.folded(t.documents.select("doc_id", "text"), "text")[1].select("doc_id", F.length("text").cast("long").alias("size"), F.md5("text").alias("digest"))


@query(
    "events_to_messages",
    """WITH i AS (SELECT *, sum(CASE WHEN role = p THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations))
SELECT conv_id, island, role, min(turn) AS first, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island, role""",
)
def events_to_messages(t: Tables):
    return S.merged_runs(t.conversations, "conv_id", "turn", "role", "text")


@query(
    "event_compact",
    """WITH e AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 1 THEN 'assistant' WHEN turn % 3 = 2 THEN 'tool_result' ELSE 'user_input' END AS type FROM conversations),
r AS (SELECT *, sum((type = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM e),
m AS (SELECT *, max(r) OVER (PARTITION BY conv_id) AS total FROM r),
f AS (SELECT *, type = 'tool_result' AND total > 1 AND r <= total - 1 AND length(text) > 120 AS fold FROM m)
SELECT conv_id, turn, CASE WHEN fold THEN 'tool_result_ref' ELSE type END AS type, CASE WHEN fold THEN substr(text, 1, 120) || '…' ELSE text END AS text, CASE WHEN fold THEN length(text) END AS size FROM f""",
)
def event_compact(t: Tables):
    kind = F.when(F.col("turn") % 3 == 1, "assistant").when(F.col("turn") % 3 == 2, "tool_result").otherwise("user_input")
    e = t.conversations.select("conv_id", "turn", "text", kind.alias("type"))
    return S.compacted(e, "conv_id", "turn", 1).withColumn("size", F.col("size").cast("long"))


@query(
    "history_two_tier",
    f"""WITH t AS (SELECT *, {EST} AS tok FROM conversations), r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS rnd FROM t),
m AS (SELECT *, max(rnd) OVER (PARTITION BY conv_id) AS total FROM r), n AS (SELECT *, total <= 1 OR rnd > total - 1 AS recent FROM m),
c AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS cum FROM n WHERE recent), k AS (SELECT * FROM c WHERE cum <= 600),
u AS (SELECT conv_id, max(cum) AS used FROM k GROUP BY conv_id),
o AS (SELECT n.conv_id, turn, sum(tok) OVER (PARTITION BY n.conv_id) AS every, 600 - coalesce(used, 0) AS room FROM n LEFT JOIN u ON u.conv_id = n.conv_id WHERE NOT recent)
SELECT conv_id, turn, 'recent' AS tier, FALSE AS needs_compaction FROM k UNION ALL SELECT conv_id, turn, 'earlier', every > room FROM o WHERE room > 200""",
)
def history_two_tier(t: Tables):
    return S.two_tier_history(t.conversations, "conv_id", "turn", 1, 600)


@query(
    "history_optimize",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, turn, CASE WHEN rn <= 2 THEN text WHEN role = 'system' THEN CASE WHEN length(text) > 220 THEN substr(text, 1, 220) || '...[truncated]' ELSE text END ELSE '' END AS text FROM r WHERE rn <= 2 OR role IN ('system', 'assistant')""",
)
def history_optimize(t: Tables):
    d = t.conversations.withColumn("rn", F.row_number().over(S.ordered("conv_id", F.col("turn").desc()))).where("rn <= 2 or role in ('system', 'assistant')")
    text = F.when(F.col("rn") <= 2, F.col("text")).when(F.col("role") == "system", T.truncated(F.col("text"), 220, "...[truncated]")).otherwise("")
    return d.select("conv_id", "turn", text.alias("text"))


@query("past_blocks_context", f"SELECT conv_id, turn, round_id FROM (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY round_id DESC) AS k FROM ({_ROUND})) WHERE k BETWEEN 2 AND 3")
def past_blocks_context(t: Tables):
    d = S.round_id(t.conversations, "conv_id", "turn", F.col("role") == "user")
    return d.withColumn("k", F.dense_rank().over(S.ordered("conv_id", F.col("round_id").desc()))).where("k between 2 and 3").select("conv_id", "turn", "round_id")


@query("stream_session_block", f"SELECT conv_id, round_id AS block, count(*) AS n, min(turn) AS first, max(turn) AS last FROM ({_ROUND}) GROUP BY ALL")
def stream_session_block(t: Tables):
    return S.round_id(t.conversations, "conv_id", "turn", F.col("role") == "user").groupBy("conv_id", F.col("round_id").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max("turn").alias("last"))


@query("agg_block_seal", f"SELECT conv_id, round_id AS block, list(DISTINCT role ORDER BY role) AS roles, count(*) AS n FROM ({_ROUND}) GROUP BY ALL")
def agg_block_seal(t: Tables):
    return S.round_id(t.conversations, "conv_id", "turn", F.col("role") == "user").groupBy("conv_id", F.col("round_id").alias("block")).agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("n"))


@query(
    "join_request_response",
    """SELECT conv_id, turn AS req, CASE WHEN r = 'assistant' THEN n END AS resp FROM (SELECT *, lead(role) OVER w AS r, lead(turn) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
)
def join_request_response(t: Tables):
    w = S.ordered("conv_id", "turn")
    d = t.conversations.withColumns({"r": F.lead("role").over(w), "n": F.lead("turn").over(w)}).where("role = 'user'")
    return d.select("conv_id", F.col("turn").alias("req"), F.when(F.col("r") == "assistant", F.col("n")).alias("resp"))


@query("sink_insert", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey + 10000000, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def sink_insert(t: Tables):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return o.select("o_orderkey", "o_totalprice").unionByName(o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_totalprice"))


@query("sink_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 1.5::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def sink_update(t: Tables):
    base = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderpriority") == "5-LOW", 1.5).alias("o_totalprice"))
    return S.updated(base, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("sink_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def sink_delete(t: Tables):
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")  # rows go with their order


@query("sink_vector_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def sink_vector_upsert(t: Tables):
    return S.last_of(t.events, "user_id", F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type")


@query("win_lru", "SELECT user_id FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) ORDER BY last DESC, user_id LIMIT 100")
def win_lru(t: Tables):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.col("last").desc(), "user_id").limit(100).select("user_id")


@query("viewport_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30 OFFSET 25")
def viewport_slice(t: Tables):
    return t.documents.select("doc_id").orderBy("doc_id").offset(25).limit(30)


_MEMORY = "(SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN substr(lag(text, 2) OVER w, 3, 40) WHEN 4 THEN ' ' || lag(text) OVER w || ' ' ELSE text END AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(
    "memory_dedup",
    f"""WITH e AS {_MEMORY} SELECT a.conv_id, a.turn, EXISTS (SELECT 1 FROM e b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND regexp_replace(b.text, '^\\s+|\\s+$', '', 'g') <> '' AND contains(b.text, regexp_replace(a.text, '^\\s+|\\s+$', '', 'g'))) AS duplicate FROM e a""",
)
def memory_dedup(t: Tables):
    """Entries of a conversation's memory; some are cut from an earlier one, some repeat the one before."""
    w = S.ordered("conv_id", "turn")
    text = F.when(F.col("turn") % 5 == 3, F.substring(F.lag("text", 2).over(w), 3, 40)).when(F.col("turn") % 5 == 4, F.concat(F.lit(" "), F.lag("text").over(w), F.lit(" "))).otherwise(F.col("text"))
    return S.duplicate_entries(t.conversations.select("conv_id", "turn", text.alias("text")), "conv_id", "turn", "text").select("conv_id", "turn", "duplicate")


_MESSAGES = """(SELECT conv_id, turn, (['user', 'assistant', 'tool', 'tool', 'system'])[(turn + conv_id) % 5 + 1] AS role, CASE WHEN length(text) % 2 = 0 AND (turn + conv_id) % 5 = 1 THEN '' ELSE text END AS content, (turn + conv_id) % 5 = 1 AND length(text) % 3 = 0 AS has_calls FROM conversations)"""


@query(
    "repair_message_groups",
    f"""WITH m AS (SELECT *, role = 'assistant' AND coalesce(content, '') = '' AND NOT has_calls AS lost FROM {_MESSAGES}),
g AS (SELECT *, sum((role <> 'tool')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM m),
h AS (SELECT *, bool_or(lost) OVER (PARTITION BY conv_id, g) AS inside FROM g)
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND content = '' THEN NULL ELSE content END AS content, has_calls FROM h WHERE NOT inside
UNION ALL SELECT conv_id, min(turn), 'user', '[Tool Result]' || chr(10) || string_agg(substr(coalesce(content, ''), 1, 500), chr(10) || '---' || chr(10) ORDER BY turn) FILTER (NOT lost), FALSE FROM h WHERE inside GROUP BY conv_id, g HAVING count(*) FILTER (NOT lost) > 0""",
)
def repair_message_groups(t: Tables):
    k, c = (F.col("turn") + F.col("conv_id")) % 5, F.col
    role = F.array(*[F.lit(x) for x in ("user", "assistant", "tool", "tool", "system")])[k.cast("int")]
    content = F.when((F.length("text") % 2 == 0) & (k == 1), "").otherwise(c("text"))
    d = t.conversations.select("conv_id", "turn", role.alias("role"), content.alias("content"), ((k == 1) & (F.length("text") % 3 == 0)).alias("has_calls"))
    return S.repaired_messages(d, "conv_id", "turn")
