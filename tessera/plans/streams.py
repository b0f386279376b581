"""Queries of stateful operators, run over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.sessions import ordered
from tessera.plans.registry import Tables, query
from tessera.streaming import state as St


def _timed(t: Tables):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.select("event_id", "user_id", seconds.alias("t"), (F.col("event_type") == "error").alias("failed"), "event_type")


_N = "SELECT *, epoch_us(ts) / 1e6 AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


def _steps(first: str, then: str, out: str) -> str:
    """SQL that carries a state along each user's events: columns of the first event, and of the next from the state s and the event e."""
    return f"""WITH RECURSIVE e AS ({_N}), s AS (SELECT user_id, event_id, n, {first} FROM e WHERE n = 1 UNION ALL SELECT user_id, event_id, n, {then} FROM (SELECT e.user_id, e.event_id, e.n, e.t, e.failed, s.* EXCLUDE (user_id, event_id, n) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id, event_id, {out} FROM s"""


_KEPT = "list_filter(kept, lambda x: x > t - 86400)"
_TOKENS = "least(3, tokens + (t - last) * (2 / 86400::DOUBLE))"
_KIND = "(CASE WHEN state = 'open' AND t - since >= 86400 THEN 'half_open' ELSE state END)"
_TRIED = "(CASE WHEN state = 'open' AND t - since >= 86400 THEN 0 ELSE tried END)"
_ALLOWED = f"({_KIND} = 'closed' OR {_KIND} = 'half_open' AND {_TRIED} < 3)"
_NEXT = f"""{_ALLOWED} AS allowed,
CASE WHEN {_ALLOWED} AND failed AND ({_KIND} = 'half_open' OR f + 1 >= 2) THEN 'open' WHEN {_ALLOWED} AND NOT failed AND {_KIND} = 'half_open' AND {_TRIED} + 1 >= 3 THEN 'closed' ELSE {_KIND} END AS state,
CASE WHEN {_ALLOWED} AND failed THEN f + 1 WHEN {_ALLOWED} AND {_KIND} = 'half_open' THEN CASE WHEN {_TRIED} + 1 >= 3 THEN 0 ELSE f END WHEN {_ALLOWED} THEN greatest(0, f - 1) ELSE f END AS f,
CASE WHEN {_ALLOWED} AND failed THEN t ELSE since END AS since, CASE WHEN {_ALLOWED} AND NOT failed AND {_KIND} = 'half_open' THEN {_TRIED} + 1 ELSE {_TRIED} END AS tried"""


@query("stream_sliding_rate_limit", _steps("[t] AS kept, true AS accepted", f"CASE WHEN len({_KEPT}) < 3 THEN list_append({_KEPT}, t) ELSE {_KEPT} END AS kept, len({_KEPT}) < 3 AS accepted", "accepted"))
def stream_sliding_rate_limit(t: Tables):
    return St.scan(_timed(t), "user_id", ["t", "event_id"], St.sliding_limit(3, 86_400.0, "user_id", "t", "event_id"), "user_id long, event_id long, accepted boolean")


@query("stream_token_bucket", _steps("2::DOUBLE AS tokens, t AS last, true AS accepted", f"CASE WHEN {_TOKENS} >= 1 THEN {_TOKENS} - 1 ELSE {_TOKENS} END AS tokens, t AS last, {_TOKENS} >= 1 AS accepted", "accepted, round(tokens, 6) AS tokens"))
def stream_token_bucket(t: Tables):
    d = St.scan(_timed(t), "user_id", ["t", "event_id"], St.token_bucket(2 / 86_400, 3.0, "user_id", "t", "event_id"), "user_id long, event_id long, accepted boolean, tokens double")
    return d.withColumn("tokens", F.round("tokens", 6))


@query("stream_circuit_breaker", _steps("true AS allowed, 'closed' AS state, failed::INT AS f, CASE WHEN failed THEN t ELSE 0 END AS since, 0 AS tried", _NEXT, "allowed, state"))
def stream_circuit_breaker(t: Tables):
    return St.scan(_timed(t), "user_id", ["t", "event_id"], St.circuit_breaker("user_id", "t", "event_id", "failed", 2, 86_400.0), "user_id long, event_id long, allowed boolean, state string")


def _runs(t: Tables):
    w = ordered("conv_id", "turn")
    d = t.conversations.select("conv_id", "turn", "text", "role", F.lead("turn").over(w).isNull().alias("last"))
    kinds = F.array(F.lit("TEXT_MESSAGE_START"), F.lit("TEXT_MESSAGE_CONTENT"), F.lit("TEXT_MESSAGE_END"))
    d = d.select("conv_id", "turn", "text", F.posexplode(F.when(F.col("last"), F.concat(kinds, F.array(F.lit("RUN_FINISHED")))).otherwise(kinds)).alias("k", "type"))
    return d.select("conv_id", (F.col("turn") * 10 + F.col("k")).alias("at"), "type", F.when(F.col("type") == "TEXT_MESSAGE_CONTENT", F.col("text")).alias("delta"), F.lit(None).cast("string").alias("output"), F.col("turn").cast("string").alias("call"))


@query("stream_run_accumulate", "SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS output, count(*) AS messages FROM conversations GROUP BY conv_id")
def stream_run_accumulate(t: Tables):
    return St.scan(_runs(t), "conv_id", ["at"], St.run_accumulator("conv_id"), "conv_id long, output string, messages long")


@query(
    "stream_tool_transcript",
    """WITH c AS (SELECT * FROM conversations WHERE turn % 2 = 0), r AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE turn % 2 = 1)
SELECT r.conv_id, r.turn::VARCHAR AS call, role, CASE role WHEN 'assistant' THEN c.text ELSE r.text END AS content FROM r LEFT JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn, (VALUES ('assistant'), ('tool')) v(role)""".replace("SELECT * FROM conversations WHERE turn % 2 = 0", "SELECT conv_id, turn, text FROM conversations WHERE turn % 2 = 0"),
)
def stream_tool_transcript(t: Tables):
    kind = F.when(F.col("turn") % 2 == 0, "TOOL_CALL_START").otherwise("TOOL_CALL_RESULT")
    d = t.conversations.select("conv_id", "turn", kind.alias("type"), F.col("text").alias("delta"), (F.col("turn") - F.col("turn") % 2).cast("string").alias("call"))
    return St.scan(d, "conv_id", ["turn"], St.tool_transcript("conv_id"), "conv_id long, call string, role string, content string")


@query("stream_sticky_route", "SELECT user_id, event_id, (['a', 'b', 'c'])[list_sum(list_transform(string_split(user_id::VARCHAR, ''), lambda c: ascii(c)))::BIGINT % 3 + 1] AS worker FROM events")
def stream_sticky_route(t: Tables):
    return St.scan(t.events.select("user_id", "event_id"), "user_id", ["event_id"], St.sticky_route(["a", "b", "c"], "user_id", "event_id"), "user_id long, event_id long, worker string")


@query(
    "stream_heartbeat",
    "SELECT user_id, event_id, coalesce(floor((epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600), 0)::BIGINT AS missed FROM events",
)
def stream_heartbeat(t: Tables):
    return St.scan(_timed(t), "user_id", ["t", "event_id"], St.heartbeat(3600.0, "user_id", "t", "event_id"), "user_id long, event_id long, missed long")


@query(
    "stream_runtime_state",
    """WITH e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
c AS (SELECT a.event_id, b.event_type, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND a.g = b.g AND b.event_id <= a.event_id AND b.event_type <> 'purchase' GROUP BY ALL HAVING count(*) >= 3)
SELECT user_id, e.event_id, coalesce(list_sort(list(c.event_type) FILTER (c.event_type IS NOT NULL)), []::VARCHAR[]) AS blocked FROM e LEFT JOIN c ON c.event_id = e.event_id GROUP BY user_id, e.event_id""",
)
def stream_runtime_state(t: Tables):
    d = t.events.select("user_id", "event_id", F.col("event_type").alias("action"), F.when(F.col("event_type") == "purchase", "effect").otherwise("other").alias("category"))
    return St.scan(d, "user_id", ["event_id"], St.runtime_state("user_id", "event_id"), "user_id long, event_id long, blocked array<string>")
