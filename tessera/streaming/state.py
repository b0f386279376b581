"""Stateful operators over keyed event streams, and the same steps over tables.

A step is a function of (state, row) that gives (state, output). ``scan`` applies it to a table: rows are shuffled by
key and sorted in each partition, and pass through one at a time, so a key with any number of rows needs no more memory
than its state. ``stream`` applies it to a stream, with the state in Spark's store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessera.shipping import ship

Step = Callable[[Any, dict], tuple[Any, list[tuple]]]


def scan(df: DataFrame, key: str, order: Sequence[str], step: Step, schema: str) -> DataFrame:
    """Outputs of a step over each key's rows in order, from state None."""
    ship(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, object()
        for b in batches:
            rows = []
            for row in b.to_pylist():
                if row[key] != last:
                    state, last = None, row[key]
                state, got = step(state, row)
                rows += got
            cols = list(zip(*rows)) if rows else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, out)], schema=out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class _Stepper(StatefulProcessor):
    """Applies a step to each key's rows; the state is a JSON text in a value state, which expires by itself after ``minutes``."""

    def __init__(self, order: Sequence[str], step: Step, names: Sequence[str], minutes: int | None):
        self.order, self.step, self.names, self.minutes = list(order), step, list(names), minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string", *([self.minutes * 60_000] if self.minutes else []))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = json.loads(self.state.get()[0]) if self.state.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            now, got = self.step(now, row)
            out += got
        if now is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


#: Stores of state that can hold those of ``stream``.
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(df: DataFrame, key: str, order: Sequence[str], step: Step, schema: str, minutes: int | None = None) -> DataFrame:
    """Outputs of a step over a stream, as rows arrive; within a batch in order. State is kept as JSON by key, for ``minutes`` without rows if given, in the session's RocksDB store, which is chosen if the session has no store of its own."""
    spark = df.sparkSession
    ship(spark)
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)
    out = StructType.fromDDL(schema)
    processor = _Stepper(order, step, out.names, minutes)
    return df.groupBy(key).transformWithStateInPandas(processor, out, "Append", "ProcessingTime" if minutes else "None")


def sliding_limit(most: int, seconds: float, key: str, time: str, ident: str) -> Step:
    """(key, ident, accepted): at most ``most`` accepted rows in the trailing window, whose start is outside it; refused rows do not count."""

    def step(state, row):
        kept = [t for t in state or [] if t > row[time] - seconds]
        ok = len(kept) < most
        return kept + [row[time]] * ok, [(row[key], row[ident], ok)]

    return step


def token_bucket(rate: float, most: float, key: str, time: str, ident: str) -> Step:
    """(key, ident, accepted, tokens): each accepted row takes a token of a bucket that refills at ``rate`` a second up to ``most``."""

    def step(state, row):
        tokens, last = state or (most, row[time])
        tokens = min(most, tokens + (row[time] - last) * rate)
        ok = tokens >= 1
        return [tokens - ok, row[time]], [(row[key], row[ident], ok, tokens - ok)]

    return step


def circuit_breaker(key: str, time: str, ident: str, failed: str, failures: int = 5, seconds: float = 60.0, trials: int = 3) -> Step:
    """(key, ident, allowed, state): opens after ``failures``, tries again after ``seconds``, closes after ``trials`` successes. Calls that are not allowed have no outcome."""

    def step(state, row):
        kind, n, at, tried = state or ("closed", 0, 0.0, 0)
        if kind == "open" and row[time] - at >= seconds:
            kind, tried = "half_open", 0
        allowed = kind == "closed" or kind == "half_open" and tried < trials
        if allowed and row[failed]:
            n, at = n + 1, row[time]
            if kind == "half_open" or n >= failures:
                kind = "open"
        elif allowed and kind == "half_open":
            tried += 1
            if tried >= trials:
                kind, n = "closed", 0
        elif allowed:
            n = max(0, n - 1)
        return [kind, n, at, tried], [(row[key], row[ident], allowed, kind)]

    return step


def run_accumulator(key: str) -> Step:
    """(run, output, messages): texts between START and END of messages, joined by lines when the run finishes; a given output replaces them; nothing of a run that fails."""

    def step(state, row):
        done, open_ = state or ([], None)
        kind = row["type"]
        if kind == "TEXT_MESSAGE_START":
            open_ = ""
        elif kind == "TEXT_MESSAGE_CONTENT" and open_ is not None:
            open_ += row["delta"] or ""
        elif kind == "TEXT_MESSAGE_END" and open_ is not None:
            done, open_ = done + [open_], None
        elif kind == "RUN_FINISHED":
            return None, [(row[key], row["output"] or "\n".join(done), len(done))]
        elif kind == "RUN_ERROR":
            return None, []
        return [done, open_], []

    return step


def tool_transcript(key: str) -> Step:
    """(run, call, role, content): two rows for each result, of its pending call and of the result; calls are forgotten when the run ends."""

    def step(state, row):
        pending = dict(state or {})
        if row["type"] == "TOOL_CALL_START":
            pending[row["call"]] = row["delta"]
        elif row["type"] == "TOOL_CALL_RESULT":
            return pending, [(row[key], row["call"], "assistant", pending.pop(row["call"], None)), (row[key], row["call"], "tool", row["delta"])]
        elif row["type"] in ("RUN_FINISHED", "RUN_ERROR"):
            return None, []
        return pending, []

    return step


def sticky_route(workers: Sequence[str], key: str, ident: str) -> Step:
    """(key, ident, worker): the worker that a key's hash names first stays its worker while it is there."""

    def step(state, row):
        worker = state if state in workers else sorted(workers)[sum(str(row[key]).encode()) % len(workers)]
        return worker, [(row[key], row[ident], worker)]

    return step


def heartbeat(seconds: float, key: str, time: str, ident: str) -> Step:
    """(key, ident, missed): how many beats a connection has missed since its last row."""

    def step(state, row):
        return row[time], [(row[key], row[ident], int((row[time] - (state if state is not None else row[time])) // seconds))]

    return step


def runtime_state(key: str, ident: str, most: int = 3) -> Step:
    """(key, ident, blocked): actions without effect are blocked once they have failed ``most`` times; an effect clears them."""

    def step(state, row):
        seen = dict(state or {})
        if row["category"] == "effect":
            seen = {}
        else:
            seen[row["action"]] = seen.get(row["action"], 0) + 1
        return seen, [(row[key], row[ident], sorted(a for a, n in seen.items() if n >= most))]

    return step


def deduplicated(df: DataFrame, time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """A stream without rows that repeat ``keys`` within a delay."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(df: DataFrame, time: str, keys: Sequence[str], size: str, delay: str) -> DataFrame:
    """Counts by window and keys of a stream; rows later than ``delay`` are left out."""
    return df.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))


def matched_calls(calls: DataFrame, results: DataFrame, within: str) -> DataFrame:
    """Results of a stream with their calls, at most ``within`` before; results without a call stay, with null arguments. calls: call, call_ts, arguments. results: call, ts, result."""
    c = calls.withWatermark("call_ts", within).withColumnRenamed("call", "__call")
    r = results.withWatermark("ts", within)
    on = (F.col("call") == F.col("__call")) & (F.col("call_ts") <= F.col("ts")) & (F.col("call_ts") >= F.col("ts") - F.expr(f"interval {within}"))
    return r.join(c, on, "left_outer").drop("__call")


def fan_out(df: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]]):
    """A writer that gives each batch of a stream to every sink; the batch is computed once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(each)
