"""Diagnostics of ordered event logs: loops, repeats, saturation, progress.

Every function takes rows of runs (``run``), ordered by ``order`` columns that decide ties, and gives what is known
after each row. Windows are partitioned by run, so a log of many runs spreads over the cluster.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.corpus import per_document
from tessera.operators.sessions import islands, ordered, so_far


def running(rows: DataFrame, run: str, order: Sequence[str], hit: Column, name: str) -> DataFrame:
    """Adds the number of rows of ``hit`` in a row that end here; 0 where it does not hold."""
    d = islands(rows, run, order, ~hit, "__i")
    n = F.sum(hit.cast("long")).over(so_far([run, "__i"], *order))
    return d.withColumn(name, n).drop("__i")


def observation_chain(rows: DataFrame, run: str, order: Sequence[str], most: int = 6) -> DataFrame:
    d = running(rows, run, order, F.col("category") == "observation", "chain")
    return d.withColumn("flag", F.col("chain") >= most)


def effect_ratio(rows: DataFrame, run: str, order: Sequence[str], size: int = 10, least: float = 0.15) -> DataFrame:
    """Adds the share of effects in the last ``size`` rows where there are as many, and whether it is below ``least``."""
    w = ordered(run, *order).rowsBetween(-(size - 1), 0)
    share = F.when(F.count(F.lit(1)).over(w) == size, F.avg((F.col("category") == "effect").cast("double")).over(w))
    return rows.withColumn("ratio", share).withColumn("low", F.coalesce(F.col("ratio") < least, F.lit(False)))


def diminishing(rows: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """Adds whether, of the last six observations (four at least), the last three found at most one new entity each but all together some."""
    w = ordered([run, "category"], *order)
    six = w.rowsBetween(-5, 0)
    hit = (F.count(F.lit(1)).over(six) >= 4) & (F.max("new_entities").over(w.rowsBetween(-2, 0)) <= 1) & (F.sum("new_entities").over(six) > 0)
    d = rows.withColumn("__hit", F.when(F.col("category") == "observation", hit))
    return d.withColumn("diminishing", F.coalesce(F.last("__hit", ignorenulls=True).over(so_far(run, *order)), F.lit(False))).drop("__hit")


def repeated_sequence(rows: DataFrame, run: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds pattern_len: 2 or 3 where the last names are a pattern of that length twice, in runs of six rows or more; else null."""
    w = ordered(run, *order)
    back = lambda k: F.lag(name, k).over(w)
    enough = F.count(F.lit(1)).over(so_far(run, *order)) >= 6
    two = (F.col(name) == back(2)) & (back(1) == back(3))
    three = (F.col(name) == back(3)) & (back(1) == back(4)) & (back(2) == back(5))
    return rows.withColumn("pattern_len", F.when(enough & two, 2).when(enough & three, 3))


def loops(rows: DataFrame, run: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``loop``: the first kind of loop that shows after this row, in runs of five rows or more. rows: category, new_entities."""
    d = diminishing(effect_ratio(observation_chain(rows, run, order), run, order), run, order)
    d = repeated_sequence(d, run, order, name).withColumn("__n", F.count(F.lit(1)).over(so_far(run, *order)))
    kind = F.when(F.col("flag"), "observation_chain").when(F.col("low"), "low_effect_ratio").when(F.col("diminishing"), "diminishing_returns").when(F.col("pattern_len").isNotNull(), "repeating_sequence")
    return d.withColumn("loop", F.when(F.col("__n") >= 5, kind)).drop("__n")


def consecutive(rows: DataFrame, run: str, order: Sequence[str], signature: Column, name: str, start: int = 1) -> DataFrame:
    """Adds how many rows in a row have had this row's signature, counting from ``start``."""
    d = rows.withColumn("__s", signature)
    d = islands(d, run, order, F.col("__s") != F.lag("__s").over(ordered(run, *order)), "__i")
    return d.withColumn(name, F.count(F.lit(1)).over(so_far([run, "__i"], *order)) + (start - 1)).drop("__s", "__i")


def retry_loop(rows: DataFrame, run: str, order: Sequence[str], signature: str) -> DataFrame:
    """Adds retry: the last five signatures (three at least) are one, or there are four in all and they alternate."""
    w = ordered(run, *order)
    last = F.collect_list(signature).over(w.rowsBetween(-4, 0))
    d = rows.withColumn("__l", last)
    n = F.size("__l")
    same = (n >= 3) & (F.size(F.array_distinct("__l")) == 1)
    abab = (n == 4) & (F.size(F.array_distinct("__l")) == 2) & (F.element_at("__l", 1) == F.element_at("__l", 3)) & (F.try_element_at("__l", F.lit(2)) == F.try_element_at("__l", F.lit(4)))
    return d.withColumn("retry", same | F.coalesce(abab, F.lit(False))).drop("__l")


def pattern_counts(rows: DataFrame, run: str, order: Sequence[str], text: str, signatures: dict[str, Sequence[str]]) -> DataFrame:
    """Adds, for each pattern, how many of the last five texts hold all its signatures."""
    w = ordered(run, *order).rowsBetween(-4, 0)
    for name, parts in signatures.items():
        has = F.lit(True)
        for p in parts:
            has = has & F.col(text).contains(p)
        rows = rows.withColumn(name, F.sum(F.coalesce(has, F.lit(False)).cast("long")).over(w))
    return rows


def first_seen(rows: DataFrame, run: str, order: Sequence[str], what: str) -> DataFrame:
    """The row in which each run first has each value."""
    return rows.withColumn("__rn", F.row_number().over(ordered([run, what], *order))).where("__rn = 1").drop("__rn")


def no_progress(rows: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """Adds the count without progress: strong and medium signals reset it, weak adds 1, none 2; and whether it reaches the category's threshold."""
    reset = F.col("signal").isin("strong", "medium")
    d = rows.withColumn("__i", F.sum(reset.cast("long")).over(so_far(run, *order)))
    step = F.when(reset, 0).when(F.col("signal") == "weak", 1).otherwise(2)
    d = d.withColumn("no_progress", F.sum(step.cast("long")).over(so_far([run, "__i"], *order))).drop("__i")
    limit = F.when(F.col("category") == "observation", 4).when(F.col("category") == "effect", 2).otherwise(3)
    return d.withColumn("stalled", F.col("no_progress") >= limit)


def content_similarity(results: DataFrame, run: str, order: str, text: str, chars: int = 2000) -> DataFrame:
    """Adds jaccard: common significant words of this text's first ``chars`` characters and the one before it in the run; null for the first."""
    w = ordered(run, order)
    d = results.withColumn("__w", T.significant_words(F.substring(F.col(text), 1, chars)))
    d = d.withColumn("__p", F.lag("__w").over(w))
    return d.withColumn("jaccard", F.when(F.col("__p").isNotNull(), T.jaccard(F.col("__w"), F.col("__p")))).drop("__w", "__p")


def saturation(results: DataFrame, run: str, order: str, text: str, query: str, similar: float = 0.7, new: float = 0.2, varied: float = 0.3) -> DataFrame:
    """Adds saturated: content_similarity, low_new_entities, repetitive_queries or null, the first that holds after this row, from the third row on.

    The tests: mean similarity of the last three texts' neighbours above ``similar``; less than ``new`` of the last
    three texts' entities seen once only in the run; queries of the last five rows that differ in pairs by less than
    ``varied`` on average.
    """
    w = ordered(run, order)
    d = content_similarity(results, run, order, text)
    d = d.withColumns({"__e": T.entities(F.col(text)), "__q": F.array_distinct(F.filter(F.split(F.lower(F.col(query)), r"\s+"), lambda x: x != ""))})
    # How often an entity was seen in the run up to each row: windows of one entity, not of the whole run.
    seen = d.select(run, order, F.posexplode("__e").alias("__k", "__x")).withColumn("__c", F.count(F.lit(1)).over(so_far([run, "__x"], order)))
    seen = seen.groupBy(run, order).agg(F.collect_list(F.struct(F.col("__x").alias("x"), F.col("__c").alias("c"))).alias("__seen"))
    d = d.drop("__e").join(seen, [run, order], "left")
    d = d.withColumns({"__n": F.count(F.lit(1)).over(so_far(run, order)), "__sim": F.avg("jaccard").over(w.rowsBetween(-1, 0)), "__recent": F.flatten(F.collect_list("__seen").over(w.rowsBetween(-2, 0))), "__qs": F.collect_list("__q").over(w.rowsBetween(-4, 0))})
    distinct = F.array_distinct(F.transform("__recent", lambda r: r["x"]))
    again = F.array_distinct(F.transform(F.filter("__recent", lambda r: r["c"] > 1), lambda r: r["x"]))
    fresh = F.when(F.size(distinct) > 0, 1 - F.size(again) / F.size(distinct)).otherwise(1.0)
    pairs = F.flatten(F.transform("__qs", lambda a, i: F.transform(F.slice("__qs", i + 2, F.size("__qs")), lambda b: T.jaccard(a, b))))
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)
    kind = F.when(F.col("__sim") > similar, "content_similarity").when(fresh < new, "low_new_entities").when(1 - mean < varied, "repetitive_queries")
    return d.withColumn("saturated", F.when(F.col("__n") >= 3, kind)).drop("__q", "__n", "__sim", "__recent", "__seen", "__qs")


def _canonical(arguments: str | None) -> str:
    try:
        value = json.loads(arguments or "")
    except ValueError:
        return arguments or ""
    return json.dumps(value, sort_keys=True, ensure_ascii=False) if isinstance(value, dict) else arguments or ""


def signed(actions: DataFrame, key: str, tool: str, arguments: str) -> DataFrame:
    """(key, signature): SHA-1 of the tool and its arguments, JSON objects with their keys in order at every level, so that the order in which a caller writes them does not matter. Null arguments are empty."""
    return per_document(actions.select(F.col(key).cast("long").alias(key), tool, arguments), f"{key} long, signature string", lambda i, t, a: iter([(i, hashlib.sha1(f"{t}|{_canonical(a)}".encode()).hexdigest())]))
