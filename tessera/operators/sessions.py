"""Sessions and their turns: rounds, budgets, folding, merging, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def ordered(session: str | Sequence[str], *order: Column | str):
    return Window.partitionBy(session).orderBy(*order)


def so_far(session, *order):
    return ordered(session, *order).rowsBetween(Window.unboundedPreceding, 0)


def round_id(turns: DataFrame, session: str, order: str, opens: Column) -> DataFrame:
    """Adds the number of rows up to this one that open a round; 0 before the first."""
    return turns.withColumn("round_id", F.sum(opens.cast("long")).over(so_far(session, order)))


def recent_rounds(turns: DataFrame, session: str, order: str, opens: Column, keep: int) -> DataFrame:
    """Adds ``recent``: whether a row is in the last ``keep`` rounds; all rows are where there are no more."""
    d = round_id(turns, session, order, opens)
    total = F.max("round_id").over(Window.partitionBy(session))
    return d.withColumn("recent", (total <= keep) | (F.col("round_id") > total - keep))


def budget(turns: DataFrame, session: str, tokens: Column, most: int, *order: Column | str) -> DataFrame:
    """Adds the running sum of tokens in an order and keeps the rows before the first that overflows."""
    return turns.withColumn("cum", F.sum(tokens).over(so_far(session, *order))).where(F.col("cum") <= most)


def last_of(rows: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__rn", F.row_number().over(ordered(key, *newest_first))).where("__rn = 1").drop("__rn")


def upserted(base: DataFrame, changes: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """base after changes: the newest change of a key replaces or adds its row."""
    new = last_of(changes, key, *newest_first).select(*base.columns)
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new)


def updated(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with the columns of its key's change that are not null; changes have a row a key."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(new, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def islands(rows: DataFrame, session: str, order: Sequence[str], differs: Column, name: str = "island") -> DataFrame:
    """Numbers runs of neighbouring rows: a run ends where ``differs`` is true or null."""
    return rows.withColumn(name, F.sum(F.coalesce(differs, F.lit(True)).cast("long")).over(so_far(session, *order)))


def merged_runs(turns: DataFrame, session: str, order: str, role: str, text: str, between: str = "\n") -> DataFrame:
    """One row for each run of rows with the same role: session, island, role, first, n, text joined in order."""
    w = ordered(session, order)
    d = islands(turns, session, [order], F.col(role) != F.lag(role).over(w))
    g = d.groupBy(session, "island", role).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("x"))
    return g.select(session, "island", role, "first", "n", F.array_join(F.transform("x", lambda x: x["t"]), between).alias("text"))


def folded(rows: DataFrame, text: str, chars: int = 4000, lines: int = 120) -> tuple[DataFrame, DataFrame]:
    """(main, artifacts): long texts move to artifacts; main keeps a preview and the size."""
    fold = F.coalesce(T.must_fold(F.col(text), chars, lines), F.lit(False))
    main = rows.withColumns({"folded": fold, "size": F.length(text).cast("long"), text: F.when(fold, T.preview(F.col(text))).otherwise(F.col(text))})
    return main, rows.where(fold)


def compacted(events: DataFrame, session: str, order: str, keep: int = 8, chars: int = 120) -> DataFrame:
    """Events with tool results older than the last ``keep`` rounds (an assistant event opens one) cut to previews, if there are more rounds."""
    d = recent_rounds(events, session, order, F.col("type") == "assistant", keep)
    fold = (F.col("type") == "tool_result") & ~F.col("recent") & (F.length("text") > chars)
    return d.withColumns({"type": F.when(fold, "tool_result_ref").otherwise(F.col("type")), "size": F.when(fold, F.length("text")), "text": F.when(fold, T.truncated(F.col("text"), chars)).otherwise(F.col("text"))}).drop("round_id", "recent")


def history_lines(turns: DataFrame, session: str, order: str, rounds: int = 3, most: int = 800) -> DataFrame:
    """The last 2 x rounds user and assistant turns as ``role: text`` lines, newest first within a token budget; the line at its edge is cut to three characters a token left, if over 50."""
    d = turns.where(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).withColumn("line", F.concat("role", F.lit(": "), F.trim("text")))
    d = d.withColumn("__rn", F.row_number().over(ordered(session, F.col(order).desc()))).where(F.col("__rn") <= 2 * rounds)
    d = d.withColumn("__cum", F.sum(T.token_estimate(F.col("line"))).over(so_far(session, "__rn"))).withColumn("__before", F.coalesce(F.lag("__cum").over(ordered(session, "__rn")), F.lit(0)))
    room = (F.lit(most) - F.col("__before")) * 3
    cut = F.concat("role", F.lit(": "), F.substring(F.trim("text"), F.lit(1), room.cast("int")), F.lit("..."))
    d = d.where((F.col("__before") <= most) & ((F.col("__cum") <= most) | (room > 50)))
    return d.select(session, order, F.when(F.col("__cum") <= most, F.col("line")).otherwise(cut).alias("line"))


def two_tier_history(turns: DataFrame, session: str, order: str, keep: int, most: int) -> DataFrame:
    """(session, order, tier, needs_compaction): recent rounds within the budget newest first, and earlier rows if their tokens fit in what is left (over 200), else flagged for compaction."""
    d = recent_rounds(turns.withColumn("__t", T.token_estimate(F.col("text"))), session, order, F.col("role") == "user", keep)
    new = d.where("recent").withColumn("__cum", F.sum("__t").over(so_far(session, F.col(order).desc()))).where(F.col("__cum") <= most)
    used = new.groupBy(session).agg(F.max("__cum").alias("__used"))
    old = d.where("not recent").withColumn("__all", F.sum("__t").over(Window.partitionBy(session))).join(used, session, "left").withColumn("__left", F.lit(most) - F.coalesce("__used", F.lit(0))).where("__left > 200")
    a = new.select(session, order, F.lit("recent").alias("tier"), F.lit(False).alias("needs_compaction"))
    return a.unionByName(old.select(session, order, F.lit("earlier").alias("tier"), (F.col("__all") > F.col("__left")).alias("needs_compaction")))


def numbered(df: DataFrame, group: Sequence[str], value: Column, ties: Sequence[str], out: str, falling: bool = False, parts: int = 64) -> DataFrame:
    """Adds ``out``: each row's place from 1 in its group by a numeric value, then by ties; null values last.

    Groups may hold most rows, so none is one window: percentiles of the value cut it into about ``parts`` ranges, rows
    are numbered within (group, range), and what stands before a range comes from counts by range, a few rows a group.
    """
    v = value.cast("double")
    cuts = df.agg(F.percentile_approx(v, [k / parts for k in range(1, parts)], 1000)).first()[0] or []  # at most ``parts`` numbers
    cuts = sorted(set(cuts))
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < v)) if cuts else F.lit(0)
    at = F.when(v.isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - at if falling else at)
    d = df.withColumn("__v", value).withColumn("__at", at)
    sums = d.groupBy(*group, "__at").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__at").alias("__range"), F.coalesce(before, F.lit(0)).alias("__before"))
    order = F.col("__v").desc_nulls_last() if falling else F.col("__v").asc_nulls_last()
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy(*group, "__at").orderBy(order, *ties)))
    same = F.col("__at") == F.col("__range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return d.join(sums, same).withColumn(out, (F.col("__rn") + F.col("__before")).cast("long")).select(*df.columns, out)


def duplicate_entries(entries: DataFrame, owner: str, order: str, text: str) -> DataFrame:
    """Adds duplicate: whether the trimmed entry stands in an earlier entry of its owner that is not blank.

    Entries meet by a hash of (owner, a word): the longest of an entry's inner words, which stands whole in any text that
    holds the entry. Entries of fewer than three words meet all earlier ones of their owner. Equal entries of an owner
    meet once, and texts are read for what has met only: the words travel without them, and by shuffles, as they are many
    times the input that Spark would take their size to be.
    """
    own, trimmed = F.col(owner), F.regexp_replace(text, r"^\s+|\s+$", "")
    at_word = lambda w: F.xxhash64(own, w)
    marks = {"__n": F.xxhash64("__t"), "__m": F.xxhash64(F.lit(1), "__t")}  # 128 bits of an owner's entry
    d = entries.withColumn("__t", trimmed)
    words = F.split("__t", r"\s+")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    best = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    new = d.where("__t is not null").groupBy(owner, "__t").agg(F.max(order).alias("__last")).select(owner, "__t", "__last", at_word(F.coalesce(best, F.lit(""))).alias("__w"))
    held = d.where("__t <> ''").groupBy(owner, F.col(text).alias("__held")).agg(F.min(order).alias("__at"))
    parts = F.array_distinct(F.concat(F.split("__held", r"\s+"), F.array(F.lit(""))))
    met = held.select("__at", F.explode(F.transform(parts, at_word)).alias("__h")).hint("merge")
    pairs = new.join(met, (F.col("__w") == F.col("__h")) & (F.col("__at") < F.col("__last"))).select(owner, "__t", "__at")
    found = pairs.join(held.hint("merge"), [owner, "__at"]).where(F.col("__held").contains(F.col("__t"))).withColumns(marks).groupBy(owner, *marks).agg(F.min("__at").alias("__first"))
    return d.withColumns(marks).drop("__t").join(found, [owner, *marks], "left").withColumn("duplicate", F.coalesce(F.col("__first") < F.col(order), F.lit(False))).drop("__first", *marks).select(*entries.columns, "duplicate")


def repaired_messages(messages: DataFrame, session: str, order: str, most: int = 500) -> DataFrame:
    """Messages (session, order, role, content, has_calls) that strict services accept.

    An assistant's message without content that calls tools has null content. One without content or calls has lost its
    calls: the tool messages right after it become one message of the user, each cut at ``most`` characters, and it is
    left out if there are none.
    """
    lost = (F.col("role") == "assistant") & (F.coalesce("content", F.lit("")) == "") & ~F.col("has_calls")
    d = messages.withColumn("__lost", lost).withColumn("__g", F.sum((F.col("role") != "tool").cast("long")).over(so_far(session, order)))
    d = d.withColumn("__in", F.first(F.col("__lost")).over(ordered([session, "__g"], order).rowsBetween(Window.unboundedPreceding, 0)) & ((F.col("role") == "tool") | F.col("__lost")) & (F.col("__g") > 0))
    plain = d.where(~F.col("__in")).select(session, order, "role", F.when((F.col("role") == "assistant") & (F.col("content") == ""), F.lit(None)).otherwise(F.col("content")).alias("content"), "has_calls")
    parts = d.where(F.col("__in")).groupBy(session, "__g").agg(F.min(order).alias(order), F.array_sort(F.collect_list(F.when(~F.col("__lost"), F.struct(F.col(order).alias("o"), F.substring(F.coalesce("content", F.lit("")), 1, most).alias("x"))))).alias("__l"))
    joined = F.concat(F.lit("[Tool Result]\n"), F.array_join(F.transform("__l", lambda r: r["x"]), "\n---\n"))
    return plain.unionByName(parts.where(F.size("__l") > 0).select(session, order, F.lit("user").alias("role"), joined.alias("content"), F.lit(False).alias("has_calls")))


def assembled(deltas: DataFrame, session: str, index: str, order: str) -> DataFrame:
    """(session, index, id, name, arguments) of tool calls that come in fragments (id, name, arguments): the last id and name that are not empty, empty if none is, and all arguments in order."""
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col(order))), F.lit(""))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("arguments", F.lit("")).alias("x"))))
    g = deltas.groupBy(session, F.coalesce(index, F.lit(0)).alias(index)).agg(last("id").alias("id"), last("name").alias("name"), parts.alias("__l"))
    return g.withColumn("arguments", F.array_join(F.transform("__l", lambda r: r["x"]), "")).drop("__l")
