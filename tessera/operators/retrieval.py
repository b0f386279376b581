"""Lexical and vector search, and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def postings(docs: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """(key, term, tf): how often each document has each term, fields counted by their weights. One shuffle, summed before it."""
    bags = [docs.select(key, F.explode(T.tokens(F.col(f))).alias("term"), F.lit(w).cast("long").alias("w")) for f, w in fields.items()]
    bag = bags[0]
    for b in bags[1:]:
        bag = bag.unionByName(b)
    return bag.groupBy(key, "term").agg(F.sum("w").alias("tf"))


def lengths(docs: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """(key, length): weighted number of tokens; needs no shuffle."""
    total = F.lit(0).cast("long")
    for f, w in fields.items():
        total = total + F.size(T.tokens(F.col(f))) * w
    return docs.select(key, total.alias("length"))


def document_frequency(posts: DataFrame) -> DataFrame:
    """(term, df): number of documents that have a term."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_search(docs: DataFrame, key: str, query: Sequence[str], k: int = 10, fields: dict[str, int] | None = None) -> DataFrame:
    """(key, score): the k documents with the highest positive BM25 score; ties by key. A term that the query repeats counts as often.

    Only the query's terms leave a document, with its length, so what is shuffled is a few rows of the documents that
    have any; lengths need no join. Corpus statistics are one row. A query without terms finds nothing.
    """
    fields = fields or {"text": 1}
    spark = docs.sparkSession
    terms = spark.createDataFrame([(t, query.count(t)) for t in dict.fromkeys(query)], "term string, times int")
    length, hits = F.lit(0).cast("long"), []
    for f, w in fields.items():
        length = length + F.size(T.tokens(F.col(f))) * w
        hits.append(_weighed(F.filter(T.tokens(F.col(f)), lambda t: t.isin(list(query) or [""])), w))
    base = docs.select(key, length.alias("length"), F.concat(*hits).alias("hits"))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    posts = base.select(key, "length", F.explode("hits").alias("h")).groupBy(key, "length", "h.term").agg(F.sum("h.w").alias("tf"))
    df = posts.groupBy("term").agg(F.count("tf").alias("df"))  # like the terms, a row for each term of the query; it counts tf so that both sides are one exchange
    scored = posts.join(F.broadcast(df), "term").join(F.broadcast(terms), "term").crossJoin(F.broadcast(stats))
    part = T.bm25_term(T.idf(F.col("n"), F.col("df")), F.col("tf"), F.col("length"), F.col("average")) * F.col("times")
    return scored.groupBy(key).agg(F.sum(part).alias("score")).where("score > 0").orderBy(F.col("score").desc(), key).limit(k)


def _weighed(words: Column, w: int) -> Column:
    return F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(w).cast("long").alias("w")))


def vector_search(vectors: DataFrame, key: str, column: str, query: Sequence[float], k: int = 10, least: float | None = None) -> DataFrame:
    """(key, sim): the k vectors of the highest cosine similarity (not below 0), ties by key; with ``least`` those below it are left out. Each task keeps its own k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = vectors.select(key, F.greatest(F.lit(0.0), T.cosine(F.col(column), q)).alias("sim")).orderBy(F.col("sim").desc_nulls_last(), key).limit(k)
    return found if least is None else found.where(F.col("sim") >= least)


def ranked(lists: DataFrame, strategy: str, score: str, name: str) -> DataFrame:
    """Adds the 1-based rank of each row in its strategy's list."""
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(strategy).orderBy(F.col(score).desc(), name)))


def fuse(lists: DataFrame, name: str = "name", strategies: Sequence[str] = ("lexical", "vector")) -> DataFrame:
    """One row for each name of ranked lists (name, strategy, source, rank, score): its rank in each of the strategies, fused score, match type and source.

    A local row wins over a remote one of the same name. Ranks in the lists of ``strategies``, any number of them, are fused by
    reciprocal rank, and the match type is the one strategy that has the name, or hybrid; a row in none of them is listed and keeps its score.
    """
    of = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    ranks = [f"{s}_rank" for s in strategies]
    own = F.max(F.when(~F.col("strategy").isin(list(strategies)), F.col("score"))).alias("own")
    one = lists.groupBy(name).agg(*[of(s, "rank").alias(r) for s, r in zip(strategies, ranks)], F.min("source").alias("source"), own)
    found = sum((F.col(r).isNotNull().cast("int") for r in ranks), F.lit(0))
    kind = F.when(found > 1, "hybrid").otherwise(F.coalesce(*[F.when(F.col(r).isNotNull(), s) for s, r in zip(strategies, ranks)], F.lit("listed")))
    score = F.when(found == 0, F.col("own")).otherwise(T.rrf(*[F.col(r) for r in ranks]))
    return one.select(name, "source", *ranks, score.alias("score"), kind.alias("match_type"))


class Recall(NamedTuple):
    """A way to find names: a strategy, where it looks, and a function of (query, k) that gives (name, score)."""

    strategy: str
    source: str
    find: Callable[[Any, int], DataFrame]


def multi_recall(recalls: Sequence[Recall], query: Any, k: int, each: int = 60) -> DataFrame:
    """The first k names that any of the recalls finds, each asked for its first ``each``, fused over their strategies. A later recall of a strategy adds to its list."""
    strategies = list(dict.fromkeys(r.strategy for r in recalls))
    lists = reduce(DataFrame.unionByName, [r.find(query, each).select("name", F.col("score").cast("double").alias("score")).withColumns({"strategy": F.lit(r.strategy), "source": F.lit(r.source)}) for r in recalls])
    return tiered(fuse(ranked(lists, "strategy", "score", "name"), strategies=strategies), k)


def tiered(candidates: DataFrame, k: int, name: str = "name") -> DataFrame:
    """The first k candidates: local ones, then remote, each by falling score; ties by name."""
    tier = F.when(F.col("source") == "local", 0).otherwise(1)
    return candidates.withColumn("tier", tier).orderBy("tier", F.col("score").desc(), name).limit(k)
