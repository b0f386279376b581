"""A stored inverted index for BM25: built once, read by the terms of a query, refreshed by document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T


class Bm25Index:
    """Postings of documents in a folder.

    ``postings`` has a row for each term and document, with the term's count and the document's length by field, in
    folders by hash of the term and sorted by term, so that a query reads the row groups of its own terms only.
    ``documents`` has the lengths, ``totals`` a row of counts and lengths for each build or refresh. A refresh appends a
    generation and lists what it supersedes in ``stale``, with lengths; postings of (document, generation) listed there no longer
    count. So a query reads its postings, the totals and what is stale, and no document. Fields are weighed
    when a query is answered, so one index serves all weights.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, fields: Sequence[str], buckets: int = 32):
        self.spark, self.path, self.key, self.fields, self.buckets = spark, path.rstrip("/"), key, list(fields), buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def _lengths(self) -> str:
        return ", ".join(f"len_{f} long" for f in self.fields)

    def documents(self) -> DataFrame:
        """(key, generation, len_...) of the documents that count."""
        d = self._read("documents", f"{self.key} long, generation int, {self._lengths}")
        return d.join(self.stale(), [self.key, "generation"], "left_anti")

    def stale(self, lengths: bool = False) -> DataFrame:
        return self._read("stale", f"{self.key} long, generation int" + (f", {self._lengths}" if lengths else ""))

    def statistics(self, weights: Mapping[str, int]) -> DataFrame:
        """(n, average): how many documents count, and their mean weighted length; one row."""
        total = F.sum(self._weighed("len", weights))
        every = self._read("totals", f"n long, {self._lengths}").agg(F.sum("n").alias("n"), total.alias("length"))
        gone = self.stale(lengths=True).agg(F.count(F.lit(1)).alias("gone"), F.coalesce(total, F.lit(0)).alias("lost"))
        left = F.col("n") - F.col("gone")
        return every.crossJoin(F.broadcast(gone)).select(left.alias("n"), ((F.col("length") - F.col("lost")) / F.nullif(left, F.lit(0))).alias("average"))

    def postings(self) -> DataFrame:
        """(bucket, term, key, generation, tf_..., len_...) of the documents that count."""
        counts = ", ".join(f"tf_{f} int" for f in self.fields)
        p = self._read("postings", f"term string, {self.key} long, generation int, {counts}, {self._lengths}, bucket int")
        return p.join(self.stale(), [self.key, "generation"], "left_anti")

    def build(self, docs: DataFrame) -> Bm25Index:
        """Writes the index of docs in place of what is there. Null fields are empty; a null key is left out."""
        empty = self.spark.createDataFrame([], f"{self.key} long, generation int, {self._lengths}")
        empty.write.mode("overwrite").parquet(f"{self.path}/stale")
        self._write(docs, 0, "overwrite")
        return self

    def _write(self, docs: DataFrame, generation: int, mode: str) -> None:
        tokens = [T.tokens(F.col(f)).alias(f) for f in self.fields]
        d = docs.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("long").alias(self.key), *tokens)
        lengths = [F.size(f).cast("long").alias(f"len_{f}") for f in self.fields]
        d.select(self.key, F.lit(generation).alias("generation"), *lengths).write.mode(mode).parquet(f"{self.path}/documents")
        new = self._read("documents", f"{self.key} long, generation int, {self._lengths}").where(F.col("generation") == generation)
        sums = [F.coalesce(F.sum(f"len_{f}"), F.lit(0)).alias(f"len_{f}") for f in self.fields]
        new.agg(F.lit(generation).alias("generation"), F.count(F.lit(1)).alias("n"), *sums).write.mode(mode).parquet(f"{self.path}/totals")
        bags = F.concat(*[_numbered(f, i) for i, f in enumerate(self.fields)])
        words = d.select(self.key, *lengths, F.explode(bags).alias("w")).select(self.key, *[f"len_{f}" for f in self.fields], "w.f", F.col("w.t").alias("term"))
        counts = [F.sum((F.col("f") == i).cast("int")).cast("int").alias(f"tf_{f}") for i, f in enumerate(self.fields)]
        p = words.groupBy("term", self.key, *[f"len_{f}" for f in self.fields]).agg(*counts).withColumn("bucket", self._bucket(F.col("term"))).withColumn("generation", F.lit(generation))
        p = p.select("term", self.key, "generation", *[f"tf_{f}" for f in self.fields], *[f"len_{f}" for f in self.fields], "bucket")
        p.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(4))).sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/postings")

    def generation(self) -> int:
        return self._read("totals", "generation int").agg(F.max("generation")).first()[0] or 0

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None) -> Bm25Index:
        """Indexes documents that are new or changed, and forgets the removed ones (a column of keys). The rest is not read again but for its keys."""
        gone = changed.select(F.col(self.key).cast("long").alias(self.key))
        if removed is not None:
            gone = gone.unionByName(removed.select(F.col(self.key).cast("long").alias(self.key)))
        old = self.documents().join(gone.distinct(), self.key, "left_semi").select(self.key, "generation", *[f"len_{f}" for f in self.fields])
        number = self.generation() + 1
        old.write.mode("append").parquet(f"{self.path}/stale")
        self._write(changed, number, "append")
        return self

    def _weighed(self, prefix: str, weights: Mapping[str, int]) -> Column:
        total = F.lit(0).cast("long")
        for f, w in weights.items():
            total = total + F.col(f"{prefix}_{f}") * w
        return total

    def search(self, query: Sequence[str], k: int = 10, weights: Mapping[str, int] | None = None) -> DataFrame:
        """(key, score): the k documents with the highest positive BM25 score; ties by key. A term that the query repeats counts as often. A query without terms finds nothing."""
        weights = weights or {f: 1 for f in self.fields}
        terms = list(dict.fromkeys(query))
        times = self.spark.createDataFrame([(t, query.count(t)) for t in terms], "term string, times int")
        buckets = [r[0] for r in times.select(self._bucket(F.col("term"))).distinct().collect()]  # at most a row a term
        found = self.postings().where(F.col("bucket").isin(buckets) & F.col("term").isin(terms or [""]))
        found = found.select("term", self.key, self._weighed("tf", weights).alias("tf"), self._weighed("len", weights).alias("length")).where("tf > 0")
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
        scored = found.join(F.broadcast(df), "term").join(F.broadcast(times), "term").crossJoin(F.broadcast(self.statistics(weights)))  # one row
        part = T.bm25_term(T.idf(F.col("n"), F.col("df")), F.col("tf"), F.col("length"), F.col("average")) * F.col("times")
        return scored.groupBy(self.key).agg(F.sum(part).alias("score")).where("score > 0").orderBy(F.col("score").desc(), self.key).limit(k)

    def document_frequency(self) -> DataFrame:
        """(term, df) of all terms."""
        return self.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _numbered(words: str, field: int) -> Column:
    return F.transform(words, lambda t: F.struct(F.lit(field).alias("f"), t.alias("t")))


_BUILT: dict[tuple[str, str], Bm25Index] = {}


def index_of(spark: SparkSession, name: str, docs: DataFrame, key: str, fields: Sequence[str], folder: str) -> Bm25Index:
    """The application's index of a named table, built when it is first asked for."""
    at = (spark.sparkContext.applicationId, name)
    if at not in _BUILT:
        _BUILT[at] = Bm25Index(spark, folder, key, fields).build(docs)
    return _BUILT[at]
