"""Queries of lexical and vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.operators.bm25_index import Bm25Index, index_of
from tessera.operators.sessions import numbered
from tessera.plans.registry import Tables, query
from tessera.storage import new_folder

#: Words that are common in the documents.
TERMS = ["thereat", "heed", "reth"]
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOKENS = rf"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOP}))".replace("{{", "{").replace("}}", "}")
TOK = TOKENS.replace("{0}", "text")
_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
_BM25 = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))"
_TERMS = ", ".join(f"('{t}')" for t in TERMS)


def _bm25_sql(bag: str, size: str, k: int) -> str:
    return f"""
WITH p AS (SELECT doc_id, term, sum(w) AS tf FROM ({bag}) WHERE term IN (SELECT * FROM (VALUES {_TERMS})) GROUP BY ALL),
l AS (SELECT doc_id, {size} AS length FROM documents), s AS (SELECT count(*) AS n, avg(length) AS average FROM l),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, round(sum({_IDF} * {_BM25}), 6) AS score FROM p JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY doc_id ORDER BY sum({_IDF} * {_BM25}) DESC, doc_id LIMIT {k}"""


FIELDS = ("source", "lang", "text")


def index(t: Tables) -> Bm25Index:
    """The stored index of documents, built by the first query of a session that needs it."""
    return index_of(t.spark, f"{t.dir}/documents", t.documents, "doc_id", FIELDS, new_folder(t.spark, "bm25"))


def _rounded(df, c="score", n=6):
    return df.withColumn(c, F.round(c, n))


@query("fn_tokenize", f"SELECT doc_id, {TOK} AS tokens FROM documents")
def fn_tokenize(t: Tables):
    return t.documents.select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query("agg_term_freq", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL")
def agg_term_freq(t: Tables):
    return R.postings(t.documents, "doc_id", {"text": 1})


@query(
    "agg_doc_freq",
    f"""WITH p AS (SELECT doc_id, unnest(list_distinct({TOK})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round({_IDF}, 6) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), n""",
)
def agg_doc_freq(t: Tables):
    i = index(t)
    n = i.statistics({"text": 1}).select("n")
    df = i.postings().where("tf_text > 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(T.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("agg_corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len({TOK})), 6) AS average FROM documents")
def agg_corpus_stats(t: Tables):
    return R.lengths(t.documents, "doc_id", {"text": 1}).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("length"), 6).alias("average"))


@query("fn_idf", f"SELECT lang, source, df, round({_IDF}, 6) AS idf FROM (SELECT lang, source, count(*) AS df FROM documents GROUP BY ALL), (SELECT count(*) AS n FROM documents)")
def fn_idf(t: Tables):
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    df = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("lang", "source", "df", F.round(T.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("fn_bm25_term", "SELECT l_orderkey, l_linenumber, round(1.5 * l_quantity * 2.2 / (l_quantity + 1.2 * (0.25 + 0.75 * l_linenumber / 4.0)), 6) AS score FROM lineitem")
def fn_bm25_term(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(T.bm25_term(F.lit(1.5), F.col("l_quantity"), F.col("l_linenumber"), F.lit(4.0)), 6).alias("score"))


@query("bm25_search", _bm25_sql(f"SELECT doc_id, unnest({TOK}) AS term, 1 AS w FROM documents", f"len({TOK})", 10))
def bm25_search(t: Tables):
    return _rounded(index(t).search(TERMS, 10, {"text": 1}))


@query("topk_bm25", _bm25_sql(f"SELECT doc_id, unnest({TOK}) AS term, 1 AS w FROM documents", f"len({TOK})", 3))
def topk_bm25(t: Tables):
    return _rounded(index(t).search(TERMS, 3, {"text": 1}))


@query(
    "bm25_field_weighted",
    _bm25_sql(
        " UNION ALL ".join(f"SELECT doc_id, unnest({TOKENS.replace('{0}', c)}) AS term, {w} AS w FROM documents" for c, w in (("source", 4), ("lang", 2), ("text", 1))),
        " + ".join(f"{w} * len({TOKENS.replace('{0}', c)})" for c, w in (("source", 4), ("lang", 2), ("text", 1))),
        10,
    ),
)
def bm25_field_weighted(t: Tables):
    return _rounded(index(t).search(TERMS, 10, {"source": 4, "lang": 2, "text": 1}))


_HALF = "(SELECT doc_id, source, lang, CASE WHEN doc_id % 5 = 0 THEN 'heed ' || source ELSE text END AS text FROM documents WHERE doc_id % 5 <> 1)"


@query("bm25_index_refresh", _bm25_sql(f"SELECT doc_id, unnest({TOK}) AS term, 1 AS w FROM {_HALF}", f"len({TOK})", 10).replace("AS length FROM documents", f"AS length FROM {_HALF}"))
def bm25_index_refresh(t: Tables):
    """A fifth of the documents changed, a fifth removed."""
    i = Bm25Index(t.spark, new_folder(t.spark, "bm25"), "doc_id", ["text"], 4).build(t.documents)
    new = t.documents.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("heed "), "source"))
    return _rounded(i.refresh(new, t.documents.where("doc_id % 5 = 1")).search(TERMS, 10))


@query("bm25_ad_hoc", _bm25_sql(f"SELECT doc_id, unnest({TOK}) AS term, 1 AS w FROM documents WHERE lang = 'en'", f"len({TOK})", 10).replace("AS length FROM documents", "AS length FROM documents WHERE lang = 'en'"))
def bm25_ad_hoc(t: Tables):
    """Without an index: one pass over documents that were filtered before."""
    return _rounded(R.bm25_search(t.documents.where("lang = 'en'"), "doc_id", TERMS, 10))


@query(
    "fn_field_weight",
    "SELECT doc_id, " + " + ".join(f"{w} * len({TOKENS.replace('{0}', c)})" for c, w in (("source", 4), ("lang", 2), ("text", 1))) + " AS length FROM documents",
)
def fn_field_weight(t: Tables):
    return R.lengths(t.documents, "doc_id", {"source": 4, "lang": 2, "text": 1})


_V = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _query_vector(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 0").select("embedding").first()[0]


@query("fn_cosine", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS sim FROM embeddings, {_V}")
def fn_cosine(t: Tables):
    return t.embeddings.select("vec_id", F.round(T.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _query_vector(t)])), 6).alias("sim"))


@query("vector_search", f"SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS sim FROM embeddings, {_V} ORDER BY greatest(0, list_cosine_similarity(embedding::DOUBLE[], q)) DESC, vec_id LIMIT 10")
def vector_search(t: Tables):
    return _rounded(R.vector_search(t.embeddings, "vec_id", "embedding", _query_vector(t), 10), "sim")


@query("topk_vector", f"SELECT vec_id FROM embeddings, {_V} ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 5")
def topk_vector(t: Tables):
    return R.vector_search(t.embeddings, "vec_id", "embedding", _query_vector(t), 5).select("vec_id")


@query("filter_min_score", f"SELECT * FROM (SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS sim FROM embeddings, {_V} ORDER BY sim DESC, vec_id LIMIT 50) WHERE sim >= 0.3")
def filter_min_score(t: Tables):
    return _rounded(R.vector_search(t.embeddings, "vec_id", "embedding", _query_vector(t), 50), "sim").where("sim >= 0.3")


@query("fn_rrf", "SELECT l_orderkey, l_linenumber, round(1.0 / (60 + l_linenumber) + CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1.0 / (60 + l_suppkey) END, 9) AS fused FROM lineitem")
def fn_rrf(t: Tables):
    second = F.when(F.col("l_returnflag") != "A", F.col("l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(T.rrf(F.col("l_linenumber"), second), 9).alias("fused"))


@query("win_rank_stamp", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def win_rank_stamp(t: Tables):
    return numbered(t.documents, ["source"], F.col("n_chars"), ["doc_id"], "rank", falling=True).select("doc_id", "source", "rank")


def _lists(t: Tables):
    """Ranked lists: the longest documents, the vectors nearest to the first, and all documents as listed."""
    long = t.documents.select(F.col("doc_id").alias("name"), F.col("n_chars").cast("double").alias("score")).orderBy(F.col("score").desc(), "name").limit(60).withColumn("strategy", F.lit("lexical"))
    near = R.vector_search(t.embeddings, "vec_id", "embedding", _query_vector(t), 60).select(F.col("vec_id").alias("name"), F.col("sim").alias("score")).withColumn("strategy", F.lit("vector"))
    all_ = t.documents.select(F.col("doc_id").alias("name"), F.lit(1.0).alias("score")).withColumn("strategy", F.lit("listed"))
    lists = R.ranked(long.unionByName(near), "strategy", "score", "name").unionByName(all_.withColumn("rank", F.lit(None).cast("int")))  # lists of 60 rows are ranked; listed rows need no rank
    return lists.withColumn("source", F.when(F.col("name") % 3 == 0, "local").otherwise("remote"))


_LISTS = f"""
WITH lists AS (
  (SELECT doc_id AS name, 'lexical' AS strategy, n_chars::DOUBLE AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60)
  UNION ALL (SELECT vec_id, 'vector', greatest(0, list_cosine_similarity(embedding::DOUBLE[], q)) AS score FROM embeddings, {_V} ORDER BY score DESC, vec_id LIMIT 60)
  UNION ALL SELECT doc_id, 'listed', 1.0 FROM documents),
r AS (SELECT *, CASE WHEN name % 3 = 0 THEN 'local' ELSE 'remote' END AS source, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, name) AS rank FROM lists),
g AS (SELECT name, min(source) AS source, max(rank) FILTER (strategy = 'lexical') AS lexical_rank, max(rank) FILTER (strategy = 'vector') AS vector_rank, max(score) FILTER (strategy = 'listed') AS own FROM r {{where}} GROUP BY name),
fused AS (SELECT name, source, lexical_rank, vector_rank, round(CASE WHEN lexical_rank IS NULL AND vector_rank IS NULL THEN own ELSE coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0) END, 9) AS score,
  CASE WHEN lexical_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'hybrid' WHEN lexical_rank IS NOT NULL THEN 'lexical' WHEN vector_rank IS NOT NULL THEN 'vector' ELSE 'listed' END AS match_type FROM g)
"""


def _fused(df):
    return _rounded(df.withColumns({c: F.col(c).cast("long") for c in ("lexical_rank", "vector_rank")}), "score", 9)


@query("join_fusion_full_outer", _LISTS.replace("{where}", "") + "SELECT * FROM fused")
def join_fusion_full_outer(t: Tables):
    return _fused(R.fuse(_lists(t)))


@query("filter_source", _LISTS.replace("{where}", "WHERE source = 'local'") + "SELECT * FROM fused")
def filter_source(t: Tables):
    return _fused(R.fuse(_lists(t).where("source = 'local'")))  # ranks were given before


@query("hybrid_search", _LISTS.replace("{where}", "WHERE strategy <> 'listed'") + "SELECT *, CASE WHEN source = 'local' THEN 0 ELSE 1 END AS tier FROM fused ORDER BY tier, score DESC, name LIMIT 20")
def hybrid_search(t: Tables):
    return R.tiered(_fused(R.fuse(_lists(t).where("strategy <> 'listed'"))), 20)


@query("hybrid_search_listed", _LISTS.replace("{where}", "") + "SELECT *, CASE WHEN source = 'local' THEN 0 ELSE 1 END AS tier FROM fused ORDER BY tier, score DESC, name LIMIT 20")
def hybrid_search_listed(t: Tables):
    return R.tiered(_fused(R.fuse(_lists(t))), 20)


@query("hybrid_rrf", _LISTS.replace("{where}", "WHERE strategy <> 'listed'") + "SELECT name, score, match_type FROM fused")
def hybrid_rrf(t: Tables):
    return _fused(R.fuse(_lists(t).where("strategy <> 'listed'"))).select("name", "score", "match_type")


@query(
    "multi_recall",
    f"""WITH l AS ((SELECT doc_id AS name, 'long' AS strategy, 'local' AS source, n_chars::DOUBLE AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60)
  UNION ALL (SELECT vec_id, 'vector', 'remote', greatest(0, list_cosine_similarity(embedding::DOUBLE[], q)) AS score FROM embeddings, {_V} ORDER BY score DESC, vec_id LIMIT 60)
  UNION ALL (SELECT doc_id, 'new', 'remote', doc_id::DOUBLE FROM documents ORDER BY doc_id DESC LIMIT 60)),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, name) AS rank FROM l),
g AS (SELECT name, min(source) AS source, round(sum(1.0 / (60 + rank)), 9) AS score, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE min(strategy) END AS match_type FROM r GROUP BY name)
SELECT *, CASE WHEN source = 'local' THEN 0 ELSE 1 END AS tier FROM g ORDER BY tier, score DESC, name LIMIT 100""",
)
def multi_recall(t: Tables):
    """Three recalls, of which none knows of the others."""
    recalls = [
        R.Recall("long", "local", lambda q, k: t.documents.select(F.col("doc_id").alias("name"), F.col("n_chars").alias("score")).orderBy(F.col("score").desc(), "name").limit(k)),
        R.Recall("vector", "remote", lambda q, k: R.vector_search(t.embeddings, "vec_id", "embedding", q, k).select(F.col("vec_id").alias("name"), F.col("sim").alias("score"))),
        R.Recall("new", "remote", lambda q, k: t.documents.select(F.col("doc_id").alias("name"), F.col("doc_id").alias("score")).orderBy(F.col("score").desc()).limit(k)),
    ]
    return _rounded(R.multi_recall(recalls, _query_vector(t), 100).select("name", "source", "score", "match_type", "tier"), "score", 9)


@query("topk_tiered", "SELECT doc_id AS name, CASE WHEN source = 'src0' THEN 'local' ELSE 'remote' END AS source, n_chars AS score, CASE WHEN source = 'src0' THEN 0 ELSE 1 END AS tier FROM documents ORDER BY tier, score DESC, name LIMIT 60")
def topk_tiered(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("name"), F.when(F.col("source") == "src0", "local").otherwise("remote").alias("source"), F.col("n_chars").alias("score"))
    return R.tiered(d, 60)


@query("enumerate_all", "SELECT doc_id AS name, 1.0::DOUBLE AS score FROM documents")
def enumerate_all(t: Tables):
    return t.documents.select(F.col("doc_id").alias("name"), F.lit(1.0).alias("score"))


@query("join_result_resolve", "SELECT vec_id, text IS NOT NULL AS found, coalesce(n_chars, 0) AS n_chars FROM embeddings LEFT JOIN documents ON doc_id = vec_id * 3")
def join_result_resolve(t: Tables):
    d = t.documents.select((F.col("doc_id")).alias("doc_id"), "n_chars", F.col("text").isNotNull().alias("has"))
    e = t.embeddings.select("vec_id", (F.col("vec_id") * 3).alias("doc_id"))
    return e.join(d, "doc_id", "left").select("vec_id", F.coalesce("has", F.lit(False)).alias("found"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
